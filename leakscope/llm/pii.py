"""Personal data: patterns propose spans, validators confirm them, context adjusts a score.

Built-in functions only.  A pattern is applied twice, to extract its matches and
to split the text at them; the lengths of the pieces give every match's place,
and the ends of the pieces next to it are its context.

The base patterns are written so that a long run of one character class is read
once: a match may only begin where its run begins or where the last match ended,
and repetitions never give back what they took.  Neither changes what is found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")

# The length of an account number by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU"}

PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])(?:" + "|".join(
        rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{length - 4}}}"
        for length, countries in IBAN_LENGTHS.items()) + r")(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}

# A quick look that a text without the kind fails.
NEEDS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]",
         "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}", "ssn": r"[0-9]-[0-9]{2}-[0-9]"}

# Scores before context, words that speak for a kind, and what a
# span needs to be reported.  The base kinds are always reported.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
CONTEXT = {
    "email": ("mail", "email", "e-mail", "contact", "write", "kontakt", "courriel", "correo"),
    "ip": ("ip", "address", "host", "server", "adresse", "serveur", "servidor"),
    "card": ("card", "visa", "credit", "payment", "karte", "kreditkarte", "carte", "tarjeta"),
    "phone": ("phone", "telephone", "call", "tel", "mobile", "fax", "telefon", "anruf", "téléphone", "teléfono", "móvil"),
    "iban": ("iban", "bank", "account", "konto", "compte", "banque", "cuenta", "banco"),
    "ssn": ("ssn", "social", "security", "sozialversicherung", "sécurité", "seguridad"),
}
CONTEXT_BONUS = 0.4
ACCEPT = 0.5
NEAR = 40


def _matches(text: Column, kind: str) -> Column:
    return F.when(F.regexp_like(text, F.lit(NEEDS[kind])),
                  F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))).otherwise(
        F.array().cast("array<string>"))


def _placed(found: str, gaps: str) -> Column:
    """start, end (code points, end exclusive), value and nearby text of every match."""
    steps = F.zip_with(F.slice(gaps, 1, F.size(found)), F.col(found),
                       lambda gap, value: F.struct(F.length(gap).alias("gap"), F.length(value).alias("len")))
    starts = F.aggregate(
        steps, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda acc, x: F.struct((acc["at"] + x["gap"] + x["len"]).alias("at"),
                                F.array_append(acc["out"], acc["at"] + x["gap"]).alias("out")),
        lambda acc: acc["out"])
    near = F.transform(F.col(found), lambda value, i: F.lower(F.concat(
        F.right(F.get(F.col(gaps), i), F.lit(NEAR)), F.lit(" "), F.left(F.get(F.col(gaps), i + 1), F.lit(NEAR)))))
    return F.transform(F.arrays_zip(starts.alias("start"), F.col(found).alias("value"), near.alias("near")),
                       lambda x: F.struct(x["start"].alias("start"),
                                          (x["start"] + F.length(x["value"])).alias("end"),
                                          x["value"].alias("value"), x["near"].alias("near")))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Checksum of card numbers."""
    return F.call_function("luhn_check", digits)


def mod97(value: Column) -> Column:
    """Checksum of account numbers: country and check digits moved to the end,
    letters as two digits, remainder 1."""
    plain = F.regexp_replace(value, " ", "")
    turned = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))
    rest = F.aggregate(
        F.transform(F.sequence(F.lit(1), F.length(turned)), lambda i: F.ascii(F.substr(turned, i, F.lit(1)))),
        F.lit(0), lambda acc, code: F.when(code < 58, (acc * 10 + code - 48) % 97).otherwise(
            (acc * 100 + code - 55) % 97))
    return F.length(plain).between(15, 34) & (rest == 1)


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return F.regexp_like(value, F.lit(rf"^{part}(?:\.{part}){{3}}$"))
    if kind == "card":
        digits = _digits(value)
        return F.length(digits).between(16, 19) & luhn(digits)
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    if kind == "iban":
        return mod97(value)
    return F.lit(True)


def _score(kind: str, near: Column) -> Column:
    word = r"(?U)\b(?:" + "|".join(CONTEXT[kind]) + r")s?\b"
    return F.round(F.least(F.lit(1.0), F.lit(SCORES[kind]) + F.when(
        F.regexp_like(near, F.lit(word)), F.lit(CONTEXT_BONUS)).otherwise(0.0)), 2)


def _spans(kind: str) -> Column:
    """Confirmed and scored spans of a kind from its matches and the text around them."""
    valid = F.filter(_placed(f"_m_{kind}", f"_g_{kind}"), lambda x: _valid(kind, x["value"]))
    scored = F.transform(valid, lambda x: F.struct(
        x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"),
        _score(kind, x["near"]).alias("score")))
    if kind not in BASE_KINDS:
        scored = F.filter(scored, lambda x: x["score"] >= ACCEPT)
    empty = F.array().cast("array<struct<start:int,end:int,value:string,score:double>>")
    return F.when(F.size(f"_m_{kind}") > 0, scored).otherwise(empty)


def find(docs: DataFrame, text: str = "text", kinds: tuple[str, ...] = tuple(PATTERNS)) -> DataFrame:
    """Adds one column per kind: array of (start, end, value, score), in order.

    A null text is empty and has empty arrays.  Extra columns stay as they are; one that
    has a kind's name comes out as ``given_<name>``.
    """
    own = {"_text", *kinds, *[f"_{c}_{k}" for c in "mg" for k in kinds]}
    docs = docs.withColumnsRenamed({c: f"given_{c}" for c in docs.columns if c.lower() in own and c != text})
    out = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    out = out.withColumns({f"_m_{k}": _matches(F.col("_text"), k) for k in kinds})
    out = out.withColumns({f"_g_{k}": F.when(F.size(f"_m_{k}") > 0, F.split("_text", PATTERNS[k], -1))
                           for k in kinds})
    out = out.withColumns({k: _spans(k) for k in kinds})
    return out.drop("_text", *[f"_{c}_{k}" for c in "mg" for k in kinds])


def joined(kinds: tuple[str, ...], scored: bool = False) -> Column:
    """kind:start:end, and the score if asked for, of all spans, by kind in the order given, then by start."""
    def named(kind: str) -> Column:
        return F.transform(F.col(kind), lambda x: F.concat_ws(
            ":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string"),
            *([x["score"].cast("string")] if scored else [])))

    return F.array_join(F.concat(*[named(k) for k in kinds]), ",")
