import hashlib
import random
import re
from collections import Counter

import numpy as np
from conftest import SMALL
from llm_cases import PROSE, awkward, nothing  # noqa: F401
from pyspark.sql import functions as F

from leakscope.llm import pii, suffixes
from leakscope.llm.queries import QUERIES


def brute_repeats(rows):
    first = {}
    for doc, text in rows:
        if doc is not None:
            for p in range(len(text) - 49):
                w = text[p:p + 50]
                first[w] = min(first.get(w, doc), doc)
    out = Counter()
    for doc, text in rows:
        gone = bytearray(len(text))
        for p in range(len(text) - 49 if doc is not None else 0):
            if first[text[p:p + 50]] < doc:
                gone[p:p + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(text, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[doc, len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def check_repeats(docs):
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.select("doc_id", "text").collect()]
    assert Counter(map(tuple, suffixes.remove_repeats(docs).collect())) == brute_repeats(rows)


def test_repeats(spark, awkward, nothing):
    check_repeats(spark.read.parquet(f"{SMALL}/documents.parquet"))
    check_repeats(awkward)
    assert suffixes.remove_repeats(nothing).count() == 0


def test_different_texts_of_one_id(spark):
    """Each row of an id loses what a smaller document has, at its own places only."""
    other = "".join(random.Random(9).choice("qwrtz pl") for _ in range(185))
    rows = [(1, PROSE), (2, PROSE + " and then a tail"), (2, other), (2, other), (3, other[:90] + PROSE[:60]), (3, "x" + PROSE)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffixes.remove_repeats(docs).collect())
    n = len(PROSE)
    assert got == [(1, n, 0), (2, 185, 0), (2, 185, 0), (2, n + 16, n), (3, 150, 150), (3, n + 1, n)]


def test_overlapping_passages(spark):
    rng = random.Random(2)
    pool = ["".join(rng.choice("ab c") for _ in range(rng.randint(30, 160))) for _ in range(12)]
    rows = [(rng.randint(0, 40), "".join(rng.choice(pool)[rng.randint(0, 20):] for _ in range(rng.randint(0, 5))))
            for _ in range(80)]
    rows += [(50, "a" * 400), (51, "b" + "a" * 70 + "c"), (52, "é" * 60), (53, "xé" * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = docs.groupBy("doc_id").agg(F.min("text").alias("text"))
    check_repeats(texts)


def test_long_texts_are_cut_into_units(spark, monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(suffixes, "SLICE", 512)
    text = (PROSE * 40).encode()
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": [text.decode()]})
    whole = {n for n in suffixes.window_names(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0].tolist()}
    parts = list(suffixes._units([batch]))
    assert len(parts) > 5
    found = set()
    for _, data, offsets, _, place in parts:
        names, start, count, _ = suffixes.window_names(data, offsets)
        found |= set(names.tolist())
        assert place[0] + offsets[-1] <= len(text)
    assert found == whole


def test_suffix_order_and_common_prefixes():
    rng = random.Random(3)
    for alphabet in (b"a", b"ab\0"):
        for _ in range(40):
            pieces = list({bytes(rng.choice(alphabet) for _ in range(rng.randint(50, 90))) for _ in range(8)})
            data = np.frombuffer(b"".join(pieces), np.uint8)
            sizes = np.array([len(p) for p in pieces])
            ends = np.cumsum(sizes)
            stretch = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(data)) - (ends - sizes)[stretch]
            limits = ends[stretch] - np.arange(len(data))
            order, tied = suffixes.suffix_order(data, stretch, limits)
            assert sorted(order.tolist()) == np.flatnonzero(limits >= 50).tolist()
            found = [data[i:i + min(limits[i], 56)].tobytes() for i in order]
            assert found == sorted(found) and tied.tolist() == [False] + [a == b for a, b in zip(found, found[1:])]
            shared = suffixes.common_prefixes(data, order, tied, limits, place, stretch)
            for a, b, n in zip(found, found[1:], shared[1:]):
                assert a[:n] == b[:n] and (n == 50 or a[n] != b[n])


def test_shards_merge_to_the_same(monkeypatch):
    rng = random.Random(4)
    pool = ["".join(rng.choice("abc") for _ in range(120)).encode() for _ in range(6)]
    pieces = list({p[i:i + rng.randint(50, 70)] for p in pool for i in range(0, 50, 3)})
    docs = np.array([rng.randint(0, 9) for _ in pieces])
    one = suffixes.Shard(pieces)
    whole = one.per_window(one.least(docs))
    parts = [suffixes.Shard(pieces[i::3]) for i in range(3)]
    merged = suffixes.merge_shards(parts, [s.least(docs[i::3]) for i, s in enumerate(parts)])
    first = np.concatenate([[0], np.cumsum([len(p) - 49 for p in pieces])])
    for i, (shard, least) in enumerate(zip(parts, merged)):
        own = np.concatenate([whole[first[k]:first[k + 1]] for k in range(i, len(pieces), 3)])
        assert shard.per_window(least).tolist() == own.tolist()


def test_stretches_alone_with_their_name_are_not_sorted(monkeypatch):
    """Equal stretches settle by their smallest document; only namesakes go to suffix arrays."""
    import pyarrow as pa
    sorted_pieces = []
    whole = suffixes.Shard
    monkeypatch.setattr(suffixes, "Shard", lambda pieces: sorted_pieces.extend(pieces) or whole(pieces))
    rng = random.Random(6)
    text = "".join(rng.choice("abcdefgh ") for _ in range(400)).encode()
    names, starts, counts, _ = suffixes.window_names(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    rows = [(doc, s, c, text[s:s + c + 49]) for s, c in zip(starts.tolist(), counts.tolist()) for doc in (3, 5, 8)]
    rows.append((2, 0, 1, rows[0][3][:50]))   # the first window of the first stretch, whose namesake it is

    def stretches(rows):
        docs, places, widths, pieces = zip(*rows)
        packed = [suffixes.ta.pack_ints(np.array(c, np.int64)) for c in (docs, [0] * len(docs), places, widths)]
        return pa.table({"bucket": pa.array([0], pa.int32()), "settled": [False], **{
            n: pa.array([p], pa.binary()) for n, p in zip(("docs", "variants", "starts", "counts"), packed)},
            "bytes": pa.array([suffixes.ta.pack_bytes(b"".join(pieces))], pa.binary())})

    found = suffixes.repeated_windows(stretches(rows)).to_pylist()
    gone = {(r["doc_id"], w) for r in found for w in range(r["start"], r["stop"])}
    assert gone == {(doc, w) for doc in (5, 8) for w in range(351)} | {(3, 0)}
    assert sorted(sorted_pieces) == sorted({rows[0][3], rows[-1][3]})


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        value = int(c) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def brute_base(text):
    def holds(kind, value):
        digits = re.sub("[^0-9]", "", value)
        return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in value.split(".")),
                "card": lambda: 16 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 8 <= len(digits) <= 15}[kind]()
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if holds(k, m.group())] for k, p in BASE.items()}


def check_base(docs):
    for r in pii.find(docs.select("doc_id", "text")).collect():
        want = brute_base(r["text"])
        assert {k: [(s["start"], s["end"]) for s in r[k]] for k in BASE} == want, r["text"]


def test_base_spans(spark, awkward):
    check_base(spark.read.parquet(f"{SMALL}/documents.parquet"))
    check_base(awkward)
    rng = random.Random(6)
    parts = ["a", "é", "☃", "b.c", "@", "x@y.z", ".", "1.2.3.4", "255", "256", "0", "4111 1111 1111 1111", "+1 (555) 010-9999",
             "-", " ", "+", "(", "12", "4111111111111111", "%", "\n", "\U0001F600", "1"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))) for i in range(1500)]
    check_base(spark.createDataFrame(rows, "doc_id long, text string"))


def test_long_runs_are_read_once(spark):
    rows = [(1, "a" * 200_000), (2, "1" * 200_000), (3, "+1" + "(" * 100_000), (4, "x@" + "a." * 50_000), (5, "1.2." * 50_000)]
    assert pii.find(spark.createDataFrame(rows, "doc_id long, text string")).count() == 5


def test_added_kinds(spark):
    rows = [(1, "Bank account IBAN DE89 3704 0044 0532 0130 00 please"), (2, "DE89 3704 0044 0532 0130 01"),
            (3, "his social security number is 123-45-6789."), (4, "part 123-45-6789 of the list"), (5, "GB82WEST12345698765432")]
    got = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [s["value"] for s in got[1]["iban"]] == ["DE89 3704 0044 0532 0130 00"] and got[1]["iban"][0]["score"] == 1.0
    assert not got[2]["iban"] and [s["value"] for s in got[5]["iban"]] == ["GB82WEST12345698765432"]
    assert [s["value"] for s in got[3]["ssn"]] == ["123-45-6789"] and not got[4]["ssn"]
    assert got[5]["iban"][0]["score"] == 0.9


def test_query_digest(spark, nothing):
    out = {r["doc_id"]: r for r in QUERIES["op8_pii"](spark, SMALL).collect()}
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect():
        base = brute_base(r["text"])
        text = ",".join(f"{k}:{a}:{b}" for k in BASE for a, b in base[k])
        row = out[r["doc_id"]]
        assert row["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [row[f"n_{k}"] for k in BASE] == [len(base[k]) for k in BASE]
        assert set(filter(None, text.split(","))) <= set(row["spans"].split(","))
    assert pii.find(nothing).count() == 0


def test_account_numbers_and_context_words(spark):
    """An account number ends at its country's length; context words are whole words, in four languages."""
    texts = ["pay to BE68 5390 0754 7034 NOW", "DE89370400440532013000", "DE89 3704 0044 0532 0130 00 and more", "BE68 5390 0754 7035 NOW",
             "his social number is 123-45-6789", "the socialite 123-45-6789", "número de seguridad 123-45-6789"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sorted(pii.find(docs).collect(), key=lambda r: r["doc_id"])
    assert [[v["value"] for v in r["iban"]] for r in rows[:4]] == [
        ["BE68 5390 0754 7034"], ["DE89370400440532013000"], ["DE89 3704 0044 0532 0130 00"], []]
    assert [len(r["ssn"]) for r in rows[4:]] == [1, 0, 1] and rows[4]["ssn"][0]["score"] == 0.7


def test_columns_with_the_name_of_a_kind_stay(spark):
    docs = spark.createDataFrame([(1, "write to a@b.org", "mine", "own")], "doc_id long, text string, email string, _text string")
    row = pii.find(docs).collect()[0]
    assert (row["given_email"], row["given__text"]) == ("mine", "own") and [x["value"] for x in row["email"]] == ["a@b.org"]
