"""License scan against plain searches."""

import re

import pytest
from llm_cases import PROSE, SCHEMA, awkward, nothing  # noqa: F401

from leakscope.llm import licenses
from leakscope.llm.licenses import BASE, NOTICES

SPLIT = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
GPL = next(t.text for t in NOTICES if t.label == "gpl-3" and t.text.startswith("you can"))


def doc_words(text):
    return SPLIT.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_base(text):
    found = doc_words(text)
    places = sorted((i, t.label) for t in BASE for i in range(len(found)) if found[i:i + len(t.text.split())] == t.text.split())
    return (len(found), len(places), places[0][0] if places else None, places[-1][0] if places else None,
            ",".join(sorted({label for _, label in places})))


def scan(spark, texts):
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    return [r for r in sorted(licenses.report(docs).collect(), key=lambda r: r["doc_id"])]


def test_base_places(spark):
    texts = ["Released under the MIT License.", "UNDER-THE\nmit  license under the mit license", "cc by nc cc by nc by nc",
             "Apache License, Version 2.0", "apache license version 20", "under the emit license", "KCC by-nc", "cc by ncé",
             PROSE + " under the mit license " + PROSE, "cc by", None, "", "cc " * 50 + "by nc", "\x00cc\x00by\x7fnc"]
    for text, row in zip(texts, scan(spark, texts)):
        assert (row["n_words"], row["n_base"], row["first_word"], row["last_word"], row["base_labels"]) == brute_base(text), text
        assert (row["score"] == 1.0) or not row["n_base"]


def test_notices_with_changed_words(spark):
    said = GPL.split()
    texts = [GPL, " ".join(said[:12] + ["indeed"] + said[12:]), " ".join(said[:12] + said[13:]), " ".join(said[:10]),
             " ".join(reversed(said)), PROSE + "\n" + GPL.upper() + "\n" + PROSE, GPL + " " + GPL]
    rows = scan(spark, texts)
    assert [r["labels"] for r in rows] == ["gpl-3", "gpl-3", "gpl-3", "", "", "gpl-3", "gpl-3"]
    assert [r["score"] for r in rows][:1] == [1.0] and 0.8 <= rows[1]["score"] < 1 and 0 < rows[3]["score"] < 0.8
    assert rows[4]["score"] == 0 and all(r["base_labels"] == "" for r in rows)


def test_every_repeat_is_a_span(spark):
    docs = spark.createDataFrame([(1, " between ".join([GPL] * 3))], "doc_id long, text string")
    spans = licenses.spans(docs).filter("label = 'gpl-3' AND coverage = 1.0").collect()
    n = len(GPL.split()) + 1
    assert sorted(r["start"] for r in spans) == [0, n, 2 * n]


def test_awkward_documents(awkward, nothing):
    assert licenses.report(nothing).count() == 0
    want = sorted((str(r["doc_id"]), *map(str, brute_base(r["text"]))) for r in awkward.collect())
    got = sorted(tuple(str(r[c]) for c in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"))
                 for r in licenses.report(awkward).collect())
    assert got == want


def test_short_exact_template(spark):
    with pytest.raises(ValueError):
        licenses.report(spark.createDataFrame([], SCHEMA), (licenses.Template("x", "two words", True),))
