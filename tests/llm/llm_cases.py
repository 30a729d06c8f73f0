"""Small documents that hold the awkward cases."""

import re

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ("size long, shard int, slot long, host string, lines string, kept boolean, removed string, names string, "
         "runs string, label long, _row long, taken long, text_hash long, _removed string, _taken string, _text string, "
         "_id string, _doc string, _hash string, _document string, document string, email string, ip string, _m_ip string, "
         "removed_text string, component long, hash string, id string, left string")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PROSE = ("the harbour lights went out one by one while the last ferry of the evening turned slowly towards the open "
         "water and nobody on the quay said a word until the sound of its engine was gone")


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empties, ties, repeated rows, a long text, and columns the operators use themselves."""
    rows = [
        (1, PROSE, "en", "a", 1), (2, PROSE, "en", "a", 1), (2, PROSE, "en", "a", 1), (3, None, None, None, None),
        (4, "", "en", "b", 0), (5, " \n\t ", "en", "b", 4), (None, PROSE, "en", None, 1), (None, None, None, None, None),
        (6, PROSE.replace("quay", "pier"), "en", "b", 1), (7, "word", "en", "c", 4), (7, "another text", "de", "c", 4),
        (8, ("x" * 70000) + " " + PROSE + "\n" + PROSE, "en", "a", 1), (9, "Ünïcode ☃ " * 40, "fr", "\U0001F600", 5),
        (10, "a\x00b\n" * 30, "fr", "￿", 5)]
    out = spark.createDataFrame(rows, SCHEMA)
    for part in EXTRA.split(", "):
        name, kind = part.split()
        out = out.selectExpr("*", f"CAST(NULL AS {kind}) AS {name}")
    return out


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall(text or "")
