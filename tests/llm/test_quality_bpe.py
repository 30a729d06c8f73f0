import hashlib
import random
import re
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from conftest import SMALL
from llm_cases import LOWER, awkward, nothing  # noqa: F401

from leakscope.llm import bpe, quality

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, special_tokens={},
                             mergeable_ranks=bpe.parse_ranks(bpe.load(PATH)))


def digest(encoding, text):
    ids = encoding.encode_ordinary(text)
    return (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(text.encode()).hexdigest())


def check_encoding(docs, encoding, **kw):
    rows = bpe.encode_documents(docs, PATH, public_tokenizers.PATTERN, **kw).collect()
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows)
    want = Counter((r["doc_id"], *digest(encoding, r["text"] or "")) for r in docs.select("doc_id", "text").collect())
    assert got == want


def test_encoding(spark, awkward, encoding):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    check_encoding(docs, encoding)
    check_encoding(docs, encoding, chunk=300, overlap=16)
    check_encoding(awkward, encoding)
    check_encoding(awkward, encoding, chunk=50, overlap=4)


def test_encoding_nothing(nothing, encoding):
    check_encoding(nothing, encoding)


def test_stitching_gives_the_pieces_of_the_whole():
    pattern = bpe._codec(bpe.load(PATH), public_tokenizers.PATTERN).pattern
    rng = random.Random(1)
    parts = ["a", "b", " ", "  ", "'", "l", "ll", "\n", "1", "23", "!", "é", "'re", " x", "\t", "日"]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 300)))
        stitcher, out = bpe.Stitcher(pattern), []
        for _, overlap, last, chunk in bpe.chunks(text, rng.choice([5, 20, 50]), rng.choice([1, 2, 3, 8])):
            out += stitcher.pieces(chunk, bpe.boundaries(pattern, chunk, last), overlap, last)
        assert out == pattern.findall(text)


def brute_figures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered))


def brute_verdicts(rows, fraction, at_least, least_left):
    def lines(text):
        return [" ".join(re.findall(r"[^\x20\x09-\x0D]+", x)).translate(LOWER) for x in (text or "").split("\n")]
    by, hosts = {}, {}
    for host, text in rows:
        hosts.setdefault(host, set()).add(text)
        for line in filter(None, lines(text)):
            by.setdefault((host, line), set()).add(text)
    often = {k for k, v in by.items() if len(v) > at_least and len(v) > fraction * len(hosts[k[0]])}
    out = []
    for host, text in rows:
        f = brute_figures(text)
        failed = f[0] < 20 or 100 * f[4] > 30 * f[0]
        gone = sum(len(x.split(" ")) for x in lines(text) if x and (host, x) in often)
        out.append((f, failed, gone, not failed and f[0] - gone >= least_left * f[0]))
    return out


@pytest.mark.parametrize("at_least, fraction, left", [(20, 0.2, 0.3), (1, 0.0, 0.9)])
def test_verdicts(spark, awkward, at_least, fraction, left):
    for docs in (spark.read.parquet(f"{SMALL}/documents.parquet"), awkward):
        rows = [(r["doc_id"], r["source"], r["text"]) for r in docs.select("doc_id", "source", "text").collect()]
        want = Counter((i, *v) for (i, _, _), v in zip(rows, brute_verdicts(
            [(h, t) for _, h, t in rows], fraction, at_least, left)))
        judged = quality.judge(docs, fraction=fraction, at_least=at_least, least_left=left)
        got = Counter((r["doc_id"], tuple(r[c] for c in quality.FIGURES), r["base_failed"], r["n_removed_words"], r["kept"])
                      for r in judged.collect())
        assert got == want


def test_clean_keeps_rows_and_columns(spark, awkward, nothing):
    prose = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen "
    rows = [(i, f"Read our  terms\n{prose}{' '.join(f'w{i}x{j}' for j in range(9))}\nEnd", "en", "h", 1) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = quality.clean(docs, at_least=3, fraction=0.5)
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.columns == docs.columns and len(got) == 5
    assert all(r["text"].startswith("one two") and "\n" not in r["text"] and r["n_chars"] == len(r["text"])
               for r in got.values())
    assert quality.clean(nothing).count() == 0
    assert quality.clean(awkward).columns == awkward.columns
    kept = {r["doc_id"] for r in quality.clean(awkward).select("doc_id").collect()}
    assert {1, 2, 6, None} <= kept and not kept & {3, 4, 5, 7}
