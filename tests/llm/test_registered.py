"""Registered queries against SQL where there is some, and the pipeline stage by stage."""

from collections import Counter

import duckdb
import public_tokenizers
import pytest
import tiktoken
from conftest import SMALL
from llm_cases import awkward, nothing, words  # noqa: F401
from pyspark.sql import functions as F

import corpus_pipeline
from leakscope.llm import bpe
from leakscope.llm.queries import ORACLE, QUERIES
from test_lines_neardup import brute_components, brute_lines
from test_quality_bpe import brute_verdicts, digest


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        con.sql(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    want = con.sql(ORACLE[name])
    got = QUERIES[name](spark, SMALL)
    assert got.columns == want.columns
    assert Counter(map(tuple, got.collect())) == Counter(want.fetchall())


def rows_of(df):
    return [(r["doc_id"], r["source"], r["text"]) for r in df.select("doc_id", "source", "text").collect()]


def check_stages(spark, docs):
    """Every stage on what its predecessor kept, against brute force on the same rows."""
    stages = dict(corpus_pipeline.STAGES)

    def step(name, df):
        out = stages[name](spark, df, SMALL)
        assert out.columns == df.columns
        return spark.createDataFrame(out.collect(), df.schema)

    before = rows_of(docs)
    kept = step("quality_rules", docs)
    verdicts = brute_verdicts([(h, t) for _, h, t in before], 0.2, 20, 0.3)
    assert Counter(r[0] for r in rows_of(kept)) == Counter(r[0] for r, v in zip(before, verdicts) if v[3])
    before = rows_of(kept)
    lines = step("line_dedup", kept)
    gone = brute_lines([(d, t) for d, _, t in before], 2, 10)
    want = Counter()
    for d, _, t in before:
        lost = {g[0] for g in gone.get((d, t), ())}
        left = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in lost)
        if not lost or words(left) and len(words(left)) >= 0.1 * len(words(t)):
            want[d, left] += 1
    assert Counter((d, t) for d, _, t in rows_of(lines)) == want
    near = step("near_dedup", lines)
    components = brute_components([(d, t) for d, _, t in rows_of(lines)], 5, 80)
    assert Counter(r[0] for r in rows_of(near)) == Counter({k[0]: n for k, n in components.items() if k[3]})
    mixed = step("source_mix", near)
    total = sum(len(words(t)) for _, _, t in rows_of(near))
    assert abs(sum(len(words(t)) for _, _, t in rows_of(mixed)) - 1.5 * total) <= 1 + len({r[1] for r in rows_of(near)})
    encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, special_tokens={}, mergeable_ranks=bpe.parse_ranks(
        bpe.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))))
    last = stages["byte_bpe"](spark, mixed, SMALL).collect()
    assert Counter(map(tuple, last)) == Counter((d, *digest(encoding, t or "")) for d, _, t in rows_of(mixed))
    return last


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").filter("doc_id < 120")
    check_stages(spark, docs)


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 100


def test_stages_on_awkward_documents(spark, awkward, nothing):
    for docs in (awkward, nothing):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SMALL)
            assert out.columns == docs.columns, name
            docs = spark.createDataFrame(out.collect(), docs.schema)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == docs.count()


def test_boilerplate_of_a_large_source_goes(spark):
    """A line in a tenth of a source's texts, and one in fewer than the limit."""
    def own(i):
        return " ".join(f"w{i}x{k}" for k in range(30))

    common, rare = "subscribe to our weekly letter for more stories", "a line that only a few texts have"
    rows = [(i, own(i) + ("\n" + common if i < 40 else "") + ("\n" + rare if 40 <= i < 60 else ""), "web") for i in range(400)]
    rows += [(1000 + i, f"{common}\none two three {i}\n" + "\n".join([common.upper()] * 2), "web") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["text"] for r in dict(corpus_pipeline.STAGES)["quality_rules"](spark, docs, SMALL).collect()}
    assert got == {i: own(i) + ("\n" + rare if 40 <= i < 60 else "") for i in range(400)}
