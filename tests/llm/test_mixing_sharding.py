import zlib
from collections import Counter

import pytest
from conftest import SMALL
from llm_cases import awkward, nothing, words  # noqa: F401
from pyspark.sql import functions as F

from leakscope.llm import mixing, sharding
from leakscope.llm.queries import QUERIES


def brute_targets(sizes, share=1.5, most=2.0):
    """Rounds of resharing, as the contract words it."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(order)}
    total, full = share * sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in full]
        if not rest:
            return full
        level = (total - sum(full.values())) / sum(weight[s] for s in rest)
        above = [s for s in rest if weight[s] * level >= most * sizes[s]]
        if not above:
            return {**full, **{s: weight[s] * level for s in rest}}
        full.update({s: most * sizes[s] for s in above})


def check_mix(docs):
    rows = mixing.mix(docs, mixing.word_count(F.col("text")), keep=("doc_id", "source")).collect()
    sizes = Counter()
    for r in docs.select("source", "text").collect():
        sizes[r["source"]] += len(words(r["text"]))
    wanted = brute_targets(sizes)
    taken = Counter()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(wanted[r["source"]], abs=1e-6)
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for source, target in wanted.items():
        assert abs(taken[source] - target) < 1 + 1e-6
    again = mixing.mix(docs.repartition(5), mixing.word_count(F.col("text")), keep=("doc_id", "source")).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))


def test_mix(spark, awkward):
    check_mix(spark.read.parquet(f"{SMALL}/documents.parquet"))
    check_mix(awkward)


def test_mix_of_nothing(nothing):
    assert mixing.mix(nothing, mixing.word_count(F.col("text"))).count() == 0


def test_repeats_take_the_words(spark):
    docs = spark.createDataFrame([(1, " one two\nthree ", 7, 3), (2, "a b", 0, 2), (3, "", 0, 0), (4, "x", 2, 1)],
                                 "doc_id int, text string, taken long, size long")
    rows = mixing.repeat_documents(docs, F.col("taken"), F.col("size")).collect()
    got = Counter((r["doc_id"], r["text"]) for r in rows)
    assert got == {(1, " one two\nthree "): 2, (1, " one"): 1, (4, "x"): 2}
    assert sum(len(words(r["text"])) for r in rows) == 9


def check_shards(docs, shards=40):
    rows = sharding.shard_documents(docs, shards).collect()
    assert len(rows) == docs.count()
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    counts = [len(slots.get(s, ())) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    texts = Counter()
    for r in docs.select("doc_id", "text").collect():
        data = (r["text"] or "").encode()
        texts[r["doc_id"], len(data) + 16, zlib.crc32(data)] += 1
    assert texts == Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows)
    return {r["doc_id"]: r["shard"] for r in rows}


def test_shards(spark, awkward, nothing):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert check_shards(docs) == check_shards(docs.repartition(7))
    check_shards(awkward, 3)
    assert sharding.shard_documents(nothing).count() == 0


def test_growing_moves_few(spark):
    rows = spark.range(20000).select(F.col("id").alias("doc_id"))
    keys, ties = [F.col("doc_id")], [F.col("doc_id")]
    before = {r[0]: r[1] for r in sharding.bounded_ring(rows, keys, ties, 10, slack=0.1).select("doc_id", "shard").collect()}
    after = {r[0]: r[1] for r in sharding.bounded_ring(rows, keys, ties, 11, slack=0.1).select("doc_id", "shard").collect()}
    assert max(Counter(before.values()).values()) <= 2201
    moved = sum(before[k] != after[k] for k in before)
    assert moved < 0.3 * len(before)          # hashing by remainder would move ten in eleven


def test_walk_is_first_come_first_served():
    points = [(10, 0), (20, 1), (30, 2)]
    ranges = sharding.walk({0: 5, 1: 1, 2: 1}, points, [2, 2, 3])
    assert ranges == [(0, 0, 2, 0, 0), (1, 0, 1, 1, 0), (2, 0, 1, 2, 0), (0, 2, 3, 1, 1), (0, 3, 5, 2, 1)]


def test_registered_results(spark):
    out = QUERIES["op7_sharding"](spark, SMALL)
    assert [c for c, _ in out.dtypes] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert dict(out.dtypes)["slot"] == "bigint" and dict(out.dtypes)["shard"] == "int"


def ring_row_by_row(rows, shards, virtual_nodes=64):
    """(id, crc, size, shard, slot): home first, then each row that found no room walks on clockwise."""
    points = sharding.ring_points(shards, virtual_nodes)
    room, filled, out, homeless = sharding.capacities(len(rows), shards, 0.0), [0] * shards, Counter(), []

    def take(row, shard):
        out[(*row[1:], shard, filled[shard])] += 1
        filled[shard] += 1

    def home(at):
        return next((i for i, (p, _) in enumerate(points) if p >= at), 0)

    nulls_first = [(home(r[0]), r[0], *[x for v in r[1:] for x in (v is not None, v or 0)], r) for r in rows]
    for node, *_, row in sorted(nulls_first):
        shard = points[node][1]
        if filled[shard] < room[shard]:
            take(row, shard)
        else:
            homeless.append((node, row))
    for node, row in homeless:
        while filled[points[node][1]] >= room[points[node][1]]:
            node = (node + 1) % len(points)
        take(row, points[node][1])
    return out


@pytest.mark.parametrize("shards", [3, 40])
def test_ring_against_rows_placed_one_by_one(spark, awkward, shards):
    for docs in (awkward, spark.read.parquet(f"{SMALL}/documents.parquet")):
        text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
        rows = docs.select("doc_id", F.crc32(text).alias("crc"), (F.length(text) + 16).cast("long").alias("size"))
        at = F.shiftrightunsigned(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("crc"))), 32)
        want = ring_row_by_row([tuple(r) for r in rows.select(at, "doc_id", "crc", "size").collect()], shards)
        got = sharding.shard_documents(docs, shards).select("doc_id", "text_crc32", "size", "shard", "slot").collect()
        assert Counter(map(tuple, got)) == want


def test_one_more_shard_without_slack_moves_few(spark):
    rows = spark.range(20000).withColumnRenamed("id", "doc_id")
    placed = [dict(map(tuple, sharding.bounded_ring(rows, [F.col("doc_id")], [F.col("doc_id")], n).select("doc_id", "shard").collect()))
              for n in (40, 41)]
    moved = sum(placed[0][i] != placed[1][i] for i in placed[0])
    print("moved", moved)
    assert moved < 0.1 * 20000
