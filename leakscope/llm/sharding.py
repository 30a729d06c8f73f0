"""Consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``virtual_nodes`` points of a ring; a row hashes to a point and
belongs to the owner of the next virtual node clockwise.  A shard takes rows up
to its capacity; rows beyond it continue clockwise to the next virtual node
whose shard has room.

The sequential rule "first come, first served" becomes one aggregate: rows are
counted per arc (the stretch in front of a virtual node), and because only
counts matter, the walk along the ring is made once, over arcs, for all rows
together.  Its outcome is a list of rank ranges, "rows 0 to 811 of arc 17 go to
shard 3 from slot 40,210 on", of at most arcs + moves entries whatever the
number of rows.  One distributed ranking inside the arcs then gives every row
its shard and slot.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RING = 1 << 32


def ring_points(shards: int, virtual_nodes: int) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node in ring order; a shard's points do
    not depend on how many other shards there are."""
    state, points = 0x2545F4914F6CDD1D, []
    for shard in range(shards):
        for node in range(virtual_nodes):
            x = (state ^ (shard << 32 | node)) * 0x9E3779B97F4A7C15 % (1 << 64)
            x = (x ^ x >> 31) * 0xBF58476D1CE4E5B9 % (1 << 64)
            points.append(((x ^ x >> 29) >> 32, shard))
    return sorted(points)


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    """Rows each shard may take.  Without slack they sum to the rows exactly and are
    at most one apart, so that every shard ends up full."""
    if slack:
        most = -(-int(rows * (1 + slack) + 1) // shards)
        return [most] * shards
    low, more = divmod(rows, shards)
    return [low + (shard < more) for shard in range(shards)]


def walk(counts: dict[int, int], points: list[tuple[int, int]], room: list[int]
         ) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot) for all rows of all arcs.

    Rows at home come first; what overflows then continues clockwise, arc by arc
    in ring order.
    """
    room, filled, ranges, waiting = list(room), [0] * len(room), [], []

    def place(arc: int, begin: int, end: int, node: int) -> int:
        shard = points[node][1]
        taken = min(end - begin, room[shard])
        if taken:
            ranges.append((arc, begin, begin + taken, shard, filled[shard]))
            room[shard] -= taken
            filled[shard] += taken
        return begin + taken

    for arc in sorted(counts):
        begin = place(arc, 0, counts[arc], arc)
        if begin < counts[arc]:
            waiting.append((arc, begin, counts[arc]))
    for arc, begin, end in waiting:
        node = arc
        while begin < end:
            node = (node + 1) % len(points)
            begin = place(arc, begin, end, node)
    return ranges


def bounded_ring(rows: DataFrame, keys: list[Column], ties: list[Column], shards: int,
                 virtual_nodes: int = 64, slack: float = 0.0) -> DataFrame:
    """Adds ``shard`` and ``slot`` (gapless from 0 in each shard).

    ``keys`` decide the ring position, ``ties`` order the rows of one position;
    nulls among them hash and sort like any other value, and repeated rows take
    neighbouring places.  With ``slack`` 0 the shards' counts are at most one
    apart; with more, a shard holds at most (1 + slack) times the mean and fewer
    rows leave their home.  An empty table gives no rows.
    """
    points = ring_points(shards, virtual_nodes)
    ends = np.array([p for p, _ in points])

    @F.pandas_udf("int")
    def arc_of(position: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(ends, position.to_numpy()) % len(ends))

    placed = (rows.withColumn("_at", F.shiftrightunsigned(F.xxhash64(*keys), 32))
              .withColumn("_arc", arc_of("_at")))
    # one row per virtual node at most
    counts = {r["_arc"]: r["n"] for r in
              placed.groupBy("_arc").agg(F.count(F.lit(1)).alias("n")).collect()}
    ranges = walk(counts, points, capacities(sum(counts.values()), shards, slack))
    moves = rows.sparkSession.createDataFrame(
        ranges, "_arc int, _begin long, _end long, shard int, _slot long")
    ranked = placed.withColumn("_rank", F.row_number().over(
        Window.partitionBy("_arc").orderBy("_at", *ties)) - F.lit(1).cast("long"))
    inside = ((F.col("r._arc") == F.col("m._arc")) & (F.col("r._rank") >= F.col("m._begin"))
              & (F.col("r._rank") < F.col("m._end")))
    # bounded by the ring: its arcs plus the cuts made as shards fill up
    return (ranked.alias("r").join(F.broadcast(moves.alias("m")), inside)
            .select(*[F.col(f"r.{c}") for c in rows.columns], "m.shard",
                    (F.col("m._slot") + F.col("r._rank") - F.col("m._begin")).alias("slot")))


def shard_documents(docs: DataFrame, shards: int = 40, virtual_nodes: int = 64,
                    slack: float = 0.0) -> DataFrame:
    """Shard and slot of every document by count.

    A document without an id takes its ring position from its text.  A null text
    has no bytes; its checksum is that of the empty text.
    """
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = docs.select("doc_id", (F.length(text) + F.lit(16)).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"))
    keys = [F.col("doc_id"), F.when(F.col("doc_id").isNull(), F.col("text_crc32"))]
    return bounded_ring(rows, keys, [F.col("doc_id"), F.col("text_crc32"), F.col("size")],
                        shards, virtual_nodes, slack)
