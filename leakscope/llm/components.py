"""Connected components of a distributed edge list, and of nodes that meet in buckets."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope.session import materialize, release

BLOCK = 1024        # members of a bucket that a task compares with as many others
PAIRS = 2048        # pairs confirmed at once, after which connected ones are sorted out again
PAIR_BYTES = 16 << 20

# Traits of many nodes as arrays, the pairs two sets of traits allow, the pairs contents confirm.
Unpack = Callable[[pa.StructArray], list[np.ndarray]]
Allowed = Callable[[list[np.ndarray], list[np.ndarray]], np.ndarray]
Confirm = Callable[[pa.Array, pa.Array], np.ndarray]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); the component is its smallest node.

    Every round a node takes the smallest label among its own and its
    neighbours', then the label its label has: chains halve, stars settle in one
    round.  Labels and edges stay distributed; the driver sees one count a round.
    Messages are minimised before they are shuffled, and a hub's edges are
    the large side of a plain join, which Spark splits when it is skewed.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label"))
                         .withColumnRenamed("a", "node"), "labels")
    while True:
        told = (both.join(labels, F.col("b") == F.col("node"))
                .groupBy("a").agg(F.min("label").alias("heard")))
        heard = (labels.join(told, F.col("node") == F.col("a"), "left")
                 .select("node", F.col("label").alias("old"), F.least("label", "heard").alias("label")))
        heard = materialize(heard, "labels")
        release(labels)
        if heard.filter("label <> old").isEmpty():
            release(both)
            return heard.select("node", F.col("label").alias("component"))
        jump = heard.select(F.col("node").alias("label"), F.col("label").alias("next"))
        labels = materialize(heard.join(jump, "label", "left")
                             .select("node", F.coalesce("next", "label").alias("label")), "labels")
        release(heard)


def settle(members: DataFrame, traits: DataFrame, contents: DataFrame, near: Callable[[Column, Column], Column],
           unpack: Unpack, allowed: Allowed, confirm: Confirm) -> DataFrame:
    """(node, component) of nodes linked by some pair that shares a bucket.

    ``members`` (bucket, node) lists buckets of two nodes or more; ``traits`` (node,
    trait) has a struct that is enough to rule pairs out, and ``contents`` (node,
    content) what decides: ``confirm`` takes the contents of many pairs.  ``near``
    is the test of traits in SQL; ``unpack`` gives traits as arrays and ``allowed``
    is the same test for all pairs of two sets of them.

    First every bucket links its members to its smallest one only.  A bucket whose
    members are then in one component is settled.  In the others all pairs of
    different components are looked at, in blocks of bounded size inside a
    task: traits decide which members matter at all, contents then confirm
    pairs, skipping those that are connected by then.  So no pair
    that could still join two components is left out, a group around one original
    costs a pair each, and the pairs of a group are never rows.
    """
    stars = (members.join(members.groupBy("bucket").agg(F.min("node").alias("a")), "bucket")
             .filter("a <> node").select("a", F.col("node").alias("b")).distinct())
    x, y = (traits.withColumnsRenamed({"node": n, "trait": f"_{n}"}) for n in "ab")
    close = materialize(stars.join(x, "a").join(y, "b").filter(near(F.col("_a"), F.col("_b"))).select("a", "b"), "stars")
    left, right = (contents.withColumnsRenamed({"node": n, "content": f"_{n}"}) for n in "ab")
    links = materialize(close.join(left, "a").join(right, "b").select("a", "b", "_a", "_b")
                        .mapInArrow(_confirmed(confirm), "a long, b long"), "links")
    release(close)
    labels = components(links)
    open_rows = _open_members(members, labels, traits, unpack, allowed)
    keys = ["bucket", "low", "high"]
    more = materialize(
        open_rows.join(traits, "node").join(contents, "node")
        .repartition(_tasks(open_rows), *keys).sortWithinPartitions(*keys)
        .select(*keys, "block", "node", "label", "trait", "content")
        .mapInArrow(_link_blocks(unpack, allowed, confirm), "a long, b long"), "links")
    release(open_rows)
    if not more.isEmpty():
        labels = components(links.union(more))
    release(links, more)
    return labels


def _tasks(df: DataFrame) -> int:
    """Tasks for rows that are small but costly, which must not be packed together for their size."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _confirmed(confirm: Confirm) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = confirm(batch.column("_a"), batch.column("_b"))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good))

    return run


def _open_members(members: DataFrame, labels: DataFrame, traits: DataFrame,
                  unpack: Unpack, allowed: Allowed) -> DataFrame:
    """Members of unsettled buckets, by pair of blocks, that may be linked to another component."""
    placed = materialize(
        members.join(labels, "node", "left").withColumn("label", F.coalesce("component", "node"))
        .drop("component"), "placed")
    unsettled = (placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("_l"),
                                              F.max("label").alias("_h"))
                 .filter("_l <> _h").select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    rows = (placed.join(unsettled, "bucket")
            .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
            .withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("bucket", F.least("block", "_with").alias("low"), F.greatest("block", "_with").alias("high"),
                    "block", "node", "label"))
    keys = ["bucket", "low", "high"]
    out = materialize(
        rows.join(traits, "node").repartition(_tasks(rows), *keys).sortWithinPartitions(*keys)
        .select(*keys, "block", "node", "label", "trait")
        .mapInArrow(_meeting(unpack, allowed), "bucket long, low int, high int, block int, node long, label long"), "open")
    release(placed)
    return out


class _Groups:
    """Whole runs of equal (bucket, low, high) in sorted rows, with their columns as arrays."""

    def __init__(self, table: pa.Table, unpack: Unpack) -> None:
        self.table = table
        keys = [table.column(c).to_numpy() for c in ("bucket", "low", "high")]
        new = np.ones(table.num_rows, dtype=bool)
        new[1:] = False
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        self.starts = np.flatnonzero(new)
        self.low, self.high = keys[1:]
        self.block, self.label = (table.column(c).to_numpy() for c in ("block", "label"))
        self.unpack = unpack

    def open_pairs(self, allowed: Allowed) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of each group's allowed pairs of different components; pairs of one block
        are the business of the group in which the block meets itself."""
        traits = self.unpack(self.table.column("trait").combine_chunks())
        label, block = self.label, self.block
        for a, b in zip(self.starts.tolist(), [*self.starts[1:].tolist(), len(label)]):
            if b - a < 2 or (label[a:b] == label[a]).all():
                continue
            low, high = self.low[a], self.high[a]
            first = second = np.arange(a, b)
            if low != high:
                first, second = a + np.flatnonzero(block[a:b] == low), a + np.flatnonzero(block[a:b] == high)
            good = label[first][:, None] != label[second][None, :]
            good &= allowed([t[first] for t in traits], [t[second] for t in traits])
            if low == high:
                good = np.triu(good, 1)
            i, j = np.nonzero(good)
            if len(i):
                yield first[i], second[j]


def _runs(batches: Iterable[pa.RecordBatch], unpack: Unpack) -> Iterator[_Groups]:
    """All groups, whatever the batches' borders: the last one waits for what follows."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        if not table.num_rows:
            continue
        last = int(_Groups(table, unpack).starts[-1])
        if last:
            yield _Groups(table.slice(0, last).combine_chunks(), unpack)
        held = table.slice(last)
    if held is not None and held.num_rows:
        yield _Groups(held.combine_chunks(), unpack)


def _meeting(unpack: Unpack, allowed: Allowed) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups in _runs(batches, unpack):
            rows = [np.unique(np.concatenate(pairs)) for pairs in groups.open_pairs(allowed)]
            if rows:
                yield from groups.table.drop_columns(["trait"]).take(
                    pa.array(np.concatenate(rows))).combine_chunks().to_batches()

    return run


class _Links:
    """Pairs of many groups, confirmed together; pairs connected meanwhile are left out."""

    def __init__(self, confirm: Confirm) -> None:
        self.confirm = confirm
        self.up: dict[int, int] = {}
        self._clear()

    def _clear(self) -> None:
        self.pairs: list[tuple[int, int, int, int]] = []
        self.left: list[pa.Array] = []
        self.right: list[pa.Array] = []
        self.bytes = 0

    def _root(self, x: int) -> int:
        up = self.up
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def add(self, label: np.ndarray, node: np.ndarray, content: pa.Array, i: np.ndarray, j: np.ndarray
            ) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(i), PAIRS):
            a, b = i[at:at + PAIRS], j[at:at + PAIRS]
            apart = np.array([self._root(x) != self._root(y) for x, y in zip(label[a].tolist(), label[b].tolist())])
            a, b = a[apart], b[apart]
            if not len(a):
                continue
            self.pairs.extend(zip(node[a].tolist(), node[b].tolist(), label[a].tolist(), label[b].tolist()))
            self.left.append(content.take(pa.array(a)))
            self.right.append(content.take(pa.array(b)))
            self.bytes += self.left[-1].nbytes + self.right[-1].nbytes
            if len(self.pairs) >= PAIRS or self.bytes >= PAIR_BYTES:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.pairs:
            return
        good = self.confirm(pa.concat_arrays(self.left), pa.concat_arrays(self.right))
        links = [p for p, hit in zip(self.pairs, good) if hit]
        for _, _, x, y in links:
            self.up[self._root(x)] = self._root(y)
        self._clear()
        if links:
            a, b, _, _ = zip(*links)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _link_blocks(unpack: Unpack, allowed: Allowed, confirm: Confirm
                 ) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = _Links(confirm)
        for groups in _runs(batches, unpack):
            columns = groups.label, groups.table.column("node").to_numpy(), groups.table.column("content").combine_chunks()
            for i, j in groups.open_pairs(allowed):
                yield from links.add(*columns, i, j)
        yield from links.flush()

    return run
