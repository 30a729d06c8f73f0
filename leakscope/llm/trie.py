"""Prefix tree of conversations: what a shared prefix saves, by parallel tree contraction.

A turn's prefix is told by four running sums of 32-bit halves of its turns' hashes,
so equal prefixes meet in one grouping however long they are.  Subtree totals come
from contracting the tree in join rounds: every round rakes the leaves into their
parents and compresses unary chains, taking out the chain nodes whose depth has the
round's bit set; then the rounds are walked backwards and every node that was taken
out gets its total from the node below it.  A round leaves about half of a chain and
no leaf, so both depth and size only cost logarithmically many rounds, and later
rounds work on ever fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leakscope.llm.turns import chained_sha256, place_turns
from leakscope.session import materialize

LANES = ("_l0", "_l1", "_l2", "_l3")
PARENT_LANES = tuple(f"_p{lane}" for lane in LANES)
NODE = ["depth", *LANES]

# Turns of a conversation that one window sums up.
STRETCH = 4096

# Ids packed into one row on their way to a digest.
PACK = 4096

EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"

LIVE, RAKED, SPLICED = 0, 1, 2


def head_turns(conv: Column) -> Column:
    """How many turns a conversation takes over: a hash of its id."""
    return (F.crc32(conv.cast("string").cast("binary")) % 6).cast("int")


def rebuilt(conversations: DataFrame, family: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, depth from 1, _digest, chars, size) of the rebuilt conversations, and all (conv_id, size).

    A conversation takes over its family's first turns in place of as many of its own.
    Only families' first ``most`` turns meet their members, at most twice ``family`` of them.
    """
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    placed = materialize(place_turns(rows, "conv_id").select(
        "conv_id", "_pos", "_digest", F.length("text").cast("long").alias("chars")), "turns")
    root = F.col("conv_id") - F.col("conv_id") % family
    heads = (placed.filter((F.col("conv_id") % family == 0) & (F.col("_pos") < most)).groupBy("conv_id")
             .agg(F.sort_array(F.collect_list(F.struct("_pos", "_digest", "chars"))).alias("_head"))
             .withColumnRenamed("conv_id", "_root"))
    members = (placed.groupBy("conv_id").agg(F.count("*").alias("_own"))
               .withColumns({"_root": root, "_h": head_turns(F.col("conv_id"))})
               .join(heads, "_root", "left")
               .withColumn("_head", F.coalesce(F.slice("_head", 1, F.col("_h")), F.array().cast(
                   "array<struct<_pos:bigint,_digest:string,chars:bigint>>")))
               .withColumn("size", F.size("_head") + F.greatest(F.col("_own") - F.col("_h"), F.lit(0))))
    members = materialize(members.select("conv_id", "_h", "_head", "size"), "members")
    taken = members.select("conv_id", "size", F.inline("_head")).select(
        "conv_id", (F.col("_pos") + 1).alias("depth"), "_digest", "chars", "size")
    own = (placed.join(members.select("conv_id", "_h", "size", F.size("_head").alias("_k")), "conv_id")
           .filter(F.col("_pos") >= F.col("_h"))
           .select("conv_id", (F.col("_pos") - F.col("_h") + F.col("_k") + 1).alias("depth"), "_digest", "chars", "size"))
    return taken.unionByName(own), members.select("conv_id", "size")


def prefixes(turns: DataFrame) -> DataFrame:
    """Adds the lanes of a turn's prefix and of the prefix before it."""
    one = F.xxhash64("_digest", "depth")
    two = F.xxhash64("depth", F.lit("second"), "_digest")
    low = F.lit(0xFFFFFFFF)
    valued = turns.withColumns({"_v0": one.bitwiseAND(low), "_v1": F.shiftrightunsigned(one, 32),
                                "_v2": two.bitwiseAND(low), "_v3": F.shiftrightunsigned(two, 32),
                                "_stretch": F.floor((F.col("depth") - 1) / STRETCH)})
    inside = W.partitionBy("conv_id", "_stretch").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    summed = valued.withColumns({lane: F.sum(f"_v{i}").over(inside) for i, lane in enumerate(LANES)})
    # conversations of more than one stretch: what the stretches before add up to
    earlier = W.partitionBy("conv_id").orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1)
    totals = valued.filter(F.col("size") > STRETCH).groupBy("conv_id", "_stretch").agg(
        *[F.sum(f"_v{i}").alias(f"_s{i}") for i in range(4)])
    before = totals.select("conv_id", "_stretch", *[F.sum(f"_s{i}").over(earlier).alias(f"_b{i}") for i in range(4)])
    joined = summed.join(before, ["conv_id", "_stretch"], "left")
    whole = {lane: F.col(lane) + F.coalesce(f"_b{i}", F.lit(0)) for i, lane in enumerate(LANES)}
    return joined.select("conv_id", "depth", "chars", "size", *[c.alias(lane) for lane, c in whole.items()], *[
        (c - F.col(f"_v{i}")).alias(PARENT_LANES[i]) for i, c in enumerate(whole.values())])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal nodes as one row: the node, the first id, the ids comma-joined."""
    for batch in batches:
        *keys, ids = [c.to_pylist() for c in batch.columns]
        starts = [i for i in range(len(ids)) if i == 0 or any(k[i] != k[i - 1] for k in keys)]
        cuts = [c for a, b in zip(starts, [*starts[1:], len(ids)]) for c in range(a, b, PACK)]
        ends = [*cuts[1:], len(ids)]
        # a cut inside a run ends where the next piece begins
        arrays = [pa.array([k[i] for i in cuts], pa.int64()) for k in keys]
        arrays += [pa.array([ids[i] for i in cuts], pa.int64()),
                   pa.array([",".join(map(str, ids[a:b])) for a, b in zip(cuts, ends)], pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, names=[*NODE, "_first", "_ids"])


def ends_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of each node's ending conversations (NODE, conv_id), ids ascending, comma-joined."""
    spread = ends.select(*NODE, "conv_id").repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    packed = spread.mapInArrow(_pack, ", ".join([*[f"{k} bigint" for k in NODE], "_first bigint, _ids string"]))
    return chained_sha256(packed, NODE, ["_first"], "_ids", "ends_sha256", ",")


def tree(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, chars, ends_sha256.

    A node is named by its smallest member and its depth.  The root holds every
    conversation, also those without turns; without conversations there is no node.
    """
    paths = materialize(prefixes(turns), "paths")
    zero = {lane: F.lit(0).cast("long") for lane in LANES}
    root = (sizes.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
            .withColumns({"depth": F.lit(0).cast("long"), "chars": F.lit(0).cast("long"), **zero, **{
                p: F.lit(0).cast("long") for p in PARENT_LANES}}))
    nodes = paths.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("chars").alias("chars"),
        *[F.first(p).alias(p) for p in PARENT_LANES]).unionByName(root)
    nodes = materialize(nodes, "nodes")
    top = sizes.agg(F.min("conv_id")).first()[0]
    ends = paths.filter(F.col("depth") == F.col("size")).select(*NODE, "conv_id").unionByName(
        sizes.filter("size = 0").select("conv_id", F.lit(0).cast("long").alias("depth"), *[
            c.alias(lane) for lane, c in zero.items()]))
    above = nodes.filter("depth > 0").select(
        (F.col("depth") + 1).alias("depth"), *[F.col(lane).alias(p) for lane, p in zip(LANES, PARENT_LANES)],
        F.col("conv_id").alias("_above"))
    # the root is the parent of very many nodes, and known
    deep = nodes.filter("depth > 1").join(above, ["depth", *PARENT_LANES])
    flat = nodes.filter("depth <= 1").withColumn("_above", F.when(F.col("depth") == 1, F.lit(top).cast("long")))
    named = materialize(deep.unionByName(flat).join(ends_digests(ends), NODE, "left").select(
        "conv_id", "depth", F.col("_above").alias("parent_conv_id"), "n_convs", "chars",
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256")), "named")
    children = named.filter("depth > 0").groupBy(
        F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    return materialize(named.join(children, ["conv_id", "depth"], "left").withColumn(
        "n_children", F.coalesce("n_children", F.lit(0)).cast("long")), "tree")


def subtree_totals(nodes: DataFrame, weights: dict[str, Column]) -> DataFrame:
    """(conv_id, depth) and, for each weight, its sum over the node's subtree.

    Contraction state of a live node: its parent among live nodes, the number of its
    live children, its weight with all that was raked into it (``_w``), and what the
    chain nodes spliced out above it add on the way to its parent (``_e``).
    """
    names = list(weights)
    w, e = [f"_w_{n}" for n in names], [f"_e_{n}" for n in names]
    zero = F.lit(0).cast("long")
    live = nodes.select(
        "conv_id", "depth", F.col("parent_conv_id").alias("_pc"),
        F.when(F.col("parent_conv_id").isNotNull(), F.col("depth") - 1).alias("_pd"), F.col("n_children").alias("_k"),
        *[c.cast("long").alias(n) for n, c in zip(w, weights.values())], *[zero.alias(n) for n in e])
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    bits, done, left, n = max(1, int(deepest).bit_length()), [], deepest is not None, 0
    while left:
        stored, left, spliced = _round(live, n % bits, w, e)
        done.append((stored, spliced))
        live = stored.filter(F.col("_kind") == LIVE).select(*live.columns)
        n += 1
    return _expand(done, names, w)


def _round(live: DataFrame, bit: int, w: list[str], e: list[str]) -> tuple[DataFrame, int, int]:
    """One rake and one compress.  Returns the rows of both, how many stay live, and how many were spliced."""
    sums = [*w, *e]
    leaves = live.filter(F.col("_k") == 0)
    raked = leaves.groupBy(F.col("_pc").alias("conv_id"), F.col("_pd").alias("depth")).agg(
        F.count("*").alias("_n"), *[F.sum(F.col(a) + F.col(b)).alias(f"_up{a}") for a, b in zip(w, e)])
    rest = live.filter(F.col("_k") > 0).join(raked, ["conv_id", "depth"], "left")
    rest = rest.withColumns({"_k": F.col("_k") - F.coalesce("_n", F.lit(0)), **{
        a: F.col(a) + F.coalesce(f"_up{a}", F.lit(0)) for a in w}}).select(*live.columns)

    def marked(depth: Column, k: Column) -> Column:
        return (k == 1) & (F.shiftright(depth, bit).bitwiseAND(F.lit(1)) == 1)

    # A marked node is spliced out unless the node below it is, so no two neighbours go at once.
    below = rest.filter(F.col("_pc").isNotNull()).groupBy(
        F.col("_pc").alias("conv_id"), F.col("_pd").alias("depth")).agg(
        F.count("*").alias("_n"), F.max(F.struct(
            F.col("conv_id").alias("c"), F.col("depth").alias("d"), F.col("_k").alias("k"), *e)).alias("_only"))
    out = (rest.filter(marked(F.col("depth"), F.col("_k")) & F.col("_pc").isNotNull())
           .join(below.filter("_n = 1"), ["conv_id", "depth"])
           .filter(~marked(F.col("_only.d"), F.col("_only.k")))
           .select("conv_id", "depth", "_pc", "_pd", "_only", *sums))
    offset = [(F.col(a) + F.col(f"_only.{b}")).alias(f"_x{a}") for a, b in zip(w, e)]
    taken = out.select("conv_id", "depth", F.lit(SPLICED).alias("_to"), F.col("_only.c").alias("_c"),
                       F.col("_only.d").alias("_d"), *offset)
    moved = out.select(
        F.col("_only.c").alias("conv_id"), F.col("_only.d").alias("depth"), F.lit(LIVE).alias("_to"),
        F.col("_pc").alias("_c"), F.col("_pd").alias("_d"),
        *[(F.col(a) + F.col(b)).alias(f"_x{a}") for a, b in zip(w, e)])
    changed = rest.join(taken.unionByName(moved), ["conv_id", "depth"], "left")
    to_live, to_splice = F.col("_to") == LIVE, F.coalesce(F.col("_to") == SPLICED, F.lit(False))
    after = changed.select(
        "conv_id", "depth", F.when(to_live, F.col("_c")).otherwise(F.col("_pc")).alias("_pc"),
        F.when(to_live, F.col("_d")).otherwise(F.col("_pd")).alias("_pd"), "_k",
        # a spliced node keeps what it adds to the total of the node below it
        *[F.when(to_splice, F.col(f"_x{a}")).otherwise(F.col(a)).alias(a) for a in w],
        *[F.when(to_live, F.col(b) + F.col(f"_x{a}")).otherwise(F.col(b)).alias(b) for a, b in zip(w, e)],
        F.when(to_splice, SPLICED).otherwise(LIVE).alias("_kind"),
        F.when(to_splice, F.col("_c")).alias("_bc"), F.when(to_splice, F.col("_d")).alias("_bd"))
    none = F.lit(None).cast("long")
    finished = leaves.select(*live.columns, F.lit(RAKED).alias("_kind"), none.alias("_bc"), none.alias("_bd"))
    seen = Observation()
    counted = after.unionByName(finished).observe(
        seen, F.count_if(F.col("_kind") == LIVE).alias("live"), F.count_if(F.col("_kind") == SPLICED).alias("spliced"))
    stored = materialize(counted, "round")
    return stored, seen.get["live"], seen.get["spliced"]


def _expand(done: list[tuple[DataFrame, int]], names: list[str], w: list[str]) -> DataFrame:
    """Totals of all nodes: leaves when raked have theirs, spliced nodes take it from below."""
    totals = None
    for stored, spliced in reversed(done):
        new = [stored.filter(F.col("_kind") == RAKED).select("conv_id", "depth", *[
            F.col(a).alias(n) for a, n in zip(w, names)])]
        if spliced:
            lower = totals.select(F.col("conv_id").alias("_bc"), F.col("depth").alias("_bd"), *names)
            new.append(materialize(stored.filter(F.col("_kind") == SPLICED).join(lower, ["_bc", "_bd"]).select(
                "conv_id", "depth", *[(F.col(n) + F.col(a)).alias(n) for a, n in zip(w, names)]), "expanded"))
        for part in new:
            totals = part if totals is None else totals.unionByName(part)
    return totals


def report(conversations: DataFrame) -> DataFrame:
    """All nodes of the rebuilt conversations' prefix tree with their subtree totals.

    Null roles and texts are empty.  Rows that tie in turn follow each other by role,
    then text; repeated rows are turns of their own.  Rows without conv_id belong to no
    conversation and take no part.  Extra columns are not looked at.  An empty table
    has no tree, so no rows.
    """
    nodes = tree(*rebuilt(conversations))
    totals = subtree_totals(nodes, {
        "n_leaves": F.when(F.col("n_children") == 0, 1).otherwise(0),
        "saved_tokens": (F.col("n_convs") - 1) * F.col("chars")})
    return nodes.join(totals, ["conv_id", "depth"]).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
