"""Exact top-k by inner product with multi-resolution segment statistics.

Cut a vector into segments and keep each segment's mean m and deviation s.  For
two vectors, length x (m m' + s s') summed over segments is never below their
inner product, so it is a lower bound of the distance -2 q.x.  The bound with one
segment is a product of two short vectors; more segments make it tighter.
A query first scores what the coarsest bound puts on top, which gives it a
k-th best score, and then only refines rows whose bound reaches that score, from
coarse to fine; every level scores its best rows to raise the k-th best score.
Exact integer scores decide.  Levels that discard next to nothing from the first
queries of a cell are left out for its other queries.

Queries and rows meet in cells of one query group and one row group, both of
bounded size: rows are copied once per query group, never to one task.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE = 64.0
LARGEST = sys.float_info.max / SCALE

# Queries that are bounded together; the first of a cell try every level, and a level
# stays for the others if it discards this share of the rows it is given.
BLOCK, WORTH = 64, 0.05


def integers(vectors: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * vectors.astype(np.float64))


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows x (2 x segments): means and deviations, both times the root of the segment's length."""
    edges = np.linspace(0, x.shape[1], segments + 1).astype(int)
    lengths = np.diff(edges)
    sums = np.add.reduceat(x, edges[:-1], axis=1)
    means = sums / lengths
    spread = np.add.reduceat((x - np.repeat(means, lengths, axis=1)) ** 2, edges[:-1], axis=1)
    return np.hstack([means * np.sqrt(lengths), np.sqrt(spread)])


def resolutions(dimension: int) -> list[int]:
    """1, 4, 16 segments, then twice as many up to one for each dimension."""
    out, segments = [], 1
    while segments < dimension:
        out.append(segments)
        segments *= 4 if segments < 16 else 2
    return [*out, dimension]


def exact_scores(x: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Integer inner products; floats where they are exact, whole numbers of any size elsewhere."""
    most = float(np.abs(x).max(initial=0)) * float(np.abs(query).max(initial=0)) * max(1, x.shape[1])
    if most < 2.0 ** 53:
        return (x @ query).astype(np.int64)
    whole = np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape)
    return np.array([int(sum(v * int(q) for v, q in zip(row, query))) for row in whole], dtype=object)


def search_cell(queries: tuple[np.ndarray, np.ndarray], rows: tuple[np.ndarray, np.ndarray], k: int,
                survivors: dict[int, list[float]] | None = None) -> tuple[list[int], list[int], list[int]]:
    """Each query's k best rows of the cell, ties to the smaller id, never the query's own.

    ``survivors`` collects, per level, the share of a query's rows that are left after it.
    """
    (query_ids, q), (ids, x) = queries, rows
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    levels = resolutions(x.shape[1]) if x.shape[1] else []
    row_stats = {s: statistics(x, s) for s in levels}
    out: tuple[list[int], list[int], list[int]] = ([], [], [])
    for at in range(0, len(query_ids), BLOCK):
        block, own = q[at:at + BLOCK], query_ids[at:at + BLOCK]
        alive = own[:, None] != ids[None, :]
        most = np.maximum(1, alive.sum(axis=1))
        left, useful = int(alive.sum()), []
        for level in levels:
            # a product of two small matrices for all queries of the block
            bounds = statistics(block, level) @ row_stats[level].T
            slack = 1e-9 * np.abs(bounds).max(initial=0) + 1e-6     # rounding of the bound itself
            for i, mine in enumerate(alive):
                if mine.sum() > k:
                    open_rows = np.flatnonzero(mine)
                    some = min(2 * k, len(open_rows))
                    top = open_rows[np.argpartition(-bounds[i, open_rows], some - 1)[:some]]
                    least = float(np.sort(exact_scores(x[top], block[i]))[::-1][k - 1])
                    mine &= bounds[i] + slack >= least
            before, left = left, int(alive.sum())
            if before and before - left >= WORTH * before:
                useful.append(level)
            if survivors is not None:
                survivors.setdefault(level, []).extend((alive.sum(axis=1) / most).tolist())
        if at == 0:
            levels = useful
        for i, mine in enumerate(alive):
            open_rows = np.flatnonzero(mine)                        # in order of id
            scores = exact_scores(x[open_rows], block[i])
            best = np.argsort(-scores, kind="stable")[:k]
            out[0].extend([int(own[i])] * len(best))
            out[1].extend(ids[open_rows[best]].tolist())
            out[2].extend(int(s) for s in scores[best])
    return out


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    column = table.column("_vector").combine_chunks()
    ids = table.column("_id").to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py():column.offsets[-1].as_py()] \
        if len(column) else np.zeros(0)
    return ids, integers(flat.reshape(len(ids), -1))


def usable(vector: Column) -> Column:
    """No component is null, not a number, or infinite when it is scaled."""
    return vector.isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= LARGEST))


def top_k(rows: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20,
          query_group: int = 2048, row_group: int = 16384) -> DataFrame:
    """query_id, rank, vec_id and score of every query's k best other rows.

    Rows without an id or with an unusable vector take no part; a row repeated
    with its id is searched once as a query and counts every time as a candidate.
    Queries of one id but different vectors share one list, the best scores of any of them.
    Only vectors of the query's own length compare with it.  Scores must fit 64 bits.
    """
    valid = rows.select(F.col(key).cast("long").alias("_id"), F.col(vector).cast("array<double>").alias("_vector"),
                        is_query.alias("_query")).filter(F.col("_id").isNotNull() & usable(F.col("_vector")))
    valid = valid.withColumn("_size", F.size("_vector"))
    total = valid.agg(F.count(F.lit(1)).alias("n"), F.count_if("_query").alias("q")).first()
    row_groups, query_groups = (max(1, -(-n // size)) for n, size in (
        (total["n"], row_group), (total["q"], query_group)))

    def spread(group: str, count: int, copies: str, times: int, df: DataFrame) -> DataFrame:
        return (df.withColumn(group, F.pmod(F.xxhash64("_id"), F.lit(count)).cast("int"))
                .withColumn(copies, F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
                .select("_size", "_qg", "_rg", "_id", "_vector"))

    queries = spread("_qg", query_groups, "_rg", row_groups,
                     valid.filter("_query").dropDuplicates(["_id", "_vector"]))
    candidates = spread("_rg", row_groups, "_qg", query_groups, valid)
    cell = ["_size", "_qg", "_rg"]
    found = queries.groupBy(*cell).cogroup(candidates.groupBy(*cell)).applyInArrow(
        _cell_search(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _cell_search(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        found = ([], [], [])
        if queries.num_rows and rows.num_rows:
            found = search_cell(_matrix(queries), _matrix(rows), k)
        return pa.table({n: pa.array(v, pa.int64()) for n, v in zip(("query_id", "vec_id", "score"), found)})

    return run
