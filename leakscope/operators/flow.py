"""Minimum-cost maximum flow over many small graphs, one graph per key."""

from __future__ import annotations

import sys
from collections import deque

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Workers get the functions below with the task; they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RESULT = ("struct<total_flow: bigint, total_cost: bigint, flow: array<bigint>, error: string>")


def min_cost_flow(src, dst, capacity, cost, source: int, sink: int) -> tuple[int, int, list[int]]:
    """Total flow, total cost and flow per edge, by successive cheapest paths.

    Arc 2k is edge k and arc 2k+1 its way back.  Arcs are relaxed first in,
    first out in edge order, so equal inputs always give the same flow.
    """
    edges = len(src)
    nodes = max(source, sink, *src, *dst) + 1
    head, room, price = [0] * (2 * edges), [0] * (2 * edges), [0] * (2 * edges)
    arcs: list[list[int]] = [[] for _ in range(nodes)]
    for k, (u, v, cap, c) in enumerate(zip(src, dst, capacity, cost)):
        head[2 * k], head[2 * k + 1] = v, u
        room[2 * k] = cap
        price[2 * k], price[2 * k + 1] = c, -c
        arcs[u].append(2 * k)
        arcs[v].append(2 * k + 1)

    total_flow = total_cost = 0
    while True:
        best: list[float] = [float("inf")] * nodes
        came_by = [-1] * nodes
        best[source] = 0
        pending, waiting = deque([source]), bytearray(nodes)
        while pending:
            u = pending.popleft()
            waiting[u] = 0
            reach = best[u]
            for arc in arcs[u]:
                if room[arc] > 0:
                    v = head[arc]
                    if reach + price[arc] < best[v]:
                        best[v] = reach + price[arc]
                        came_by[v] = arc
                        if not waiting[v]:
                            waiting[v] = 1
                            pending.append(v)
        if came_by[sink] < 0:
            break
        path, v = [], sink
        while v != source:
            path.append(came_by[v])
            v = head[came_by[v] ^ 1]
        push = min(room[arc] for arc in path)
        for arc in path:
            room[arc] -= push
            room[arc ^ 1] += push
        total_flow += push
        total_cost += push * best[sink]
    return total_flow, int(total_cost), [room[2 * k + 1] for k in range(edges)]


def _solver(source: int, sink: int):
    @F.pandas_udf(RESULT)
    def solve(src: pd.Series, dst: pd.Series, cap: pd.Series, cost: pd.Series) -> pd.DataFrame:
        rows = []
        for graph in zip(src, dst, cap, cost):
            try:
                rows.append((*min_cost_flow(*(a.tolist() for a in graph), source, sink), None))
            except Exception as failure:  # one bad graph must not fail the others
                rows.append((None, None, None, f"{type(failure).__name__}: {failure}"))
        return pd.DataFrame(rows, columns=["total_flow", "total_cost", "flow", "error"])

    return solve


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Hash-partition by key over all cores.  The rows are few but costly to solve,
    so they must not be packed into few tasks for their small size."""
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                2 * spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, *keys)


def solve_graphs(edges: DataFrame, keys: list[str], source: int = 0, sink: int = 1) -> DataFrame:
    """One row per key: total_flow, total_cost, the edges in order with their flow, error.

    ``edges`` holds keys, edge_no, src, dst, capacity, cost.  A graph is bounded
    by the network it describes (stops x time windows), never by event volume;
    all graphs of a batch reach Python together.
    """
    packed = F.array_sort(F.collect_list(F.struct("edge_no", "src", "dst", "capacity", "cost")))
    graphs = edges.groupBy(*keys).agg(packed.alias("edges"))
    solved = graphs.withColumn("_r", _solver(source, sink)(
        *[F.col(f"edges.{c}") for c in ("src", "dst", "capacity", "cost")]))
    return solved.select(*keys, "edges", "_r.total_flow", "_r.total_cost", "_r.flow", "_r.error")


def _faults(source: int, sink: int):
    @F.pandas_udf("struct<over_capacity: bigint, unbalanced: bigint, total_gap: bigint, path_left: boolean>")
    def check(src: pd.Series, dst: pd.Series, cap: pd.Series, flow: pd.Series, total: pd.Series) -> pd.DataFrame:
        rows = []
        for u, v, c, f, t in zip(src, dst, cap, flow, total):
            net: dict[int, int] = {}
            onward: dict[int, list[int]] = {}
            for a, b, room, used in zip(u.tolist(), v.tolist(), c.tolist(), f.tolist()):
                net[a], net[b] = net.get(a, 0) - used, net.get(b, 0) + used
                if used < room:
                    onward.setdefault(a, []).append(b)
                if used > 0:
                    onward.setdefault(b, []).append(a)
            seen, open_nodes = {source}, [source]
            while open_nodes:
                for b in onward.get(open_nodes.pop(), ()):
                    if b not in seen:
                        seen.add(b)
                        open_nodes.append(b)
            rows.append((int(((f < 0) | (f > c)).sum()), sum(n != 0 for k, n in net.items() if k not in (source, sink)),
                         int(t + net.get(source, 0)), sink in seen))
        return pd.DataFrame(rows, columns=["over_capacity", "unbalanced", "total_gap", "path_left"])

    return check


def flow_checks(solved: DataFrame, keys: list[str], source: int = 0, sink: int = 1) -> DataFrame:
    """What a maximum flow must not have, per graph: edges beyond their capacity, inner
    nodes that gain or lose flow, a total other than what leaves the source, and a
    way left from source to sink.  A graph without a solution is left out."""
    good = solved.filter(F.col("error").isNull())
    found = good.withColumn("_c", _faults(source, sink)(
        *[F.col(f"edges.{c}") for c in ("src", "dst", "capacity")], "flow", "total_flow"))
    return found.select(*keys, "_c.*")


def edge_flows(solved: DataFrame, keys: list[str]) -> DataFrame:
    """Edges that carry flow."""
    paired = F.arrays_zip(F.col("edges"), F.col("flow"))
    return (solved.filter(F.col("error").isNull())
            .select(*keys, "total_flow", "total_cost", F.explode(paired).alias("_e"))
            .select(*keys, "total_flow", "total_cost", "_e.edges.*", F.col("_e.flow").alias("flow"))
            .filter("flow > 0"))
