"""Isolation forest: grouped tree building, vectorised scoring."""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leakscope.operators.features import ANOMALY_FEATURES, feature_array
from leakscope.operators.selection import nth_largest
from leakscope.session import materialize

# Workers get the functions below with the task; they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values.
NUM_TREES = 50
SAMPLE_SIZE = 256
CONTAMINATION = 0.05
DEFAULT_THRESHOLD = 0.5
EULER = 0.5772156649

NODE_SCHEMA = ("tree int, node int, left_child int, right_child int, feature int, "
               "split double, size int, depth int")


def mean_path(n: float) -> float:
    """Mean depth of an unsuccessful search in a binary tree of n values."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + EULER) - 2.0 * (n - 1) / n


def _uniform(*parts) -> Column:
    """Repeatable draw in [0, 1) per row."""
    bits = F.shiftrightunsigned(F.xxhash64(*parts), 11)
    return bits.cast("double") / float(1 << 53)


def _candidates(rows: DataFrame, key: str, num_trees: int, share: float, seed: int) -> DataFrame:
    """(tree, draw) pairs in which every row is a candidate of each tree with the same chance.

    A row draws once per tree, inside one expression, and is copied only for the
    trees it reaches; that is the rule for tables of any size.
    """
    reached = F.filter(F.transform(F.sequence(F.lit(0), F.lit(num_trees - 1)), lambda t: F.struct(
        t.alias("tree"), _uniform(F.col(key), t, F.lit(seed)).alias("draw"))), lambda d: d["draw"] < share)
    return rows.withColumn("_d", F.explode(reached)).select("*", "_d.tree", "_d.draw").drop("_d")


def tree_samples(features: DataFrame, key: str, num_trees: int, size: int, seed: int,
                 total: int) -> DataFrame:
    """``size`` distinct rows per tree, drawn independently for every tree.

    About num_trees * size rows leave the scan, however large the table is.
    The margin is widened until every tree has enough.
    """
    wanted, margin = min(size, total), 10.0
    while True:
        share = min(1.0, (wanted + margin * math.sqrt(wanted)) / max(total, 1))
        by_draw = W.partitionBy("tree").orderBy("draw", key)
        drawn = materialize(
            _candidates(features.select(key, "x"), key, num_trees, share, seed)
            .withColumn("_place", F.row_number().over(by_draw))
            .filter(F.col("_place") <= wanted).select("tree", key, "x"), "samples")
        sizes = drawn.groupBy("tree").count().agg(F.count("*"), F.min("count")).first()
        if share == 1.0 or (sizes[0] == num_trees and sizes[1] == wanted):
            return drawn
        margin *= 4


def _grow(rows: pd.DataFrame, seed: int, max_depth: int) -> pd.DataFrame:
    tree = int(rows["tree"].iloc[0])
    points = np.array(rows.sort_values(rows.columns[1])["x"].tolist(), dtype=float)
    rng = np.random.default_rng([seed, tree])
    nodes, open_nodes = [], [(0, points, 0)]
    taken = 1
    while open_nodes:
        number, inside, depth = open_nodes.pop()
        left = right = feature = -1
        split = 0.0
        if depth < max_depth and len(inside) > 1:
            column = int(rng.integers(inside.shape[1]))
            low, high = inside[:, column].min(), inside[:, column].max()
            if low < high:
                feature, split = column, float(rng.uniform(low, high))
                below = inside[:, column] < split
                if below.any():
                    left, taken = taken, taken + 1
                    open_nodes.append((left, inside[below], depth + 1))
                if not below.all():
                    right, taken = taken, taken + 1
                    open_nodes.append((right, inside[~below], depth + 1))
        nodes.append((tree, number, left, right, feature, split, len(inside), depth))
    return pd.DataFrame(nodes, columns=[c.split()[0] for c in NODE_SCHEMA.split(", ")])


def fit_forest(features: DataFrame, key: str = "event_id", num_trees: int = NUM_TREES,
               sample_size: int = SAMPLE_SIZE, seed: int = 42,
               names: list[str] = ANOMALY_FEATURES) -> DataFrame:
    """Node table of a forest.  Each task grows a tree from its sample of at most 256 rows."""
    points = features.select(key, feature_array(names).alias("x"))
    drawn = tree_samples(points, key, num_trees, sample_size, seed, features.count())
    depth = math.ceil(math.log2(sample_size))
    return drawn.select("tree", key, "x").groupBy("tree").applyInPandas(
        lambda rows: _grow(rows, seed, depth), NODE_SCHEMA)


def _forest_arrays(nodes: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """Trees as rows of padded arrays; a leaf points to itself."""
    trees = sorted(nodes["tree"].unique())
    width = int(nodes["node"].max()) + 1
    itself = np.tile(np.arange(width), (len(trees), 1))
    left, right = itself.copy(), itself.copy()
    feature = np.zeros_like(itself)
    split = np.full(itself.shape, np.inf)
    path = np.zeros(itself.shape)
    place = {t: i for i, t in enumerate(trees)}
    for n in nodes.itertuples():
        at = (place[n.tree], n.node)
        path[at] = n.depth + mean_path(n.size)
        if n.feature >= 0:
            feature[at], split[at] = n.feature, n.split
            left[at] = n.left_child if n.left_child >= 0 else n.node
            right[at] = n.right_child if n.right_child >= 0 else n.node
    return left, right, feature, split, path


def _score_udf(nodes: pd.DataFrame, sample_size: int):
    left, right, feature, split, path = _forest_arrays(nodes)
    steps = int(nodes["depth"].max())
    scale = mean_path(sample_size)

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        points = np.column_stack([c.to_numpy(dtype=float) for c in columns])
        width, values = points.shape[1], points.ravel()
        first, total = np.arange(len(points)) * width, np.zeros(len(points))
        for t in range(len(path)):
            at = np.zeros(len(points), dtype=np.int64)
            for _ in range(steps):
                goes_left = values[first + feature[t][at]] < split[t][at]
                at = np.where(goes_left, left[t][at], right[t][at])
            total += path[t][at]
        return pd.Series(np.power(2.0, -(total / len(path)) / scale))

    return score


def score_forest(features: DataFrame, nodes: DataFrame, sample_size: int = SAMPLE_SIZE,
                 names: list[str] = ANOMALY_FEATURES) -> DataFrame:
    """Features with forest_score.

    The node table is the one thing sent to every task: at most 511 nodes per
    tree, whatever the size of the data.
    """
    score = _score_udf(nodes.toPandas(), sample_size)
    return features.withColumn("forest_score", score(*[
        F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names]))


def forest_threshold(features: DataFrame, nodes: DataFrame, sample_size: int = SAMPLE_SIZE,
                     contamination: float = CONTAMINATION) -> float:
    """Score at place floor(n * contamination) from the top of the training rows."""
    # Scored once; the passes below read one column.
    scores = materialize(score_forest(features, nodes, sample_size).select("forest_score"), "scores")
    found = nth_largest(scores, "forest_score", int(scores.count() * contamination))
    return found or DEFAULT_THRESHOLD


def label_outliers(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.withColumn("is_outlier", (F.col("forest_score") >= threshold).cast("int"))
