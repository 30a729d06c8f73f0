import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from leakscope.operators import evaluate, forecast, forest


def test_tree_and_boosting_fit_a_line(spark, tmp_path):
    rng = np.random.default_rng(7)
    x = np.arange(100) / 10
    y = 2 * x + 1 + rng.uniform(-0.25, 0.25, 100)
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x1 double, y double")
    cells = forecast.training_cells(rows, ["y"], ["x1"])
    model = forecast.fit_boosted_trees(cells, "y", num_trees=20, max_depth=4, names=["x1"])
    fitted = forecast.predict(model, rows, names=["x1"])
    assert evaluate.regression_metrics(fitted, "y", "predicted").first().mse < 5
    at5 = forecast.predict(model, spark.createDataFrame([(5.0,)], "x1 double"), names=["x1"]).first().predicted
    assert abs(at5 - 11) < 3
    model.write().overwrite().save(str(tmp_path / "m"))
    again = type(model).load(str(tmp_path / "m"))
    got = forecast.predict(again, fitted, "again", names=["x1"]).select(
        F.max(F.abs(F.col("again") - F.col("predicted")))).first()[0]
    assert got < 0.001
    tree = forecast.fit_tree(rows, "y", names=["x1"])
    assert evaluate.regression_metrics(forecast.predict(tree, rows, names=["x1"]), "y", "predicted").first().mse < 5


def test_cells_give_the_same_trees_as_rows(spark, small):
    """Merged and weighted rows leave every split and leaf as it was."""
    names = ["hour", "day_of_week", "stop_sequence"]
    rows = small.features.select(*names, F.col("boarding_count").cast("double"))
    merged = forecast.training_cells(rows, ["boarding_count"], names)
    single = rows.withColumn("weight", F.lit(1.0))
    models = [forecast.fit_boosted_trees(df, "boarding_count", num_trees=2, max_depth=2, names=names,
                                         subset="all") for df in (merged, single)]
    both = rows.distinct()
    for name, model in zip(("a", "b"), models):
        both = forecast.predict(model, both, name, names)
    worst = both.select(F.max(F.abs(F.col("a") - F.col("b")))).first()[0]
    # split candidates come from the cells on one side and from the rows on the other
    assert worst < 0.5
    assert merged.agg(F.sum("weight")).first()[0] == rows.count()


def walk(nodes, x):
    by_node = {n.node: n for n in nodes}
    n = by_node[0]
    while n.feature >= 0:
        n = by_node[n.left_child if x[n.feature] < n.split else n.right_child]
    return n.depth + forest.mean_path(n.size)


@pytest.fixture(scope="module")
def trained(small):
    names = forest.ANOMALY_FEATURES
    rows = small.features.filter("is_anomalous = 0").select("event_id", *names).persist()
    nodes = forest.fit_forest(rows, num_trees=7, sample_size=64).persist()
    return rows, nodes


def test_forest_structure(trained):
    _, nodes = trained
    for tree, part in nodes.toPandas().groupby("tree"):
        root = part[part.node == 0].iloc[0]
        assert root["size"] == 64 and part["depth"].max() <= 6
        inner = part[part.feature >= 0]
        sizes = dict(zip(part.node, part["size"]))
        for n in inner.itertuples():
            assert n.size == sizes.get(n.left_child, 0) + sizes.get(n.right_child, 0)
    assert nodes.select("tree").distinct().count() == 7


def test_forest_scores_follow_the_trees(trained):
    rows, nodes = trained
    scored = forest.score_forest(rows, nodes, 64).limit(40).toPandas()
    trees = [list(p.itertuples()) for _, p in nodes.toPandas().groupby("tree")]
    for r in scored.itertuples():
        x = [float(getattr(r, n)) for n in forest.ANOMALY_FEATURES]
        mean = sum(walk(t, x) for t in trees) / len(trees)
        assert math.isclose(r.forest_score, 2 ** (-mean / forest.mean_path(64)), rel_tol=1e-12)


def test_forest_repeats_and_threshold_labels_the_share(trained):
    rows, nodes = trained
    again = forest.fit_forest(rows.repartition(5), num_trees=7, sample_size=64)
    order = ["tree", "node"]
    pd.testing.assert_frame_equal(nodes.toPandas().sort_values(order).reset_index(drop=True),
                                  again.toPandas().sort_values(order).reset_index(drop=True))
    threshold = forest.forest_threshold(rows, nodes, 64)
    scores = np.sort(forest.score_forest(rows, nodes, 64).toPandas().forest_score.to_numpy())[::-1]
    assert threshold == scores[int(len(scores) * 0.05)]


def test_samples_are_distinct_and_whole(spark):
    rows = spark.range(3000).select(F.col("id").cast("string").alias("k"),
                                    F.array(F.col("id").cast("double")).alias("x"))
    drawn = forest.tree_samples(rows, "k", 5, 100, 1, 3000)
    per_tree = drawn.groupBy("tree").agg(F.count("*").alias("n"), F.count_distinct("k").alias("d")).collect()
    assert len(per_tree) == 5 and all(r.n == r.d == 100 for r in per_tree)
    few = forest.tree_samples(rows.limit(20), "k", 5, 100, 1, 20)
    assert {r["count"] for r in few.groupBy("tree").count().collect()} == {20}


def test_mean_path():
    assert forest.mean_path(1) == 0 and forest.mean_path(2) == 1
    assert math.isclose(forest.mean_path(256), 10.244770, abs_tol=1e-5)


def test_quality_of_nothing(spark):
    df = spark.createDataFrame([(0, 0)], "a int, b int")
    q = evaluate.detection_quality(df, F.col("a") == 1, F.col("b") == 1).first()
    assert (q.tp, q.tn, q.precision, q.recall, q.f1) == (0, 1, 0.0, 0.0, 0.0)


def test_dates_split_in_order(spark):
    df = spark.sql("select explode(sequence(date'2024-01-01', date'2024-01-07')) as sim_date")
    parts = {str(r.sim_date): r.part for r in forecast.split_dates(df).collect()}
    assert [d for d, p in sorted(parts.items()) if p == "test"] == ["2024-01-06", "2024-01-07"]
    assert str(forecast.last_train_date(df)) == "2024-01-05"
