"""Exact order statistics and repeatable samples without a global sort."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Items of a quantile sketch, the quantiles read off it, a share of rows well above its
# error, and values that may be listed.
SKETCH, MARKS, WIDTH, EXACT = 4096, 1000, 0.002, 200_000


def row_hash(key: str, seed: int) -> Column:
    """Repeatable pseudo-random number of a row: 60 bits of a digest any engine can take."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows (all, if there are fewer), the same ones on every run.

    A histogram over the top bits of the hash finds how far to look, so the
    final top-n sees little more than n rows.
    """
    hashed = df.withColumn("_hash", row_hash(key, seed))
    bucket = F.shiftright("_hash", 44)
    sizes = hashed.groupBy(bucket.alias("_bucket")).agg(F.count("*").alias("_n"))
    # at most 65,536 buckets
    reach = sizes.select("_bucket", F.sum("_n").over(W.orderBy("_bucket")).alias("_reach"))
    last = reach.agg(F.coalesce(F.min(F.when(F.col("_reach") >= n, F.col("_bucket"))),
                                F.max("_bucket")))
    return (hashed.filter(bucket <= last.scalar())
            .orderBy("_hash", key).limit(n).drop("_hash"))


def threshold_of_rounded(df: DataFrame, score: str, fraction: float, default: float = 0.5,
                         name: str = "threshold") -> DataFrame:
    """Score at zero-based place floor(n * fraction) in descending order, as one row.

    For scores rounded to few decimals: they are counted per distinct value,
    which leaves a bounded table to order.
    """
    sizes = df.groupBy(score).agg(F.count("*").alias("_n"))
    ranked = sizes.select(
        score, F.sum("_n").over(W.orderBy(F.desc(score))).alias("_reach"),
        F.sum("_n").over(W.partitionBy()).alias("_all"))
    found = ranked.agg(F.max(F.when(F.col("_reach") > F.floor(F.col("_all") * fraction),
                                    F.col(score))).alias("_found"))
    return found.select(F.when(F.col("_found") != 0, F.col("_found"))
                        .otherwise(F.lit(default)).alias(name))


def nth_largest(df: DataFrame, score: str, place: int) -> float | None:
    """Exact score at a zero-based place in descending order; nulls and NaN have no place.

    A quantile sketch brackets the place and one more pass counts the values inside
    the bracket: two jobs for up to ``EXACT / (2 x WIDTH)`` rows.  Beyond, where a
    bracket would still hold too many values to list, it is sketched again.  The
    counts show whether the place is in the bracket; if not, a wider one is tried.
    """
    value, width = F.col(score).cast("double"), WIDTH
    rows = df.filter(value.isNotNull() & ~F.isnan(value)).select(value.alias("_v"))
    low, high, above = float("-inf"), float("inf"), 0
    while True:
        inside = rows.filter(F.col("_v").between(low, high))
        n, marks = inside.agg(F.count("*").alias("n"), F.kll_sketch_agg_double("_v", SKETCH).alias("s")).select(
            "n", F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("s", F.array(*[
                F.lit(i / MARKS) for i in range(MARKS + 1)])))).first()
        if place - above >= n:
            return None
        middle = 1 - (place - above + 0.5) / n
        least = marks[max(0, math.floor((middle - width) * MARKS))]
        most = marks[min(MARKS, math.ceil((middle + width) * MARKS))]
        side = F.when(F.col("_v") > most, 1).when(F.col("_v") < least, -1).otherwise(0)
        if n * 2 * width > EXACT and (least, most) != (low, high):
            sizes = dict(map(tuple, inside.groupBy(side.alias("_side")).count().collect()))
            if sizes.get(1, 0) <= place - above < sizes.get(1, 0) + sizes.get(0, 0):
                low, high, above = least, most, above + sizes.get(1, 0)
            else:
                width = min(1.0, 4 * width)
            continue
        groups = inside.groupBy(side.alias("_side"), F.when(side == 0, F.col("_v")).alias("_v")).count().collect()
        at = place - above
        for where, found_value, size in sorted(groups, key=lambda r: (-r[0], -r[1] if r[0] == 0 else 0)):
            if at < size:
                if where == 0:
                    return found_value
                break
            at -= size
        width = min(1.0, 4 * width)
