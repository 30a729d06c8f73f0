"""Mixing sources to target weights, with built-in functions only.

Every document draws a hash-random key.  Keys are uniform, so equal stretches of
the key space are equal shares of a source: a source is cut into ``ranges`` of
them without sampling, and even a source with a third of all rows is sorted in
many small pieces.  Words before a document = words of the source's earlier
ranges (a running sum over at most ``ranges`` rows per source, from a partial
aggregate) + words before it inside its range.  The cut is then arithmetic: a
target of 1.3 times a source takes every document once and the first 0.3 once more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakscope.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(0))), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A text that is never null and sorts as the sources do, null last."""
    return F.when(source.isNull(), F.lit("w")).otherwise(F.concat(F.lit("v"), source))


def random_key(columns: list[Column], seed: int) -> Column:
    """128 random bits as hexadecimal digits; the same row always draws the same key."""
    parts = [F.coalesce(c.cast("string"), F.lit("null")) for c in columns]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def targets(sizes: DataFrame, share: float, most: float, weights: tuple[float, ...] = WEIGHTS
            ) -> DataFrame:
    """(_source, source_size, target) from one row (_source, source_size) per source.

    Weights repeat over the sources in order.  A target stops at ``most`` times
    its source's size, and the excess goes to the others by weight until none is
    above.  Filling sources in the order of size per weight gives that fixpoint at
    once: a source is full exactly if the level the sources from it on would get
    exceeds its own limit per weight.
    """
    everything = Window.orderBy("_source")
    ranked = sizes.withColumn("_no", (F.row_number().over(everything) - 1) % len(weights))
    ranked = ranked.withColumn("_weight", F.get(F.array(*[F.lit(w) for w in weights]), F.col("_no")))
    ranked = (ranked.withColumn("_limit", F.col("source_size") * F.lit(float(most)))
              .withColumn("_ratio", F.col("_limit") / F.col("_weight"))
              .withColumn("_total", F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))))
    up = Window.orderBy("_ratio", "_source")
    ranked = (ranked
              .withColumn("_before", F.coalesce(F.sum("_limit").over(
                  up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
              .withColumn("_rest", F.sum("_weight").over(
                  up.rowsBetween(0, Window.unboundedFollowing)))
              .withColumn("_level", (F.col("_total") - F.col("_before")) / F.col("_rest")))
    ranked = ranked.withColumn("_full", F.col("_level") >= F.col("_ratio"))
    level = F.min(F.when(~F.col("_full"), F.struct("_ratio", "_source", "_level"))).over(
        Window.partitionBy())["_level"]
    return ranked.select("_source", "source_size", F.when(
        F.col("_full"), F.col("_limit")).otherwise(F.col("_weight") * level).alias("target"))


def mix(docs: DataFrame, size: Column, source: str = "source", keys: tuple[str, ...] = ("doc_id", "text"),
        share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS,
        ranges: int = 4096, seed: int = 1, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, size, source_size, target and taken for every row.

    The words taken from a source are its target rounded down: every full pass
    takes each document once, the pass that is cut takes documents in key order
    and ends inside the last of them.  Rows with null or equal keys tie and are
    told apart by size; rows equal in everything may swap, which changes nothing.
    Null sources are one source.  Documents without words are never taken.
    """
    rows = docs.select(
        *keep, size.alias("size"), source_key(F.col(source)).alias("_source"),
        random_key([F.col(k) for k in keys], seed).alias("_key"))
    # texts are read once; what follows needs a few words per document
    rows = materialize(rows, "mix")
    # the first 32 bits of the key, scaled to the number of ranges
    first = F.conv(F.substring("_key", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("_range", F.shiftright(first * F.lit(ranges), 32).cast("int"))
    blocks = rows.groupBy("_source", "_range").agg(F.sum("size").alias("_words"))
    by_source = Window.partitionBy("_source").orderBy("_range")
    blocks = (blocks
              .withColumn("_earlier", F.sum("_words").over(by_source) - F.col("_words")))
    aims = targets(rows.groupBy("_source").agg(F.sum("size").alias("source_size")), share, most, weights)
    blocks = blocks.join(aims, "_source").drop("_words")
    inside = Window.partitionBy("_source", "_range").orderBy("_key", "size")
    placed = (rows.join(blocks, ["_source", "_range"])
              .withColumn("_start", F.col("_earlier") - F.col("size") + F.sum("size").over(
                  inside.rowsBetween(Window.unboundedPreceding, 0))))
    budget = F.floor("target")
    passes = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - passes * F.col("source_size")
    taken = passes * F.col("size") + F.least(F.col("size"), F.greatest(F.lit(0), rest - F.col("_start")))
    return placed.select(*keep, "size", "source_size", "target", taken.cast("long").alias("taken"))


def repeat_documents(docs: DataFrame, taken: Column, size: Column, text: str = "text") -> DataFrame:
    """One row for every time a document is taken; a last, partial pass keeps the
    document's first words, with the white space before each of them."""
    whole = F.when(size > 0, F.floor(taken / size)).otherwise(0).cast("int")
    part = (taken - whole * size).cast("int")
    words = F.regexp_extract_all(F.col(text), F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(0))
    copies = F.concat(F.array_repeat(F.lit(None).cast("int"), whole),
                      F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))
    cut = F.when(F.col("_part").isNull(), F.col(text)).otherwise(
        F.array_join(F.slice(words, 1, F.col("_part")), ""))
    return docs.withColumn("_part", F.explode(copies)).withColumn(text, cut).drop("_part")
