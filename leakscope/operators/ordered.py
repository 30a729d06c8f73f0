"""Consecutive numbering without a single-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leakscope.session import materialize

# monotonically_increasing_id keeps the partition number above this bit
_ROW_BITS = 33


def ordered_index(df: DataFrame, order: list[str], name: str = "row_index") -> DataFrame:
    """Zero-based position of every row in the given total order.

    Rows are range-partitioned and sorted inside each partition; the position
    is the number of rows in earlier partitions plus the place in the own one.
    The order must end in a unique key, so equal leading values (a hot date,
    say) still spread over many partitions.  The placed rows are written out:
    sizes and rows then come from the same partitioning even when an executor
    is lost in between.
    """
    placed = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order)
                         .withColumn("_at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_at", _ROW_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # one row per partition, so one task can add them up and each task can hold them
    starts = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    inside = F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1)
    return (placed.join(F.broadcast(starts), part == F.col("_part"))
            .withColumn(name, F.col("_before") + inside)
            .drop("_at", "_part", "_before"))


def index_in_groups(df: DataFrame, group: str, order: list[str], name: str = "offset") -> DataFrame:
    """Zero-based position of every row inside its group, for few large groups.

    One total order over (group, order) gives a global position; subtracting
    the position where the group starts gives the place in the group, without
    any task holding a whole group.
    """
    indexed = ordered_index(df, [group, *order], "_index")
    # stored, so that its size is known and a small one is broadcast without a shuffle
    starts = materialize(indexed.groupBy(group).agg(F.min("_index").alias("_first")), "starts")
    return (indexed.join(starts, group)
            .withColumn(name, F.col("_index") - F.col("_first"))
            .select(*df.columns, name))
