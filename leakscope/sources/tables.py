"""Reading, writing and maintaining the engine's tables.

A table is a folder of parquet files below a root; fact tables are
partitioned by date so that a date filter reads only its own folders.

Dates are replaced through a change: the new rows of all its dates are written aside, and
one rename declares them valid.  From then on readers take these dates from the change, and
whoever writes next copies it into the table first.  A job that dies before the rename has
changed nothing, one that dies after it has changed everything.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscope import schemas
from leakscope.operators.ordered import ordered_index
from leakscope.session import delete_path, folder_names, job_scratch, materialize, path_exists, rename_path

NO_DATE = "__HIVE_DEFAULT_PARTITION__"


def table_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}"


def scan(spark: SparkSession, root: str, name: str, fmt: str = "parquet") -> DataFrame:
    """A named table under its declared schema; columns and filters prune at the files.

    Dates of a declared change that is not copied yet come from the change.  A reader whose
    files a copy replaces meanwhile fails and has to read again; it never mixes old and new.
    """
    stored = spark.read.schema(schemas.TABLES[name]).format(fmt).load(table_path(root, name))
    if not path_exists(spark, _change_path(root, name)):
        return stored
    changed, days = _change(spark, root, name)
    if days is None:
        return changed
    return stored.filter(~_on_days(schemas.PARTITIONED_BY[name][0], days)).unionByName(changed)


def select_rows(df: DataFrame, where: Column | None = None, order_by: list | None = None,
                limit: int | None = None, offset: int = 0) -> DataFrame:
    """Filter, sort and page in one call.  LIMIT 0 gives no rows."""
    out = df if where is None else df.filter(where)
    if order_by:
        out = out.orderBy(*order_by)
    if offset:
        out = out.offset(offset)
    return out if limit is None else out.limit(limit)


def conform(df: DataFrame, name: str) -> DataFrame:
    """Columns of the declared schema in order; absent ones become NULL, unknown ones fail."""
    fields = schemas.TABLES[name].fields
    unknown = set(df.columns) - {f.name for f in fields}
    if unknown:
        raise ValueError(f"{name} has no columns {sorted(unknown)}")
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in fields])


def _writer(df: DataFrame, name: str, mode: str):
    keys = schemas.PARTITIONED_BY.get(name)
    writer = df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    return writer.partitionBy(*keys) if keys else writer


def append(df: DataFrame, root: str, name: str) -> None:
    apply_change(df.sparkSession, root, name)
    _writer(conform(df, name), name, "append").parquet(table_path(root, name))


def overwrite(df: DataFrame, root: str, name: str) -> None:
    """Replace a table, or only the dates at hand where it is partitioned."""
    apply_change(df.sparkSession, root, name)
    _write_dates(df, root, name)


def _write_dates(df: DataFrame, root: str, name: str) -> None:
    _writer(conform(df, name), name, "overwrite").parquet(table_path(root, name))


def latest_per_key(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Last row of every key.  Partial aggregation keeps one row per key and task,
    so a key that is replayed very often does not reach one task as a whole."""
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row"))
            .select(*keys, "_row.*"))


def upsert(target: DataFrame, updates: DataFrame, keys: list[str],
           order: Column | None = None) -> DataFrame:
    """Merge rows by key.  Supplied columns replace the old value, NULLs included;
    columns the updates do not carry keep theirs."""
    unknown = set(updates.columns) - set(target.columns)
    if unknown:
        raise ValueError(f"unknown columns {sorted(unknown)}")
    source = updates if order is None else latest_per_key(updates, keys, order)
    source = source.withColumn("_supplied", F.lit(True)).alias("s")
    joined = target.alias("t").join(source, [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys],
                                    "full_outer")

    def merged(name: str) -> Column:
        if name in keys:
            return F.coalesce(f"t.{name}", f"s.{name}")
        if name in updates.columns:
            return F.when(F.col("s._supplied"), F.col(f"s.{name}")).otherwise(F.col(f"t.{name}"))
        return F.col(f"t.{name}")

    return joined.select(*[merged(c).alias(c) for c in target.columns])


def upsert_table(spark: SparkSession, root: str, name: str, updates: DataFrame,
                 order: Column | None = None) -> None:
    """Merge rows into a stored table.  ``order`` picks the last row of a key the
    updates repeat; without it keys must be unique.

    Where the table is partitioned by date and the updates carry the date, a key
    is looked up in the whole table, but only the dates the updates name and
    the dates their keys are stored under are rewritten; a row whose date
    changes moves, in one step for readers and through failures.  A missing date is a date of
    its own.  One job at a time may write to a table.
    """
    path, keys = table_path(root, name), schemas.PRIMARY_KEYS[name]
    source = updates if order is None else latest_per_key(updates, keys, order)
    if not path_exists(spark, path):
        overwrite(source, root, name)
        return
    with job_scratch(spark, "upsert"):
        source = materialize(source, "updates")
        apply_change(spark, root, name)
        target = scan(spark, root, name)
        parts = schemas.PARTITIONED_BY.get(name, [])
        if parts and set(parts) <= set(updates.columns):
            target, days = _touched(target, source, keys, parts[0])
        else:
            days = None
        _declare(spark, upsert(target, source, keys), root, name, days)
    apply_change(spark, root, name)


def _touched(target: DataFrame, source: DataFrame, keys: list[str], part: str
             ) -> tuple[DataFrame, list[dt.date | None]]:
    """Stored rows of the days that updates name or their keys are stored under, and these days."""
    stored = target.select(*keys, part).join(source.select(*keys), keys, "left_semi")
    # one value per calendar day
    days = [r[0] for r in source.select(part).union(stored.select(part)).distinct().collect()]
    return target.filter(_on_days(part, days)), days


def _on_days(part: str, days: list[dt.date | None]) -> Column:
    """True for rows of the given days; None is the rows without a date."""
    on = F.coalesce(F.col(part).isin([d for d in days if d is not None]), F.lit(False))
    return on | F.col(part).isNull() if None in days else on


def _change_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/_changes/{name}/declared"


def _declare(spark: SparkSession, merged: DataFrame, root: str, name: str,
             days: list[dt.date | None] | None) -> None:
    """Writes the rows of the days a change replaces, all rows where ``days`` is None, and then
    declares the change by a rename.  A day that ends up without rows is part of it all the same."""
    path = _change_path(root, name)
    aside = f"{path}-not-yet"
    delete_path(spark, aside)
    # the rows keep their date as a column: emptied days need no folder
    conform(merged, name).write.parquet(f"{aside}/rows")
    if days is not None:
        spark.createDataFrame([(d,) for d in days], "day date").coalesce(1).write.parquet(f"{aside}/days")
    rename_path(spark, aside, path)


def _change(spark: SparkSession, root: str, name: str) -> tuple[DataFrame, list[dt.date | None] | None]:
    """Rows of the declared change and its days, one value per calendar day; None is the whole table."""
    path = _change_path(root, name)
    rows = spark.read.schema(schemas.TABLES[name]).parquet(f"{path}/rows")
    if not path_exists(spark, f"{path}/days"):
        return rows, None
    return rows, [r[0] for r in spark.read.schema("day date").parquet(f"{path}/days").collect()]


def apply_change(spark: SparkSession, root: str, name: str) -> bool:
    """Copies the declared change, if there is one, into the table.  It can be repeated from any
    point: the dates are overwritten, the emptied ones deleted, and only then the change goes."""
    path = _change_path(root, name)
    if not path_exists(spark, path):
        return False
    rows, days = _change(spark, root, name)
    _write_dates(rows, root, name)
    if days is not None:
        part = schemas.PARTITIONED_BY[name][0]
        filled = {r[0] for r in rows.select(part).distinct().collect()}
        for day in set(days) - filled:
            delete_path(spark, f"{table_path(root, name)}/{part}={NO_DATE if day is None else day}")
    # a change without its name is no change, even where the deletion stops half way
    delete_path(spark, f"{path}-done")
    rename_path(spark, path, f"{path}-done")
    delete_path(spark, f"{path}-done")
    return True


def update_where(df: DataFrame, where: Column, changes: dict[str, Column]) -> DataFrame:
    hit = F.coalesce(where, F.lit(False))
    return df.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in changes.items()})


def delete_where(df: DataFrame, where: Column) -> DataFrame:
    """Rows that do not match.  A condition that is unknown keeps the row."""
    return df.filter(~F.coalesce(where, F.lit(False)))


def assign_ids(df: DataFrame, order: list[str], start_after: int = 0, name: str = "id") -> DataFrame:
    """Consecutive surrogate ids after the highest one in use."""
    return ordered_index(df, order, "_index").select(
        (F.col("_index") + (start_after + 1)).alias(name), *df.columns)


# Objects: files below bucket/key.

def put_object(df: DataFrame, root: str, bucket: str, key: str, fmt: str = "json") -> None:
    df.write.mode("overwrite").format(fmt).save(f"{root}/{bucket}/{key}")


def get_object(spark: SparkSession, root: str, bucket: str, key: str, fmt: str = "json"
               ) -> DataFrame | None:
    """The stored object, or None where there is none."""
    path = f"{root}/{bucket}/{key}"
    return spark.read.format(fmt).load(path) if path_exists(spark, path) else None


def list_objects(spark: SparkSession, path: str) -> DataFrame:
    """Every file below a prefix with size and time; contents are not read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
            .select(F.col("path").alias("key"), F.col("length").alias("size"),
                    F.col("modificationTime").alias("last_modified")))


def register_views(frames: dict[str, DataFrame]) -> None:
    """Make tables known to spark.sql under their own names."""
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
