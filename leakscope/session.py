"""Session settings and the shared scratch location."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on.  Sizes are left to the cluster's own defaults.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A side is broadcast only when its size is known to be below this.
    "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # The JVM does not compile methods above 8,000 bytes of bytecode; a projection
    # that long runs faster in pieces than as one interpreted method.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(app: str = "leakscope", master: str | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **(extra or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables.

    A cluster names its shared folder in ``spark.checkpoint.dir``.  Where nothing
    is set, the warehouse takes them, which driver and executors share as well.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def _file_system(spark: SparkSession, path: str):
    """The file system a path belongs to, and the path as it knows it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is something at a path.  A file system that cannot tell raises."""
    files, where = _file_system(spark, path)
    return files.exists(where)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names directly below a path; none where there is nothing."""
    files, where = _file_system(spark, path)
    return [s.getPath().getName() for s in files.listStatus(where)] if files.exists(where) else []


def rename_path(spark: SparkSession, path: str, to: str) -> None:
    """Renames a folder; on file systems with atomic renames nobody sees it half done."""
    files, where = _file_system(spark, path)
    if not files.rename(where, _file_system(spark, to)[1]):
        raise OSError(f"{path} was not renamed to {to}")


def delete_path(spark: SparkSession, path: str) -> None:
    files, where = _file_system(spark, path)
    files.delete(where, True)


# Folders of the jobs that are running, innermost last, by application.
_scopes: dict[str, list[str]] = {}


def _application_folder(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark)}/leakscope-{spark.sparkContext.applicationId}"


@contextmanager
def job_scratch(spark: SparkSession, name: str) -> Iterator[None]:
    """Intermediate tables written inside belong to one job and go when it ends."""
    folder = f"{_application_folder(spark)}/{name}-{uuid.uuid4().hex}"
    open_scopes = _scopes.setdefault(spark.sparkContext.applicationId, [])
    open_scopes.append(folder)
    try:
        yield
    finally:
        open_scopes.remove(folder)
        delete_path(spark, folder)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder: the running job's, or else the
    application's, which the file system deletes when the application ends."""
    open_scopes = _scopes.get(spark.sparkContext.applicationId)
    if open_scopes:
        return f"{open_scopes[-1]}/{name}-{uuid.uuid4().hex}"
    files, where = _file_system(spark, _application_folder(spark))
    files.mkdirs(where)
    files.deleteOnExit(where)
    return f"{_application_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes an intermediate result to the shared folder and reads it back.

    This cuts the lineage: a lost executor re-reads files instead of redoing
    the work, and every use sees the same rows.  Unlike an RDD checkpoint the
    table is columnar, so later steps read only their columns and its size is
    known when joins are planned.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._scratch = path
    return stored


def release(*stored: DataFrame) -> None:
    """Deletes materialised tables that no plan will read again."""
    for df in stored:
        delete_path(df.sparkSession, df._scratch)
