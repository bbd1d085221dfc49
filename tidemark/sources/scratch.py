"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: The folder of scratch tables inside spark.checkpoint.dir.
SCRATCH = "tidemark-scratch"
#: Lets shuffle files go as soon as their query has ended.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_cleaned: set[str] = set()
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_watched: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only a session on one machine that names none (a test) gets a temporary folder.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
        sc.setCheckpointDir(folder)
        folder = sc.getCheckpointDir()
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the application's scratch folder, which goes when the driver ends."""
    top = f"{shared_dir(spark)}/{SCRATCH}/{spark.sparkContext.applicationId}"
    if top not in _cleaned:
        _cleaned.add(top)
        atexit.register(_remove, spark, top)
    return f"{top}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows of df as a table in the shared folder.

    It cuts the lineage, so a lost executor costs no more than the tasks that read on from here. Shuffle files of
    the query go when it is written.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    before = spark.conf.get(TIDY, "false")
    spark.conf.set(TIDY, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(TIDY, before)
    table = spark.read.schema(df.schema).parquet(path)
    _paths[table] = path
    for tables in _watched:
        tables.append(table)
    return table


@contextmanager
def tables_of(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """The tables that are written inside the block, so that they can be dropped when its result is."""
    _watched.append(made := [])
    try:
        yield made
    finally:
        _watched[:] = [m for m in _watched if m is not made]


def dropped(*tables: DataFrame) -> None:
    """Removes tables that written() gave, once nothing reads them any more; other DataFrames are let be."""
    for table in tables:
        path = _paths.pop(table, None)
        if path:
            _remove(table.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is None or sc._jsc.sc().isStopped():
        return
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
