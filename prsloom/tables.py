"""Intermediate tables in the folder that driver and executors share.

A table cuts the lineage and survives a lost executor. Tables are deleted when they are dropped, and what is left of them when
the driver's process ends.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset: one of our own in local mode, an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = getattr(spark, "_own_tables", None)
        if found is None:
            found = spark._own_tables = tempfile.mkdtemp(prefix="spark-tables-")
            atexit.register(shutil.rmtree, found, True)
    return found.rstrip("/")


def _known(spark: SparkSession) -> list[str]:
    """Paths of the tables that this session wrote and has not dropped."""
    found = getattr(spark, "_written_tables", None)
    if found is None:
        found = spark._written_tables = []
        atexit.register(_forget, spark, found)
    return found


def _forget(spark: SparkSession, paths: list[str]) -> None:
    with suppress(Exception):  # the gateway may be gone
        for path in list(paths):
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    with suppress(ValueError):
        _known(spark).remove(path)


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df as a Parquet table in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _known(spark).append(path)
    df.write.option("compression", codec).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._table_path = path
    return table


def once(df: DataFrame, name: str) -> DataFrame:
    """df as a table: itself if it is a mere read of one, so that several uses compute it once."""
    if df._jdf.queryExecution().analyzed().children().isEmpty():
        return df
    return written(df, name)


def drop(*tables: DataFrame) -> None:
    """Deletes tables that nothing reads any more."""
    for table in tables:
        _delete(table.sparkSession, table._table_path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Tables written inside are deleted at the end, but for those put into the list."""
    before = set(_known(spark))
    kept: list[DataFrame] = []
    try:
        yield kept
    finally:
        stay = before | {x._table_path for x in kept}
        for path in [x for x in _known(spark) if x not in stay]:
            _delete(spark, path)
