"""Session helpers. Nothing here overrides what a cluster has configured."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, shuffle_partitions: int | None = None, memory: str = "16g") -> SparkSession:
    """A session for tests and the benchmark; on a cluster use the one spark-submit gives."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("prsloom")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
