"""Session settings and table access shared by every query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "corvane", cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings that the queries rely on (UTC clock, adaptive execution)."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; columns and filters are pruned by Catalyst at the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
