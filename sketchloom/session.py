"""Session settings."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "sketchloom", *, master: str | None = None, shuffle_partitions: int | None = None, max_partition_bytes: str | None = None, driver_memory: str | None = None, executor_memory: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """A session with adaptive execution; sizes that aren't given stay as the cluster has them."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    chosen = {"spark.sql.shuffle.partitions": shuffle_partitions, "spark.sql.files.maxPartitionBytes": max_partition_bytes, "spark.driver.memory": driver_memory, "spark.executor.memory": executor_memory}
    for key, value in {**chosen, **(conf or {})}.items():
        if value is not None:
            builder = builder.config(key, str(value))
    if master:
        builder = builder.master(master)
    return builder.getOrCreate()
