"""Session factory: UTC, ANSI left on, adaptive execution on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "pageline", cpus: int | None = None, shuffle_partitions: int | None = None, driver_memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller passes its own session to every query."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
