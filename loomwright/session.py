"""Session builder with the settings the engine expects."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "loomwright", cores: int | str = "*", **conf: str) -> SparkSession:
    """Local session for tests and benchmarks; on a cluster the caller's own session is used as it is."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": os.environ.get("LOOM_DRIVER_MEMORY", "8g"),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    return SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=settings).getOrCreate()
