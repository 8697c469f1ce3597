"""Session helper for tests, benches and the command line."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, name: str = "tamis", **conf: str) -> SparkSession:
    """A local session: UTC, adaptive execution, few shuffle partitions.

    On a cluster the session comes from spark-submit; no operator depends on this helper.
    """
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("TAMIS_DRIVER_MEMORY", "8g"),
        "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="tamis-warehouse-"),
        **conf,
    }
    spark = builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
