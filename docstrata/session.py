"""Session factory; on a cluster the caller's own session is used instead."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(name: str = "docstrata", cores: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    base = {
        "spark.sql.shuffle.partitions": str(cores),
        "spark.driver.memory": memory,
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
    }
    spark = SparkSession.builder.master(f"local[{cores}]").appName(name).config(map=base | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
