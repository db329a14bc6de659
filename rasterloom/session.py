"""The Spark session that tests, benches and examples share."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session in UTC; on a cluster the submitted configuration wins over all of this."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("rasterloom")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
