"""Session for tests and benchmarks on one machine.

On a cluster, make the session as usual and set there: the UTC zone, adaptive
execution, ``spark.checkpoint.dir`` on shared storage, removal of checkpoints no
longer in use, and shuffle partitions so that one holds a few hundred MB.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cpus: str = "8", shuffle_partitions: str | None = None) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("sealtrail")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", shuffle_partitions or cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
