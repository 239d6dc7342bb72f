"""Session defaults and the checkpoint folder rule."""

import tempfile

from pyspark.sql import SparkSession


def local_session(cores="*", shuffle_partitions=8, app="evalmill"):
    """A local session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark):
    """The reliable folder named by ``spark.checkpoint.dir``.

    A cluster must name a shared folder there. Only where it is unset and Spark runs
    inside one process (tests) is a fresh temporary folder used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="evalmill-checkpoint-")

