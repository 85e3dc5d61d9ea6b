"""A session with the settings the jobs are written for."""

from pyspark.sql import SparkSession


def build_session(
    master: str | None = None, shuffle_partitions: int | None = None, **settings
) -> SparkSession:
    """Adaptive execution with skew handling on; everything else is left to the cluster."""
    builder = (
        SparkSession.builder.appName("plumbline")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Hash instead of sort-merge joins where every build partition is known to be small.
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64MB")
        # Recording the Python call site of every column doubles the time to build a plan.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
