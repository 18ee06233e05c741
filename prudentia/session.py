"""Session settings every job of this package expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings that change results or protect plans from skew. Sizing (executors,
# memory, shuffle.partitions) belongs to the cluster and is left alone.
REQUIRED_CONF = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # Recording the Python line of every column call doubles the time to build a plan.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(
    app_name: str = "prudentia",
    master: str | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Get or create a session; ``extra`` wins over the required settings."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**REQUIRED_CONF, **(extra or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
