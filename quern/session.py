"""One place that builds a session with the settings the plans assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(app: str = "quern", master: str | None = None, **extra: str) -> SparkSession:
    """A session with UTC, AQE, last-wins map keys and checkpoints that go with their last user; ``extra`` overrides any of them.

    Partition counts are left to AQE on a cluster: 64 MB advisory partitions are
    merged or split at run time, so the same plan serves 100 MB and 100 TB.
    """
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | extra
    b = SparkSession.builder.appName(app).config(map=conf)
    return (b.master(master) if master else b).getOrCreate()
