"""Session builder: the settings that the library is tested under."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "stormledger", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and small Arrow batches; keyword settings win (dots as ``__``)."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=settings).getOrCreate()
