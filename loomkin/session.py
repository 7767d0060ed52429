"""A session with the settings the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "loomkin", **conf: str) -> SparkSession:
    """Adaptive execution, UTC and Arrow on; anything given in conf (dots as underscores are not translated) wins."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    return SparkSession.builder.appName(app).config(map=settings).getOrCreate()
