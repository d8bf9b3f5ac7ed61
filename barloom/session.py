"""A session with the settings that the library's results rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    """An existing session, or a new one with SETTINGS and ``settings``."""
    builder = SparkSession.builder.appName("barloom").config(map=SETTINGS | settings)
    return (builder.master(master) if master else builder).getOrCreate()
