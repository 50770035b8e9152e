"""Spark sessions with the settings that the operators count on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(name: str = "folioflow", master: str | None = None, **settings: str) -> SparkSession:
    """A session in UTC, with adaptive execution; further settings by keyword, dots as double underscores."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
