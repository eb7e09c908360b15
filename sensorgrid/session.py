"""Session settings that the engine expects. It also runs in a session that someone else has made."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.aggregatePushdown": "true",
    "spark.sql.python.filterPushdown.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def session(name: str = "sensorgrid", master: str | None = None, **settings: str) -> SparkSession:
    """A session with SETTINGS; `master` only where the submitter names none."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
