"""The session that the library's queries are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings under which results don't depend on the machine's zone; Spark adapts plans at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.cteRecursionLevelLimit": "10000",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "tarnwell", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
