"""Spark sessions with the settings the operators expect."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(name: str = "tickloom", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, ANSI and adaptive execution on; everything else is the cluster's own unless given."""
    builder = SparkSession.builder.appName(name)
    if master or "SPARK_MASTER" in os.environ:
        builder = builder.master(master or os.environ["SPARK_MASTER"])
    own = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    return builder.config(map=own | conf).getOrCreate()
