"""Session settings that the operators are written for."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def session(app: str = "ledgerloom", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, ANSI casts and adaptive execution; anything else is the cluster's own."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all machines share, as ``spark.checkpoint.dir`` names it; without that setting on one machine only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        root = spark.conf.get("spark.sql.warehouse.dir", "spark-warehouse").rstrip("/") + "/_work"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
