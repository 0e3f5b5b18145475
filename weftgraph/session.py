"""A session with the settings the engine expects; on a cluster, pass your own."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[*]", partitions: int = 8, **settings) -> SparkSession:
    builder = SparkSession.builder.master(master).appName("weftgraph")
    conf = {
        "spark.sql.shuffle.partitions": partitions,
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in (conf | settings).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
