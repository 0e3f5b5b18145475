"""The registry of queries and of the DuckDB SQL that restates them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import graphs, network, records


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From raw texts to co-occurrence edges at every level."""
    return network.cooccurrence_rollup(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (*network.QUERIES, *graphs.QUERIES, *records.QUERIES)}


def oracle_sql() -> dict[str, str]:
    return network.SQL | graphs.SQL | records.SQL
