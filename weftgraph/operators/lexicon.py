"""The lexicon: a table of (moniker, id) pairs and how it is built, asked and changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import moniker_forms


def build(entities: DataFrame) -> DataFrame:
    """Distinct (moniker, id) from (id, monikers array)."""
    forms = entities.select("id", F.explode("monikers").alias("m")).select("id", F.explode(moniker_forms(F.col("m"))).alias("moniker"))
    return forms.where("moniker <> ''").select("moniker", "id").distinct()


def grouped(lexicon: DataFrame) -> DataFrame:
    """(moniker, ids): the multimap, ids ascending."""
    return lexicon.groupBy("moniker").agg(F.sort_array(F.collect_set("id")).alias("ids"))


def exact(lexicon: DataFrame, key: str) -> DataFrame:
    return lexicon.where(F.col("moniker") == key)


def prefix(lexicon: DataFrame, key: str) -> DataFrame:
    """All entries below a prefix; a comparison that parquet statistics can use, rather than a trie."""
    return lexicon.where(F.col("moniker").startswith(key))


def matches(lexicon: DataFrame, entities: DataFrame, key: str, by_prefix: bool = False) -> DataFrame:
    """The entities behind a moniker, or below a prefix, by name."""
    found = (prefix if by_prefix else exact)(lexicon, key).select("id").distinct()
    return entities.join(found, "id", "left_semi").orderBy("name", "id")


def contains(lexicon: DataFrame, key: str, by_prefix: bool = False) -> bool:
    return bool(key) and not (prefix if by_prefix else exact)(lexicon, key).isEmpty()


def insert(lexicon: DataFrame, more: DataFrame) -> DataFrame:
    return lexicon.unionByName(more.select("moniker", "id")).distinct()


def set_prefix(lexicon: DataFrame, key: str, more: DataFrame) -> DataFrame:
    """Replace everything below a prefix."""
    return insert(lexicon.where(~F.col("moniker").startswith(key)), more)


def delete(lexicon: DataFrame, key: str) -> DataFrame:
    return lexicon.where(F.col("moniker") != key)


def ordered(lexicon: DataFrame) -> DataFrame:
    return grouped(lexicon).orderBy("moniker")


def size(lexicon: DataFrame) -> DataFrame:
    return lexicon.agg(F.count_distinct("moniker").alias("n_monikers"), F.count(F.lit(1)).alias("n_entries"))
