"""Kinship: from named relations to edges between entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import KIN
from .components import written
from .graph import undirected


def relations(entities: DataFrame, kinds: tuple[str, ...] = KIN) -> DataFrame:
    """(id, surname, relation) for each named relative."""
    named = F.flatten(F.array(*[F.coalesce(F.col("relatives")[k], F.array().cast("array<string>")) for k in kinds]))
    return entities.select("id", "surname", F.explode(named).alias("relation"))


def targets(asked: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, relation, target, how): the first rule that finds somebody decides, and of several the least id.

    1 the name itself; 2 the forename with the own surname; 3 a moniker; 4 a moniker that contains the relation.  Rules 1 to 3
    are equi-joins.  Rule 4 has no key to join by; only what the others left, each different string once, is compared
    with the monikers, in a nested loop over a table of a row a string.
    """
    people = entities.select("id", "name", F.explode(F.array_union("monikers", F.array("name"))).alias("moniker"))
    names = people.groupBy("name").agg(F.min("id").alias("target"))
    known = entities.select("id", F.explode("monikers").alias("moniker")).groupBy("moniker").agg(F.min("id").alias("target"))
    out = asked.withColumn("fore", F.concat_ws(" ", F.split("relation", " ")[0], "surname"))
    out = out.join(names.toDF("relation", "t1"), "relation", "left").join(names.toDF("fore", "t2"), "fore", "left").join(known.toDF("relation", "t3"), "relation", "left")
    out = written(out.select("id", "relation", F.coalesce("t1", "t2", "t3").alias("t"), F.when(F.col("t1").isNotNull(), 1).when(F.col("t2").isNotNull(), 2).when(F.col("t3").isNotNull(), 3).alias("how")))
    rest = out.where("t is null").select("relation").distinct()
    inside = rest.join(known, F.contains(F.col("moniker"), F.col("relation"))).groupBy("relation").agg(F.min("target").alias("t4"))
    out = out.join(inside, "relation", "left")
    return out.select("id", "relation", F.coalesce("t", "t4").alias("target"), F.coalesce("how", F.when(F.col("t4").isNotNull(), 4)).alias("how"))


def edges(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges between nodes of the graph; unresolved relations and ends outside of it go."""
    ids = nodes.select("id")
    out = found.where("target is not null").select(F.col("id").alias("src"), F.col("target").alias("dst"))
    return undirected(out.join(ids.toDF("src"), "src", "left_semi").join(ids.toDF("dst"), "dst", "left_semi"))


def graph(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (entities with a world) and kinship edges."""
    nodes = entities.where("world is not null")
    return nodes, edges(targets(relations(nodes), entities), nodes)


def within(nodes: DataFrame, links: DataFrame, world: str | None = None, book: str | None = None, family: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The part of a kinship graph in a world, a book or a family."""
    from .graph import induced

    for column, value in (("world", world), ("family", family)):
        if value is not None:
            nodes = nodes.where(F.col(column) == value)
    if book is not None:
        nodes = nodes.where(F.array_contains("books", book))
    return nodes, induced(nodes, links)
