"""Graphs as two tables: nodes (id, ...) and edges (src, dst[, weight]) with src <= dst."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import MIN_COMPONENT, MIN_WEIGHT
from .components import components, written


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct edges without direction."""
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def weighted(edges: DataFrame, *keys: str) -> DataFrame:
    """Edges without direction with the sum of their weights, by keys."""
    return edges.groupBy(*keys, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("weight").cast("bigint").alias("weight"))


def combined(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of two weighted graphs; weights of shared edges add up."""
    return weighted(a.select("src", "dst", "weight").unionByName(b.select("src", "dst", "weight")))


def rollup(pairs: DataFrame, key="key", chapter="chapter", series="series") -> DataFrame:
    """Weights by chapter, book, series and overall, with ``level``, in one pass of grouping sets."""
    groups = [[series, key, chapter, "src", "dst"], [series, key, "src", "dst"], [series, "src", "dst"], ["src", "dst"]]
    out = pairs.groupingSets([[F.col(c) for c in g] for g in groups], series, key, chapter, "src", "dst").agg(F.sum("weight").cast("bigint").alias("weight"), F.grouping_id().alias("g"))
    level = F.when(F.col("g") == 0, "chapter").when(F.col("g") == 4, "book").when(F.col("g") == 12, "series").otherwise("universe")
    return out.select(level.alias("level"), series, key, chapter, "src", "dst", "weight")


def heavy(edges: DataFrame, least: int = MIN_WEIGHT, exempt: tuple[int, ...] = ()) -> DataFrame:
    """Edges of a least weight, and those at an exempt node whatever they weigh."""
    keep = F.col("weight") >= least
    if exempt:
        keep = keep | F.col("src").isin(*exempt) | F.col("dst").isin(*exempt)
    return edges.where(keep)


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without the isolated ones."""
    return nodes.join(endpoints(edges), "id", "left_semi")


def induced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges both of whose ends are among the nodes."""
    ids = nodes.select("id").distinct()
    kept = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
    return kept.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def large_components(nodes: DataFrame, edges: DataFrame, least: int = MIN_COMPONENT) -> DataFrame:
    """(id, component, size) of the components with at least so many nodes."""
    found = components(edges, nodes)
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= least)
    return found.join(sizes, "component").select("id", "component", "size")


def scopes(nodes: DataFrame, edges: DataFrame, by: str = "world", least: int = MIN_COMPONENT) -> DataFrame:
    """(scope, id): the graph as a whole and that of each value of ``by``, small components left out of either.

    The graphs of all values are one graph: the edges whose ends agree in it.
    """
    nodes, edges = written(nodes.select("id", by)), written(edges.select("src", "dst"))
    whole = large_components(nodes, edges, least).select(F.lit("all").alias("scope"), "id")
    ends = nodes.select("id", by)
    same = edges.join(ends.toDF("src", "w1"), "src").join(ends.toDF("dst", "w2"), "dst").where("w1 = w2").select("src", "dst")
    same = written(same)
    own = large_components(nodes.where(F.col(by).isNotNull()), same, least).join(ends, "id").select(F.col(by).alias("scope"), "id")
    own = own.join(connected(ends, same).select(F.col(by).alias("scope")).distinct(), "scope", "left_semi")  # those with an edge at all
    return whole.unionByName(own)


def neighbours(edges: DataFrame) -> DataFrame:
    """(id, neighbour) in both directions, with the incident edge."""
    both = edges.select(F.col("src").alias("id"), F.col("dst").alias("neighbour"), "src", "dst")
    return both.unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("neighbour"), "src", "dst")).distinct()


def ego(edges: DataFrame, ident: int) -> DataFrame:
    """(id, distance): the node and its neighbours."""
    near = neighbours(edges).where((F.col("id") == ident) & (F.col("neighbour") != ident)).select(F.col("neighbour").alias("id"), F.lit(1).alias("distance")).distinct()
    return edges.sparkSession.range(1).select(F.lit(ident).cast("bigint").alias("id"), F.lit(0).alias("distance")).unionByName(near)


def component_of(edges: DataFrame, ident: int) -> DataFrame:
    """The nodes connected with one node, itself included; a node without edges is its own component."""
    found = components(edges)
    mine = found.where(F.col("id") == ident).select("component")
    return found.join(mine, "component", "left_semi").select("id").unionByName(edges.sparkSession.range(1).select(F.lit(ident).cast("bigint").alias("id"))).distinct()
