"""Faceted views and search over a graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import induced

Facets = dict[str, set]


def toggled(facets: Facets, key: str, value) -> Facets:
    """Facets with a value switched on or off; a key without values goes."""
    values = facets.get(key, set()) ^ {value}
    return {k: v for k, v in (facets | {key: values}).items() if v}


def applied(facets: Facets, key: str, value) -> bool:
    return value in facets.get(key, ())


def accepts(facets: Facets) -> Column:
    """True if any attribute has any of its values; without facets, always."""
    tests = [F.col(k).isin(*sorted(v)) for k, v in facets.items() if v]
    return reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests], F.lit(False)) if tests else F.lit(True)


def subset(nodes: DataFrame, edges: DataFrame, facets: Facets) -> tuple[DataFrame, DataFrame]:
    """The nodes that the facets accept and the edges among them."""
    kept = nodes.where(accepts(facets))
    return kept, induced(kept, edges)


def exact(nodes: DataFrame, edges: DataFrame, key: str, value) -> tuple[DataFrame, DataFrame]:
    kept = nodes.where(F.col(key) == value)
    return kept, induced(kept, edges)


def search(nodes: DataFrame, term: str) -> DataFrame:
    """Nodes of which a moniker contains the term, in any case; an empty term finds none."""
    if not term:
        return nodes.where(F.lit(False))
    return nodes.where(F.exists("monikers", lambda m: F.contains(F.lower(m), F.lit(term.lower()))))


def suggestions(nodes: DataFrame, term: str) -> DataFrame:
    """What a search box shows: name, other names, value."""
    return search(nodes, term).select("name", F.array_except("monikers", F.array("name")).alias("aliases"), F.col("id").alias("value"))
