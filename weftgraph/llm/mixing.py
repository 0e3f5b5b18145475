"""Mixing sources to target weights along a time-varying curriculum (DataFrame functions only).

Each source's weight in the mix changes linearly over training time t in [0, 1].  The integral of the schedule is the
source's share; inverting it at the share of the source's words that come before a document gives the document's
place in training.  Sorting by that place over range partitions yields the curriculum.

Cases: a null text has size 0; a null source is a source of its own, last in order; sources without words get target
0 and their documents are not taken; repeated rows (same id, source and text) get the same decision; an empty table
gives an empty result; other columns are carried or ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import n_words, running, scratch

#: Weights dealt to the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)


def units(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """One row for each different (id, source, text): sizes in words, how often it occurs, and its hash."""
    text, source = F.col(text_col).cast("string"), F.col(source_col).cast("string")
    rows = docs.select(
        F.col(id_col).alias("id"),
        source.isNull().alias("src_null"),
        F.coalesce(source, F.lit("")).alias("src"),
        n_words(text).alias("size"),
        F.xxhash64(F.coalesce(text, F.lit("")), text.isNull()).alias("fp"),
    )
    rows = rows.groupBy("id", "src_null", "src", "size", "fp").agg(F.count(F.lit(1)).alias("times"))
    return rows.withColumn("h", F.xxhash64("id", "fp")).withColumn("amount", F.col("size") * F.col("times"))


def targets(sizes: DataFrame, weights=WEIGHTS, cap: float = 3.0, ramp: float = 0.5) -> DataFrame:
    """Targets and schedules of the sources from (src_null, src, source_size): ``target``, ``slope``.

    The targets min(cap * size, level * weight) add up to the sum of all sizes; the level comes from running sums over
    the sources in the order in which they reach their cap.  A source's schedule is share * (1 + slope * (1 - 2t)):
    slopes grow with the weight, lie within +-ramp, and add up to nothing over the shares, so that the schedules add up
    to 1 at every t.  This table has a row for each source and is the only one that is ordered in one task.
    """
    one = W.partitionBy(F.lit(0))
    ranked = sizes.withColumn("n", F.row_number().over(one.orderBy("src_null", "src")) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("n") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(cap))).withColumn("all", F.sum("source_size").over(one))
    up = one.orderBy(F.col("cap") / F.col("weight"), "n")
    level = (F.col("all") - F.coalesce(F.sum("cap").over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(
        up.rowsBetween(0, W.unboundedFollowing)
    )
    ranked = ranked.withColumn("level", level).withColumn("free", F.col("level") <= F.col("cap") / F.col("weight"))
    ranked = ranked.withColumn("level", F.min_by("level", F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), F.col("n")))).over(one))
    ranked = ranked.withColumn("target", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))))
    mean = F.sum(F.col("target") * F.col("weight")).over(one) / F.sum("target").over(one)
    span = float(max(weights) - min(weights)) or 1.0
    slope = F.coalesce(F.lit(ramp) * (F.col("weight") - mean) / F.lit(span), F.lit(0.0))
    return ranked.select("src_null", "src", "source_size", "target", slope.alias("slope"))


def place(u, slope):
    """Invert the integral (1 + slope) t - slope t^2 of a source's schedule at u."""
    b = F.lit(1.0) + slope
    return F.lit(2.0) * u / (b + F.sqrt(F.greatest(b * b - F.lit(4.0) * slope * u, F.lit(0.0))))


def plan(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, cap: float = 3.0, ramp: float = 0.5, bits: int = 10) -> DataFrame:
    """For each different (id, source, text): ``copies`` of it in the mix, and ``places``, the training positions of these.

    A source's documents are read in the order of a hash, whole passes first; the last, partial pass stops at the
    document whose middle passes the target.  So the words taken miss the target by half a document at most.
    """
    rows = scratch(units(docs, id_col, text_col, source_col))
    keys = ["src_null", "src"]
    aims = targets(rows.groupBy(*keys).agg(F.sum("amount").alias("source_size")), weights, cap, ramp)
    out = running(rows, keys, "h", ["id", "fp"], "amount", bits).drop("total").join(aims, keys)
    middle = F.col("before") + F.col("amount") / F.lit(2.0)
    passes = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(passes)
    out = out.withColumn("copies", F.when(F.col("source_size") > 0, whole + (middle < (passes - whole) * F.col("source_size")).cast("long")).otherwise(F.lit(0)).cast("long"))
    u = lambda k: F.least((k * F.col("source_size") + middle) / F.col("target"), F.lit(1.0))
    places = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1), lambda k: place(u(k), F.col("slope"))))
    return out.withColumn("places", places).drop("amount", "before", "slope")


def curriculum(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, in training order over range partitions."""
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text, source = F.col(f"row.{text_col}").cast("string"), F.col(f"row.{source_col}").cast("string")
    marked = marked.select(
        "row",
        F.col(f"row.{id_col}").alias("id"),
        source.isNull().alias("src_null"),
        F.coalesce(source, F.lit("")).alias("src"),
        F.xxhash64(F.coalesce(text, F.lit("")), text.isNull()).alias("fp"),
    ).alias("d")
    mix = plan(docs, id_col, text_col, source_col, **options).where("copies > 0").alias("p")
    same = F.col("d.id").eqNullSafe(F.col("p.id")) & (F.col("d.fp") == F.col("p.fp")) & (F.col("d.src") == F.col("p.src")) & (F.col("d.src_null") == F.col("p.src_null"))
    taken = marked.join(mix, same).select("row", F.col("d.id").alias("id"), F.explode("places").alias("place"))
    return taken.repartitionByRange("place", "id").sortWithinPartitions("place", "id").select("row.*")


def digest(docs: DataFrame, **options) -> DataFrame:
    """The contract's columns, one row for each row of ``docs``."""
    out = plan(docs, **options)
    out = out.select(
        F.col("id").alias("doc_id"),
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("copies")).alias("taken"),
        F.element_at("places", 1).alias("first_place"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("__t"),
    )
    return out.drop("__t")
