"""What several operators of this subpackage share: scratch tables, word rules, distributed running sums."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.components import _put, removed, shared_dir
from ..operators.components import written as scratch

__all__ = ["SPACE", "bucket_of", "n_words", "removed", "running", "scratch", "scratch_until", "shared_dir", "words_of"]

#: A word is a longest run of characters other than space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"


@contextmanager
def scratch_until(spark: SparkSession):
    """A function like ``scratch`` whose tables are removed at the end of the block; what is made of them has to be written by then."""
    paths = []

    def put(df: DataFrame) -> DataFrame:
        table, path = _put(df)
        paths.append(path)
        return table

    try:
        yield put
    finally:
        for path in paths:
            removed(spark, path)


def n_words(text: Column) -> Column:
    """Words of a text; 0 for null."""
    pieces = F.size(F.split(text, SPACE + "+"))
    edges = text.rlike("^" + SPACE).cast("int") + text.rlike(SPACE + r"\z").cast("int")
    return F.when(text.isNull() | (text == ""), 0).otherwise(pieces - edges).cast("long")


def words_of(text: Column) -> Column:
    """The array of words; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def bucket_of(h: Column, bits: int) -> Column:
    """The leading bits of a 64-bit hash."""
    return F.shiftrightunsigned(h, 64 - bits).cast("int")


def running(df: DataFrame, keys: list[str], h: str, ties: list[str], amount: str, bits: int = 10) -> DataFrame:
    """Add ``before``, the sum of ``amount`` over the rows of the same keys that come earlier, and ``total``, the keys' sum.

    Rows are ordered by the hash ``h``, then by ``ties``.  Each key is cut into 2**bits ranges of the hash; only a
    range is ever sorted in one task, and the ranges' sums are added up in a table of keys x ranges.  So a key that
    holds a third of all rows is spread like any other.  ``df`` is read twice; give it a written table.
    """
    cut = df.withColumn("__b", bucket_of(F.col(h), bits))
    sums = cut.groupBy(*keys, "__b").agg(F.sum(amount).alias("__s"))
    w = W.partitionBy(*keys)
    offsets = sums.select(
        *keys,
        "__b",
        F.coalesce(F.sum("__s").over(w.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__o"),
        F.sum("__s").over(w).alias("total"),
    )
    inner = W.partitionBy(*keys, "__b").orderBy(h, *ties).rowsBetween(W.unboundedPreceding, -1)
    return (
        cut.withColumn("__i", F.coalesce(F.sum(amount).over(inner), F.lit(0)))
        .join(offsets, [*keys, "__b"])
        .withColumn("before", F.col("__o") + F.col("__i"))
        .drop("__o", "__i", "__b")
    )
