"""What changed between two snapshots of pages."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(pageid, change, old_title, new_title, old_content, new_content) of the pages that differ; both are (pageid, title, timestamp, content)."""
    o = old.select("pageid", *[F.col(c).alias(f"old_{c}") for c in ("title", "timestamp", "content")], F.lit(True).alias("in_old"))
    n = new.select("pageid", *[F.col(c).alias(f"new_{c}") for c in ("title", "timestamp", "content")], F.lit(True).alias("in_new"))
    both = o.join(n, "pageid", "full_outer")
    same = F.col("old_title").eqNullSafe(F.col("new_title")) & F.col("old_content").eqNullSafe(F.col("new_content")) & F.col("old_timestamp").eqNullSafe(F.col("new_timestamp"))
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(~F.col("old_title").eqNullSafe(F.col("new_title")), "renamed").otherwise("modified")
    return both.where(F.col("in_old").isNull() | F.col("in_new").isNull() | ~same).withColumn("change", change).drop("in_old", "in_new")


@F.pandas_udf(T.ArrayType(T.StringType()))
def line_diff(old: pd.Series, new: pd.Series, old_name: pd.Series, new_name: pd.Series) -> pd.Series:
    rows = zip(old, new, old_name, new_name, strict=True)
    return pd.Series([list(difflib.unified_diff((a or "").splitlines(), (b or "").splitlines(), x or "", y or "", lineterm="")) for a, b, x, y in rows])


def with_diff(found: DataFrame, form: str = "dd MMM yyyy HH:mm:ss") -> DataFrame:
    """Add ``diff``, the unified diff of renamed and modified pages; titles and times head it."""
    head = lambda side: F.concat_ws("\t", f"{side}_title", F.date_format(f"{side}_timestamp", form))
    edited = F.col("change").isin("renamed", "modified") & ~F.col("old_content").eqNullSafe(F.col("new_content"))
    return found.withColumn("diff", F.when(edited, line_diff("old_content", "new_content", head("old"), head("new"))))


def log_lines(found: DataFrame) -> DataFrame:
    """(pageid, at, line): the change log as text."""
    link = lambda c: F.concat(F.lit("[["), c, F.lit("]]"))
    head = (
        F.when(F.col("change") == "added", F.concat(link(F.col("new_title")), F.lit(" added.")))
        .when(F.col("change") == "removed", F.concat(link(F.col("old_title")), F.lit(" removed.")))
        .when(F.col("change") == "renamed", F.concat(link(F.col("old_title")), F.lit(" renamed to "), link(F.col("new_title")), F.lit(".")))
        .otherwise(F.concat(link(F.col("new_title")), F.lit(" modified.")))
    )
    return found.select("pageid", F.posexplode(F.concat(F.array(head), F.coalesce("diff", F.array().cast("array<string>")))).alias("at", "line"))
