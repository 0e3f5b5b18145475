"""From flat pages to entities: the infobox is read in Python, everything after it is columns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import monikers, split_name, without_parenthesis
from ..functions.wikitext import Dims, record
from ..schemas import RELATIVES

_BOX = (
    "id bigint, title string, has_template boolean, has_box boolean, deleted boolean, unnamed boolean, died boolean, aliases array<string>, titles array<string>, books array<string>, "
    "abilities array<string>, world string, universe string, residence string, nationality string, ethnicity string, species string, subspecies string, family string, profession string, "
    "groups string, relatives map<string,array<string>>, blank boolean"
)
_NAMES = [c.split()[0] for c in _BOX.split(", ")]
_KINDS = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "map<string,array<string>>": pa.map_(pa.string(), pa.list_(pa.string()))}
_ARROW = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in _BOX.split(", ")])
#: Boxes that are given back at once.
BATCH = 2000


def boxes(pages: DataFrame, dims: Dims) -> DataFrame:
    """What the infoboxes of (pageid, title, content) say.

    Reading a box costs far more than moving a page, and snapshots lie in a few files, or in one; so the pages are dealt out first, in a
    fixed number of parts, as Spark would merge small ones again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for pageid, title, content in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                got = record(content, dims) if content else {}
                got |= {"id": pageid, "title": title, "blank": not content, "relatives": [(k, got.get(k, [])) for k in RELATIVES]}
                got["unnamed"], got["died"] = "unnamed" in got, "died" in got
                rows.append([got.get(c) for c in _NAMES])
            for at in range(0, len(rows), BATCH):
                yield pa.record_batch([list(c) for c in zip(*rows[at : at + BATCH], strict=True)], schema=_ARROW)

    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pages.select("pageid", "title", "content").repartition(parts, "pageid").mapInArrow(run, _BOX)


def entities(pages: DataFrame, dims: Dims, universe: str) -> DataFrame:
    """The entities that are kept, one row each.

    A page goes if its title is a user's, if it has a template but no infobox or a deletion mark, if its universe is
    another, or if it has content without any template.  An empty page stays, with its name only.
    """
    raw = boxes(pages, dims)
    common, surname = split_name(F.col("title"), list(dims.titles))
    none = F.array().cast("array<string>")
    keep = ~F.col("title").contains("User:") & (F.col("blank") | (F.col("has_template") & F.col("has_box") & ~F.col("deleted") & (F.lower(F.coalesce("universe", F.lit(""))) == universe.lower())))
    blank = lambda c: F.when(F.col("blank"), "").otherwise(c)
    out = raw.where(keep).select(
        "id",
        without_parenthesis(F.col("title")).alias("name"),
        blank(common).alias("common_name"),
        blank(surname).alias("surname"),
        "unnamed",
        (~F.col("died")).alias("living"),
        *[F.coalesce(c, none).alias(c) for c in ("aliases", "titles")],
        "world",
        *[F.coalesce(c, none).alias(c) for c in ("books", "abilities")],
        *["residence", "nationality", "ethnicity", "species", "subspecies", "family", "relatives"],
        F.struct("profession", F.coalesce("groups", F.lit("")).alias("groups"), F.when(F.col("title").contains("("), F.col("title")).otherwise("").alias("original_name")).alias("misc"),
    )
    return with_monikers(out)


def with_monikers(rows: DataFrame) -> DataFrame:
    return rows.withColumn("monikers", monikers(*[F.col(c) for c in ("name", "common_name", "surname", "aliases", "titles")]))


def overridden(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Apply (name, world or null, action, field, value): append, remove, set or drop.  Rules of an entity apply in any order, as they touch different values."""
    keyed = rows.select("id", F.col("name").alias("n"), F.col("world").alias("w"))
    hit = keyed.join(rules, (F.col("n") == F.col("name")) & (rules["world"].isNull() | (F.col("w") == rules["world"]))).drop("name", "world")
    pick = lambda action, f: F.collect_list(F.when((F.col("action") == action) & (F.col("field") == f), F.col("value")))
    folded = hit.groupBy("id").agg(
        F.bool_or(F.col("action") == "drop").alias("__drop"),
        *[pick("append", f).alias(f"__a_{f}") for f in ("aliases", "titles")],
        *[pick("remove", f).alias(f"__r_{f}") for f in ("aliases", "titles")],
        *[F.max(F.when((F.col("action") == "set") & (F.col("field") == f), F.col("value"))).alias(f"__s_{f}") for f in ("name", "common_name", "surname")],
    )
    out = rows.join(folded, "id", "left").where(~F.coalesce("__drop", F.lit(False)))
    none = F.array().cast("array<string>")
    for f in ("aliases", "titles"):
        out = out.withColumn(f, F.concat(F.array_except(f, F.coalesce(f"__r_{f}", none)), F.coalesce(f"__a_{f}", none)))
    for f in ("name", "common_name", "surname"):
        out = out.withColumn(f, F.coalesce(f"__s_{f}", f))
    return with_monikers(out.select(*[c for c in rows.columns if c != "monikers"]))


def properties(rows: DataFrame) -> DataFrame:
    """The node attributes of a graph."""
    nickname = F.when(F.col("common_name") != F.col("name"), F.col("common_name")).otherwise("")
    return rows.select(
        "id", "name", nickname.alias("nickname"), "aliases", "monikers", "living", "family", "world", "books", "abilities", "residence", "nationality", "ethnicity", "species", "subspecies"
    )
