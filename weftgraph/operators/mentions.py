"""From chapters to tokens, mentions and their resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..schemas import LINES_AFTER, LINES_BEFORE, RUN_SIZE
from .components import written


def tokenise(chapters: DataFrame) -> DataFrame:
    """(key, chapter, pos, token) from (key, chapter, text); empty tokens are dropped before they are numbered."""
    return chapters.select("key", "chapter", F.posexplode(tokens(F.col("text"))).alias("pos", "token"))


def lookahead(toks: DataFrame) -> DataFrame:
    """Add the one-, two- and three-token n-grams at each position.

    ``ahead`` comes with the token array where ``chapters`` are at hand; over a token table, a window within the chapter.
    Past the end of a chapter n-grams are padded with blanks, which no moniker has.
    """
    w = W.partitionBy("key", "chapter").orderBy("pos")
    a, b = F.lead("token", 1, "").over(w), F.lead("token", 2, "").over(w)
    return toks.select("*", F.concat_ws(" ", "token", a).alias("two"), F.concat_ws(" ", "token", a, b).alias("three"), F.concat_ws(" ", a, b).alias("next_two"), a.alias("next_one"))


def ngrams(chapters: DataFrame) -> DataFrame:
    """What ``lookahead`` gives, made from the array of tokens without a shuffle."""
    rows = context(chapters)
    zipped = F.arrays_zip("t", F.slice(F.concat("t", F.array(F.lit(""))), 2, F.greatest(F.size("t"), F.lit(1))).alias("a"), F.slice(F.concat("t", F.array(F.lit(""), F.lit(""))), 3, F.greatest(F.size("t"), F.lit(1))).alias("b"))
    # A filter on the array, which Spark also infers from an inner explode, would make the tokens once more.
    out = rows.select("key", "chapter", F.size("t").alias("n_tokens"), F.posexplode_outer(zipped).alias("pos", "z")).where("pos is not null")
    return out.select(
        "key", "chapter", "n_tokens", "pos", F.col("z.t").alias("token"), F.concat_ws(" ", "z.t", "z.a").alias("two"), F.concat_ws(" ", "z.t", "z.a", "z.b").alias("three"), F.concat_ws(" ", "z.a", "z.b").alias("next_two"), F.col("z.a").alias("next_one")
    )


def candidates(lexicon: DataFrame, entities: DataFrame) -> DataFrame:
    """(moniker, cands): ids with the books they are present in, by id.  The lexicon is a dimension; Spark broadcasts it below its threshold."""
    return lexicon.join(entities.select("id", "books"), "id").groupBy("moniker").agg(F.array_sort(F.collect_list(F.struct("id", "books"))).alias("cands"))


def mentions(grams: DataFrame, lexicon: DataFrame, titles: list[str]) -> DataFrame:
    """(key, chapter, pos, step, kind, ids, moniker) at the positions where something is found.

    Three words win over two, two over a title, a title over one word, whoever is present in the book; ``ids`` are the
    entities that are.  A title counts only if neither the next word nor the next two are monikers.  ``lexicon`` is (moniker, cands).
    Only positions whose word begins a moniker or is a title are looked up, and candidates are read where a moniker has been found.
    """
    title = F.col("token").isin(titles) if titles else F.lit(False)
    monikers = lexicon.select("moniker")
    first = monikers.select(F.substring_index("moniker", " ", 1).alias("token"))
    if titles:
        first = first.unionByName(lexicon.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, titles))).alias("token")))
    grams = grams.join(written(first.distinct()), "token", "left_semi")
    for k, col in ((3, "three"), (2, "two"), (1, "token")):
        grams = grams.join(monikers.toDF(f"m{k}"), F.col(col) == F.col(f"m{k}"), "left")
    for col in ("next_one", "next_two"):
        grams = grams.join(monikers.toDF(f"k_{col}"), (F.col(col) == F.col(f"k_{col}")) & title, "left")
    kind = F.when(F.col("m3").isNotNull(), 3).when(F.col("m2").isNotNull(), 2).when(title, F.when(F.col("k_next_one").isNull() & F.col("k_next_two").isNull(), 0)).when(F.col("m1").isNotNull(), 1)
    moniker = F.when(F.col("kind") == 3, F.col("three")).when(F.col("kind") == 2, F.col("two")).otherwise(F.col("token"))
    found = grams.withColumn("kind", kind).where("kind is not null").select("key", "chapter", "n_tokens", "pos", "kind", moniker.alias("moniker"))
    found = found.join(lexicon.select(F.col("moniker").alias("m"), "cands"), (F.col("moniker") == F.col("m")) & (F.col("kind") > 0), "left")
    book = F.split("key", "/")[0]
    present = F.transform(F.filter("cands", lambda c: F.array_contains(c["books"], book)), lambda c: c["id"])
    found = found.select("key", "chapter", "n_tokens", "pos", F.greatest("kind", F.lit(1)).alias("step"), "kind", F.coalesce(present, F.array().cast("array<bigint>")).alias("ids"), "moniker")
    return found.where("step > 1 or kind = 0 or size(ids) > 0")


def recalled(resolution: DataFrame, entities: DataFrame) -> DataFrame:
    """``resolution`` (key, chapter, pos, char_id) with ids that no entity has made null: whoever was meant is nobody now."""
    known = entities.select(F.col("id").alias("char_id"), F.lit(True).alias("here")).distinct()
    return resolution.join(known, "char_id", "left").select("key", "chapter", "pos", F.when(F.col("here"), F.col("char_id")).alias("char_id"))


def with_defaults(resolution: DataFrame, found: DataFrame, defaults: DataFrame) -> DataFrame:
    """``resolution`` and, for questions that it leaves open, the id that ``defaults`` (moniker, char_id) gives to a moniker of several entities."""
    asked = found.where("kind > 0 and size(ids) > 1").join(defaults, "moniker").select("key", "chapter", F.col("pos").cast("int").alias("pos"), "char_id")
    own = resolution.select("key", "chapter", F.col("pos").cast("int").alias("pos"), "char_id")
    return own.unionByName(asked.join(own, ["key", "chapter", "pos"], "left_anti"))


def merged(old: DataFrame, answers: DataFrame) -> DataFrame:
    """``old`` with ``answers``, which win; both (key, chapter, pos, char_id)."""
    return old.join(answers, ["key", "chapter", "pos"], "left_anti").unionByName(answers)


def resolved(found: DataFrame, resolution: DataFrame | None = None) -> DataFrame:
    """Add ``hit`` (an id or null) and ``open`` (asked for and not answered).

    One candidate is taken; several, and titles, are looked up in (key, chapter, pos, char_id), where a null id means
    nobody and a missing row that the question is open.  Ids that no entity has are to be made null before (``recalled``).
    """
    asked = (F.col("kind") == 0) | (F.size("ids") > 1)
    if resolution is None:
        out = found.withColumn("char_id", F.lit(None).cast("bigint")).withColumn("known", F.lit(None).cast("boolean"))
    else:
        out = found.join(resolution.select("key", "chapter", F.col("pos").cast("int").alias("pos"), "char_id", F.lit(True).alias("known")), ["key", "chapter", "pos"], "left")
    hit = F.when(asked, F.col("char_id")).when(F.size("ids") == 1, F.get("ids", F.lit(0)))
    return out.withColumn("hit", hit).withColumn("open", asked & F.col("known").isNull()).drop("char_id", "known")


def pending(found: DataFrame, resolution: DataFrame, chapters: DataFrame) -> DataFrame:
    """Open questions with the 25-token lines around them, to be answered in a resolution table."""
    ask = resolved(found, resolution).where("open").select("key", "chapter", "pos", "kind", "ids")
    return ask.join(context(chapters), ["key", "chapter"]).select("key", "chapter", "pos", "kind", "ids", *around(F.col("t"), F.col("pos")))


def context(chapters: DataFrame) -> DataFrame:
    return chapters.select("key", "chapter", tokens(F.col("text")).alias("t"))


def around(t, pos, before: int = LINES_BEFORE, after: int = LINES_AFTER, size: int = RUN_SIZE) -> list:
    """The run from ``pos`` as a line, and the lines before and after it; blank ones are dropped."""
    n = F.size(t)
    line = lambda a, b: F.array_join(F.slice(t, F.least(F.greatest(a, F.lit(0)), n) + 1, F.greatest(F.least(b, n) - F.least(F.greatest(a, F.lit(0)), n), F.lit(0))), " ")
    full = lambda a, k: F.filter(F.array(*[line(a + i * size, a + (i + 1) * size) for i in range(k)]), lambda x: x != "")
    return [full(pos - before * size, before).alias("prev"), line(pos, pos + size).alias("run"), full(pos + size, after).alias("next")]
