"""Quotation linking: messages without their quotes, in reply order (DataFrame functions only).

A line that starts with ``>`` marks is quoted at the level that their number gives.  Neighbouring lines of one level are
a passage.  Passages and their lines are normalised (lower case, letters and digits, single blanks), hashed and joined, within
their conversation, to the messages that came earlier and have them as own text: a line, a paragraph or the whole.
Each unit votes, by its words, for the latest such message; a passage links to the one with most votes, the latest of
equals, and a message replies to the link of its level-1 passages with most votes.

Reply order is (root, depth, turn): a message that quotes nothing known is its own root.  The latest earlier source is
found as a running maximum over ranges of turns, so neither a conversation with very many turns nor a line that all of
them repeat meets in one task; roots come from pointer doubling.

Cases: null or empty texts have no quotes; a null turn neither quotes nor is quoted and sorts first; null conversations
are one of their own; repeated rows are kept and get the same links; turns are compared, so ties of two rows of one turn
don't quote each other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import scratch

MARK = r"^[ \t]*>"
MARKS = r"^((?:[ \t]*>)+)"
#: Turns in a range.
RANGE = 256


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def parsed(text: Column) -> Column:
    """An array of (level, body) of the lines."""

    def line(x):
        marks = F.regexp_extract(x, MARKS, 1)
        return F.struct((F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))).alias("level"), F.regexp_replace(x, MARKS + "[ \t]?", "").alias("body"))

    return F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), line)


def own_text(lines: Column) -> Column:
    """The lines that aren't quoted; runs of blank lines that the quotes leave become one, at the ends none."""
    text = F.array_join(F.transform(F.filter(lines, lambda x: x["level"] == 0), lambda x: x["body"]), "\n")
    return F.regexp_replace(F.regexp_replace(text, r"^(?:[ \t]*\n)+|(?:\n[ \t]*)+\z", ""), r"\n(?:[ \t]*\n){2,}", "\n\n")


def units(messages: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """One row for each different message, with its parsed lines, written once."""
    c = F.col(f"`{conv}`")
    rows = messages.select(c.alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), F.col(f"`{role}`").alias("role"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = rows.groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("times"))
    rows = rows.withColumn("c", F.concat(F.col("conv").isNull().cast("string"), F.coalesce(F.col("conv").cast("string"), F.lit("")))).withColumn("m", F.xxhash64("role", "text"))
    quotes = F.col("text").contains(">") & F.col("text").rlike("(?m)" + MARK)
    lines = F.when(quotes, parsed(F.col("text")))
    return scratch(rows.withColumn("lines", lines).withColumn("own", F.when(F.col("lines").isNull(), F.col("text")).otherwise(own_text(F.col("lines")))))


def passages(rows: DataFrame) -> DataFrame:
    """(c, turn, m, passage, level, units) of the quoted passages; units are their normalised text and lines."""
    lines = rows.where("lines is not null and turn is not null").select("c", "turn", "m", F.posexplode("lines").alias("at", "line"))
    lines = lines.select("c", "turn", "m", "at", "line.level", "line.body")
    w = W.partitionBy("c", "turn", "m").orderBy("at")  # the lines of a message
    lines = lines.withColumn("new", (F.col("level") != F.lag("level", 1, -1).over(w)).cast("int")).withColumn("passage", F.sum("new").over(w)).where("level > 0")
    whole = lines.groupBy("c", "turn", "m", "passage", "level").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "body"))), lambda x: x["body"]).alias("b"))
    found = F.array_distinct(F.concat(F.array(normal(F.array_join("b", " "))), F.transform("b", normal)))
    return whole.select("c", "turn", "m", "passage", "level", F.filter(found, lambda x: x != "").alias("units"))


def weight(unit: Column) -> Column:
    return F.size(F.split(unit, " ")).cast("long")


def latest_source(asked: DataFrame, given: DataFrame) -> DataFrame:
    """``asked`` (c, hash, turn) with ``source``, the greatest turn below it among ``given`` (c, hash, turn), where there is one."""
    both = asked.select("c", "hash", "turn", F.lit(None).cast("long").alias("src")).distinct().unionByName(given.select("c", "hash", "turn", F.col("turn").alias("src")).distinct())
    both = both.withColumn("r", F.floor(F.col("turn") / RANGE))
    ranges = both.groupBy("c", "hash", "r").agg(F.max("src").alias("top"))
    ranges = ranges.select("c", "hash", "r", F.max("top").over(W.partitionBy("c", "hash").orderBy("r").rowsBetween(W.unboundedPreceding, -1)).alias("older"))
    within = W.partitionBy("c", "hash", "r").orderBy("turn").rangeBetween(W.unboundedPreceding, -1)
    both = both.withColumn("near", F.max("src").over(within)).where("src is null").join(ranges, ["c", "hash", "r"])
    return both.select("c", "hash", "turn", F.coalesce("near", "older").alias("source")).where("source is not null")


def links(rows: DataFrame) -> DataFrame:
    """(c, turn, m, passage, level, source, votes) of the passages; source is null where nothing known is quoted."""
    quoted = scratch(passages(rows))
    asked = quoted.select("c", "turn", "m", "passage", "level", F.explode("units").alias("unit")).select("*", F.xxhash64("unit").alias("hash"), weight(F.col("unit")).alias("w"))
    own = rows.where("turn is not null and own is not null").join(quoted.select("c").distinct(), "c", "left_semi")
    parts = F.concat(F.array("own"), F.split("own", r"\n[ \t]*\n"), F.split("own", "\n"))
    given = own.select("c", "turn", F.explode(F.array_distinct(F.filter(F.transform(parts, normal), lambda x: x != ""))).alias("unit")).select("c", "turn", F.xxhash64("unit").alias("hash"))
    given = given.join(asked.select("c", "hash").distinct(), ["c", "hash"], "left_semi")
    votes = asked.join(latest_source(asked, given), ["c", "hash", "turn"]).groupBy("c", "turn", "m", "passage", "source").agg(F.sum("w").alias("votes"))
    best = votes.groupBy("c", "turn", "m", "passage").agg(F.max(F.struct("votes", "source")).alias("best"))
    return quoted.drop("units").join(best, ["c", "turn", "m", "passage"], "left").select("c", "turn", "m", "passage", "level", "best.source", "best.votes")


def roots(parents: DataFrame) -> DataFrame:
    """(c, turn, root, depth) from (c, turn, up), up below turn; each round doubles the way that has been gone."""
    now = scratch(parents.groupBy("c", "turn").agg(F.max("up").alias("root")).withColumn("depth", F.lit(1).cast("long")))
    while True:
        ahead = now.select("c", F.col("turn").alias("root"), F.col("root").alias("r2"), F.col("depth").alias("d2"))
        joined = now.join(ahead, ["c", "root"], "left")
        after = scratch(joined.select("c", "turn", F.coalesce("r2", "root").alias("root"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"), F.col("r2").isNotNull().alias("moved")))
        if after.where("moved").isEmpty():
            return after.drop("moved")
        now = after.drop("moved")


def thread(messages: DataFrame, conv="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """Each message without its quotes, in reply order: ``text``, ``n_quotes``, ``n_linked``, ``levels``, ``parent_turn``, ``root_turn``, ``depth``."""
    rows = units(messages, conv, turn, role, text)
    found = scratch(links(rows))
    per = found.groupBy("c", "turn", "m").agg(F.count(F.lit(1)).alias("n_quotes"), F.count("source").alias("n_linked"), F.max("level").cast("int").alias("levels"))
    ups = found.where("level = 1 and source is not null").groupBy("c", "turn", "m", "source").agg(F.sum("votes").alias("v")).groupBy("c", "turn", "m").agg(F.max(F.struct("v", "source"))["source"].alias("up"))
    ups = scratch(ups)
    out = rows.join(per, ["c", "turn", "m"], "left").join(ups, ["c", "turn", "m"], "left")
    tops = roots(ups).select("c", F.col("turn").alias("up"), F.col("root").alias("up_root"), F.col("depth").alias("up_depth"))
    out = out.join(tops, ["c", "up"], "left")
    out = out.select(
        F.col("conv").alias(conv),
        F.col("turn").alias(turn),
        F.col("role").alias(role),
        F.col("own").alias(text),
        F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.coalesce("levels", F.lit(0)).alias("levels"),
        F.col("up").alias("parent_turn"),
        F.coalesce("up_root", "up", "turn").alias("root_turn"),
        F.when(F.col("up").isNull(), 0).otherwise(F.coalesce("up_depth", F.lit(0)) + 1).cast("long").alias("depth"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("copy"),
    )
    return out.repartitionByRange(conv, "root_turn", "depth", turn).sortWithinPartitions(conv, "root_turn", "depth", turn, "copy").drop("copy")
