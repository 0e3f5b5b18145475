"""Quality rules whose cutoffs carry a guarantee (DataFrame functions only).

Four rules each compare a share with a cutoff.  On the labelled rows of a stratum, the cutoffs of a fixed grid are
tested from the mildest on: the null hypothesis "this cutoff rejects more than ``limit / rules`` of the good documents
of the stratum" is rejected if the exact binomial tail P(X <= k) at that rate is at most ``delta / (strata * rules)``
(Bonferroni over strata and rules; within a rule the fixed sequence stops at the first cutoff that isn't certified and
needs no more correction).  So with probability 1 - delta no stratum loses more than ``limit`` of its good documents.
Of the certified cutoffs the mildest with the greatest gain (bad ones rejected, less ``price`` times the good ones) is used.

Cases: a null text has no words and fails the base test; a null stratum is a stratum of its own; strata without enough
labels have no certified cutoff and keep all that pass the base test; labels that are null, or of unknown documents, are
ignored; an empty table gives an empty result; repeated rows get the same verdict; other columns are carried untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import scratch, words_of

RULES = ("symbols", "shouting", "dup_lines", "repeats")
#: Mildest first.
CUTOFFS = (0.9, 0.75, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.075, 0.05, 0.03, 0.02, 0.01)
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LIMIT, DELTA, PRICE = 0.05, 0.1, 5


def let(value: Column, then) -> Column:
    """``then(value)``, with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def repeat_words(words: Column) -> Column:
    """Words that lie in a 5-word window which is found twice or more.

    Windows are compared by 64-bit hashes of the five words.  Texts whose windows all differ stop there; in the others
    (hash, position) pairs are sorted, those equal to a neighbour marked, and the union of their spans measured.
    """

    def spans(at: Column) -> Column:
        steps = F.transform(at, lambda x, k: F.least(F.lit(5), F.coalesce(F.get(at, k + 1) - x, F.lit(5))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def marked(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        at = F.transform(s, lambda x, i: F.when(same(x, i - 1) | same(x, i + 1), x["i"]))
        return let(F.array_sort(F.filter(at, lambda p: p.isNotNull())), spans)

    def hashed(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(pairs, marked))

    windows = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - 4), lambda i: F.xxhash64(F.slice(w, i, 5)))
    return let(words, lambda w: F.when(F.size(w) < 5, F.lit(0).cast("long")).otherwise(let(windows(w), hashed)))


def measures(text: Column) -> Column:
    """A struct of the base columns and what the rules compare."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    words = words_of(t)
    solid = F.translate(t, " \t\n\x0b\x0c\r", "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("r")))
    return F.struct(
        counts.alias("c"),
        F.length(solid).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length(t) - F.length(F.translate(t, CAPITALS, ""))).cast("long").alias("n_capitals"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("l"),
    )


def measured(docs: DataFrame, text_col: str, stratum_col: str, id_col: str, carry: list[str]) -> DataFrame:
    """``row`` (the columns to carry), ``id``, ``stratum`` and the measures; written once, as they are read twice."""
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"),
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{stratum_col}`").cast("string").alias("stratum"),
        measures(F.col(f"`{text_col}`")).alias("m"),
    )
    n, share = F.col("m.c.n"), lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    rows = rows.select(
        "row",
        "id",
        "stratum",
        n.alias("n_words"),
        F.col("m.word_chars").alias("word_chars"),
        F.col("m.n_symbols").alias("n_symbols"),
        F.col("m.l.dup").alias("n_dup_lines"),
        F.col("m.c.r").alias("n_repeat_words"),
        F.array(share(F.col("m.n_symbols"), F.col("m.word_chars")), share(F.col("m.n_capitals"), F.col("m.word_chars")), share(F.col("m.l.dup"), F.col("m.l.n")), share(F.col("m.c.r"), n)).alias("shares"),
    )
    failed = (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words"))
    return scratch(rows.withColumn("base_failed", failed))


def tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of a binomial; 1 where k is not below the mean, as it is then no evidence.  Summed as logarithms."""
    step = lambda s, j: F.struct(
        (s["lp"] + F.log((n - j) / (j + F.lit(1.0))) + F.log(F.lit(p / (1 - p)))).alias("lp"),
        (F.greatest(s["sum"], s["lp"]) + F.log1p(F.exp(-F.abs(s["sum"] - s["lp"])))).alias("sum"),
    )
    first = n * F.log(F.lit(1 - p))
    start = F.struct((first + F.log(n.cast("double")) + F.log(F.lit(p / (1 - p)))).alias("lp"), first.alias("sum"))
    total = F.aggregate(F.when(k < 1, F.array().cast("array<bigint>")).otherwise(F.sequence(F.lit(1).cast("long"), k)), start, step, lambda s: F.exp(s["sum"]))
    return F.when((n <= 0) | (k >= n * F.lit(p)), F.lit(1.0)).otherwise(total)


def cutoffs(rows: DataFrame, labels: DataFrame, limit: float, delta: float, price: float) -> DataFrame:
    """``stratum`` and ``cut``: the rules' cutoffs in order, 2.0 (never rejects) where none is certified."""
    marks = labels.select(F.col("doc_id").alias("__l"), F.col("quality").cast("int").alias("good")).where("good is not null and __l is not null").distinct()
    seen = rows.select("id", F.coalesce(F.concat(F.lit("="), "stratum"), F.lit("")).alias("s"), "shares", "base_failed").where("not base_failed")
    # How many of the cutoffs a share exceeds; the grid falls, so it exceeds the last ones.
    over = lambda x: sum((x > F.lit(c)).cast("int") for c in CUTOFFS)
    each = seen.join(marks, seen["id"] == marks["__l"]).select("s", "good", F.posexplode(F.transform("shares", over)).alias("rule", "over"))
    cells = each.groupBy("s", "rule", "over").agg(F.sum((F.col("good") > 0).cast("long")).alias("g"), F.sum((F.col("good") <= 0).cast("long")).alias("b"))
    per = W.partitionBy("s", "rule")
    grid = cells.select("s", "rule").distinct().select("s", "rule", F.explode(F.array(*[F.lit(i) for i in range(len(CUTOFFS))])).alias("i"))
    # Cutoff i rejects the rows whose share exceeds at least len - i of the cutoffs.
    full = grid.withColumn("over", F.lit(len(CUTOFFS)) - F.col("i")).join(cells, ["s", "rule", "over"], "left").fillna(0, ["g", "b"])
    zero = cells.where("over = 0").select("s", "rule", F.col("g").alias("g0"))
    upto = per.orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    full = full.join(zero, ["s", "rule"], "left").select("s", "rule", "i", F.sum("g").over(upto).alias("k"), F.sum("b").over(upto).alias("hit"), (F.sum("g").over(per) + F.coalesce("g0", F.lit(0))).alias("n"))
    strata = rows.select(F.coalesce(F.concat(F.lit("="), "stratum"), F.lit("")).alias("s")).distinct().agg(F.count("s").alias("strata"))
    full = full.crossJoin(F.broadcast(strata))  # one row
    ok = tail(F.col("k"), F.col("n"), limit / len(RULES)) <= F.lit(delta / len(RULES)) / F.col("strata")
    full = full.withColumn("ok", ok.cast("int")).withColumn("ok", F.min("ok").over(upto) == 1).where("ok")
    best = full.withColumn("gain", F.col("hit") - F.lit(price) * F.col("k")).where("gain > 0").groupBy("s", "rule").agg(F.min_by("i", F.struct(-F.col("gain"), F.col("i"))).alias("i"))
    value = F.element_at(F.array(*[F.lit(c) for c in CUTOFFS]), F.col("i") + 1)
    return best.groupBy("s").agg(*[F.coalesce(F.max(F.when(F.col("rule") == r, value)), F.lit(2.0)).alias(f"c{r}") for r in range(len(RULES))]).select("s", F.array(*[f"c{r}" for r in range(len(RULES))]).alias("cut"))


def judged(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", stratum_col="lang", limit=LIMIT, delta=DELTA, price=PRICE, carry: list[str] | None = None) -> DataFrame:
    """The measured rows with ``kept``.  The cutoffs are a written table of a row for each stratum, so that Spark knows
    its size and broadcasts it only if that is under the session's threshold."""
    rows = measured(docs, text_col, stratum_col, id_col, docs.columns if carry is None else carry)
    cuts = scratch(cutoffs(rows, labels, limit, delta, price))
    rows = rows.withColumn("s", F.coalesce(F.concat(F.lit("="), "stratum"), F.lit(""))).join(cuts, "s", "left")
    hit = F.coalesce(F.exists(F.zip_with("shares", "cut", lambda a, c: a > c), lambda x: x), F.lit(False))
    return rows.withColumn("kept", ~F.col("base_failed") & ~hit)


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns."""
    return judged(docs, labels, **options).where("kept").select("row.*")


def digest(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The contract's columns, one row for each row of ``docs``."""
    return judged(docs, labels, carry=["doc_id"], **options).select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
