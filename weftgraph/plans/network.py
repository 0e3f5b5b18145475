"""Queries over texts: tokens, lexicon, mentions, runs and co-occurrence.

``documents`` stand for chapters: ``source`` is the book, ``doc_id`` the chapter.  The lexicon is made of the frequent
capitalised n-grams; ids are ranks, every third moniker is also the next one's, and an entity is absent from a fourth of the books.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import graph, lexicon, mentions, runs
from ..operators.components import written
from ..sources.graphs import ordinals
from ..sources.pages import paragraphs

TITLES = ["The", "Of", "And"]
LEAST = (20, 12, 5)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chapters(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("source").alias("key"), F.col("doc_id").cast("string").alias("chapter"), F.coalesce("text", F.lit("")).alias("text"))


def stand_in(spark, sf_dir, least=LEAST) -> DataFrame:
    """(moniker, id)."""
    grams = mentions.ngrams(chapters(spark, sf_dir)).where(F.col("token").rlike("^[A-Z][a-z]+$"))
    each = grams.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("moniker")) for k, c in ((1, "token"), (2, "two"), (3, "three"))])).alias("g")).select("g.*")
    each = each.where(~F.col("moniker").endswith(" "))  # those that a chapter's end cuts short
    often = each.groupBy("k", "moniker").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= F.element_at(F.array(*[F.lit(x) for x in least]), F.col("k")))
    ranked = ordinals(often.select(F.col("moniker").alias("id"))).select(F.col("id").alias("moniker"), F.col("ordinal").alias("id"))
    return ranked.unionByName(ranked.where("id % 3 = 0").select("moniker", (F.col("id") + 1).alias("id")))


def entities(spark, sf_dir, lex: DataFrame) -> DataFrame:
    books = read(spark, sf_dir, "documents").select("source").distinct().agg(F.array_sort(F.collect_list("source")).alias("all"))
    number = lambda s: F.regexp_extract(s, r"(\d+)", 1).cast("int")
    return lex.select("id").distinct().crossJoin(F.broadcast(books)).select("id", F.filter("all", lambda s: (F.col("id") + number(s)) % 4 != 0).alias("books"))


def found(spark, sf_dir, lex: DataFrame | None = None) -> DataFrame:
    """The lexicon is written once, as it is joined five times; Spark then knows its size and broadcasts it if it is small."""
    lex = lex or written(stand_in(spark, sf_dir))
    cands = written(mentions.candidates(lex, entities(spark, sf_dir, lex)))
    return mentions.mentions(mentions.ngrams(chapters(spark, sf_dir)), cands, TITLES)


def answers(hits: DataFrame) -> DataFrame:
    """A resolution table: nobody at every third position, else one of the candidates in turn."""
    asked = hits.where((F.col("kind") == 0) | (F.size("ids") > 1))
    pick = F.when(F.col("kind") == 0, F.col("pos") % 50).otherwise(F.get("ids", (F.col("pos") % F.greatest(F.size("ids"), F.lit(1))).cast("int")))
    return asked.select("key", "chapter", "pos", F.when(F.col("pos") % 3 != 0, pick).cast("bigint").alias("char_id"))


def walked(spark, sf_dir) -> DataFrame:
    hits = written(found(spark, sf_dir))
    return runs.runs(mentions.resolved(hits, answers(hits)))


def tokenise(spark, sf_dir):
    return mentions.tokenise(chapters(spark, sf_dir)).select("chapter", "pos", "token")


def ngram_lookahead(spark, sf_dir):
    return mentions.ngrams(chapters(spark, sf_dir)).select("chapter", "pos", "token", "two", "three")


def html_paragraphs(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", paragraphs(F.col("html")).alias("text"))


def html_tokens(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", tokens(paragraphs(F.col("html"))).alias("t"))
    return pages.select("page_id", F.size("t").cast("bigint").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


def lexicon_build(spark, sf_dir):
    return lexicon.grouped(stand_in(spark, sf_dir)).select("moniker", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


def lexicon_exact(spark, sf_dir):
    lex = stand_in(spark, sf_dir)
    return lexicon.exact(lex, "The").select("moniker", "id")


def lexicon_prefix(spark, sf_dir):
    return lexicon.prefix(stand_in(spark, sf_dir), "Th").select("moniker", "id")


def lexicon_size(spark, sf_dir):
    return lexicon.size(stand_in(spark, sf_dir))


def mention_ladder(spark, sf_dir):
    return found(spark, sf_dir).select("key", "chapter", "pos", "step", "kind", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


def resolution_join(spark, sf_dir):
    hits = written(found(spark, sf_dir))
    return mentions.resolved(hits, answers(hits)).select("chapter", "pos", "hit", "open")


def resolution_recall(spark, sf_dir):
    """Answers of which every fifth position's is an id that no entity has: nobody."""
    lex = written(stand_in(spark, sf_dir))
    hits = written(found(spark, sf_dir, lex))
    stale = answers(hits).withColumn("char_id", F.when(F.col("pos") % 5 == 0, F.col("char_id") + 1000000).otherwise(F.col("char_id")))
    return mentions.resolved(hits, mentions.recalled(stale, lex)).select("chapter", "pos", "hit", "open")


def resolution_defaults(spark, sf_dir):
    """Every third position is answered; monikers of several entities have their greatest id as default, and what is left stays open."""
    lex = written(stand_in(spark, sf_dir))
    hits = written(found(spark, sf_dir, lex))
    usual = lex.groupBy("moniker").agg(F.max("id").alias("char_id"))
    known = answers(hits).where("pos % 3 = 1")
    return mentions.resolved(hits, mentions.with_defaults(known, hits, usual)).select("chapter", "pos", "hit", "open")


def pending_questions(spark, sf_dir):
    hits = written(found(spark, sf_dir))
    known = answers(hits).where("char_id is not null")
    out = mentions.pending(hits, known, chapters(spark, sf_dir))
    return out.select("chapter", "pos", F.array_join("prev", "|").alias("prev"), "run", F.array_join("next", "|").alias("next"))


def run_walk(spark, sf_dir):
    return walked(spark, sf_dir).select("chapter", "idx", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


def cooccurrence_rollup(spark, sf_dir):
    pairs = runs.pairs(walked(spark, sf_dir)).withColumn("series", F.concat(F.lit("s"), (F.regexp_extract("key", r"(\d+)", 1).cast("int") % 3).cast("string")))
    return graph.rollup(pairs)


def cooccurrence_book(spark, sf_dir):
    """Edges of each book, light ones pruned but for those of entity 13."""
    pairs = runs.pairs(walked(spark, sf_dir))
    return graph.heavy(graph.weighted(pairs, "key"), 2, (13,))


def context_window(spark, sf_dir):
    """The run in the middle of each chapter with the lines around it."""
    rows = mentions.context(chapters(spark, sf_dir)).withColumn("pos", F.floor(F.size("t") / 2).cast("int"))
    out = rows.select("chapter", "pos", *mentions.around(F.col("t"), F.col("pos")))
    return out.select("chapter", "pos", F.array_join("prev", "|").alias("prev"), "run", F.array_join("next", "|").alias("next"))


QUERIES = (
    tokenise, ngram_lookahead, html_paragraphs, html_tokens, lexicon_build, lexicon_exact, lexicon_prefix, lexicon_size, mention_ladder, resolution_join, resolution_recall, resolution_defaults,
    pending_questions, run_walk, cooccurrence_rollup, cooccurrence_book, context_window,
)

_CLEAN = r"""regexp_replace(regexp_replace(regexp_replace({x}, '[''’‘]s([^\p{{L}}\p{{N}}_]|$)', '\1', 'g'), '[''’‘]', '', 'g'), '[“”?!:;,.…\-–—~/•]', ' ', 'g')"""
_SPLIT = rf"list_filter(regexp_split_to_array({_CLEAN}, '\s+'), lambda w: w <> '')"
_TOKS = f"docs AS (SELECT source AS key, doc_id::VARCHAR AS chapter, {_SPLIT.format(x="coalesce(text, '')")} AS t FROM documents)"
_GRAMS = """grams AS (SELECT key, chapter, len(t)::INT AS n_tokens, (i - 1)::INT AS pos, t[i] AS token, coalesce(t[i + 1], '') AS next_one, coalesce(t[i + 1], '') || ' ' || coalesce(t[i + 2], '') AS next_two
  FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM docs))"""
_LEX = f"""counted AS (
    SELECT k, m, count(*) AS n FROM (SELECT unnest([{{'k': 1, 'm': token}}, {{'k': 2, 'm': token || ' ' || next_one}}, {{'k': 3, 'm': token || ' ' || next_two}}], recursive := true)
      FROM grams WHERE regexp_matches(token, '^[A-Z][a-z]+$')) WHERE m NOT LIKE '% ' GROUP BY ALL),
  ranked AS (SELECT m AS moniker, row_number() OVER (ORDER BY m) - 1 AS id FROM counted WHERE n >= ({list(LEAST)})[k]),
  lex AS (SELECT * FROM ranked UNION ALL SELECT moniker, id + 1 FROM ranked WHERE id % 3 = 0)"""
_BASE = f"WITH {_TOKS},\n{_GRAMS},\n{_LEX}"
_FOUND = f"""keyed AS (SELECT key, moniker, list(id ORDER BY id) FILTER ((id + regexp_extract(key, '(\\d+)', 1)::INT) % 4 <> 0) AS ids FROM lex, (SELECT DISTINCT key FROM docs) GROUP BY ALL),
  laddered AS (
    SELECT g.*, CASE WHEN a.moniker IS NOT NULL THEN 3 WHEN b.moniker IS NOT NULL THEN 2
        WHEN token IN ('The', 'Of', 'And') THEN CASE WHEN next_one NOT IN (SELECT moniker FROM lex) AND next_two NOT IN (SELECT moniker FROM lex) THEN 0 END
        WHEN c.moniker IS NOT NULL THEN 1 END AS kind, a.ids AS i3, b.ids AS i2, c.ids AS i1
    FROM grams g LEFT JOIN keyed a ON a.key = g.key AND a.moniker = token || ' ' || next_two LEFT JOIN keyed b ON b.key = g.key AND b.moniker = token || ' ' || next_one LEFT JOIN keyed c ON c.key = g.key AND c.moniker = token),
  found AS (
    SELECT key, chapter, n_tokens, pos, greatest(kind, 1) AS step, kind, coalesce(CASE kind WHEN 3 THEN i3 WHEN 2 THEN i2 WHEN 1 THEN i1 END, []) AS ids FROM laddered WHERE kind IS NOT NULL),
  hits AS (SELECT * FROM found WHERE step > 1 OR kind = 0 OR len(ids) > 0)"""
_LINE = "array_to_string(t[greatest({a}, 0) + 1:greatest({b}, 0)], ' ')"


def _around(pos: str) -> str:
    line = lambda a: _LINE.format(a=f"({pos} + {a})", b=f"({pos} + {a} + 25)")
    many = lambda at: "array_to_string(list_filter([" + ", ".join(line(a) for a in at) + "], lambda x: x <> ''), '|')"
    return f"{many((-100, -75, -50, -25))} AS prev, {line(0)} AS run, {many((25, 50, 75))} AS next"


_HTML = r"""array_to_string(list_transform(list_slice(regexp_split_to_array(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', '', 'g'), '(?i)<p(?:\s[^>]*)?>'), 2, 1000000000),
  lambda x: replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(x, '(?is)</?(?:p|div|ul|ol|table|section|article|header|footer|nav|body|html|h[1-6])\b.*', '', 'g'), '<[^>]*>', '', 'g'),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')), chr(10))"""
_HIT = "CASE WHEN kind = 0 THEN CASE WHEN pos % 3 <> 0 THEN (pos % 50)::BIGINT END WHEN len(ids) > 1 THEN CASE WHEN pos % 3 <> 0 THEN ids[pos % len(ids) + 1] END WHEN len(ids) = 1 THEN ids[1] END"
#: Runs, with each chapter's mentions as a list: a fold over those within 25 tokens follows the path of one run.
_FOLD = """list_reduce(list_filter(hl, lambda x: x.p >= idx AND x.p < idx + 25), lambda a, x: CASE WHEN x.p < a.p THEN a
    ELSE {'p': x.p + x.s, 's': a.s, 'h': list_concat(a.h, x.h), 'f': CASE WHEN len(a.h) = 0 AND len(x.h) > 0 THEN x.p + x.s - a.s ELSE a.f END} END, {'p': idx, 's': idx, 'h': []::BIGINT[], 'f': 0::BIGINT})"""
_WALK = f"""res AS (SELECT key, chapter, n_tokens, pos, step, {_HIT} AS hit FROM hits),
  chap AS (SELECT key, chapter, any_value(n_tokens)::BIGINT AS n, list({{'p': pos::BIGINT, 's': step::BIGINT, 'h': CASE WHEN hit IS NULL THEN []::BIGINT[] ELSE [hit] END, 'f': 0::BIGINT}} ORDER BY pos) AS hl FROM res GROUP BY ALL),
  walk AS (
    SELECT key, chapter, n, hl, 0::BIGINT AS idx FROM chap WHERE n > 0
    UNION ALL SELECT * FROM (SELECT key, chapter, n, hl, idx + CASE WHEN len(r.h) > 1 THEN r.f + 1 WHEN len(r.h) = 1 THEN r.f ELSE 24 END AS idx FROM (SELECT *, {_FOLD} AS r FROM walk)) WHERE idx < n),
  runs AS (SELECT key, chapter, idx, list_sort(list_distinct(({_FOLD}).h)) AS members FROM walk),
  pairs AS (SELECT key, chapter, src, dst, count(*) AS weight FROM (SELECT key, chapter, src, unnest(members) AS dst FROM (SELECT *, unnest(members) AS src FROM runs)) WHERE src < dst GROUP BY ALL)"""
SQL = {
    "run_walk": f"{_BASE.replace('WITH ', 'WITH RECURSIVE ', 1)},\n{_FOUND},\n{_WALK} SELECT chapter, idx::INT AS idx, array_to_string(members, ',') AS members FROM runs WHERE len(members) > 0",
    "cooccurrence_rollup": f"""{_BASE.replace('WITH ', 'WITH RECURSIVE ', 1)},\n{_FOUND},\n{_WALK}, base AS (SELECT 's' || (regexp_extract(key, '(\\d+)', 1)::INT % 3) AS series, * FROM pairs)
      SELECT CASE grouping(series, key, chapter) WHEN 0 THEN 'chapter' WHEN 1 THEN 'book' WHEN 3 THEN 'series' ELSE 'universe' END AS level, series, key, chapter, src, dst, sum(weight)::BIGINT AS weight FROM base
      GROUP BY GROUPING SETS ((series, key, chapter, src, dst), (series, key, src, dst), (series, src, dst), (src, dst))""",
    "cooccurrence_book": f"""{_BASE.replace('WITH ', 'WITH RECURSIVE ', 1)},\n{_FOUND},\n{_WALK} SELECT key, src, dst, sum(weight)::BIGINT AS weight FROM pairs GROUP BY ALL HAVING sum(weight) >= 2 OR src = 13 OR dst = 13""",
    "tokenise": f"WITH {_TOKS},\n{_GRAMS} SELECT chapter, pos, token FROM grams",
    "ngram_lookahead": f"WITH {_TOKS},\n{_GRAMS} SELECT chapter, pos, token, token || ' ' || next_one AS two, token || ' ' || next_two AS three FROM grams",
    "html_paragraphs": f"SELECT page_id, {_HTML} AS text FROM pages",
    "html_tokens": f"SELECT page_id, len(t)::BIGINT AS n_tokens, array_to_string(t, ' ') AS tokens FROM (SELECT page_id, {_SPLIT.format(x='x')} AS t FROM (SELECT page_id, {_HTML} AS x FROM pages))",
    "lexicon_build": f"{_BASE} SELECT moniker, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids FROM lex GROUP BY 1",
    "lexicon_exact": f"{_BASE} SELECT moniker, id FROM lex WHERE moniker = 'The'",
    "lexicon_prefix": f"{_BASE} SELECT moniker, id FROM lex WHERE starts_with(moniker, 'Th')",
    "lexicon_size": f"{_BASE} SELECT count(DISTINCT moniker) AS n_monikers, count(*) AS n_entries FROM lex",
    "mention_ladder": f"{_BASE},\n{_FOUND} SELECT key, chapter, pos, step, kind, array_to_string(ids, ',') AS ids FROM hits",
    "resolution_join": f"""{_BASE},\n{_FOUND} SELECT chapter, pos, {_HIT} AS hit, false AS open FROM hits""",
    "resolution_recall": f"""{_BASE},\n{_FOUND}, answered AS (SELECT *, {_HIT} AS hit FROM hits)
      SELECT chapter, pos, CASE WHEN (kind = 0 OR len(ids) > 1) AND (pos % 5 = 0 OR hit NOT IN (SELECT id FROM lex)) THEN NULL ELSE hit END AS hit, false AS open FROM answered""",
    "resolution_defaults": f"""{_BASE},\n{_FOUND}, usual AS (SELECT moniker, max(id) AS usual FROM lex GROUP BY 1),
      words AS (SELECT h.*, u.usual FROM hits h JOIN grams g ON g.key = h.key AND g.chapter = h.chapter AND g.pos = h.pos
        LEFT JOIN usual u ON h.kind > 0 AND u.moniker = CASE h.kind WHEN 3 THEN token || ' ' || next_two WHEN 2 THEN token || ' ' || next_one ELSE token END)
      SELECT chapter, pos, CASE WHEN kind > 0 AND len(ids) = 1 THEN ids[1] WHEN pos % 3 = 1 THEN {_HIT} WHEN kind > 0 AND len(ids) > 1 THEN usual END AS hit,
        kind = 0 AND pos % 3 <> 1 AS open FROM (SELECT * FROM words WHERE kind = 0 OR len(ids) > 0)
      UNION ALL SELECT chapter, pos, NULL, false FROM words WHERE kind > 0 AND len(ids) = 0""",
    "pending_questions": f"{_BASE},\n{_FOUND} SELECT h.chapter, pos, {_around('pos')} FROM hits h JOIN docs USING (key, chapter) WHERE (kind = 0 OR len(ids) > 1) AND pos % 3 = 0",
    "context_window": f"WITH {_TOKS} SELECT chapter, pos, {_around('pos')} FROM (SELECT *, (len(t) // 2)::INT AS pos FROM docs)",
}
