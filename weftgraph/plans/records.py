"""Queries over records: names, keys, dimensions, snapshots."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.wikitext import Dims
from ..operators import delta, entities, lexicon
from ..operators.components import written
from ..sources.pages import flat
from .network import read


def key_normalise(spark, sf_dir):
    raw = F.concat(F.lit(" "), F.upper("p_type"), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, "-RAW").otherwise(""))
    return read(spark, sf_dir, "part").select("p_partkey", text.key_normal(raw).alias("key"))


def name_split(spark, sf_dir):
    common, surname = text.split_name(F.col("p_name"), ["red", "green"])
    return read(spark, sf_dir, "part").select("p_partkey", common.alias("common_name"), surname.alias("surname"))


def sanitise(spark, sf_dir):
    name = F.concat("c_name", F.lit(" ("), F.lower("c_mktsegment"), F.lit(")"))
    return read(spark, sf_dir, "customer").select("c_custkey", text.without_parenthesis(name).alias("name"))


def moniker_sets(spark, sf_dir):
    c, s = text.split_name(F.col("p_name"), ["red", "green"])
    forms = text.monikers(F.col("p_name"), c, s, F.array("p_type"), F.array(F.lit("")))
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(forms, "|").alias("monikers"))


def detail_lines(spark, sf_dir):
    c, n, r = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    none = F.lit(None).cast("string")
    out = text.details(F.col("c_name"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")), F.col("n_name"), F.col("r_name"), F.when(F.col("c_nationkey") % 2 == 0, F.lit("Old")), F.when(F.col("c_nationkey") % 3 == 0, F.lit("Folk")), none, F.col("c_acctbal") >= 0)
    return rows.select("c_custkey", out.alias("details"), text.href("https://example.org/?id=", F.col("c_custkey")).alias("href"))


def dim_lookup(spark, sf_dir):
    """A value table is joined from the left, so unknown values are null; Spark broadcasts it below its threshold."""
    dim = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("raw"), F.col("n_name").alias("nationality")).where("raw < 20")
    return read(spark, sf_dir, "customer").join(dim, F.col("c_nationkey") == F.col("raw"), "left").select("c_custkey", "nationality")


def page_flatten(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    revision = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.struct(F.struct(F.col("props").alias("content")).alias("main")).alias("slots"))
    raw = events.select(F.col("event_id").alias("pageid"), F.when(F.col("user_id") % 10 != 0, F.col("event_type")).alias("title"), F.when(F.col("event_id") % 7 != 0, F.array(revision)).alias("revisions"))
    return flat(raw)


def _snapshots(spark, sf_dir):
    """For each user, the first and the last event of each type as two versions of a page; each type's single events are added or removed."""
    e = read(spark, sf_dir, "events").select((F.col("user_id") * 10 + F.length("event_type")).alias("pageid"), F.col("event_type").alias("title"), F.date_trunc("second", "ts").alias("timestamp"), F.col("props").alias("content"), "event_id", "value")
    side = lambda lo: e.groupBy("pageid").agg((F.min_by if lo else F.max_by)(F.struct("title", "timestamp", "content", "value"), F.struct("timestamp", "event_id")).alias("x")).select("pageid", "x.*")
    return side(True).where("value >= 5").drop("value"), side(False).where("value < 95").drop("value")


def snapshot_delta(spark, sf_dir):
    return delta.changes(*_snapshots(spark, sf_dir)).select("pageid", "change", "old_title", "new_title", "old_content", "new_content")


def delta_log(spark, sf_dir):
    return delta.log_lines(delta.with_diff(delta.changes(*_snapshots(spark, sf_dir))))


def lexicon_forms(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array("p_name", F.concat("p_brand", F.lit("'s own"))).alias("monikers"))
    return lexicon.build(p)


DIMS = Dims(
    demonyms={"northern": "North", "southern": "South"}, species={"stone spren": "Stone", "human": "Human"}, books={f"Brand#{k}": f"series {k % 3}" for k in range(1, 5)}, titles=("red", "green"),
    kinds={"spren": "Spirit"},
)


def pages(spark, sf_dir):
    """Parts as pages: what the columns say is written as an infobox, with misspelt fields, references, foreign and deleted pages."""
    even = F.col("p_partkey") % 2 == 0
    when = lambda c, x: F.when(c, F.lit(x)).otherwise("")
    content = F.concat(
        F.lit("{{stub}}{{character\n| Name = "), "p_name", F.lit(" Jr, Old "), "p_name", F.lit("<ref>x</ref>{{ref|y}}\n|titles={{tag|"), "p_type", F.lit("}}\n|books = ''[["), "p_brand", F.lit("]]'', [[x|Brand#1]], [[none]]\n|world-raw = "), "p_brand",
        F.lit("\n|universe = "), F.when(F.col("p_size") > 45, "else").otherwise("Tales"), F.lit("\n|residnece = [[small town]] (near x)<br>{{tag|city}}\n|nation = "), F.when(even, "Northern").otherwise("nowhere"),
        F.lit("\n|species = "), F.when(even, "stone spren").otherwise("human"), F.lit("\n|powers = {{tag|shard|Fire}}, [[Sight|sees]]\n|parents = [[Mary_Lee]], [["), "p_brand", F.lit("]]\n|junk = 1"), when(F.col("p_size") % 3 == 0, "\n|death ="), F.lit("\n}} text"), when(F.col("p_size") == 1, "{{Deleted page}}"),
    )
    content = F.when(F.col("p_size") == 2, "no template").when(F.col("p_size") == 3, "").otherwise(content)
    title = F.concat(when(F.col("p_size") == 4, "User:"), "p_name", when(F.col("p_size") == 5, " (a book)"))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("pageid"), title.alias("title"), content.alias("content"))


def page_entities(spark, sf_dir):
    found = entities.entities(pages(spark, sf_dir), DIMS, "tales")
    joined = lambda c: F.array_join(c, "|").alias(c)
    return found.select(
        "id", "name", "common_name", "surname", "living", joined("aliases"), joined("titles"), joined("books"), joined("abilities"), "world", "residence", "nationality", "species", "subspecies",
        F.array_join(F.col("relatives")["parents"], "|").alias("parents"), F.col("misc.original_name").alias("original_name"),
    )


def entity_overrides(spark, sf_dir):
    rules = spark.createDataFrame(
        [("Brand#1", "append", "aliases", "One"), ("Brand#2", "drop", None, None), ("Brand#3", "set", "common_name", "Three"), ("Brand#4", "remove", "titles", "PROMO")], "world string, action string, field string, value string"
    )
    who = written(entities.entities(pages(spark, sf_dir), DIMS, "tales"))  # read three times, parsed once
    named = who.select("name", "world").distinct().join(rules, "world")
    return entities.properties(entities.overridden(who, named)).select("id", "name", "nickname", F.array_join("aliases", "|").alias("aliases"), F.array_join("monikers", "|").alias("monikers"), "world")


def legend_numbers(spark, sf_dir):
    """The values of an attribute, numbered from 0 for a legend."""
    values = read(spark, sf_dir, "customer").select("c_mktsegment").distinct()
    return values.select(F.col("c_mktsegment").alias("value"), (F.row_number().over(Window.orderBy("c_mktsegment")) - 1).alias("number"))


def key_prefix(spark, sf_dir):
    """Chapters of all books whose key starts with a series' key."""
    d = read(spark, sf_dir, "documents").where(F.col("source").startswith("src1"))
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("n_chapters"))


QUERIES = (page_entities, entity_overrides, legend_numbers, key_prefix, key_normalise, name_split, sanitise, moniker_sets, detail_lines, dim_lookup, page_flatten, snapshot_delta, delta_log, lexicon_forms)

_WORDS = "string_split(p_name, ' ')"
_COMMON = f"CASE WHEN {_WORDS}[1] IN ('red', 'green') THEN '' ELSE {_WORDS}[1] END"
_SURNAME = f"CASE WHEN {_WORDS}[1] IN ('red', 'green') OR len({_WORDS}) > 1 THEN {_WORDS}[-1] ELSE '' END"
_SIDE = "SELECT pageid, {f}(struct_pack(title, ts, content, value), struct_pack(ts, event_id)) AS x FROM ev GROUP BY 1"
_ENT = f"""ent AS (SELECT p_partkey AS id, p_size = 3 AS blank, p_partkey % 2 = 0 AS even, *, p_name || CASE WHEN p_size = 5 THEN ' (a book)' ELSE '' END AS title,
    CASE WHEN p_size = 3 THEN '' ELSE {_COMMON} END AS common_name, CASE WHEN p_size = 3 THEN '' WHEN p_size = 5 THEN 'book)' ELSE {_SURNAME} END AS surname, p_name || ' Jr|Old ' || p_name AS al,
    CASE WHEN p_brand IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4') THEN 'series ' || (p_brand[7:]::INT % 3) || '|' ELSE '' END || 'series 1' AS bk
  FROM part WHERE p_size = 3 OR p_size NOT IN (1, 2, 4) AND p_size <= 45)"""
SQL = {
    "page_entities": f"""WITH {_ENT} SELECT id, p_name AS name, common_name, surname, blank OR p_size % 3 <> 0 AS living, CASE WHEN blank THEN '' ELSE al END AS aliases, CASE WHEN blank THEN '' ELSE p_type END AS titles,
      CASE WHEN blank THEN '' ELSE bk END AS books, CASE WHEN blank THEN '' ELSE 'shard|shard of fire|sees' END AS abilities, CASE WHEN NOT blank THEN p_brand END AS world, CASE WHEN NOT blank THEN 'Small Town, city' END AS residence,
      CASE WHEN NOT blank AND even THEN 'North' END AS nationality, CASE WHEN NOT blank THEN CASE WHEN even THEN 'Spirit' ELSE 'Human' END END AS species, CASE WHEN NOT blank AND even THEN 'Stone' END AS subspecies,
      CASE WHEN blank THEN '' ELSE 'Mary Lee|' || p_brand END AS parents, CASE WHEN p_size = 5 THEN title ELSE '' END AS original_name FROM ent""",
    "entity_overrides": f"""WITH {_ENT}, o AS (SELECT *, CASE WHEN blank THEN NULL ELSE p_brand END AS world FROM ent), c AS (
        SELECT id, p_name AS name, world, CASE WHEN world = 'Brand#3' THEN 'Three' ELSE common_name END AS cn, surname, list_filter(string_split(CASE WHEN blank THEN '' ELSE al END || CASE WHEN world = 'Brand#1' THEN '|One' ELSE '' END, '|'), lambda x: x <> '') AS al,
          list_filter([CASE WHEN blank THEN '' ELSE p_type END], lambda x: x <> '' AND NOT (x = 'PROMO' AND coalesce(world, '') = 'Brand#4')) AS ti FROM o WHERE coalesce(world, '') <> 'Brand#2'),
      m AS (SELECT *, list_filter(list_concat([name, cn, surname], al, ti), lambda x: x <> '') AS ms FROM c)
      SELECT id, name, CASE WHEN cn <> name THEN cn ELSE '' END AS nickname, array_to_string(al, '|') AS aliases, array_to_string(list_transform(list_filter(list_zip(ms, range(1, len(ms) + 1)), lambda z: list_position(ms, z[1]) = z[2]), lambda z: z[1]), '|') AS monikers, world FROM m""",
    "legend_numbers": "SELECT value, (row_number() OVER (ORDER BY value) - 1)::INT AS number FROM (SELECT DISTINCT c_mktsegment AS value FROM customer)",
    "key_prefix": "SELECT source, count(*) AS n_chapters FROM documents WHERE starts_with(source, 'src1') GROUP BY 1",
    "key_normalise": "SELECT p_partkey, regexp_replace(regexp_replace(lower(' ' || upper(p_type) || p_size || CASE WHEN p_partkey % 2 = 0 THEN '-RAW' ELSE '' END), '[^a-z-]', '', 'g'), '-raw$', '') AS key FROM part",
    "name_split": f"SELECT p_partkey, {_COMMON} AS common_name, {_SURNAME} AS surname FROM part",
    "sanitise": r"SELECT c_custkey, regexp_replace(c_name || ' (' || lower(c_mktsegment) || ')', '\s\([\w\s]+\)', '', 'g') AS name FROM customer",
    "moniker_sets": f"""SELECT p_partkey, array_to_string(list_filter([m.a, CASE WHEN m.b NOT IN (m.a) THEN m.b END, CASE WHEN m.c NOT IN (m.a, m.b) THEN m.c END, CASE WHEN m.d NOT IN (m.a, m.b, m.c) THEN m.d END], lambda x: x IS NOT NULL AND x <> ''), '|') AS monikers
      FROM (SELECT p_partkey, struct_pack(a := p_name, b := {_COMMON}, c := {_SURNAME}, d := p_type) AS m FROM part)""",
    "detail_lines": """SELECT c_custkey, c_name || ' -- ' || concat_ws(', ', CASE WHEN c_acctbal > 0 THEN c_mktsegment END, n_name, coalesce(r_name, 'Unknown'))
        || CASE WHEN b = '' THEN '' ELSE ' (' || b || ')' END AS details, 'https://example.org/?id=' || c_custkey AS href
      FROM (SELECT *, concat_ws(', ', nullif(concat_ws(' ', CASE WHEN c_nationkey % 2 = 0 THEN 'Old' END, CASE WHEN c_nationkey % 3 = 0 THEN 'Folk' END), ''), CASE WHEN NOT c_acctbal >= 0 THEN 'deceased' END) AS b
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)""",
    "dim_lookup": "SELECT c_custkey, n_name AS nationality FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON c_nationkey = n_nationkey",
    "page_flatten": "SELECT event_id AS pageid, CASE WHEN user_id % 10 <> 0 THEN event_type ELSE '' END AS title, CASE WHEN event_id % 7 <> 0 THEN date_trunc('second', ts) END AS timestamp, CASE WHEN event_id % 7 <> 0 THEN props ELSE '' END AS content FROM events",
    "snapshot_delta": f"""WITH ev AS (SELECT user_id * 10 + length(event_type) AS pageid, event_type AS title, date_trunc('second', ts) AS ts, props AS content, event_id, value FROM events),
      o AS (SELECT pageid, x FROM ({_SIDE.format(f="arg_min")}) WHERE x.value >= 5), n AS (SELECT pageid, x FROM ({_SIDE.format(f="arg_max")}) WHERE x.value < 95)
      SELECT coalesce(o.pageid, n.pageid) AS pageid, CASE WHEN o.pageid IS NULL THEN 'added' WHEN n.pageid IS NULL THEN 'removed' WHEN o.x.title <> n.x.title THEN 'renamed' ELSE 'modified' END AS change,
        o.x.title AS old_title, n.x.title AS new_title, o.x.content AS old_content, n.x.content AS new_content
      FROM o FULL JOIN n ON o.pageid = n.pageid WHERE o.pageid IS NULL OR n.pageid IS NULL OR (o.x.title, o.x.ts, o.x.content) IS DISTINCT FROM (n.x.title, n.x.ts, n.x.content)""",
    "lexicon_forms": "SELECT DISTINCT id, moniker FROM (SELECT p_partkey AS id, unnest([p_name, p_brand || ' own', p_brand || '''s own']) AS moniker FROM part)",
}
