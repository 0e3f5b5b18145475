"""Queries over graphs, made of the star schema: customers (2k) and parts (2k + 1) are nodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, kin, views
from ..operators.components import components as component_labels
from ..operators.components import written
from ..sources import graphs as files
from .network import read


def lines(spark, sf_dir):
    """(src, dst, flag): who ordered what."""
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_returnflag")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select((F.col("o_custkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst"), "l_returnflag", "l_extendedprice", "l_orderkey", "l_linenumber")


def weighted_lines(spark, sf_dir, flag=None):
    rows = lines(spark, sf_dir)
    rows = rows if flag is None else rows.where(F.col("l_returnflag") == flag)
    return graph.weighted(rows.select("src", "dst", F.lit(1).alias("weight")))


def favourites(spark, sf_dir):
    """Each customer's dearest line: a sparse graph of many components."""
    best = F.max_by("dst", F.struct("l_extendedprice", "l_orderkey", "l_linenumber")).alias("dst")
    return lines(spark, sf_dir).groupBy("src").agg(best).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))


def customers(spark, sf_dir):
    c, n = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    c = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select((F.col("c_custkey") * 2).alias("id"), F.col("c_name").alias("name"), F.col("n_name").alias("world"), F.col("c_mktsegment").alias("segment"))


def parts(spark, sf_dir):
    return read(spark, sf_dir, "part").select((F.col("p_partkey") * 2 + 1).alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("world"), F.col("p_type").alias("segment"))


def nodes(spark, sf_dir):
    return customers(spark, sf_dir).unionByName(parts(spark, sf_dir))


def edge_weights(spark, sf_dir):
    return weighted_lines(spark, sf_dir)


def min_weight_prune(spark, sf_dir):
    return graph.heavy(weighted_lines(spark, sf_dir), 2, (26,))


def combine_edges(spark, sf_dir):
    return graph.combined(weighted_lines(spark, sf_dir, "A"), weighted_lines(spark, sf_dir, "R"))


def graph_rollup(spark, sf_dir):
    """Weights of customer-part edges by customer (chapter), nation (book), region (series) and overall."""
    c = customers(spark, sf_dir).select("id", F.col("world").alias("key"))
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    up = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("key"), F.col("r_name").alias("series"))
    e = read(spark, sf_dir, "part").select((F.col("p_partkey") * 2 + 1).alias("dst"), F.col("p_size").cast("bigint").alias("to"))
    rows = lines(spark, sf_dir).join(c, F.col("src") == F.col("id")).join(up, "key").join(e, "dst")
    pairs = rows.groupBy("series", "key", F.col("l_returnflag").alias("chapter"), F.lit(0).cast("bigint").alias("src"), F.col("to").alias("dst")).agg(F.count(F.lit(1)).alias("weight"))
    return graph.rollup(pairs)


def connected_components(spark, sf_dir):
    return component_labels(favourites(spark, sf_dir))


def prune_components(spark, sf_dir):
    e = favourites(spark, sf_dir)
    return graph.large_components(graph.endpoints(e), e, 3)


def drop_isolates(spark, sf_dir):
    return graph.connected(nodes(spark, sf_dir), favourites(spark, sf_dir)).select("id", "name")


def graph_scopes(spark, sf_dir):
    """Suppliers' customers: the favourites graph projected on customers, split by nation."""
    return graph.scopes(customers(spark, sf_dir), shared_taste(spark, sf_dir), "world", 3)


def shared_taste(spark, sf_dir):
    """Customers linked with the first one who has the same favourite."""
    f = written(favourites(spark, sf_dir)).select(F.when(F.col("src") % 2 == 0, F.col("src")).otherwise(F.col("dst")).alias("c"), F.when(F.col("src") % 2 == 1, F.col("src")).otherwise(F.col("dst")).alias("p"))
    first = f.groupBy("p").agg(F.min("c").alias("src"))
    return f.join(first, "p").where("src < c").select("src", F.col("c").alias("dst"))


def neighbour_sets(spark, sf_dir):
    near = graph.neighbours(favourites(spark, sf_dir)).select("id", "neighbour").distinct()
    return near.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list("neighbour")), lambda x: x.cast("string")), ",").alias("neighbours"))


def ego_view(spark, sf_dir):
    return graph.ego(weighted_lines(spark, sf_dir), 20)


def component_of_node(spark, sf_dir):
    return graph.component_of(favourites(spark, sf_dir), 20)


def facet_subset(spark, sf_dir):
    facets = views.toggled(views.toggled(views.toggled({}, "segment", "BUILDING"), "segment", "MACHINERY"), "world", "FRANCE")
    n, e = views.subset(nodes(spark, sf_dir), favourites(spark, sf_dir), facets)
    return n.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.lit(None).cast("bigint").alias("b")).unionByName(e.select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b")))


def exact_subset(spark, sf_dir):
    n, e = views.exact(customers(spark, sf_dir), shared_taste(spark, sf_dir), "segment", "BUILDING")
    return n.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.lit(None).cast("bigint").alias("b")).unionByName(e.select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b")))


def people(spark, sf_dir):
    """Parts as people: two-word names, a surname, a nickname, and relatives named after other parts in five ways."""
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.split("p_name", " ").alias("w"), F.col("p_brand").alias("world"))
    p = p.withColumn("surname", F.element_at("w", -1)).withColumn("monikers", F.array(F.col("name"), F.col("w")[0], F.concat(F.lit("Old "), F.col("name"), F.lit(" "), F.col("id").cast("string"))))
    other = p.select(F.col("id").alias("oid"), F.col("name").alias("oname"), F.col("w").alias("ow"))
    size = p.agg(F.max("id").alias("top"))
    asked = p.crossJoin(F.broadcast(size)).withColumn("oid", (F.col("id") * 7 + 3) % F.col("top") + 1).join(other, "oid", "left")
    how = F.col("id") % 5
    relation = F.when(how == 0, F.col("oname")).when(how == 1, F.concat(F.col("ow")[0], F.lit(" of nowhere"))).when(how == 2, F.concat(F.lit("Old "), F.col("oname"), F.lit(" "), F.col("oid").cast("string"))).when(how == 3, F.concat(F.lit("d "), F.col("oname"))).otherwise(F.lit("nobody at all"))
    return asked.select("id", "name", "surname", "monikers", "world", F.create_map(F.lit("siblings"), F.array(F.coalesce(relation, F.lit("nobody at all")))).alias("relatives"))


def kin_resolution(spark, sf_dir):
    p = people(spark, sf_dir)
    return kin.targets(kin.relations(p), p).select("id", "relation", "target", F.col("how").cast("int").alias("how"))


def kin_edges(spark, sf_dir):
    return kin.graph(people(spark, sf_dir))[1]


def gml_rows(spark, sf_dir):
    return files.gml_lines(customers(spark, sf_dir), shared_taste(spark, sf_dir))


def nodelink_items(spark, sf_dir):
    return files.nodelink(customers(spark, sf_dir), shared_taste(spark, sf_dir))


def moniker_search(spark, sf_dir):
    return views.search(people(spark, sf_dir), "LD").select("id", "name")


def search_suggestions(spark, sf_dir):
    out = views.suggestions(people(spark, sf_dir), "red")
    return out.select("name", F.array_join("aliases", "|").alias("aliases"), "value")


QUERIES = (
    edge_weights, min_weight_prune, combine_edges, graph_rollup, connected_components, prune_components, drop_isolates, graph_scopes, neighbour_sets, ego_view, component_of_node,
    facet_subset, exact_subset, kin_resolution, kin_edges, gml_rows, nodelink_items, moniker_search, search_suggestions,
)

_LINES = "li AS (SELECT o_custkey * 2 AS src, l_partkey * 2 + 1 AS dst, l_returnflag, l_extendedprice, l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
_FAV = """fav0 AS (SELECT src AS c, arg_max(dst, {'p': l_extendedprice, 'o': l_orderkey, 'n': l_linenumber}) AS p FROM li GROUP BY 1), fav AS (SELECT least(c, p) AS src, greatest(c, p) AS dst FROM fav0)"""
_CUST = "cust AS (SELECT c_custkey * 2 AS id, c_name AS name, n_name AS world, c_mktsegment AS segment FROM customer JOIN nation ON c_nationkey = n_nationkey)"
_NODES = f"{_CUST}, nodes AS (SELECT * FROM cust UNION ALL SELECT p_partkey * 2 + 1, p_name, p_brand, p_type FROM part)"
_TASTE = "taste AS (SELECT b.src, a.c AS dst FROM fav0 a JOIN (SELECT p, min(c) AS src FROM fav0 GROUP BY 1) b USING (p) WHERE b.src < a.c)"
_W = "w AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, count(*) AS weight FROM li GROUP BY ALL)"


def _reach(edges: str, name: str = "comp") -> str:
    return f"""both_{name} AS (SELECT src AS a, dst AS b FROM {edges} UNION SELECT dst, src FROM {edges}),
  reach_{name}(a, b) AS (SELECT a, a FROM both_{name} UNION SELECT r.a, e.b FROM reach_{name} r JOIN both_{name} e ON r.b = e.a), {name} AS (SELECT a AS id, min(b) AS component FROM reach_{name} GROUP BY 1)"""


_PEOPLE = """ppl AS (
  SELECT p_partkey AS id, p_name AS name, string_split(p_name, ' ') AS w, p_brand AS world, string_split(p_name, ' ')[-1] AS surname,
    [p_name, string_split(p_name, ' ')[1], 'Old ' || p_name || ' ' || p_partkey] AS monikers, (p_partkey * 7 + 3) % (SELECT max(p_partkey) FROM part) + 1 AS oid FROM part),
  asked AS (SELECT a.id, a.surname, coalesce(CASE a.id % 5 WHEN 0 THEN o.name WHEN 1 THEN o.w[1] || ' of nowhere' WHEN 2 THEN 'Old ' || o.name || ' ' || o.id WHEN 3 THEN 'd ' || o.name ELSE 'nobody at all' END, 'nobody at all') AS relation
    FROM ppl a LEFT JOIN ppl o ON o.id = a.oid),
  known AS (SELECT m, min(id) AS t FROM (SELECT id, unnest(monikers) AS m FROM ppl) GROUP BY 1), named AS (SELECT name, min(id) AS t FROM ppl GROUP BY 1),
  three AS (SELECT a.id, a.relation, n.t AS t1, s.t AS t2, k.t AS t3 FROM asked a LEFT JOIN named n ON n.name = a.relation LEFT JOIN named s ON s.name = string_split(a.relation, ' ')[1] || ' ' || a.surname LEFT JOIN known k ON k.m = a.relation),
  inside AS (SELECT r.relation, min(k.t) AS t4 FROM (SELECT DISTINCT relation FROM three WHERE coalesce(t1, t2, t3) IS NULL) r JOIN known k ON contains(k.m, r.relation) GROUP BY 1),
  kin AS (SELECT id, relation, coalesce(t1, t2, t3, t4) AS target, CASE WHEN t1 IS NOT NULL THEN 1 WHEN t2 IS NOT NULL THEN 2 WHEN t3 IS NOT NULL THEN 3 WHEN t4 IS NOT NULL THEN 4 END AS how FROM three LEFT JOIN inside USING (relation))"""
SQL = {
    "edge_weights": f"WITH {_LINES}, {_W} SELECT * FROM w",
    "min_weight_prune": f"WITH {_LINES}, {_W} SELECT * FROM w WHERE weight >= 2 OR src = 26 OR dst = 26",
    "combine_edges": f"WITH {_LINES} SELECT least(src, dst) AS src, greatest(src, dst) AS dst, count(*) AS weight FROM li WHERE l_returnflag IN ('A', 'R') GROUP BY ALL",
    "graph_rollup": f"""WITH {_LINES}, {_CUST}, base AS (SELECT r_name AS series, n_name AS key, l_returnflag AS chapter, 0::BIGINT AS src, p_size::BIGINT AS dst FROM li JOIN cust ON li.src = cust.id JOIN nation ON n_name = world JOIN region ON r_regionkey = n_regionkey JOIN part ON p_partkey * 2 + 1 = li.dst)
      SELECT CASE grouping(series, key, chapter) WHEN 0 THEN 'chapter' WHEN 1 THEN 'book' WHEN 3 THEN 'series' ELSE 'universe' END AS level, series, key, chapter, src, dst, count(*)::BIGINT AS weight FROM base
      GROUP BY GROUPING SETS ((series, key, chapter, src, dst), (series, key, src, dst), (series, src, dst), (src, dst))""",
    "connected_components": f"WITH RECURSIVE {_LINES}, {_FAV}, {_reach('fav')} SELECT id, component FROM comp",
    "prune_components": f"WITH RECURSIVE {_LINES}, {_FAV}, {_reach('fav')} SELECT id, component, size FROM comp JOIN (SELECT component, count(*) AS size FROM comp GROUP BY 1) USING (component) WHERE size >= 3",
    "drop_isolates": f"WITH {_LINES}, {_FAV}, {_NODES} SELECT id, name FROM nodes WHERE id IN (SELECT src FROM fav UNION SELECT dst FROM fav)",
    "graph_scopes": f"""WITH RECURSIVE {_LINES}, {_FAV}, {_CUST}, {_TASTE}, own AS (SELECT t.src, t.dst FROM taste t JOIN cust a ON a.id = t.src JOIN cust b ON b.id = t.dst WHERE a.world = b.world),
      {_reach('taste')}, {_reach('own', 'comp2')}
      SELECT 'all' AS scope, id FROM comp WHERE component IN (SELECT component FROM comp GROUP BY 1 HAVING count(*) >= 3)
      UNION ALL SELECT world, id FROM comp2 JOIN cust USING (id) WHERE component IN (SELECT component FROM comp2 GROUP BY 1 HAVING count(*) >= 3)""",
    "neighbour_sets": f"WITH {_LINES}, {_FAV}, b AS (SELECT src AS id, dst AS x FROM fav UNION SELECT dst, src FROM fav) SELECT id, count(*) AS n, string_agg(x::VARCHAR, ',' ORDER BY x) AS neighbours FROM b GROUP BY 1",
    "ego_view": f"WITH {_LINES} SELECT 20::BIGINT AS id, 0 AS distance UNION ALL SELECT DISTINCT dst, 1 FROM li WHERE src = 20",
    "component_of_node": f"WITH RECURSIVE {_LINES}, {_FAV}, {_reach('fav')} SELECT 20::BIGINT AS id UNION SELECT id FROM comp WHERE component = (SELECT component FROM comp WHERE id = 20)",
    "facet_subset": f"WITH {_LINES}, {_FAV}, {_NODES}, k AS (SELECT id FROM nodes WHERE segment IN ('BUILDING', 'MACHINERY') OR world = 'FRANCE') SELECT 'node' AS kind, id AS a, NULL::BIGINT AS b FROM k UNION ALL SELECT 'edge', src, dst FROM fav WHERE src IN (FROM k) AND dst IN (FROM k)",
    "exact_subset": f"WITH {_LINES}, {_FAV}, {_CUST}, {_TASTE}, k AS (SELECT id FROM cust WHERE segment = 'BUILDING') SELECT 'node' AS kind, id AS a, NULL::BIGINT AS b FROM k UNION ALL SELECT 'edge', src, dst FROM taste WHERE src IN (FROM k) AND dst IN (FROM k)",
    "kin_resolution": f"WITH {_PEOPLE} SELECT id, relation, target, how FROM kin",
    "kin_edges": f"WITH {_PEOPLE} SELECT DISTINCT least(id, target) AS src, greatest(id, target) AS dst FROM kin WHERE target IS NOT NULL",
    "gml_rows": f"""WITH {_LINES}, {_FAV}, {_CUST}, {_TASTE}, o AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM cust),
      ls AS (SELECT 0 AS part, 0 AS a, 0 AS b, ['graph ['] AS l UNION ALL SELECT 3, 0, 0, [']']
        UNION ALL SELECT 1, n, 0, ['  node [', '    id ' || n, '    label "' || id || '"', '    name "' || name || '"', '    world "' || world || '"', '    segment "' || segment || '"', '  ]'] FROM cust JOIN o USING (id)
        UNION ALL SELECT 2, x.n, y.n, ['  edge [', '    source ' || x.n, '    target ' || y.n, '  ]'] FROM taste JOIN o x ON x.id = src JOIN o y ON y.id = dst)
      SELECT part, a, b, (unnest(range(1, len(l) + 1)) - 1)::INT AS at, unnest(l) AS line FROM ls""",
    "nodelink_items": f"""WITH {_LINES}, {_FAV}, {_CUST}, {_TASTE} SELECT 'node' AS kind, id AS a, NULL::BIGINT AS b, '{{"name":"' || name || '","world":"' || world || '","segment":"' || segment || '","id":' || id || '}}' AS item FROM cust
      UNION ALL SELECT 'link', src, dst, '{{"source":' || src || ',"target":' || dst || '}}' FROM taste""",
    "moniker_search": f"WITH {_PEOPLE} SELECT id, name FROM ppl WHERE list_bool_or(list_transform(monikers, lambda m: contains(lower(m), 'ld')))",
    "search_suggestions": f"WITH {_PEOPLE} SELECT name, array_to_string(list_filter(monikers, lambda m: m <> name), '|') AS aliases, id AS value FROM ppl WHERE list_bool_or(list_transform(monikers, lambda m: contains(lower(m), 'red')))",
}
