import random

import pytest
from pyspark.sql import functions as F

from weftgraph import cli
from weftgraph.functions import text, wikitext
from weftgraph.functions.wikitext import Dims, Link, Template, parse, plain, record
from weftgraph.operators import delta, entities, graph, kin, lexicon, mentions, runs, views
from weftgraph.operators.components import components
from weftgraph.sources import graphs, pages
from weftgraph.streaming import cooccurrence


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'string' if isinstance(values[n], str) else 'array<string>'}" for n in names)).select(column).first()[0]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("Ana's cat", ["Ana", "cat"]), ("Ana’s’s", ["Ana"]), ("boys' hats", ["boys", "hats"]), ("well-known—fact", ["well", "known", "fact"]), ("wait… no", ["wait", "no"]),
        ('"quoted" [x]', ['"quoted"', "[x]"]), ("a b c", ["a", "b", "c"]), ("O'Brien", ["OBrien"]), ("", []), (" ?! ", []),
    ],
)
def test_tokens(spark, raw, want):
    assert one(spark, text.tokens(F.col("t")), t=raw) == want


def test_names(spark):
    titles = ["King", "Lord"]
    for name, want in {"King Bob": ("", "Bob"), "Ann": ("Ann", ""), "Ann Lee": ("Ann", "Lee"), "Bob's son": ("Bob's son", ""), "Ann (book)": ("Ann", "(book)")}.items():
        common, surname = text.split_name(F.col("t"), titles)
        assert (one(spark, common, t=name), one(spark, surname, t=name)) == want
    assert one(spark, text.without_parenthesis(F.col("t")), t="Ann (a b)") == "Ann"
    assert one(spark, text.key_normal(F.col("t")), t=" Fam1ily-RAW ") == "family"
    assert one(spark, text.moniker_forms(F.col("t")), t="Ann's dog") == ["Ann's dog", "Ann dog"]
    assert one(spark, text.highlighted(F.col("t"), F.lit(1), F.lit(2)), t=["a", "b", "c", "d"]) == "a «b c» d"
    row = spark.createDataFrame([("N", None, "Home", "W", "E", "S", None, False)], "n string, r string, h string, w string, e string, s string, u string, l boolean")
    assert row.select(text.details(*[F.col(c) for c in "n r h w e s u l".split()])).first()[0] == "N -- Home, W (E S, deceased)"


BOX = """{{image|x}} {{character
|name = Annie, {{tag|The Red}}
|aliases = Nan<ref>x</ref>, {{highprince|north|of all}}
|titles={{tag|highprince|Northland}}, Boss
|books = [[Book One]], ''[[B2|Book Two]]'', [[Other]]
|world-raw = [[Earth]]
|universe = Tales
|residnece = [[small town]] (near x)<br>{{tag|city}}
|nation = Northern
|species = stone spren
|powers = {{tag|shard|Fire}}, {{tag+|squire|of Bob}}, [[Sight|sees]]
|family = [[House Lee]]
|parents = [[Mary_Lee]], [[John]]
|died =
|unnamed = no
|junk = 1
}} text"""


def test_wikitext():
    dims = Dims(demonyms={"northern": "North"}, species={"stone spren": "Stone"}, books={"Book One": "one", "Book Two": "two"}, kinds={"spren": "Spirit"})
    got = record(BOX, dims)
    assert got["has_box"] and not got["deleted"] and got["books"] == ["one", "two"] and got["world"] == "Earth" and got["nationality"] == "North"
    assert got["aliases"][0].startswith("Nan") and got["aliases"][-2:] == ["Annie", "The Red"] and "highprince of Northland" in got["titles"]
    assert got["species"] == "Spirit" and got["subspecies"] == "Stone" and got["parents"] == ["Mary Lee", "John"] and got["family"] == "House Lee"
    assert got["abilities"][:2] == ["shard", "shard of fire"] and "squire (bob)" in got["abilities"] and got["residence"] == "Small Town, city"
    assert got["died"] is True and got["unnamed"] is False and "junk" not in got
    assert parse("a [[x|y]] {{t|k=v|{{u}}}} {{open") == ["a ", Link("x", "y"), " ", Template("t", [("k", ["v"]), (None, [Template("u")])]), " {{open"]
    assert plain(parse("''a'' [[x|y]] {{t}}<b>c</b>")) == "a y c"


def test_entities(spark):
    rows = [(1, "Ann Lee (book)", BOX), (2, "User:Bob", BOX), (3, "C", "no template"), (4, "D", "{{other}}"), (5, "E", BOX + "{{Deleted}}"), (6, "F", BOX.replace("Tales", "else")), (7, "G", "")]
    flat = spark.createDataFrame(rows, "pageid bigint, title string, content string")
    got = {r["id"]: r for r in entities.entities(flat, Dims(), "tales").collect()}
    assert set(got) == {1, 7}
    assert got[1]["name"] == "Ann Lee" and got[1]["surname"] == "(book)" and not got[1]["living"] and got[1]["unnamed"] and got[1]["misc"]["original_name"] == "Ann Lee (book)"
    assert got[7]["living"] and got[7]["monikers"] == ["G"] and got[7]["relatives"]["parents"] == []
    rules = spark.createDataFrame([("Ann Lee", None, "append", "aliases", "Queenie"), ("Ann Lee", "Earth", "set", "common_name", "Annie"), ("Ann Lee", "Mars", "drop", None, None), ("G", None, "drop", None, None)], "name string, world string, action string, field string, value string")
    fixed = entities.overridden(entities.entities(flat, Dims(), "tales"), rules).collect()
    assert [r["id"] for r in fixed] == [1] and "Queenie" in fixed[0]["monikers"] and fixed[0]["common_name"] == "Annie"
    assert entities.properties(entities.entities(flat, Dims(), "tales")).where("id = 1").first()["nickname"] == "Ann"


def test_lexicon(spark):
    lex = lexicon.build(spark.createDataFrame([(1, ["Ann", "Ann's"]), (2, ["Ann", "Bo-b"])], "id bigint, monikers array<string>"))
    assert sorted(map(tuple, lex.collect())) == [("Ann", 1), ("Ann", 2), ("Ann's", 1), ("Bo-b", 2)]
    who = spark.createDataFrame([(1, "Zed"), (2, "Abe")], "id bigint, name string")
    assert [r["name"] for r in lexicon.matches(lex, who, "An", True).collect()] == ["Abe", "Zed"]
    assert lexicon.contains(lex, "Ann") and lexicon.contains(lex, "An", True) and not lexicon.contains(lex, "An") and not lexicon.contains(lex, "")
    assert lexicon.delete(lex, "Ann").count() == 2 and lexicon.insert(lex, lex).count() == 4
    assert lexicon.set_prefix(lex, "Ann", lex.limit(0)).count() == 1 and [r["moniker"] for r in lexicon.ordered(lex).collect()] == ["Ann", "Ann's", "Bo-b"]
    assert tuple(lexicon.size(lex).first()) == (3, 4)


def scan(tokens, lex, titles, present, answers):
    """The ladder and the walk, restated on plain lists; returns (idx, ids)."""
    n, out, idx = len(tokens), [], 0
    at = lambda p: tokens[p] if p < n else ""

    def found(p):
        for k in (3, 2):
            gram = " ".join(at(p + i) for i in range(k))
            if gram in lex:
                return k, pick(gram, p)
        if at(p) in titles:
            free = at(p + 1) not in lex and f"{at(p + 1)} {at(p + 2)}" not in lex
            return 1, answers.get(p) if free else None
        return 1, pick(at(p), p) if at(p) in lex else None

    def pick(gram, p):
        own = sorted(c for c in lex[gram] if present(c))
        return answers.get(p) if len(own) > 1 else own[0] if own else None

    while idx < n:
        i, hits = 0, []
        while i < min(25, n - idx):
            step, hit = found(idx + i)
            i += step
            if hit is not None:
                hits.append((i, hit))
        if hits:
            out.append((idx, sorted({h for _, h in hits})))
        idx += hits[0][0] + 1 if len(hits) > 1 else hits[0][0] if hits else 24
    return out


def test_scanner_equals_restatement(spark):
    rnd = random.Random(7)
    lex = {"A": [1, 2], "B": [3], "C": [2], "A B": [4, 5], "B C": [6], "A B C": [7], "T": [8], "D": [9]}
    books = {c: ["b"] if c not in (7, 9) else ["other"] for c in range(10)}
    rows, want = [], {}
    for k, n in enumerate([0, 1, 2, 5, 24, 25, 26, 49, 300, 900] * 3):
        tokens = rnd.choices(["A", "B", "C", "D", "T", "x", "y"], [2, 2, 2, 1, 1, 8 + 40 * (k % 3), 8], k=n)
        rows.append(("b/1", str(k), " ".join(tokens)))
        answers = {p: None if p % 3 == 0 else p % 4 for p in range(n)}
        want[str(k)] = scan(tokens, lex, {"T"}, lambda c: "b" in books[c], answers)
    chapters = spark.createDataFrame(rows, "key string, chapter string, text string")
    lexic = spark.createDataFrame([(m, c) for m, cs in lex.items() for c in cs], "moniker string, id bigint")
    who = spark.createDataFrame(list(books.items()), "id bigint, books array<string>")
    found = mentions.mentions(mentions.ngrams(chapters), mentions.candidates(lexic, who), ["T"])
    asked = found.where("kind = 0 or size(ids) > 1").select("key", "chapter", "pos", F.when(F.col("pos") % 3 != 0, F.col("pos") % 4).cast("bigint").alias("char_id"))
    got = {}
    for r in runs.runs(mentions.resolved(found, asked)).collect():
        got.setdefault(r["chapter"], []).append((r["idx"], list(r["members"])))
    assert {c: sorted(v) for c, v in got.items()} == {c: v for c, v in want.items() if v}
    with pytest.raises(Exception, match="not resolved"):
        runs.runs(mentions.resolved(found, None)).collect()
    assert runs.runs(mentions.resolved(found, None), strict=False).count() > 0
    assert mentions.pending(found, asked.limit(0), chapters).count() == asked.count()


def test_open_mentions_matter_only_where_a_run_comes():
    with pytest.raises(runs.OpenMention):
        list(runs.walk(30, {3: (1, None, True)}))
    assert [i for i, _ in runs.walk(60, {0: (3, 5, False), 1: (1, None, True)})] == [0, 3, 27, 51]


def edges_of(spark, rows):
    return spark.createDataFrame([(*r, 1) if len(r) == 2 else r for r in rows], "src bigint, dst bigint, weight bigint")


def test_graph(spark):
    e = edges_of(spark, [(1, 2), (2, 1), (2, 3, 5), (4, 4), (5, 6), (7, 8), (8, 9)])
    w = {(r["src"], r["dst"]): r["weight"] for r in graph.weighted(e).collect()}
    assert w[1, 2] == 2 and w[2, 3] == 5
    assert sorted(map(tuple, graph.heavy(graph.weighted(e), 2, (5,)).select("src", "dst").collect())) == [(1, 2), (2, 3), (5, 6)]
    assert {r["src"]: r["weight"] for r in graph.combined(e, e).where("src = 2").collect()} == {2: 10}
    nodes = spark.createDataFrame([(k, "w" if k < 5 else "v") for k in range(1, 11)], "id bigint, world string")
    assert dict(map(tuple, components(e, nodes).collect())) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7, 8: 7, 9: 7, 10: 10}
    assert {r["id"] for r in graph.large_components(nodes, e).collect()} == {1, 2, 3, 7, 8, 9}
    assert {(r["scope"], r["id"]) for r in graph.scopes(nodes, e).collect()} == {("all", k) for k in (1, 2, 3, 7, 8, 9)} | {("w", 1), ("w", 2), ("w", 3), ("v", 7), ("v", 8), ("v", 9)}
    assert {tuple(r) for r in graph.ego(e, 2).collect()} == {(2, 0), (1, 1), (3, 1)}
    assert {r["id"] for r in graph.component_of(e, 8).collect()} == {7, 8, 9} and {r["id"] for r in graph.component_of(e, 10).collect()} == {10}
    assert graph.connected(nodes, e).count() == 9
    long = spark.createDataFrame([(k, k + 1) for k in range(200)], "src bigint, dst bigint")
    assert components(long).select("component").distinct().count() == 1


def test_views(spark):
    nodes = spark.createDataFrame([(1, "x", "p", ["Ann", "Queen"]), (2, "y", "p", ["Bob"]), (3, "y", "q", ["Cy"])], "id bigint, world string, kind string, monikers array<string>").withColumn("name", F.col("monikers")[0])
    e = edges_of(spark, [(1, 2), (2, 3)])
    facets = views.toggled(views.toggled({}, "world", "x"), "kind", "q")
    assert views.applied(facets, "world", "x") and views.toggled(facets, "kind", "q") == {"world": {"x"}}
    n, k = views.subset(nodes, e, facets)
    assert {r["id"] for r in n.collect()} == {1, 3} and k.count() == 0
    assert views.subset(nodes, e, {})[1].count() == 2
    n, k = views.exact(nodes, e, "world", "y")
    assert n.count() == 2 and [tuple(r)[:2] for r in k.collect()] == [(2, 3)]
    assert [r["id"] for r in views.search(nodes, "uEE").collect()] == [1] and views.search(nodes, "").count() == 0
    assert views.suggestions(nodes, "ann").first()["aliases"] == ["Queen"]


def test_kin(spark):
    rows = [
        (1, "Ann Lee", "Lee", ["Ann Lee", "Ann"], "w", ["Bob Lee", "Cy", "Dee of old", "nobody"]), (2, "Bob Lee", "Lee", ["Bob Lee"], "w", []), (3, "Cy Lee", "Lee", ["Cy Lee"], None, []),
        (4, "Dan", "", ["Dan", "Lord Dee of old"], "w", ["Annie"]), (5, "Annie", "", ["Annie"], "w", []),
    ]
    who = spark.createDataFrame([(*r[:5], {"siblings": r[5]}) for r in rows], "id bigint, name string, surname string, monikers array<string>, world string, relatives map<string,array<string>>")
    got = {(r["id"], r["relation"]): (r["target"], r["how"]) for r in kin.targets(kin.relations(who), who).collect()}
    assert got == {(1, "Bob Lee"): (2, 1), (1, "Cy"): (3, 2), (1, "Dee of old"): (4, 4), (1, "nobody"): (None, None), (4, "Annie"): (5, 1)}
    nodes, e = kin.graph(who)
    assert sorted(map(tuple, e.collect())) == [(1, 2), (1, 4), (4, 5)] and nodes.count() == 4
    assert kin.within(nodes, e, world="v")[1].count() == 0


def test_delta(spark):
    schema = "pageid bigint, title string, timestamp timestamp, content string"
    old = spark.createDataFrame([(1, "A", None, "x\ny"), (2, "B", None, "b"), (3, "C", None, "c"), (5, "E", None, "e")], schema)
    new = spark.createDataFrame([(1, "A", None, "x\nz"), (2, "B2", None, "b"), (4, "D", None, "d"), (5, "E", None, "e")], schema)
    found = delta.with_diff(delta.changes(old, new))
    assert {r["pageid"]: r["change"] for r in found.collect()} == {1: "modified", 2: "renamed", 3: "removed", 4: "added"}
    lines = [r["line"] for r in delta.log_lines(found).orderBy("pageid", "at").collect()]
    assert lines[0] == "[[A]] modified." and "-y" in lines and "+z" in lines and "[[B]] renamed to [[B2]]." in lines and "[[C]] removed." in lines


def test_graph_files(spark, tmp_path):
    nodes = spark.createDataFrame([(5, 'A "x" & y', ["p", "q"], True, None), (3, "B", ["one"], False, "w"), (9, "", [], True, "v")], "id bigint, name string, aliases array<string>, living boolean, world string")
    e = edges_of(spark, [(3, 5, 4), (5, 9, 1)])
    graphs.write_gml(nodes, e, str(tmp_path / "g"))
    text_ = "\n".join(r[0] for p in sorted((tmp_path / "g").glob("part*")) for r in spark.read.text(str(p)).collect())
    got, links = graphs.read_gml(text_)
    assert got == [{"name": "B", "aliases": ["one"], "living": 0, "world": "w", "id": 3}, {"name": 'A "x" & y', "aliases": ["p", "q"], "living": 1, "world": None, "id": 5}, {"name": None, "aliases": None, "living": 1, "world": "v", "id": 9}]
    assert links == [{"source": 3, "target": 5, "weight": 4}, {"source": 5, "target": 9, "weight": 1}]
    graphs.write_nodelink(nodes, e, str(tmp_path / "j"))
    n, k = graphs.read_nodelink(spark, str(tmp_path / "j"))
    assert sorted(map(str, n.select(*nodes.columns).collect())) == sorted(map(str, nodes.collect())) and sorted(map(tuple, k.select("src", "dst", "weight").collect())) == [(3, 5, 4), (5, 9, 1)]


def test_resolution_files(spark, tmp_path):
    (tmp_path / "a.yml").write_text("c1:\n  3: 7\n  9: null\nc2: {}\n")
    (tmp_path / "b.yml").write_text("- x\n")
    chapters, rows = graphs.read_resolution(spark, str(tmp_path / "a.yml"), "k")
    assert chapters.count() == 2 and sorted(map(tuple, rows.collect())) == [("k", "c1", 3, 7), ("k", "c1", 9, None)]
    with pytest.raises(graphs.NoResolution):
        graphs.read_resolution(spark, str(tmp_path / "no.yml"), "k")
    with pytest.raises(graphs.BadResolution):
        graphs.read_resolution(spark, str(tmp_path / "b.yml"), "k")
    assert graphs.read_resolution(spark, str(tmp_path / "no.yml"), "k", strict=False)[1].count() == 0
    graphs.write_resolution(rows, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == 2


def test_pages(spark, tmp_path):
    assert pages.format_of("a/b.JSON") == "json" and pages.format_of("x.log") == "text" and pages.format_of("dir") == "parquet"
    with pytest.raises(ValueError):
        pages.format_of("a.pkl")
    (tmp_path / "s.json").write_text('[{"pageid": 2, "title": "B", "revisions": [{"timestamp": "2020-01-02T03:04:05Z", "slots": {"main": {"content": "x"}}}]}, {"pageid": 1}]')
    got = pages.flat(pages.snapshot(spark, str(tmp_path / "s.json"))).collect()
    assert [r["pageid"] for r in got] == [1, 2] and got[0]["content"] == "" and str(got[1]["timestamp"]) == "2020-01-02 03:04:05"
    made = []
    make = pages.cached(str(tmp_path / "kept.parquet"))(lambda s, n: made.append(n) or s.range(n))
    assert make(spark, 3).count() == 3 and make(spark, 9).count() == 3 and made == [3]
    answers = iter([{"query": {"pages": [{"pageid": 1}]}, "continue": {"c": 1}}, {"query": {"pages": [{"pageid": 2}]}}])
    asked = []
    assert [p["pageid"] for p in pages.batches(lambda q: asked.append(q) or next(answers), {"a": 0})] == [1, 2] and asked == [{"a": 0}, {"a": 0, "c": 1}]
    with pytest.raises(pages.SourceError):
        list(pages.batches(lambda q: {"error": "no"}, {}))
    spark.dataSource.register(pages.PagedSource)
    assert spark.read.format("pages").option("ask", "tests.paged:ask").option("parts", 2).load().count() == 4
    opf = '<package xmlns="urn:x"><manifest><item id="c2" href="b.html" media-type="application/xhtml+xml"/><item id="img" href="i.png" media-type="image/png"/><item id="c1" href="a.html" media-type="application/xhtml+xml"/></manifest></package>'
    found = spark.createDataFrame([(opf, "c[0-9]")], "o string, p string").select(pages.manifest(F.col("o"), F.col("p"))).first()[0]
    assert [tuple(x) for x in found] == [("c2", "b.html"), ("c1", "a.html")]
    assert one(spark, pages.paragraphs(F.col("t")), t="<p>a<b>b</b><script>'</p>'</script><p class=x>c &amp;lt; d</p>tail<div><p>e</div>") == "ab\nc &lt; d\ne"


def test_stream(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "k", "Ann met Bob"), ("2024-01-01 00:20:00", "k", "Bob and Ann"), ("2024-01-01 01:10:00", "k", "Ann alone")]
    table = spark.createDataFrame(rows, "at string, key string, text string").withColumn("at", F.to_timestamp("at"))
    table.write.parquet(str(tmp_path / "in"))
    lex = {"Ann": 1, "Bob": 2}
    want = sorted(map(str, cooccurrence.edges(table, lex).collect()))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    q = cooccurrence.edges(stream, lex).writeStream.outputMode("complete").format("memory").queryName("pairs").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(str, spark.table("pairs").collect())) == want and spark.table("pairs").first()["weight"] == 2


def test_commands(spark, tmp_path):
    import json

    root = str(tmp_path / "root")
    page = lambda i, t, c: {"pageid": i, "title": t, "revisions": [{"timestamp": "2020-01-01T00:00:00Z", "slots": {"main": {"content": c}}}]}
    box = lambda kin_: "{{character|universe=tales|world=w|books=[[One]]|siblings=" + kin_ + "}}"
    first = [page(1, "Ann Lee", box("[[Bob Lee]]")), page(2, "Bob Lee", box("[[Cy Lee]]")), page(3, "Cy Lee", box(""))]
    (tmp_path / "a.json").write_text(json.dumps(first))
    (tmp_path / "b.json").write_text(json.dumps([*first[:2], page(3, "Cy Lee", box("") + "\nnew"), page(4, "Dee Lee", box(""))]))
    (tmp_path / "dims.json").write_text(json.dumps({"books": {"One": "one"}, "titles": ["King"]}))
    run = lambda *a: cli.main(["--root", root, "--dims", str(tmp_path / "dims.json"), "--universe", "tales", *a], spark)
    assert len(run("refresh", "characters", str(tmp_path / "a.json"))) == 1
    log = run("refresh", "characters", str(tmp_path / "b.json"))[0]
    assert "[[Dee Lee]] added." in [r[0] for r in spark.read.text(log).collect()]
    assert len(run("analyze", "relatives")) == 4 and len(run("analyze", "relatives", "--world", "w", "--format", "json")) == 1
    spark.createDataFrame([("one/a", "1", "Ann met Bob and Ann saw Bob. " * 3), ("one/b", "2", "Cy and Dee and Bob")], "key string, chapter string, text string").write.parquet(root + "/chapters.parquet")
    assert run("disambiguate", "one") == [root + "/pending.parquet"]
    assert run("list", "worlds") == ["w"] and run("list", "books") == ["one"] and run("list", "keys") == ["one", "one/a", "one/b"]
    (tmp_path / "answers.json").write_text('[{"key": "one/a", "chapter": "1", "pos": 0, "char_id": 2}, {"key": "one/a", "chapter": "1", "pos": 3, "char_id": 99}]')
    run("disambiguate", "one", "--answers", str(tmp_path / "answers.json"))
    (tmp_path / "answers.json").write_text('[{"key": "one/a", "chapter": "1", "pos": 0, "char_id": 1}]')
    run("disambiguate", "one", "--answers", str(tmp_path / "answers.json"))
    assert sorted(map(tuple, graphs.stored_resolution(spark, root + "/resolution").collect())) == [("one/a", "1", 0, 1), ("one/a", "1", 3, 99)]
    out = run("analyze", "interactions", "one", "--format", "json")
    nodes, e = graphs.read_nodelink(spark, out[0])
    assert e.count() >= 1 and nodes.count() >= 2
    assert len(run("analyze", "interactions", "all", "--discretize", "--format", "gml")) == 2
    assert run("show", "gml") == [root + "/graphs/gml"] and run("cleanup", "gml", "logs")
    assert run("refresh", "list") == ["characters"]


def test_recalled_and_default_answers(spark):
    found = spark.createDataFrame([("one", "1", 100, p, 1, k, ids, m) for p, k, ids, m in ((0, 1, [1, 2], "Ann"), (3, 1, [1, 2], "Ann"), (6, 0, [], "King"), (9, 1, [2], "Bob"))], "key string, chapter string, n_tokens int, pos int, step int, kind int, ids array<bigint>, moniker string")
    answers = spark.createDataFrame([("one", "1", 0, 99)], "key string, chapter string, pos int, char_id bigint")
    who = spark.createDataFrame([(1,), (2,)], "id bigint")
    usual = spark.createDataFrame([("Ann", 2), ("King", 1)], "moniker string, char_id bigint")
    known = mentions.recalled(mentions.with_defaults(answers, found, usual), who)
    got = {r["pos"]: (r["hit"], r["open"]) for r in mentions.resolved(found, known).collect()}
    assert got == {0: (None, False), 3: (2, False), 6: (None, True), 9: (2, False)}


def test_books(spark, tmp_path):
    for key in ("a", "a/b", "c"):
        (tmp_path / key / "text x").mkdir(parents=True)
        (tmp_path / key / "text x" / "content.opf").write_text('<package><manifest><item id="c1" href="one.html" media-type="application/xhtml+xml"/><item id="toc" href="t.html" media-type="application/xhtml+xml"/></manifest></package>')
        (tmp_path / key / "text x" / "one.html").write_text(f"<p>{key}</p>")
        (tmp_path / key / "text x" / "t.html").write_text("<p>no</p>")
    got = pages.chapters(spark, str(tmp_path), {"a": r"c\d", "a/b": "toc", "c": None}).collect()
    assert sorted(map(tuple, got)) == [("a", "c1", "a"), ("a/b", "toc", "no")]


def test_wikitext_in_one_pass():
    many = 10_000
    assert wikitext.parse("{{a|" * many) == ["{{a|" * many]
    deep = wikitext.parse("{{a|" * many + "}}" * many)
    assert len(deep) == 1 and sum(1 for _ in wikitext.walk(deep)) == many
    got = wikitext.parse("x {{a|b=c=d|[[t|s]]|{{z}}}} {{open|[[u]]")
    assert got == ["x ", wikitext.Template("a", [("b", ["c=d"]), (None, [wikitext.Link("t", "s")]), (None, [wikitext.Template("z")])]), " {{open|", wikitext.Link("u")]
    assert wikitext.parse("[[a {{b}} | c") == ["[[a ", wikitext.Template("b"), " | c"]


def test_walk_by_mentions_equals_walk_by_tokens():
    def by_tokens(n, at, size):
        idx = 0
        while idx < n:
            i, ids, first, end = 0, [], 0, min(size, n - idx)
            while i < end:
                step, hit, _ = at.get(idx + i, (1, None, False))
                i += step
                if hit is not None:
                    if not ids:
                        first = i
                    ids.append(hit)
            yield idx, ids
            idx += first + 1 if len(ids) > 1 else first if ids else size - 1

    rnd = random.Random(5)
    for _ in range(300):
        n = rnd.randint(0, 120)
        at = {p: (rnd.randint(1, 3), rnd.choice([None, 1, 2, 3]), False) for p in range(n) if rnd.random() < rnd.choice([0.02, 0.2, 0.9])}
        assert list(runs.walk(n, at)) == list(by_tokens(n, at, 25))


def test_runs_read_many_chapters_at_a_time(spark, monkeypatch):
    """A chapter may be cut by a batch, and a group of rows a chapter goes to Python no more."""
    rows = [(k, str(c), 60, p, 1, p % 7, False) for k in ("a", "b", None) for c in range(40) for p in range(0, 60, 3)]
    found = spark.createDataFrame(rows, "key string, chapter string, n_tokens int, pos int, step int, hit bigint, open boolean")
    want = sorted((str(k), str(c), idx, sorted(set(ids))) for k in ("a", "b", None) for c in range(40) for idx, ids in runs.walk(60, {p: (1, p % 7, False) for p in range(0, 60, 3)}) if ids)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    monkeypatch.setattr(runs, "BATCH", 11)
    try:
        out = runs.runs(found)
        assert sorted((str(r["key"]), r["chapter"], r["idx"], list(r["members"])) for r in out.collect()) == want
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "FlatMapGroups" not in plan
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert runs.runs(found.limit(0)).count() == 0


def test_pages_are_dealt_out_and_parsed_once(spark, tmp_path):
    spark.createDataFrame([(k, f"P{k}", BOX) for k in range(50)], "pageid bigint, title string, content string").coalesce(1).write.parquet(str(tmp_path / "one"))
    flat = spark.read.parquet(str(tmp_path / "one"))
    assert flat.rdd.getNumPartitions() == 1
    found = entities.boxes(flat, Dims())
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) and found.count() == 50
    assert wikitext.plain(["a '' b"]) == "a  b" and wikitext.plain(["it's <b>c</b>", wikitext.Link("d")]) == "it's cd"


def test_overrides_and_scopes_read_written_tables(spark):
    from weftgraph.plans import graphs as plans
    from weftgraph.plans import records

    plan = records.entity_overrides(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and "MapInPandas" not in plan
    plan = plans.graph_scopes(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "lineitem.parquet" not in plan and "l_partkey" not in plan


def test_ngrams_need_no_shuffle(spark):
    from weftgraph.plans import network

    plan = network.ngram_lookahead(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    rows = spark.createDataFrame([("k", "1", "a b"), ("k", "2", ""), ("k", "3", None)], "key string, chapter string, text string")
    assert [(r["pos"], r["n_tokens"], r["two"], r["three"]) for r in mentions.ngrams(rows).collect()] == [(0, 2, "a b", "a b "), (1, 2, "b ", "b  ")]


def test_ladder_looks_up_only_words_that_begin_a_moniker(spark):
    rows = spark.createDataFrame([("b", "1", "x A B C y T z T A B")], "key string, chapter string, text string")
    lexic = spark.createDataFrame([("A B C", 1), ("B", 2), ("A", 3), ("A", 4)], "moniker string, id bigint")
    who = spark.createDataFrame([(k, ["b"]) for k in (1, 2, 3, 4)], "id bigint, books array<string>")
    found = mentions.mentions(mentions.ngrams(rows), mentions.candidates(lexic, who), ["T"])
    assert sorted((r["pos"], r["step"], r["kind"], r["ids"], r["moniker"]) for r in found.collect()) == [(1, 3, 3, [1], "A B C"), (2, 1, 1, [2], "B"), (5, 1, 0, [], "T"), (8, 1, 1, [3, 4], "A"), (9, 1, 1, [2], "B")]
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()


def test_tokens_in_one_split_equal_those_in_steps(spark):
    rnd = random.Random(3)
    pool = [*"ab s's’‘'\t\n\u0085   　é.,-—…/•~?!;:_0Ś"]
    rows = spark.createDataFrame([("".join(rnd.choices(pool, k=rnd.randint(0, 30))),) for _ in range(2000)], "x string")
    steps = F.filter(F.split(F.regexp_replace(text.stripped(F.col("x")), text.INFIX, " "), r"(?U)\s+"), lambda t: t != "")
    assert rows.where(steps != text.tokens(F.col("x"))).count() == 0
