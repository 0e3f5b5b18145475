import itertools
import math
import random
import zlib

import numpy as np
import pytest

from tests.llm import brute
from weftgraph.llm import chat, langid, licences, line_dedup, media, mixing, ngram_join, pieces, quality, sharding, trie
from weftgraph.llm.common import n_words, words_of
from weftgraph.llm.graph import blocked, by_group, components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]


def test_words(spark):
    texts = ["", " ", "a", " a", "a ", "a\x0bb\x0c\n c", " ", "a\x00b", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(n_words(mixing.F.col("t")), words_of(mixing.F.col("t"))).collect()
    assert [r[0] for r in got] == [len(brute.words(t)) for t in texts] and [r[1] for r in got] == [brute.words(t) for t in texts]


def test_components_and_groups(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 500)] + [(600, k) for k in range(601, 700)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    rows = spark.createDataFrame([(k % 3, k) for k in range(90)] + [(7, 1)], "key bigint, id bigint")
    cut = blocked(rows, "key", "id", 8).collect()
    meet = {(a["key"], a["id"], b["id"]) for a in cut for b in cut if a["key"] == b["key"] and (a["i"], a["j"]) == (b["i"], b["j"])}
    assert meet == {(a % 3, a, b) for a in range(90) for b in range(90) if a % 3 == b % 3}

    def total(table):
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array([table.column("key")[0].as_py()]), pa.array([sum(table.column("id").to_pylist())])], names=["key", "s"])

    assert dict(map(tuple, by_group(rows, ["key"], total, "key bigint, s bigint").collect())) == {r: sum(k for k in range(90) if k % 3 == r) for r in range(3)} | {7: 1}


@pytest.mark.parametrize("seed", range(20))
def test_trie_equals_brute_force(seed):
    rnd = random.Random(seed)
    base = [rnd.sample(range(400), rnd.randint(1, 150)) for _ in range(3)]
    sets = []
    for _ in range(rnd.randint(1, 40)):
        b = set(rnd.choice(base))
        for _ in range(rnd.randint(0, 20)):
            b ^= {rnd.randrange(400)}
        sets.append(np.array(sorted(b), np.uint64))
    label, links = trie.joined(sets, 75)
    want, many = brute.linked([frozenset(s.tolist()) for s in sets], 75)
    assert [list(label).index(x) for x in label] == [want.index(x) for x in want] and list(links) == many


def test_ngram_join_equals_brute_force(docs, rows):
    rows = sorted(rows)
    label, links = brute.linked([brute.shingles(t) for _, t, _ in rows], 75)
    want = {r[0]: (len(brute.shingles(r[1])), rows[label[k]][0], links[k]) for k, r in enumerate(rows)}
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in ngram_join.digest(docs).collect()} == want


def test_blocks_of_worlds_lose_no_link(docs, monkeypatch):
    want = sorted(map(tuple, ngram_join.digest(docs).collect()))
    monkeypatch.setattr(ngram_join, "SETS", 3)
    monkeypatch.setattr(ngram_join, "ELEMENTS", 500)
    monkeypatch.setattr(ngram_join, "FEW", 0)
    assert sorted(map(tuple, ngram_join.digest(docs).collect())) == want


def test_line_dedup_equals_brute_force(docs, rows, monkeypatch):
    gone = brute.lines_gone([r[:2] for r in rows])
    want = {}
    for i, t, _ in rows:
        left = "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i, t])
        want[i] = (len(t.split("\n")), len(gone[i, t]), len(left))
    got = {r["doc_id"]: tuple(r)[1:4] for r in line_dedup.digest(docs).collect()}
    assert got == want
    monkeypatch.setattr(line_dedup, "HELD", 50)
    monkeypatch.setattr(line_dedup, "ELEMENTS", 300)
    assert {r["doc_id"]: tuple(r)[1:4] for r in line_dedup.digest(docs).collect()} == want


def test_fuzzy_lines(spark):
    a = "The quick brown fox jumps over the lazy dog while seven wizards watch from a hill far away in the north"
    b = a.replace("seven", "eleven").upper()
    c = spark.createDataFrame([(1, a), (2, b + "\nsomething else that is not alike at all"), (3, "unlike either of them in every way"), (4, b)], "doc_id bigint, text string")
    assert {r["doc_id"]: r["n_dropped"] for r in line_dedup.digest(c).collect()} == {1: 0, 2: 1, 3: 0, 4: 1}
    out = {r["doc_id"]: r["text"] for r in line_dedup.without_copies(c).collect()}
    assert out == {1: a, 2: "something else that is not alike at all", 3: "unlike either of them in every way"}


def test_mixing_equals_brute_force(docs, rows):
    copies, target = brute.mixed(rows)
    got = mixing.digest(docs).collect()
    assert {r["doc_id"]: r["taken"] for r in got} == {d[0]: len(brute.words(d[1])) * n for d, n in copies.items()}
    by = {i: s for i, _, s in rows}
    assert all(math.isclose(r["target"], target[by[r["doc_id"]]]) for r in got)
    order = [r["doc_id"] for r in mixing.curriculum(docs).collect()]
    assert sorted(order) == sorted(d[0] for d, n in copies.items() for _ in range(n)) and order == [r["doc_id"] for r in mixing.curriculum(docs).collect()]


def test_caps_of_targets(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, None: 3, "z": 0}
    rows = spark.createDataFrame([(s is None, s or "", n) for s, n in sizes.items()], "src_null boolean, src string, source_size bigint")
    got = {None if r["src_null"] else r["src"]: r["target"] for r in mixing.targets(rows).collect()}
    assert got == pytest.approx(brute.fill(sizes))
    assert sum(got.values()) == pytest.approx(1018)


def test_schedule_is_inverted():
    for slope in (-0.5, 0.0, 0.3):
        t = np.linspace(0, 1, 11)
        u = (1 + slope) * t - slope * t * t
        b = 1 + slope
        assert np.allclose(2 * u / (b + np.sqrt(b * b - 4 * slope * u)), t)


def test_flow_moves_the_fewest_bytes():
    rnd = random.Random(2)
    for _ in range(30):
        old, new = rnd.randint(1, 6), rnd.randint(1, 8)
        supply = [rnd.randint(0, 50) for _ in range(old)]
        total = sum(supply)
        capacity = [total * (j + 1) // new - total * j // new for j in range(new)]
        flow = sharding.min_cost_flow(supply, capacity)
        assert [sum(r) for r in flow] == supply and [sum(c) for c in zip(*flow, strict=True)] == capacity
        assert sum(flow[i][i] for i in range(min(old, new))) == sum(min(supply[i], capacity[i]) for i in range(min(old, new)))


def test_shards(docs, spark, tmp_path):
    got = sharding.digest(docs).toPandas()
    texts = dict(docs.select("doc_id", "text").collect())
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.size == len(texts[r.doc_id].encode()) + 8 for r in got.itertuples())
    for _, own in got.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    sums = got.groupby("shard")["size"].sum().reindex(range(24), fill_value=0)
    assert (sums - got["size"].sum() / 24).abs().max() <= 2 * got["size"].max()
    path = str(tmp_path / "table")
    docs.withColumn("shard", sharding.F.pmod(sharding.F.xxhash64("doc_id"), sharding.F.lit(4)).cast("int")).write.partitionBy("shard").parquet(path)
    read = lambda: spark.read.parquet(path)
    assert sharding.rewrite(spark, path, old=4, new=6) == list(range(6))
    assert sorted(map(tuple, read().drop("shard").collect())) == sorted(map(tuple, docs.collect())) and read().select("shard").distinct().count() == 6
    assert sharding.rewrite(spark, path, old=6, new=6) in ([], *([a, b] for a in range(6) for b in range(a + 1, 6))) or read().count() == docs.count()
    assert set(sharding.rewrite(spark, path, old=6, new=4)) >= {4, 5}
    assert sorted(map(tuple, read().drop("shard").collect())) == sorted(map(tuple, docs.collect())) and {r[0] for r in read().select("shard").distinct().collect()} == set(range(4))


def test_shards_without_a_number_and_cut_off_swaps(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = [(k % 7 if k % 5 else None, None if k % 11 == 0 else f"text {k % 13} " * (k % 17), (None, 0, 1, 9)[k % 4]) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, shard int")
    docs.write.partitionBy("shard").parquet(path)
    changed = sharding.rewrite(spark, path, docs.schema, old=2, new=3)
    assert changed == [None, 0, 1, 2, 9]
    read = lambda: spark.read.schema(docs.schema).parquet(path)
    assert sorted(map(str, read().drop("shard").collect())) == sorted(map(str, docs.drop("shard").collect()))
    sums = dict(read().groupBy("shard").agg(sharding.F.sum(sharding.size_of(sharding.F.col("text")))).collect())
    assert set(sums) == {0, 1, 2} and max(sums.values()) - min(sums.values()) <= 2 * max(len(t or "") + 8 for _, t, _ in rows)
    real, calls = sharding.swap, []

    def cut_off(session, at):
        calls.append(at)
        if len(calls) == 2:  # the new shards are written, nothing is in its place yet
            raise RuntimeError("the driver is lost")
        real(session, at)

    sharding.swap = cut_off
    try:
        with pytest.raises(RuntimeError):
            sharding.rewrite(spark, path, docs.schema, old=3, new=2)
    finally:
        sharding.swap = real
    assert read().count() == 200
    sharding.rewrite(spark, path, docs.schema, old=2, new=2)
    assert sorted(map(str, read().drop("shard").collect())) == sorted(map(str, docs.drop("shard").collect())) and {r[0] for r in read().select("shard").distinct().collect()} == {0, 1}


def test_quality(docs, rows):
    def repeats(text):
        w = brute.words(text)
        seen = {}
        for i in range(len(w) - 4):
            seen.setdefault(tuple(w[i : i + 5]), []).append(i)
        return len({i + k for at in seen.values() if len(at) > 1 for i in at for k in range(5)})

    labels = docs.sparkSession.read.parquet(f"{SF}/labels.parquet")
    got = {r["doc_id"]: r for r in quality.digest(docs, labels).collect()}
    for i, t, _ in rows:
        assert got[i]["n_repeat_words"] == repeats(t) and got[i]["n_words"] == len(brute.words(t)) and got[i]["n_symbols"] == sum(c in "#*$%&|<>" for c in t)
        assert got[i]["word_chars"] == sum(map(len, brute.words(t)))


def test_binomial_tail(spark):
    cases = [(0, 50), (1, 400), (5, 3000), (0, 0), (9, 100), (20, 5000)]
    p = 0.0125
    got = [r[0] for r in spark.createDataFrame(cases, "k bigint, n bigint").select(quality.tail(quality.F.col("k"), quality.F.col("n"), p)).collect()]
    for (k, n), x in zip(cases, got, strict=True):
        exact = sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1)) if n and k < n * p else 1.0
        assert x == pytest.approx(exact, rel=1e-9)


def test_certified_cutoffs(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(30)) + (" ###" * 20 if i % 10 == 0 else ""), "en") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 10 != 0)) for i in range(3500)], "doc_id bigint, quality int")
    got = quality.digest(docs, labels).where("not base_failed").toPandas()
    assert (got["kept"] == (got["doc_id"] % 10 != 0)).all() and len(got) > 3000
    few = quality.digest(docs, labels.where("doc_id < 100")).where("not base_failed").toPandas()
    assert few["kept"].all()


def test_png_round_trip_and_filters():
    rnd = np.random.default_rng(1)
    for size in (0, 1, 63, 64, 65, 5000):
        raw = rnd.integers(0, 255, size, np.uint8).tobytes().decode("latin-1")
        payload = media.padded(raw)
        assert media.decode(media.encode(payload)).tobytes() == payload and len(payload) % 64 == 0 and len(payload) >= 64
    image = rnd.integers(0, 256, (40, 64)).astype(np.uint8)
    kinds = rnd.integers(0, 5, 40)
    lines = np.zeros((40, 64), np.uint8)
    for y, x in itertools.product(range(40), range(64)):
        left, up = int(image[y, x - 1]) if x else 0, int(image[y - 1, x]) if y else 0
        corner = int(image[y - 1, x - 1]) if x and y else 0
        p = left + up - corner
        near = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
        lines[y, x] = (int(image[y, x]) - [0, left, up, (left + up) // 2, near][kinds[y]]) % 256
    assert (media.unfilter(kinds, lines) == image).all()
    good = media.encode(b"a" * 640)
    for at in (3, 20, 45, len(good) - 3):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            media.decode(bytes(bad))
    with pytest.raises(ValueError):
        media.decode(good[:-12])
    near = media.decode(media.encode(media.padded("hello world " * 300)))
    assert len(media.cosine_hash(near)) == 8 and media.cosine_hash(near) == media.cosine_hash(near.copy())


def test_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.digest(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(got) > 150 and (got["lang"] == got["lang_pred"]).mean() > 0.97 and got["score"].between(0, 1).all()
    assert langid.digest(spark.createDataFrame([(1, "123 !"), (2, "abc")], "doc_id bigint, text string").selectExpr("*", "cast(null as string) as lang")).select("lang_pred").distinct().collect()[0][0] == "und"


def test_filters_have_no_false_negatives():
    rnd = np.random.default_rng(2)
    members = {f"l{k:03}": rnd.integers(0, 2**32, 500).astype(np.uint32) for k in range(70)}
    f = langid.Filters(sorted(members), members)
    assert len(f.slices) == 2
    for k, lang in enumerate(f.langs):
        mask = np.uint64(~np.uint64(0))
        for p in langid.positions(members[lang], f.bits):
            mask = mask & f.slices[k // 64][p]
        assert (mask >> np.uint64(k % 64) & np.uint64(1)).all()
    assert len(langid.grams(b"x" * 10)) == len(langid.grams(b"x" * 4)) + 6


def test_licences_equal_brute_force(docs, rows):
    tool = licences.Scanner(licences.TEMPLATES)
    extra = ["x\n" + licences.TEMPLATES["MIT-full"] + "\nnothing", "\n".join(["Released under the MIT License."] * 300), licences.TEMPLATES["BSD-2-Clause"].replace("source", "course")]
    for text in [t for _, t, _ in rows if "icense" in t][:20] + extra[::2]:
        lines = [licences.words(x) for x in text.split("\n")]
        want = set()
        for name, template in licences.TEMPLATES.items():
            own = licences.bigrams(licences.words(template))
            best = 0.0
            for a in range(len(lines)):
                for b in range(a, len(lines)):
                    got = licences.bigrams([w for x in lines[a : b + 1] for w in x])
                    best = max(best, 2 * len(got & own) / (len(got) + len(own)) if got else 0)
            if best >= licences.THRESHOLD:
                want.add((name, round(best, 9)))
        assert {(f[0], round(f[3], 9)) for f in tool.scan(text)} == want
    assert {f[0] for f in tool.scan(extra[1])} == {"MIT"}


def test_nbest_equals_enumeration():
    rnd = random.Random(4)
    alphabet = "ab."
    words = {"".join(rnd.choices(alphabet, k=rnd.randint(1, 3))) for _ in range(14)} | {"a", "b", "▁", "▁a", "▁ab"}
    vocabulary = {w: (k, -rnd.randint(1, 9)) for k, w in enumerate(sorted(words))}
    tool = pieces.Pieces(vocabulary, 100, {k: w.replace("▁", " ").encode() for w, (k, _) in vocabulary.items()} | {100 + b: bytes([b]) for b in range(256)})

    def every(text):
        """(score, ids) of all segmentations."""
        if not text:
            return [(0, ())]
        out = []
        for j in range(1, len(text) + 1):
            if text[:j] in vocabulary:
                k, s = vocabulary[text[:j]]
                out += [(s + t, (k, *ids)) for t, ids in every(text[j:])]
        if text[0] not in vocabulary:
            out += [(tool.lowest + t, (*(100 + b for b in text[0].encode()), *ids)) for t, ids in every(text[1:])]
        return out

    for _ in range(60):
        text = "".join(rnd.choices(alphabet + " c", k=rnd.randint(1, 9)))
        all_ways = every("▁" + text.replace(" ", "▁"))
        for n in (1, 2, 3, 5):
            raw, scores, others = tool.encode(text, n)
            ids = np.frombuffer(raw, "<i4").tolist()
            assert scores == sorted((s for s, _ in all_ways), reverse=True)[:n], (text, n)
            ways = [tuple(ids)]
            for changes in others:
                new = list(ids)
                for at, m, put in changes:
                    new[at : at + m] = put
                ways.append(tuple(new))
            assert len(set(ways)) == len(ways) and all((s, w) in all_ways for s, w in zip(scores, ways, strict=True)), (text, n)
        assert tool.decode(ids).decode() == text


def test_segmentations_are_written_out(spark):
    texts = ["Hello there, this is it", "", None, "x ▁ 🎉"]
    coded = pieces.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), n=4)
    tool = pieces.Pieces.load()
    for r in coded.select("*", pieces.segmentations().alias("all")).collect():
        if texts[r["doc_id"]] is None:
            assert r["all"] is None and r["others"] is None
            continue
        assert len({tuple(x) for x in r["all"]}) == len(r["all"]) == len(r["scores"]) and r["all"][0] == r["ids"]
        assert all(tool.decode(x).decode() == texts[r["doc_id"]] for x in r["all"])


def test_memory_of_segments_is_bounded_and_changes_nothing():
    tool = pieces.Pieces.load()
    rnd = random.Random(8)
    texts = [" ".join("".join(rnd.choices("abcdef", k=rnd.randint(1, 90))) for _ in range(40)) for _ in range(30)]
    want = [tool.encode(t, 3) for t in texts]
    tool.memory = pieces.Memory(tool.two, 40_000)
    assert [tool.encode(t, 3) for t in texts] == want
    assert len(tool.memory) + len(tool.memory.older) <= 40_000 // pieces.ENTRY + 2 and max(map(len, tool.memory)) <= pieces.LONG
    long = "ab" * 100_000
    assert tool.decode(np.frombuffer(tool.encode(long, 3)[0], "<i4").tolist()).decode() == long


def test_decoding_gives_every_text_back(spark, docs):
    more = spark.createDataFrame([(i, t) for i, t in enumerate(["", " ", "  a  b ", "▁x ▁", "don't, x's. 3.5%", "\U0001f389 日本\n\t", "a\x00b", None])], "doc_id bigint, text string")
    for d in (more, docs.select("doc_id", "text")):
        coded = pieces.encode(d)
        assert coded.where("text_ok = false").count() == 0
        assert sorted(map(str, pieces.decode(coded).collect())) == sorted(map(str, d.collect()))


def test_quotations(spark):
    rows = [
        (1, 0, "u", "Hello there friend\nhow are you doing"),
        (1, 1, "a", "> Hello there friend\nI am fine.\n\nAnd you?"),
        (1, 2, "u", ">> Hello there friend\n> I am fine.\n\nGreat news"),
        (1, 3, "a", "> How are YOU doing?\nlate reply"),
        (2, 5, "a", "> Hello there friend\nanother conversation"),
    ] + [(3, t, "u", "> same line as ever\nsame line as ever") for t in range(700)]
    got = {(r["conv_id"], r["turn"]): r for r in chat.thread(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert [got[1, t]["parent_turn"] for t in range(4)] == [None, 0, 1, 0] and [got[1, t]["depth"] for t in range(4)] == [0, 1, 2, 1]
    assert got[1, 2]["text"] == "Great news" and got[1, 2]["n_linked"] == 2 and got[1, 2]["levels"] == 2
    assert got[2, 5]["parent_turn"] is None and got[2, 5]["n_quotes"] == 1
    assert all(got[3, t]["parent_turn"] == (t - 1 if t else None) and got[3, t]["root_turn"] == 0 and got[3, t]["depth"] == t for t in range(700))
    order = [(r["conv_id"], r["turn"]) for r in chat.thread(spark.createDataFrame(rows[:4], "conv_id bigint, turn bigint, role string, text string")).collect()]
    assert order == [(1, 0), (1, 1), (1, 3), (1, 2)]


def test_sets_about_the_size_of_a_sketch_lose_no_link(spark):
    """Pairs of 52 to 90 shingles at just the threshold, where a partner's sketch isn't its whole set."""
    rnd = random.Random(9)
    rows, word = [], lambda: "".join(rnd.choices("abcdefgh", k=6))
    for k in range(150):
        n = rnd.randint(52, 68)
        text = [word() for _ in range(n)]
        more = (n - 4) * 100 // 75 - (n - 4)
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(text + [word() for _ in range(more)]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: (r["component_id"], r["n_links"]) for r in ngram_join.digest(docs).collect()}
    assert got == {i: (i - i % 2, 1) for i, _ in rows}
