"""Cases that a cut would lose: what a review of the operators found missing."""

import random
import zlib

import numpy as np

from tests.llm import brute
from weftgraph.llm import licences, line_dedup, ngram_join, sharding, trie

SF = "/root/testdata/sf0.001"


def test_one_row_of_repeated_ones_keeps_the_line(spark, tmp_path):
    """Rows without an id, and rows that agree in everything."""
    line, other = "a line that is long enough to be told from others", "there is another line in here, too"
    rows = [(None, line), (None, line), (7, other + "\n" + line), (7, other + "\n" + line), (7, other + "\n***"), (3, "***"), (3, "***"), (None, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(str(tmp_path / "t"))
    got = line_dedup.without_copies(spark.read.parquet(str(tmp_path / "t"))).collect()
    texts = [x for r in got if r["text"] is not None for x in r["text"].split("\n")]
    assert sorted(x for x in texts if x != "***") == [line, other] and sum(r["text"] is None for r in got) == 1 and sum(r["doc_id"] == 3 for r in got) == 2
    assert [r["doc_id"] for r in got if line in (r["text"] or "")] == [None]


def test_bands_with_several_groups_lose_no_pair(spark, monkeypatch):
    """Chains of lines whose ends are unlike; with every line in every band, all pairs have to be found."""
    monkeypatch.setattr(line_dedup, "band_keys", lambda form, a, b: np.zeros((len(a), line_dedup.BANDS), np.uint64) + np.arange(line_dedup.BANDS, dtype=np.uint64))
    rnd, rows = random.Random(6), []
    for chain in range(12):
        words = ["".join(rnd.choices("abcdefghijklmnop", k=6)) for _ in range(rnd.randint(4, 16))]
        for k in range(rnd.randint(2, 9)):
            at = rnd.randrange(len(words))
            words[at] = rnd.choice("qrstuv") + words[at][1:]
            rows.append((100 * chain + k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(1)
    gone = brute.lines_gone(rows)
    want = {r[0]: len(gone[r]) for r in rows}
    assert 10 < sum(want.values()) < len(rows) - 12
    assert {r["doc_id"]: r["n_dropped"] for r in line_dedup.digest(docs).collect()} == want
    monkeypatch.setattr(line_dedup, "ELEMENTS", 400)
    assert {r["doc_id"]: r["n_dropped"] for r in line_dedup.digest(docs).collect()} == want


def test_bands_find_nearly_all_pairs():
    """Made pairs of lines at 0.8 to 0.9 and at 0.9 or more, by length."""
    rnd, met, all_pairs = random.Random(7), {0.8: 0, 0.9: 0}, {0.8: 0, 0.9: 0}
    for _ in range(3000):
        x = "".join(rnd.choices("abcdefghijklmnopqrstuvwxyzéß日", k=rnd.randint(20, 300)))
        y = list(x)
        for _ in range(rnd.randint(1, 4)):
            y[rnd.randrange(len(y))] = rnd.choice("abcdef")
        y = "".join(y)
        a, b = ({t[i : i + 8] for i in range(len(t) - 7)} for t in (x, y))
        share = len(a & b) / len(a | b)
        if share < 0.8 or x == y:
            continue
        form, at, _ = line_dedup.normal_lines([x, y])
        keys = line_dedup.band_keys(form, at[:-1], at[1:])
        level = 0.9 if share >= 0.9 else 0.8
        all_pairs[level] += 1
        met[level] += bool((keys[0] == keys[1]).any())
        assert line_dedup.alike([x.encode()], [y.encode()], 80).tolist() == [True]
    assert min(all_pairs.values()) > 200 and met[0.8] > 0.99 * all_pairs[0.8] and met[0.9] > 0.998 * all_pairs[0.9]


def test_near_copies_of_a_line_are_compared_a_few_times_each(spark, monkeypatch):
    """A line is verified against the pivots of its bands, however many lines they hold."""
    base = "this is a notice that all pages of the site show at their very end and that hardly differs, printed on page"

    def pairs(n):
        docs = spark.createDataFrame([(k, f"{base} {k}") for k in range(n)], "doc_id bigint, text string").repartition(4)
        star = line_dedup.starred(line_dedup.scanned(docs, "doc_id", "text").where("bands is not null"))
        assert line_dedup.digest(docs).where("n_dropped = 0").count() == 1
        return star.select("k", "pivot").distinct().count()

    few, many = pairs(300), pairs(1200)
    assert few <= line_dedup.BANDS * 300 and many <= line_dedup.BANDS * 1200 and many < 8 * few


def test_copies_with_short_lines_go(spark):
    text = "Menu\n---\n\nÉ\nA line that is long enough to have a signature"
    docs = spark.createDataFrame([(1, text), (2, text), (3, "menu!\nother"), (4, "***"), (5, "ok")], "doc_id bigint, text string")
    assert {r["doc_id"]: r["text"] for r in line_dedup.without_copies(docs).collect()} == {1: text, 3: "other", 4: "***", 5: "ok"}


def test_rows_that_share_an_id_but_do_not_link_all_stay(spark):
    a, b, c = ("one two three four five six seven", "alpha beta gamma delta epsilon zeta", "red orange yellow green blue indigo")
    rows = [(None, a), (None, b), (None, b), (7, a), (8, b.upper()), (9, c), (9, "x y z"), (9, "x y z"), (10, c), (None, "p q r s t u"), (None, "v w")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r["doc_id"], r["text"]) for r in ngram_join.keep_one(docs).collect()), key=str)
    assert got == sorted([(7, a), (8, b.upper()), (9, c), (9, "x y z"), (None, "p q r s t u"), (None, "v w")], key=str)


def test_repeated_and_embedded_notices_match():
    tool = licences.Scanner(licences.TEMPLATES)
    notice = "Released under the MIT License."
    for text in (" ".join([notice] * 6), " ".join([notice] * 20_000), "\n".join([" ".join([notice] * 6)] * 3), "some words before " * 9 + notice + " and many other words that follow it" * 9, "a b c d e f g released under\nthe mit license h i j k l m n"):
        assert [f[0] for f in tool.scan(text)] == ["MIT"], text[:99]
        assert tool.scan(text)[0][3] == 1 and tool.scan(text)[0][1] == 0
    flat = "x y z " + " ".join(licences.TEMPLATES["MIT-full"].split()) + " u v w"
    assert [(f[0], f[3]) for f in tool.scan(flat)] == [("MIT-full", 1.0)]


def test_word_runs_equal_brute_force():
    rnd = random.Random(5)
    own = licences.TEMPLATES["CC-BY-4.0"]
    tool = licences.Scanner({"x": own})
    target = licences.bigrams(licences.words(own))
    for _ in range(60):
        text = "".join(w + rnd.choice("  \n") for _ in range(3) for w in [*rnd.choices("abc", k=rnd.randint(0, 3)), *[w for w in licences.words(own) if rnd.random() < 0.93]])
        w = licences.words(text)
        dice = [2 * len(g & target) / (len(g) + len(target)) for a in range(len(w)) for b in range(a + 2, len(w) + 1) if (g := licences.bigrams(w[a:b]))]
        best = max(dice, default=0)
        assert [f[3] for f in tool.scan(text)] == ([best] if best >= licences.THRESHOLD else [])


def test_sharding_reports_the_files_that_were_written(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    written, real = [], sharding.rewrite

    def rewrite(session, path, *args, **options):
        written.append((path, real(session, path, *args, **options)))
        return written[-1][1]

    monkeypatch.setattr(sharding, "rewrite", rewrite)
    got = {(r["doc_id"], r["shard"], r["size"], r["text_crc32"]) for r in sharding.digest(docs).collect()}
    ((path, changed),) = written
    files = spark.read.parquet(path).select("row.doc_id", "text", "old_shard", "shard").collect()
    assert changed and got == {(r["doc_id"], r["shard"], len(r["text"].encode()) + 8, zlib.crc32(r["text"].encode())) for r in files}
    assert sorted(tuple(r)[:2] for r in files) == sorted(map(tuple, docs.select("doc_id", "text").collect()))
    # The flow: as many bytes stay as can, but for what a cut's row adds.
    size = lambda r: len(r["text"].encode()) + 8
    total, most = sum(map(size, files)), max(map(size, files))
    stay = sum(size(r) for r in files if r["old_shard"] == r["shard"])
    best = sum(min(sum(size(r) for r in files if r["old_shard"] == i), total // 24) for i in range(16))
    assert abs(stay - best) <= 16 * most


def test_both_ways_of_comparing_lines_agree():
    random = np.random.Generator(np.random.PCG64(5))
    for n in (2, 5, 30):
        base = random.integers(0, 1 << 60, 60).astype(np.uint64)
        sets = [np.unique(np.append(base[random.random(60) > random.random() / 4], random.integers(0, 1 << 60, random.integers(1, 9)).astype(np.uint64))) for _ in range(n)]
        side = random.integers(0, n, n)
        owner = np.repeat(np.arange(n), [len(x) for x in sets])
        repeated = np.concatenate([np.concatenate(sets), sets[0]]), np.append(owner, np.zeros(len(sets[0]), int))
        assert line_dedup.few_joined(*repeated, n, side, 80).tolist() == trie.joined(sets, 80, side)[0].tolist()


def test_stars_of_bands_do_not_depend_on_buckets(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, f"line number {i % 40} of those that are nearly alike\nother line {i // 3} of some length, too") for i in range(200)], "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))

    def bands():
        star = line_dedup.starred(line_dedup.scanned(docs, "doc_id", "text").where("bands is not null")).collect()
        found = {}
        for r in star:
            found.setdefault(r["band"] & 0xFFFFFFFF, set()).update((r["k"], r["pivot"]))
        return sorted(map(sorted, found.values()))

    monkeypatch.setattr(line_dedup, "bucket_bits", lambda docs: 3)
    few = bands()
    monkeypatch.setattr(line_dedup, "bucket_bits", lambda docs: 20)
    monkeypatch.setattr(line_dedup, "HELD", 50)
    assert bands() == few and few
