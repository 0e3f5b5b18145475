"""Cases that every operator and stage has to take: nulls, empty and long texts, repeats, empty tables, clashing names."""

import random

import pytest
from pyspark.sql import functions as F

from weftgraph.llm import chat, langid, licences, line_dedup, media, mixing, ngram_join, pieces, quality, sharding

rnd = random.Random(3)
LONG = " ".join("".join(rnd.choices("abcdefghij", k=5)) for _ in range(40_000))
ROWS = [
    (1, None, "en", "a", 0),
    (2, "", "en", "a", 0),
    (3, " \t\n ", None, None, 4),
    (None, "one two three four five six seven eight nine ten eleven", "en", "a", 1),
    (4, "one two three four five six seven eight nine ten eleven", "en", None, 1),
    (4, "one two three four five six seven eight nine ten eleven", "en", None, 1),
    (5, LONG, "en", "b", None),
    (6, LONG + " tail", "en", "b", None),
    (7, "kurz", "de", "c", 4),
    (8, "literal ▁ mark, \U0001f389 and 日本\nline two is here and it is long enough\nline two is here and it is long enough", "de", "", 9),
    (None, None, None, None, None),
]
EXTRA = ("row", "id", "k", "size", "h", "n", "t", "c", "m", "before", "total", "lines", "kept", "s", "cut", "place", "fp", "shard", "old_shard", "root", "sig")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).select("*", *[F.lit("x").alias(c) for c in EXTRA])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (7, None, 0), (None, 1, 1), (99, 0, 0)], "doc_id bigint, quality int, toxic int")


def digests(labels):
    return {
        "licences": licences.digest,
        "media": media.digest,
        "lines": line_dedup.digest,
        "langid": langid.digest,
        "quality": lambda d: quality.digest(d, labels),
        "mixing": mixing.digest,
        "ngrams": ngram_join.digest,
        "pieces": pieces.digest,
        "sharding": sharding.digest,
    }


@pytest.mark.parametrize("name", list(digests(None)))
def test_every_row_has_a_result(spark, docs, labels, name):
    run = digests(labels)[name]
    got = run(docs).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in got) == sorted((r[0] is not None, r[0] or 0) for r in ROWS)
    twice = [r.asDict() for r in got if r["doc_id"] == 4]
    for r in twice:
        r.pop("slot", None), r.pop("shard", None)
    assert twice[0] == twice[1]
    empty = run(docs.limit(0))
    assert empty.count() == 0 and set(empty.columns) == set(got[0].asDict())


def test_filters_keep_columns(spark, docs, labels):
    for stage in (lambda d: quality.keep_good(d, labels), line_dedup.without_copies, ngram_join.keep_one, mixing.curriculum):
        out = stage(docs)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        assert stage(docs.limit(0)).count() == 0
        out.collect()


def test_near_copies_of_long_texts_link(docs):
    got = {r["doc_id"]: r for r in ngram_join.digest(docs).where("doc_id is not null").collect()}
    assert got[6]["component_id"] == 5 and got[5]["n_links"] == 1 and got[4]["component_id"] == 4 and got[4]["n_links"] == 2
    assert got[1]["component_id"] == 1 and got[1]["n_shingles"] == 0 and got[7]["n_shingles"] == 1
    kept = [r["doc_id"] for r in ngram_join.keep_one(docs).collect()]
    assert sorted(x for x in kept if x is not None) == [1, 2, 3, 4, 5, 7, 8] and kept.count(None) == 1


def test_conversations(spark):
    rows = [(1, 0, "u", None), (1, 0, "u", None), (1, None, "a", "> x"), (None, 1, "u", ""), (2, 1, None, ">" * 50 + " deep")]
    messages = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("c", F.lit(1)).withColumn("own", F.lit(2))
    assert chat.thread(messages).count() == 5
    assert chat.thread(messages.limit(0)).count() == 0
    deep = chat.thread(messages).where("conv_id = 2").first()
    assert deep["levels"] == 50 and deep["text"] == "" and deep["parent_turn"] is None
