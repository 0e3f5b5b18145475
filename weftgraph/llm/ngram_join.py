"""Self join of texts by the Jaccard similarity of their word shingles: a prefix-tree join, dealt out in closed worlds.

1. Each text's set is hashed once; equal sets become one, with a count.  A set's sketch is its least ``SKETCH`` hashes.
2. Sets that can't link go: if a set links, at least ``percent`` of its elements are shared.  This is tested exactly for
   sets so small that the sketches of all possible partners are whole.  Of a larger set, a linked pair shares each of the least hashes of its union with
   probability >= 0.75, so that fewer than 17 shared of 64 has a chance below 1e-15, far below that of a lost row.
3. Worlds: sets that share one of their least ``ROUTES`` hashes meet in a group (a linked pair misses all with chance
   0.25**16).  In a group, leaders are chosen: a set is attached to every leader that its sketch resembles at about 0.25
   to 0.3, and is a new leader unless it resembles one at about 0.7.  Jaccard distance obeys the triangle inequality: what links with
   a set attached to a leader at 0.7 resembles that leader at 0.45 and is attached too.  So linked sets are connected
   through leaders; the components of these edges are the worlds, and what shares only a passage stays apart.
4. In a world, the trie join of the whole sets gives all links, exactly.  Groups and worlds over a size are cut into
   blocks, each pair of which is a task of bounded size; components of the blocks' results are joined once more.

Cases: null, empty and wordless texts have the empty set and link with nothing; fewer than five words are one shingle;
repeated rows and equal texts are one set; ties go to the smallest id, then to the least text hash, and a null id is never a
representative unless all are null; ids need not be unique: rows of one id (or of none) whose texts don't link are kept apart; other columns are ignored; an empty table gives an empty result; texts are taken whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import trie
from .common import scratch
from .graph import blocked, by_group, components
from .shingles import shingle_sets, signature, together

PERCENT = 75
SKETCH, SHARED, ROUTES = 64, 17, 16
ATTACH, COVER = 24 / 128, 53 / 128
#: Most sets of a group and most elements of a world in one block.
SETS, ELEMENTS = 4096, 1 << 20
#: Ids that are broadcast when a table is read once more; above, it is joined by a shuffle.
FEW = 2_000_000


def texts_of(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def sketched(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fp, n, sig, sketch) for each row: its text's hash, size and 128-bit signature of its set, and the least hashes."""
    text = F.col(f"`{text_col}`").cast("string")
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.xxhash64(text).alias("fp"))
    schema = T.StructType([slim.schema[0], T.StructField("fp", T.LongType()), T.StructField("n", T.LongType()), T.StructField("sig", T.BinaryType()), T.StructField("sketch", T.ArrayType(T.LongType(), False))])

    def run(batches):
        for batch in batches:
            texts = texts_of(batch, 1)
            for a, b in together(texts):
                sets = shingle_sets(texts[a:b])
                least = [s[:SKETCH] for s in sets]
                values = pa.array(np.concatenate(least).view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(x) for x in least]), pa.int32()), values)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array([signature(s) for s in sets], pa.binary()), lists], names=[f.name for f in schema]
                )

    return slim.mapInArrow(run, schema)


def leaders(table: pa.Table):
    """Edges (k, least k) of the sets of a group that are connected through its leaders."""
    ids = table.column("k").to_numpy()
    side = table.column("side").to_numpy()
    crossing = table.column("i")[0].as_py() != table.column("j")[0].as_py()
    if len(ids) < 2 or crossing and len(np.unique(side)) < 2:
        return
    raw = table.column("sketch").to_pylist()
    size = np.array([len(x) // 4 for x in raw])
    owner = np.repeat(np.arange(len(ids)), size)
    _, token = np.unique(np.frombuffer(b"".join(raw), "<u4"), return_inverse=True)
    shared = np.bincount(token)[token] > 1
    own = np.bincount(owner[shared], minlength=len(ids))
    # A set can't resemble another more than it shares elements with any; the other may be smaller, as the sketch of a linked set is by a fourth.
    open_ = own >= ATTACH * size * 1.7
    use = shared & open_[owner]
    token, owner = token[use], owner[use]
    by = np.argsort(token, kind="stable")
    ends = np.cumsum(np.bincount(token[by])) if len(by) else np.empty(0, np.int64)
    postings = np.split(owner[by], ends[:-1]) if len(by) else []
    tokens = np.split(token, np.cumsum(np.bincount(owner, minlength=len(ids)))[:-1])
    label = np.arange(len(ids))
    while True:
        left = np.flatnonzero(open_)
        if not len(left):
            break
        leader = left[0]
        open_[leader] = False
        if not len(tokens[leader]):
            continue
        count = np.bincount(np.concatenate([postings[t] for t in tokens[leader]]), minlength=len(ids))
        both = size + size[leader]
        old = np.unique(label[np.append(np.flatnonzero(count >= ATTACH * both), leader)])
        if len(old) > 1:
            label[np.isin(label, old)] = old[0]
        open_ &= count < COVER * both
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, label, ids)
    moved = np.flatnonzero(ids != least[label])
    if len(moved):
        yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(least[label[moved]])], names=["a", "b"])


def world(percent: int):
    def then(table: pa.Table):
        """(sig, first, links) of the sets of a world, or of a pair of its blocks."""
        sets = [np.frombuffer(x, "<u8") for x in table.column("grams").to_pylist()]
        sigs = table.column("sig").to_pylist()
        crossing = table.column("i")[0].as_py() != table.column("j")[0].as_py()
        label, links = trie.joined(sets, percent, table.column("side").to_numpy() if crossing else None, table.column("copies").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.binary()), pa.array([sigs[k] for k in label], pa.binary()), pa.array(links)], names=["sig", "first", "links"])

    return then


def survivors(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The sets of which enough elements are shared, as (k), and the shared elements (t, k, pos) of all sketches."""
    tokens = sets.select("k", F.posexplode("sketch").alias("pos", "t"))
    common = tokens.groupBy("t").agg(F.count(F.lit(1)).alias("df")).where("df > 1").select("t")
    shared = scratch(tokens.join(common, "t"))
    counted = shared.groupBy("k").agg(F.count(F.lit(1)).alias("own")).join(sets.select("k", "n"), "k")
    # Sketches of all that such a set can link with are whole sets.
    complete = F.col("n") * 100 <= SKETCH * percent
    enough = F.when(complete, F.col("own") * 100 >= F.col("n") * percent).otherwise(F.col("own") >= SHARED)
    return scratch(counted.where(enough).select("k").distinct()), shared


def whole_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(sig, grams) of the wanted (id, sig): their texts are read again; only ids of a checked number are broadcast."""
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    ids = wanted.select("id").distinct()
    found = slim.join(F.broadcast(ids) if ids.count() <= FEW else ids, slim["id"].eqNullSafe(ids["id"]), "left_semi")

    def run(batches):
        for batch in batches:
            texts = texts_of(batch, 0)
            for a, b in together(texts):
                sets = shingle_sets(texts[a:b])
                yield pa.RecordBatch.from_arrays([pa.array([signature(s) for s in sets], pa.binary()), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], names=["sig", "grams"])

    grams = found.select("text").mapInArrow(run, "sig binary, grams binary")
    return grams.join(wanted.select("sig"), "sig", "left_semi").groupBy("sig").agg(F.first("grams").alias("grams"))


def linked_sets(docs: DataFrame, id_col: str, text_col: str, percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows (id, fp, n, sig), and the sets (sig, links, copies, root, at): ``root`` names the component, ``at`` is the set's first row (nul, id, fp)."""
    rows = scratch(sketched(docs, id_col, text_col))
    sets = rows.where("n > 0").groupBy("sig").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min(F.struct(F.col("id").isNull().alias("nul"), "id", "fp")).alias("at"), F.count(F.lit(1)).alias("copies"))
    sets = scratch(sets.withColumn("k", F.xxhash64("sig")))
    left, shared = survivors(sets, percent)
    routes = shared.where(F.col("pos") < ROUTES).join(left, "k").select("t", "k")
    routes = blocked(routes, "t", "k", SETS).select("t", "i", "j", "side", "k")
    small = sets.join(left, "k", "left_semi").select("k", "sketch")
    small = small.mapInArrow(packed, "k bigint, sketch binary")
    edges = by_group(routes.join(small, "k"), ["t", "i", "j"], leaders, "a bigint, b bigint")
    worlds = scratch(components(edges).withColumnRenamed("node", "k"))
    wanted = scratch(sets.join(worlds, "k").select("sig", "n", F.col("at.id").alias("id"), "copies", "root"))
    grams = whole_sets(docs, wanted, id_col, text_col)
    parts = blocked(wanted.drop("id"), "root", "sig", ELEMENTS, "n").select("root", "i", "j", "side", "sig", "copies")
    found = scratch(by_group(parts.join(grams, "sig"), ["root", "i", "j"], world(percent), "sig binary, first binary, links bigint"))
    linked = components(found.where("sig <> first").select("sig", "first"), "sig", "first")
    counts = found.groupBy("sig").agg(F.sum("links").alias("links"))
    each = sets.select("sig", "at", "copies").join(counts, "sig", "left").join(linked.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    return rows.select("id", "fp", "n", "sig"), each


def classes(docs: DataFrame, id_col="doc_id", text_col="text", percent: int = PERCENT) -> DataFrame:
    """``id``, ``n`` (size of the set), ``component`` (smallest id reachable by links, itself included) and ``links`` (how many rows it links with)."""
    rows, each = linked_sets(docs, id_col, text_col, percent)
    least = each.groupBy("root").agg(F.min("at.id").alias("component"))
    each = each.join(least, "root").select("sig", "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    out = rows.select("id", "n", "sig").join(each, "sig", "left")
    alone = F.col("n") == 0
    return out.select("id", "n", F.when(alone, F.col("id")).otherwise(F.col("component")).alias("component"), F.when(alone, 0).otherwise(F.col("links")).cast("long").alias("links"))


def packed(batches):
    for batch in batches:
        lists = batch.column(1)
        values, at = lists.flatten().to_numpy().astype("<i4"), np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([values[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["k", "sketch"])


def keep_one(docs: DataFrame, id_col="doc_id", text_col="text", percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` without those that are linked, directly or not, with one of a smaller id; of linked rows with the same id one stays.

    Representatives are chosen by (id, text hash), so rows that share an id, or have none, but don't link all stay.
    Texts without words are kept.
    """
    _, each = linked_sets(docs, id_col, text_col, percent)
    keep = scratch(each.groupBy("root").agg(F.min("at").alias("at")).select(F.col("at.id").alias("ki"), F.col("at.fp").alias("kf")))
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("fp"), (~F.coalesce(F.col(f"`{text_col}`").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))).alias("bare"))
    kept = marked.where("not bare").join(keep, F.col("id").eqNullSafe(F.col("ki")) & (F.col("fp") == F.col("kf")), "left_semi").dropDuplicates(["id", "fp"])
    return kept.unionByName(marked.where("bare")).select("row.*")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, one row for each row of ``docs``, with the number of rows that it links with."""
    return classes(docs).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("links").alias("n_links"))
