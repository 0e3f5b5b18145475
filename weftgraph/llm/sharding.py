"""Resharding by minimum-cost flow.

A table lies in folders by shard.  From the sizes of the old shards and the capacities of the new ones (equal up to a
byte), a minimum-cost flow over old x new shards, at no cost where a shard keeps its bytes and at one a byte elsewhere,
tells how many bytes go where.  Each old shard's rows, in the order of a hash of their place in the files, are cut into runs of
these lengths; a run is a block that moves as a whole.  The law is ``bytes``: the sizes of shards differ by a few
documents at most, since each cut falls on the row whose middle it passes.

A cut is a hash, so which shard a row goes to is known from the row alone: the rewrite reads and writes texts once and never
shuffles them.  Cuts are found from sums over ranges of the hash, then within the one range that holds the cut.

Cases: a null text has no bytes; the table may be empty; repeated rows are dealt one by one, as their places differ; null
ids are dealt too; equal texts need not meet in a shard; rows in a folder without a number, or with one that is no old
shard's, all move; very long texts move as a whole, and a shard may exceed its capacity by half of one; other columns are rewritten untouched.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shared_dir

OLD, NEW = 16, 24
NEXT = "_next"
LAST = (1 << 63) - 1


def min_cost_flow(supply: list[int], capacity: list[int], homes: int | None = None) -> list[list[int]]:
    """Bytes from each old to each new shard, moving as few as can be; only the first ``homes`` old shards have a new one where bytes stay.

    Successive shortest paths over source -> old -> new -> sink with residual arcs (Bellman-Ford).  A path fills an arc
    of the source or the sink or empties one between shards, so there are few.
    """
    n, m = len(supply), len(capacity)
    s, t, size = n + m, n + m + 1, n + m + 2
    arcs: list[list[int]] = []  # to, left, cost; the reverse arc is the next or the one before

    def add(u: int, v: int, left: int, cost: int) -> None:
        out[u].append(len(arcs))
        arcs.append([v, left, cost])
        out[v].append(len(arcs))
        arcs.append([u, 0, -cost])

    out: list[list[int]] = [[] for _ in range(size)]
    for i, x in enumerate(supply):
        add(s, i, x, 0)
    for i in range(n):
        for j in range(m):
            add(i, n + j, sum(supply), int(i != j or homes is not None and i >= homes))
    for j, x in enumerate(capacity):
        add(n + j, t, x, 0)
    while True:
        far, via = [float("inf")] * size, [-1] * size
        far[s] = 0
        for _ in range(size):
            moved = False
            for u in range(size):
                if far[u] < float("inf"):
                    for a in out[u]:
                        v, left, cost = arcs[a]
                        if left and far[u] + cost < far[v]:
                            far[v], via[v], moved = far[u] + cost, a, True
            if not moved:
                break
        if via[t] < 0:
            break
        path, v = [], t
        while v != s:
            path.append(via[v])
            v = arcs[via[v] ^ 1][0]
        step = min(arcs[a][1] for a in path)
        for a in path:
            arcs[a][1] -= step
            arcs[a ^ 1][1] += step
    flow = [[0] * m for _ in range(n)]
    for i in range(n):
        for a in out[i]:
            v = arcs[a][0]
            if n <= v < n + m and not a & 1:
                flow[i][v - n] = arcs[a ^ 1][1]
    return flow


def size_of(text: Column) -> Column:
    return (F.octet_length(F.coalesce(text.cast("string"), F.lit(""))) + 8).cast("long")


def placed(found: DataFrame, shard_col: str, old: int) -> DataFrame:
    """Add ``__old``, the old shard (``old`` for those that are none), and ``__h``, 63 bits of a hash of the row's place."""
    shard = F.col(f"`{shard_col}`").cast("int")
    place = F.xxhash64(shard, F.col("_metadata.file_name"), F.col("_metadata.row_index"))
    return found.select("*", F.when(shard.between(0, old - 1), shard).otherwise(old).alias("__old"), F.shiftrightunsigned(place, 1).alias("__h"))


def plan(found: DataFrame, text_col="text", shard_col="shard", old: int = OLD, new: int = NEW) -> list[list[tuple[int, int]]]:
    """For each old shard its runs in order, as (new shard, first hash that belongs to the next run); the rest goes to the last.

    ``found`` is read from files.  To the driver come the old shards' sums and, for each arc of the flow, one range and one hash.
    """
    rows = placed(found, shard_col, old).select("__old", "__h", size_of(F.col(f"`{text_col}`")).alias("size"))
    bits = min(16, max(4, (found.count() >> 16).bit_length()))
    span = 63 - bits
    ranges = rows.groupBy("__old", F.shiftright("__h", span).alias("r")).agg(F.sum("size").alias("s"))
    upto = W.partitionBy("__old").orderBy("r")
    ranges = ranges.withColumn("end", F.sum("s").over(upto)).persist()
    sizes = dict(ranges.groupBy("__old").agg(F.sum("s")).collect())
    supply = [sizes.get(i, 0) for i in range(old + 1)]
    total = sum(supply)
    capacity = [total * (j + 1) // new - total * j // new for j in range(new)]
    runs: list[list[list[int]]] = []
    for i, row in enumerate(min_cost_flow(supply, capacity, old)):  # the bytes that stay come first
        at, own = 0, []
        for j in sorted(range(new), key=lambda j: (j != i, j)):
            if row[j]:
                at += row[j]
                own.append([j, at])
        runs.append(own or [[min(i, new - 1), 0]])
    wanted = [(i, end) for i, own in enumerate(runs) for _, end in own[:-1]]
    cut: dict[tuple[int, int], int] = {}
    if wanted:
        ask = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(e).cast("long").alias("cut")) for i, e in wanted])).alias("w")
        asked = found.sparkSession.range(1).select(ask).select("w.*")
        hit = (F.col("__old") == F.col("i")) & (F.col("cut") > F.col("end") - F.col("s")) & (F.col("cut") <= F.col("end"))
        at = ranges.join(F.broadcast(asked), hit).select("__old", "r", "cut", (F.col("end") - F.col("s")).alias("start")).collect()  # a row for each arc
        inside = rows.withColumn("r", F.shiftright("__h", span)).where(F.concat_ws(" ", "__old", "r").isin(sorted({f"{x['__old']} {x['r']}" for x in at})))
        before = F.sum("size").over(W.partitionBy("__old", "r").orderBy("__h").rowsBetween(W.unboundedPreceding, -1))
        inside = inside.withColumn("middle", F.coalesce(before, F.lit(0)) * 2 + F.col("size"))
        first = lambda x: F.min(F.when((F.col("__old") == x["__old"]) & (F.col("r") == x["r"]) & (F.col("middle") >= 2 * (x["cut"] - x["start"])), F.col("__h")))
        for x, h in zip(at, inside.agg(*[first(x) for x in at]).first(), strict=True):
            cut[x["__old"], x["cut"]] = min((x["r"] + 1) << span, LAST) if h is None else h
    ranges.unpersist()
    return [[(j, cut[i, end]) for j, end in own[:-1]] + [(own[-1][0], LAST)] for i, own in enumerate(runs)]


def target(runs: list[list[tuple[int, int]]]) -> Column:
    """The new shard of a placed row."""
    out = F.lit(None).cast("int")
    for i, own in enumerate(runs):
        to = F.lit(own[-1][0])
        for j, end in reversed(own[:-1]):
            to = F.when(F.col("__h") < F.lit(end), j).otherwise(to)
        out = F.when(F.col("__old") == i, to).otherwise(out)
    return out


def folders(spark: SparkSession, path: str):
    """The file system of ``path`` and a function that makes paths in it."""
    make = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}" if name else path)
    return make("").getFileSystem(spark._jsc.hadoopConfiguration()), make


def swap(spark: SparkSession, path: str) -> None:
    """Put the shards that a rewrite has finished in place of the old ones.  May be repeated after it was cut off: a shard is
    there as a whole, old or new, or still in ``_next``."""
    fs, at = folders(spark, path)
    if not fs.exists(at(f"{NEXT}/_READY")):
        fs.delete(at(NEXT), True)
        return
    for x in fs.listStatus(at(NEXT)):
        name = x.getPath().getName()
        if "=" in name:
            fs.delete(at(name), True)
            fs.rename(at(f"{NEXT}/{name}"), at(name))
    fs.delete(at(NEXT), True)


def rewrite(spark: SparkSession, path: str, schema=None, text_col="text", shard_col="shard", old: int = OLD, new: int = NEW) -> list[int | None]:
    """Bring the table at ``path`` (folders by ``shard_col``) to the new layout.

    Only the shards that gain or lose rows are written, each as a whole and beside the old ones, which go when all
    are there; so a lost executor, a failed write or a lost driver costs no row.  Files of other shards stay.  Returns the folders changed.
    """
    swap(spark, path)  # what an earlier rewrite has left
    found = spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
    runs = plan(found, text_col, shard_col, old, new)
    rows = placed(found, shard_col, old).withColumn("__new", target(runs))
    was = F.col(f"`{shard_col}`").cast("int")
    moves = rows.where(~was.eqNullSafe(F.col("__new"))).select(was.alias("a"), F.col("__new").alias("b")).distinct().collect()  # folders, not rows
    changed = sorted({x for r in moves for x in r}, key=lambda x: (x is not None, x))
    if not changed:
        return []
    numbers = [x for x in changed if x is not None]
    rows = rows.where(was.isin(numbers) | was.isNull() if None in changed else was.isin(numbers))
    columns = [F.col(f"`{c}`") for c in found.columns if c != shard_col]
    rows.select(*columns, F.col("__new").alias(shard_col)).write.mode("overwrite").partitionBy(shard_col).parquet(f"{path}/{NEXT}")
    fs, at = folders(spark, path)
    for x in changed:  # those that are empty now, too
        fs.mkdirs(at(f"{NEXT}/{shard_col}={'__HIVE_DEFAULT_PARTITION__' if x is None else x}"))
    fs.create(at(f"{NEXT}/_READY")).close()
    swap(spark, path)
    return changed


def rewritten(docs: DataFrame, id_col="doc_id", text_col="text", old: int = OLD, new: int = NEW) -> DataFrame:
    """``docs`` laid out in the shared folder as its old shards (a hash of the id), brought to the new layout by
    ``rewrite``, and read back: ``row`` (the input's columns), ``text``, ``old_shard`` and ``shard``, the folder that the row was read from."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/weftgraph-{uuid.uuid4().hex}"
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row")
    was = F.pmod(F.xxhash64(F.col(f"`{id_col}`"), F.lit(1)), F.lit(old)).cast("int")
    laid = docs.select(row, F.col(f"`{text_col}`").cast("string").alias("text"), was.alias("old_shard"), was.alias("shard"))
    laid.write.partitionBy("shard").parquet(path)
    rewrite(spark, path, laid.schema, old=old, new=new)
    return spark.read.schema(laid.schema).parquet(path)


def slots(found: DataFrame, *columns: Column, shard_col="shard") -> DataFrame:
    """``columns``, the shard and ``slot``: rows of a shard are numbered by file and place in it, from the files' counts alone."""
    rows = found.select(*columns, F.col(shard_col).cast("int").alias("shard"), F.col("_metadata.file_name").alias("__f"), F.col("_metadata.row_index").alias("__r"))
    files = rows.groupBy("shard", "__f").agg(F.count(F.lit(1)).alias("__n"))
    earlier = W.partitionBy("shard").orderBy("__f").rowsBetween(W.unboundedPreceding, -1)
    files = files.select("shard", "__f", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__o"))
    return rows.join(files, ["shard", "__f"]).withColumn("slot", F.col("__o") + F.col("__r")).drop("__f", "__r", "__o")


def digest(docs: DataFrame, old: int = OLD, new: int = NEW) -> DataFrame:
    """The contract's columns, one row for each row of ``docs``, from the files after the rewrite; texts stay out of the join that numbers the rows."""
    found = rewritten(docs.select("doc_id", "text"), old=old, new=new)
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    rows = slots(found, F.col("row.doc_id").alias("doc_id"), size_of(F.col("text")).alias("size"), crc.alias("text_crc32"), F.col("old_shard"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")
