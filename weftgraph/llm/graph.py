"""Connected components of distributed edges, and groups of rows in Python without collecting more than one of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import labels


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): every node of an edge with the smallest node that it is connected with."""
    return labels(edges, a, b)


def blocked(rows: DataFrame, key: str, ident: str, most: int, size: str | None = None) -> DataFrame:
    """Add ``i``, ``j`` and ``side``: groups of a key that are too large are cut into s blocks by a hash, and every pair of blocks
    (i <= j) gets its rows.  So all pairs of a group meet somewhere, and no task holds more than two blocks."""
    sums = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), (F.sum(size) if size else F.count(F.lit(1))).alias("s"))
    sums = sums.where("n > 1").select(key, F.ceil(F.col("s") / most).cast("int").alias("parts"))
    out = rows.join(sums, key).withColumn("side", F.pmod(F.xxhash64(ident, F.lit(3)), F.col("parts")).cast("int"))
    out = out.withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return out.withColumn("i", F.least("side", "__o")).withColumn("j", F.greatest("side", "__o")).drop("__o", "parts")


def by_group(rows: DataFrame, keys: list[str], then: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply ``then`` to the rows of each group, as an Arrow table.  Keys are integers.  Groups are sorted runs; only one is held at a time, and small results are sent together."""

    def groups(batches):
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            columns = [batch.column(k).to_numpy() for k in range(len(keys))]
            change = np.zeros(n, bool)
            change[0] = last is None or any(c[0] != x for c, x in zip(columns, last, strict=True))
            for c in columns:
                change[1:] |= c[1:] != c[:-1]
            starts = np.flatnonzero(change).tolist()
            if held and starts[:1] == [0]:
                yield held
                held = []
            for a, b in zip([0] * (starts[:1] != [0]) + starts, [*starts[starts[:1] == [0] :], n], strict=True):
                held.append(batch.slice(a, b - a))
                if b < n:
                    yield held
                    held = []
            last = [c[-1] for c in columns]
        if held:
            yield held

    def run(batches):
        out: list[pa.RecordBatch] = []
        size = 0
        for held in groups(batches):
            for made in then(pa.Table.from_batches(held)):
                out.append(made)
                size += made.num_rows
            if size > 4096:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                out, size = [], 0
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    rest = [c for c in rows.columns if c not in keys]
    return rows.select(*keys, *rest).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
