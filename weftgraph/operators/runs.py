"""Walking a chapter in runs whose stride depends on what they hold.

A run starts at ``idx`` and follows the steps of the positions for at most 25 tokens.  The next run starts one past the
end of the first mention if there are two or more mentions, at the end of the first if there is one, else 24 further.
Only the positions with mentions are needed, so a chapter's tokens never go to Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import RUN_SIZE, RUNS

#: Runs that are given back at once.
BATCH = 10_000


class OpenMention(ValueError):
    """A run came to a mention that nobody has resolved."""


def walk(n: int, at: dict[int, tuple[int, int | None, bool]], size: int = RUN_SIZE, strict: bool = True) -> Iterator[tuple[int, list[int]]]:
    """(idx, ids in order of mention) of the runs of a chapter of ``n`` tokens; ``at`` has (step, id, open) by position."""
    idx, where, low = 0, sorted(at), 0
    while idx < n:
        while low < len(where) and where[low] < idx:
            low += 1
        i, ids, first, end, j = idx, [], 0, min(idx + size, n), low
        while j < len(where) and where[j] < end:
            if where[j] >= i:
                step, hit, is_open = at[where[j]]
                if is_open and strict:
                    raise OpenMention(f"position {where[j]}")
                i = where[j] + step
                if hit is not None:
                    if not ids:
                        first = i - idx
                    ids.append(hit)
            j += 1
        yield idx, ids
        idx += first + 1 if len(ids) > 1 else first if ids else size - 1


def _chapters(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, int, dict[int, tuple[int, int | None, bool]]]]:
    """(key, chapter, n_tokens, mentions by position) of rows in which each chapter's lie together; a batch may end within a chapter."""
    name, n, at = None, 0, {}
    for batch in batches:
        for key, chapter, n_tokens, pos, *what in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if name != (key, chapter):
                if name is not None:
                    yield *name, n, at
                name, n, at = (key, chapter), n_tokens, {}
            at[pos] = tuple(what)
    if name is not None:
        yield *name, n, at


def runs(resolved: DataFrame, size: int = RUN_SIZE, strict: bool = True) -> DataFrame:
    """(key, chapter, idx, members) of all runs with a mention; chapters are the units of parallel work, read in batches of many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.string()), ("chapter", pa.string()), ("idx", pa.int32()), ("members", pa.list_(pa.int64()))])
        out: list[tuple] = []
        for key, name, n, at in _chapters(batches):
            try:
                out += [(key, name, idx, sorted(set(ids))) for idx, ids in walk(n, at, size, strict) if ids]
            except OpenMention as e:
                raise OpenMention(f"{key}, {name}: {e} is not resolved") from None
            if len(out) >= BATCH:
                yield pa.record_batch([*map(list, zip(*out, strict=True))], schema=schema)
                out = []
        if out:
            yield pa.record_batch([*map(list, zip(*out, strict=True))], schema=schema)

    slim = resolved.select("key", "chapter", "n_tokens", "pos", "step", "hit", "open")
    return slim.repartition("key", "chapter").sortWithinPartitions("key", "chapter", "pos").mapInArrow(run, RUNS)


def pairs(found: DataFrame) -> DataFrame:
    """(key, chapter, src, dst, weight): in how many runs two entities meet."""
    some = found.where(F.size("members") > 1).select("key", "chapter", "idx", F.explode("members").alias("src"), "members")
    some = some.select("key", "chapter", "src", F.explode("members").alias("dst")).where("src < dst")
    return some.groupBy("key", "chapter", "src", "dst").agg(F.count(F.lit(1)).alias("weight"))
