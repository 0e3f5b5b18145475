"""Co-occurrence edges from a stream of chapters.

Each chapter arrives whole, so its runs are made without state; weights are kept by a streaming aggregation, and a
watermark on the arrival time bounds what is remembered of windows that are over.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators.runs import walk
from ..schemas import RUN_SIZE


def pairs_of(chapters: DataFrame, lexicon: dict[str, int], size: int = RUN_SIZE) -> DataFrame:
    """(at, key, src, dst) for each run of each chapter in which two entities meet; ``lexicon`` is a dimension of one-word monikers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for at, key, words in zip(batch["at"], batch["key"], batch["words"], strict=True):
                hits = {p: (1, lexicon[w], False) for p, w in enumerate(words) if w in lexicon}
                for _, ids in walk(len(words), hits, size):
                    own = sorted(set(ids))
                    out += [(at, key, a, b) for i, a in enumerate(own) for b in own[i + 1 :]]
            yield pd.DataFrame(out, columns=["at", "key", "src", "dst"])

    rows = chapters.select("at", "key", tokens(F.coalesce("text", F.lit(""))).alias("words"))
    return rows.mapInPandas(run, "at timestamp, key string, src bigint, dst bigint")


def edges(chapters: DataFrame, lexicon: dict[str, int], window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window, key, src, dst, weight); works on a stream and on a table alike."""
    found = pairs_of(chapters, lexicon).withWatermark("at", late)
    return found.groupBy(F.window("at", window), "key", "src", "dst").agg(F.count(F.lit(1)).alias("weight"))
