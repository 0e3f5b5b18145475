"""Language identification with bit-sliced Bloom filters.

One filter holds the n-grams of all languages: each of its positions is a 64-bit mask of languages, and a lookup ANDs
the masks at the positions that an n-gram hashes to, which gives every language that contains it at once.  A text's
n-grams are counted by language (the popcount of the language's bit over all of them), counts are corrected for the
filter's false positives, (count - rate * total) / (1 - rate), and the largest decides.

n-grams are four bytes of the lower-cased UTF-8 text whose ASCII other than letters is blanked, runs of blanks excluded.
A language's n-grams are its most frequent ones, with at least ``RATE`` of its occurrences.  They are counted on a
bounded sample of labelled rows: about ``SAMPLE`` a language, chosen by a hash of the id.  Everything else covers all.

Cases: null texts and texts without a letter are ``und`` with score 0, as are all if nothing was learned; ties go to the
first language; a null id is not held out and not learned from; repeated rows get the same answer; more than 64 languages use more than one
mask; texts are taken whole, a long one in pieces of ``PIECE`` bytes.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE = 3000
GRAMS = 20_000
RATE = 2e-5
HASHES = 3
PIECE = 1 << 20
LETTER = re.compile(r"[^\W\d_]").search
_TABLE = np.array([c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256)], np.uint8)
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D), np.uint32(0x27D4EB2F))


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def grams(text: bytes) -> np.ndarray:
    """The n-grams of a lower-cased text, as 32-bit integers."""
    b = _TABLE[np.frombuffer(b" " + text + b" ", np.uint8)]
    if len(b) < 4:
        return np.empty(0, np.uint32)
    w = b.astype(np.uint32)
    g = w[:-3] | w[1:-2] << np.uint32(8) | w[2:-1] << np.uint32(16) | w[3:] << np.uint32(24)
    blank = b == 32
    return g[~((blank[:-1] & blank[1:])[:-2] | (blank[:-1] & blank[1:])[1:-1] | (blank[:-1] & blank[1:])[2:])]


def positions(g: np.ndarray, bits: int):
    for m in _MIX[:HASHES]:
        x = (g ^ (g >> np.uint32(15))) * m
        x ^= x >> np.uint32(13)
        yield (x * np.uint32(0x2545F491)) >> np.uint32(32 - bits)


class Filters:
    """Masks of languages by position; ``rates`` are the languages' shares of false positives."""

    def __init__(self, langs: list[str], members: dict[str, np.ndarray]):
        self.langs = langs
        most = max((len(m) for m in members.values()), default=1)
        self.bits = max(12, int(np.ceil(np.log2(max(most, 1) * HASHES * 12))))
        self.slices = [np.zeros(1 << self.bits, np.uint64) for _ in range(-(-len(langs) // 64))]
        for i, lang in enumerate(langs):
            for p in positions(members[lang], self.bits):
                self.slices[i // 64][p] |= np.uint64(1 << i % 64)
        fill = [np.mean(self.slices[i // 64] >> np.uint64(i % 64) & np.uint64(1)) for i in range(len(langs))]
        self.rates = np.array(fill, np.float64) ** HASHES

    def counts(self, text: bytes) -> tuple[np.ndarray, int]:
        """How many n-grams each language contains, and how many there are.  Pieces end within the text at any byte; each takes the three before along."""
        total, hits = 0, np.zeros(len(self.langs), np.int64)
        for at in range(0, max(len(text), 1), PIECE):
            g = grams(text[max(at - 3, 0) : at + PIECE])
            total += len(g)
            where = list(positions(g, self.bits))
            for k, table in enumerate(self.slices):
                mask = table[where[0]]
                for p in where[1:]:
                    mask &= table[p]
                own = self.langs[64 * k : 64 * k + 64]
                hits[64 * k : 64 * k + len(own)] += [int(np.count_nonzero(mask & np.uint64(1 << i))) for i in range(len(own))]
        return hits, total

    def decide(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.langs or not LETTER(text):
            return "und", 0.0
        hits, total = self.counts(text.lower().encode("utf-8", "surrogatepass"))
        true = np.clip((hits - self.rates * total) / (1 - self.rates), 0, None)
        best = int(np.argmax(true))
        return self.langs[best], float(true[best] / true.sum()) if true.sum() else 0.0


def fit(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", sample: int = SAMPLE, most: int = GRAMS) -> Filters:
    """Learn from the rows that aren't held out.  At most ``most`` n-grams a language come to the driver."""
    ident, lang = F.col(f"`{id_col}`"), F.col(f"`{lang_col}`").cast("string")
    known = docs.select(ident.alias("id"), lang.alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    known = known.where(F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return Filters([], {})
    share = F.create_map(*[x for k, v in sizes.items() for x in (F.lit(k), F.lit(min(1.0, sample / v)))])
    drawn = known.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))

    def count(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, by = batch.slice(at, 512), {}
                for name, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    text = text.lower().encode("utf-8", "surrogatepass")
                    by.setdefault(name, []).extend(grams(text[max(i - 3, 0) : i + PIECE]) for i in range(0, max(len(text), 1), PIECE))
                for name, parts in by.items():
                    g, n = np.unique(np.concatenate(parts), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    counted = drawn.select("lang", "text").mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    per = W.partitionBy("lang")
    ranked = counted.withColumn("all", F.sum("n").over(per)).where(F.col("n") >= F.col("all") * RATE)
    top = ranked.withColumn("k", F.row_number().over(per.orderBy(F.desc("n"), "gram"))).where(F.col("k") <= most).select("lang", "gram")
    members: dict[str, list[int]] = {k: [] for k in sizes}
    for r in top.toLocalIterator():
        members[r["lang"]].append(r["gram"])
    return Filters(sorted(sizes), {k: np.array(v, np.int64).astype(np.uint32) for k, v in members.items()})


def predict(docs: DataFrame, filters: Filters, id_col="doc_id", text_col="text") -> DataFrame:
    """``id_col``, ``lang_pred``, ``score`` for each row; the filters' size is bounded by ``GRAMS`` times the languages."""
    slim = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("__text"))
    schema = T.StructType([slim.schema[0], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches):
        tool = shared.value
        for whole in batches:
            for at in range(0, max(whole.num_rows, 1), 1024):
                batch = whole.slice(at, 1024)
                rows = [tool.decide(t) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())], names=[f.name for f in schema])

    return slim.mapInArrow(run, schema)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, one row for each row of ``docs``."""
    return predict(docs, fit(docs)).withColumn("held_out", held_out(F.col("doc_id")))
