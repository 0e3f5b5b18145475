"""Fuzzy line deduplication: one line of each group of lines that are alike stays.

1. A line's letters and digits, lower-cased, are its normal form; its windows of WINDOW characters are its shingles.  One
   pass over the texts gives each line's 128-bit hash, in two halves, and its signature: one-permutation MinHash, the least hash in each
   of BANDS * ROWS bins, empty bins filled from others at random (Shrivastava, 2017).  Each task sends a band's value and a line only once, so a line
   that a third of all documents have is one row a task.
2. Lines that agree in a band are candidates: each is paired with one of its band, and these pairs are verified by
   the exact Jaccard coefficient of whole sets (100 * intersection >= PERCENT * union).  Union-find over the pairs that hold gives groups; work is
   linear, however many near copies of a line there are.
3. What is left are bands whose lines lie in several groups.  There, lines of different groups are compared exactly (a band over a
   size in pairs of blocks), and union-find over the groups that are linked joins them.  So no pair that agrees in a band is lost.
   At a similarity of 0.8, a pair agrees in one of ten bands of four with 99.5 %, at 0.9 with 99.997 %.
4. The first line by (id, text hash, line) of each group stays.

Cases: null stays null; lines without a letter or digit (blank ones too) are left alone; lines shorter than a window have
no signature and are alike only if their normal forms are equal; an empty text stays; of rows that agree in id and text only the first can keep a line (``docs`` has to come from files,
as rows are told apart by their place); ties go to the smaller id, null first; an
empty table gives an empty result; other columns are carried untouched; texts are taken whole, memory follows the longest.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import trie
from .common import scratch, scratch_until
from .graph import blocked, by_group, components
from .shingles import _BACK, _BASE, mixed, powers
from .shingles import together as together_up_to

PERCENT, WINDOW = 80, 8
BANDS, ROWS = 10, 4
#: Most characters of the lines of a band that are compared in one task.
ELEMENTS = 1 << 20
#: Lines of a band are compared by a table of so many cells (lines by windows, below 2**24 so that floats count right); more by the trie.
CELLS = 1 << 21
#: Band entries that a task holds before it sends them.
HELD = 1 << 22
#: Pairs that are verified together; a pair's number and 52 bits of a shingle's hash make one integer.
PAIRS = 4096
#: Bits of the table of wanted lines, 64 in a row.
BITS = 24
#: Texts are worked on together up to so many characters, so that the arrays stay in the processor's cache.
CHUNK = 1 << 17
_EMPTY = np.uint32(0xFFFFFFFF)


def together(texts: list):
    return together_up_to(texts, CHUNK)


@lru_cache(1)
def alphabet() -> np.ndarray:
    """Whether a code point is a letter or digit."""
    return np.fromiter(map(str.isalnum, map(chr, range(0x110000))), bool, 0x110000)


def text_of(raw: bytes | None) -> str:
    return (raw or b"").decode("utf-8", "surrogateescape")


def normal_lines(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all lines' normal forms, where each line begins in them (one entry more), and each text's number of lines."""
    data = np.frombuffer("\n".join(texts).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kept = alphabet()[data]
    so_far = np.cumsum(kept)
    starts = np.concatenate([[0], so_far[data == 10], so_far[-1:] if len(data) else [0]])
    return data[kept], starts, np.array([t.count("\n") + 1 for t in texts])


def code_points(forms: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of normal forms and of the breaks between them; where each form begins and ends."""
    data = np.frombuffer(b"\n".join(forms).decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32)
    breaks = np.flatnonzero(data == 10)
    return data, np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(data)]])


def windows(form: np.ndarray) -> np.ndarray:
    """Hashes of all windows of the code points."""
    if len(form) < WINDOW:
        return np.empty(0, np.uint64)
    h, base = form.astype(np.uint64), 0x9FB21C651E98DF25
    for width in (1 << k for k in range(WINDOW.bit_length() - 1)):  # two neighbours of half the length make one; WINDOW is a power of 2
        h = h[:-width] * np.uint64(base) + h[width:]
        base = base * base % 2**64
    return mixed(h)


def of_lines(form: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the windows within the lines [a, b) of ``form``, and the line of each."""
    many = np.maximum(b - a - WINDOW + 1, 0)
    owner = np.repeat(np.arange(len(a)), many)
    at = np.arange(len(owner)) + np.repeat(a - (np.cumsum(many) - many), many)
    return windows(form)[at], owner


@lru_cache(1)
def values() -> tuple[np.ndarray, np.ndarray]:
    """Two odd numbers for each code point."""
    one = mixed(np.arange(1, 0x110001, dtype=np.uint64)) | np.uint64(1)
    return one, mixed(one ^ np.uint64(0xA5A5A5A5A5A5A5A5)) | np.uint64(1)


def line_hashes(form: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bits, out = max(10, int(len(form)).bit_length()), []
    back = powers(_BACK, bits + 1)[a]
    for value in values():
        sums = np.zeros(len(form) + 1, np.uint64)
        np.cumsum(value[form] * powers(_BASE, bits)[: len(form)], out=sums[1:])
        out.append(mixed((sums[b] - sums[a]) * back + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    return out[0], out[1]


@lru_cache(1)
def probes() -> np.ndarray:
    """Where an empty bin looks for a value, one bin after the other: at random places first, so that the bins of a band
    borrow from different ones, then at all in turn."""
    bins = BANDS * ROWS
    random = np.random.Generator(np.random.PCG64(7)).integers(0, bins, (2 * bins, bins))
    return np.concatenate([random, (np.arange(bins)[None, :] + np.arange(1, bins)[:, None]) % bins])


def band_keys(form: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """lines x BANDS hashes."""
    bins = BANDS * ROWS
    v, owner = of_lines(form, a, b)
    least = np.full(len(a) * bins, _EMPTY, np.uint32)
    np.minimum.at(least, owner * bins + ((v >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64), (v & np.uint64(0xFFFFFFFE)).astype(np.uint32))
    least = least.reshape(-1, bins)
    gaps = np.flatnonzero((least == _EMPTY).any(axis=1))
    if len(gaps):
        old = new = least[gaps]
        left = np.arange(len(gaps))
        for step, source in enumerate(probes(), 1):
            now, have = new[left], old[left][:, source]
            fill = (now == _EMPTY) & (have != _EMPTY)
            now[fill] = have[fill] + np.uint32(step * 0x9E3779B1 & 0xFFFFFFFF)
            if step == 1:
                new = now
            else:
                new[left] = now
            left = left[(now == _EMPTY).any(axis=1)]
            if not len(left):
                break
        least[gaps] = new
    s = least.reshape(-1, BANDS, ROWS).astype(np.uint64)
    h = np.zeros(s.shape[:2], np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        h = mixed(h * np.uint64(0x9FB21C651E98DF25) + s[:, :, r])
    return h


def rows_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fp, text, place) of the rows that have a text."""
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("fp"), text.alias("text"), F.monotonically_increasing_id().alias("place")).where("text is not null")


def bucket_bits(docs: DataFrame) -> int:
    """Bits of the buckets that bands are dealt to: a bucket for every 16 KB of the table, by the planner's statistics; any number gives the same result."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return min(max((size >> 14).bit_length(), 8), 28)


def scanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of two kinds: lines (id, fp, place, line, k, k2), and a task's different lines by the values of
    their bands (bucket, bands, ks): 32 bits of each value, next to those that make the bucket, and the lines' k, as bytes."""
    slim = rows_of(docs, id_col, text_col)
    bits = bucket_bits(slim)
    schema = T.StructType(
        [slim.schema["id"], T.StructField("fp", T.LongType()), T.StructField("place", T.LongType()), T.StructField("line", T.IntegerType())]
        + [T.StructField(n, T.LongType()) for n in ("k", "k2", "bucket")]
        + [T.StructField(n, T.BinaryType()) for n in ("bands", "ks")]
    )
    kinds = [None, pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def run(batches):
        bands: list[np.ndarray] = []
        keys: list[np.ndarray] = []
        held, id_type = 0, pa.int64()

        def rows(n, **columns):
            out = []
            for f, t in zip(schema, kinds, strict=True):
                x = columns.get(f.name)
                out.append(pa.nulls(n, t or id_type) if x is None else x if isinstance(x, pa.Array) else pa.array(x, t))
            return pa.RecordBatch.from_arrays(out, names=[f.name for f in schema])

        def members():
            key, which = np.unique(np.concatenate(keys), return_index=True)
            band = (np.concatenate(bands)[which] & np.uint64((1 << 32 + bits) - 1)).ravel()
            order = np.argsort(band)
            band, key = band[order], key[order // BANDS]
            bucket = (band >> np.uint64(32)).view(np.int64)
            starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            ends = np.append(starts, len(band))
            blobs = [pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer((ends * x.itemsize).astype(np.int32)), pa.py_buffer(x)]) for x in (band.astype(np.uint32), key)]
            for at in range(0, len(starts), 1 << 12):
                part = pa.array(bucket[starts[at : at + (1 << 12)]])
                yield rows(len(part), bucket=part, bands=blobs[0].slice(at, len(part)), ks=blobs[1].slice(at, len(part)))

        for batch in batches:
            id_type = batch.column(0).type
            texts = [text_of(x) for x in batch.column(2).cast(pa.binary()).to_pylist()]
            for start, end in together(texts):
                form, at, counts = normal_lines(texts[start:end])
                doc = np.repeat(np.arange(end - start), counts)
                number = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
                use = np.flatnonzero(np.diff(at))
                if not len(use):
                    continue
                a, b = at[:-1][use], at[1:][use]
                k, k2 = line_hashes(form, a, b)
                pick = pa.array(doc[use] + start)
                yield rows(len(use), id=batch.column(0).take(pick), fp=batch.column(1).take(pick), place=batch.column(3).take(pick), line=number[use].astype(np.int32), k=k.view(np.int64), k2=k2.view(np.int64))
                fuzzy = b - a >= WINDOW
                if not fuzzy.any():
                    continue
                a, b = a[fuzzy], b[fuzzy]
                k_once, which = np.unique(k[fuzzy], return_index=True)
                bands.append(band_keys(form, a[which], b[which]))
                keys.append(k_once)
                held += bands[-1].size
                if held > HELD:
                    yield from members()
                    bands, keys, held = [], [], 0
        if held:
            yield from members()

    return slim.mapInArrow(run, schema)


def starred(members: DataFrame) -> DataFrame:
    """(band, k, pivot) for each line of a band but one, the pivot, from (bucket, bands, ks).

    Buckets are read as a sorted stream.  What is kept of the last one is a line for each of its bands, so that a band is never held
    whole; there are as many buckets as the size of the table asks for.  Whichever line is the pivot, the same pairs are found in the end.
    """

    def run(batches):
        band, k = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = batch.column(1).to_pylist()
            bucket = np.repeat(batch.column(0).to_numpy(), np.array([len(x) for x in raw]) // 4)
            band = np.append(band, bucket << 32 | np.frombuffer(b"".join(raw), np.uint32))
            k = np.append(k, np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int64))
            order = np.argsort(band, kind="stable")
            band, k = band[order], k[order]
            starts = np.flatnonzero(np.append(True, band[1:] != band[:-1]))
            pivot = np.repeat(k[starts], np.diff(np.append(starts, len(k))))
            use = np.flatnonzero(k != pivot)
            if len(use):
                yield pa.RecordBatch.from_arrays([pa.array(x[use]) for x in (band, k, pivot)], names=["band", "k", "pivot"])
            starts = starts[band[starts] >> 32 == bucket[-1]]
            band, k = band[starts], k[starts]

    dealt = members.select("bucket", "bands", "ks").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "band bigint, k bigint, pivot bigint").distinct()


def alike(x: list[bytes], y: list[bytes], percent: int) -> np.ndarray:
    """Which of up to PAIRS pairs of normal forms reach the threshold; all have a shingle."""
    n = len(x)
    hashes, owner = of_lines(*code_points(x + y))
    keys = (owner % n).astype(np.uint64) << np.uint64(52) | hashes >> np.uint64(13) << np.uint64(1) | (owner >= n)
    keys.sort()
    keys = keys[np.append(True, keys[1:] != keys[:-1])]  # those of one pair and shingle are neighbours, the sides differ in the last bit
    count = lambda k: np.bincount((k >> np.uint64(52)).astype(np.int64), minlength=n)
    return (100 + percent) * count(keys[1:][keys[1:] ^ keys[:-1] == 1]) >= percent * count(keys)


def verified(percent: int):
    """(a, b) of those (a, b, form of a, form of b) that are alike."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, PAIRS):
                part = batch.slice(at, PAIRS)
                x, y = part.column(2).to_pylist(), part.column(3).to_pylist()
                good = np.concatenate([alike(x[a:b], y[a:b], percent) for a, b in together([p + q for p, q in zip(x, y, strict=True)])])
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(good)) for c in (part.column(0), part.column(1))], names=["a", "b"])

    return run


def few_joined(hashes: np.ndarray, owner: np.ndarray, n: int, side: np.ndarray, percent: int) -> np.ndarray:
    """What ``trie.joined`` gives first, for n sets of few shingles: the product of the table of sets and shingles holds all intersections."""
    _, column = np.unique(hashes, return_inverse=True)
    table = np.zeros((n, int(column.max()) + 1), np.float32)
    table[owner, column] = 1
    size, shared = table.sum(axis=1), table @ table.T
    linked = ((100 + percent) * shared >= percent * (size[:, None] + size)) & (side[:, None] != side)
    label = list(range(n))
    for a, b in np.argwhere(np.triu(linked)).tolist():
        if label[a] != label[b]:
            old, new = sorted((label[a], label[b]), reverse=True)
            label = [new if k == old else k for k in label]
    return np.array(label)


def rest(percent: int):
    def then(table: pa.Table):
        """(a, b): links between the groups of the lines of a band, or of a pair of its blocks."""
        root = table.column("root").to_numpy()
        if (root == root[0]).all():
            return
        forms = table.column("form").to_pylist()
        hashes, owner = of_lines(*code_points(forms))
        if len(forms) * len(hashes) <= CELLS:
            label = few_joined(hashes, owner, len(forms), root, percent)
        else:
            sets = [np.unique(x) for x in np.split(hashes, np.searchsorted(owner, np.arange(1, len(forms))))]
            label = trie.joined(sets, percent, root)[0]
        moved = np.flatnonzero(label != np.arange(len(label)))
        if len(moved):
            yield pa.RecordBatch.from_arrays([pa.array(root[moved]), pa.array(root[label[moved]])], names=["a", "b"])

    return then


def forms(docs: DataFrame, lines: DataFrame, ends: DataFrame, id_col: str, text_col: str, put=scratch) -> DataFrame:
    """(k, form) of the lines whose hashes are in ``ends`` (k): each is read again from one text that has it.

    Tables of BITS bits, which don't grow with the data, tell of most other texts and lines that they aren't wanted, before
    they are taken apart or leave Python; the join that follows is exact.
    """
    spark = docs.sparkSession
    once = put(lines.select("k", F.xxhash64("id", "fp").alias("doc"), "line").join(ends, "k", "left_semi").groupBy("k").agg(F.min(F.struct("doc", "line")).alias("at")).select("at"))

    def bits(spot):
        words = once.select(F.shiftrightunsigned(spot, 64 - BITS + 6).alias("word"), F.shiftrightunsigned(spot, 64 - BITS).bitwiseAND(63).cast("int").alias("bit"))
        words = words.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()
        table = np.zeros(1 << (BITS - 6), np.int64)
        table[words.column("word").to_numpy()] = words.column("bits").to_numpy()
        return spark.sparkContext.broadcast(table.view(np.uint64))

    def wanted(sent, spot):
        spot = spot >> np.uint64(64 - BITS)
        return sent.value[spot >> np.uint64(6)] >> (spot & np.uint64(63)) & np.uint64(1) == 1

    spot = F.col("at.doc").bitwiseXOR(F.shiftleft(F.col("at.line").cast("long"), 64 - BITS))
    by_text, by_line = bits(F.col("at.doc")), bits(spot)

    def run(batches):
        for batch in batches:
            docs_at = batch.column(0).to_numpy().view(np.uint64)
            here = wanted(by_text, docs_at)
            texts, docs_at = [text_of(x) for x in batch.column(1).filter(pa.array(here)).cast(pa.binary()).to_pylist()], docs_at[here]
            for start, end in together(texts):
                form, at, counts = normal_lines(texts[start:end])
                number = np.arange(len(at) - 1) - np.repeat(np.cumsum(counts) - counts, counts)
                likely = wanted(by_line, np.repeat(docs_at[start:end], counts) ^ number.astype(np.uint64) << np.uint64(64 - BITS))
                use = np.flatnonzero((np.diff(at) >= WINDOW) & likely)
                if not len(use):
                    continue
                a, b = at[:-1][use], at[1:][use]
                form = np.concatenate([form[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)])
                b = np.cumsum(b - a)
                a = np.append(0, b[:-1])
                k, _ = line_hashes(form, a, b)
                k, which = np.unique(k, return_index=True)
                raw = form.tobytes()
                made = [raw[x:y].decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogateescape") for x, y in zip((4 * a[which]).tolist(), (4 * b[which]).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(made, pa.binary())], names=["k", "form"])

    every = rows_of(docs, id_col, text_col).select(F.xxhash64("id", "fp").alias("doc"), "text").mapInArrow(run, "k bigint, form binary")
    return every.join(ends, "k", "left_semi").groupBy("k").agg(F.first("form").alias("form"))


def groups(docs: DataFrame, lines: DataFrame, star: DataFrame, id_col: str, text_col: str, percent: int, put=scratch) -> DataFrame:
    """(k, k2, root) of the lines that are like another one."""
    pairs = star.select("k", "pivot").distinct()
    ends = pairs.select("k").unionByName(pairs.select(F.col("pivot").alias("k"))).distinct()
    texts = put(forms(docs, lines, ends, id_col, text_col, put))
    x = pairs.join(texts.withColumnRenamed("form", "x"), "k")
    x = x.join(texts.select(F.col("k").alias("pivot"), F.col("form").alias("y")), "pivot")
    held = x.select("k", "pivot", "x", "y").mapInArrow(verified(percent), "a bigint, b bigint")
    found = put(components(held).withColumnRenamed("node", "k"))
    # Bands whose lines lie in several groups; two lines were compared when they were verified.
    label = lambda name: found.select(F.col("k").alias(name), F.col("root").alias(f"root_{name}"))
    star = star.join(label("k"), "k", "left").join(label("pivot"), "pivot", "left")
    star = star.select("band", "k", "pivot", F.coalesce("root_k", "k").alias("root"), F.coalesce("root_pivot", "pivot").alias("top"))
    star = put(star)
    # Bands that hold the same lines are compared once; two hashes of 64 bits and a count tell the sets apart.
    own = star.groupBy("band", "pivot").agg(
        F.max((F.col("root") != F.col("top")).cast("int")).alias("mixed"), F.count(F.lit(1)).alias("n"), F.bit_xor("k").alias("x"), F.bit_xor(F.xxhash64("k")).alias("y")
    )
    mixed_bands = own.where("mixed = 1 and n > 1").groupBy("pivot", "n", "x", "y").agg(F.min("band").alias("band")).select("band")
    star = star.join(mixed_bands, "band", "left_semi")
    among = star.select("band", "k", "root").unionByName(star.select("band", F.col("pivot").alias("k"), F.col("top").alias("root")).distinct())
    among = put(among.join(texts.select("k", F.length("form").alias("size")), "k"))
    parts = blocked(among, "band", "k", ELEMENTS, "size").select("band", "i", "j", "k", "root")
    more = put(by_group(parts.join(texts, "k"), ["band", "i", "j"], rest(percent), "a bigint, b bigint"))
    if not more.isEmpty():
        final = components(more).select(F.col("node").alias("root"), F.col("root").alias("last"))
        # Groups that are linked may be single lines, which ``found`` lacks.
        found = found.unionByName(final.select(F.col("root").alias("k"), "root")).dropDuplicates(["k"])
        found = found.join(final, "root", "left").select("k", F.coalesce("last", "root").alias("root"))
    # One line for each k: another with the same 64 bits, should there be one, was not compared.
    return lines.select("k", "k2").join(found, "k").groupBy("k", "root").agg(F.min("k2").alias("k2"))


def dropped(docs: DataFrame, id_col="doc_id", text_col="text", percent: int = PERCENT) -> DataFrame:
    """(id, fp, first, lines, all): by document, the place of its first row, the numbers of the lines that go from it, and
    of all that have a letter or digit, which go from rows that repeat it; the last is null where there are none."""
    with scratch_until(docs.sparkSession) as put:
        found = put(scanned(docs, id_col, text_col))
        lines = found.where("bands is null").select("id", "fp", "place", "line", "k", "k2")
        linked = groups(docs, lines, put(starred(found.where("bands is not null"))), id_col, text_col, percent, put)
        # A line that occurs once and is like no other stays; the rest of the way is without it.
        again = lines.groupBy("k", "k2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        # A group is named by its root, or else by both halves of its one line's hash.
        roots = again.join(linked, ["k", "k2"], "full").select("k", "k2", F.coalesce("root", "k").alias("root"), F.when(F.col("root").isNull(), F.col("k2")).alias("half"))
        each = put(lines.join(roots, ["k", "k2"]).groupBy("id", "fp", "line", "root", "half").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("times")))
        own = F.struct(F.col("id").isNotNull().alias("known"), "id", "fp", "line")
        stays = each.groupBy("root", "half").agg(F.min(own).alias("at"), F.sum("times").alias("n")).where("n > 1")
        same = (F.col("each.root") == F.col("stays.root")) & F.col("each.half").eqNullSafe(F.col("stays.half"))
        gone = each.alias("each").join(stays.alias("stays"), same).select("each.*", "at").withColumn("goes", own != F.col("at"))
        gone = gone.where("goes or times > 1").groupBy("id", "fp").agg(F.min("place").alias("first"), F.collect_set(F.when(F.col("goes"), F.col("line"))).alias("lines"), F.collect_set(F.when(F.col("times") > 1, F.col("line"))).alias("all"))
        return scratch(gone.withColumn("all", F.when(F.size("all") > 0, F.col("all"))))


def deduplicated(docs: DataFrame, id_col="doc_id", text_col="text", percent: int = PERCENT) -> DataFrame:
    """``row`` (the input's columns), ``n_lines`` and ``n_gone`` (counts) and ``left``, the text without the lines that go."""
    gone = dropped(docs, id_col, text_col, percent)
    gone = gone.select(F.col("id").alias("gi"), F.col("fp").alias("gf"), "first", F.col("lines").alias("own"), "all")
    text = F.col(f"`{text_col}`").cast("string")
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("di"), F.xxhash64(text).alias("df"), text.alias("dt"), F.monotonically_increasing_id().alias("place"))
    out = marked.join(gone, F.col("di").eqNullSafe(F.col("gi")) & (F.col("df") == F.col("gf")), "left")
    out = out.withColumn("lines", F.when(F.col("all").isNull() | (F.col("place") == F.col("first")), F.col("own")).otherwise(F.col("all")))
    pieces = F.split("dt", "\n")
    keep = F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), F.col("lines"))
    rest = F.element_at(F.transform(F.array(pieces), lambda p: F.array_join(F.transform(keep, lambda i: F.get(p, i)), "\n")), 1)
    left = F.when(F.col("lines").isNull(), F.col("dt")).otherwise(rest)
    return out.select("row", F.when(F.col("dt").isNull(), 0).otherwise(F.size(pieces)).cast("long").alias("n_lines"), F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_gone"), left.alias("left"))


def without_copies(docs: DataFrame, id_col="doc_id", text_col="text", chars_col="n_chars", percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` with their texts (and numbers of characters) after deduplication.  Documents that lost lines and have no letter or digit left go."""
    out = deduplicated(docs, id_col, text_col, percent)
    out = out.where((F.col("n_gone") == 0) | F.col("left").rlike(r"[0-9A-Za-z\x{80}-\x{10FFFF}]"))
    changed = {text_col: F.col("left"), chars_col: F.when(F.col("n_gone") == 0, F.col(f"row.`{chars_col}`")).otherwise(F.length("left"))} if chars_col in docs.columns else {text_col: F.col("left")}
    return out.select(*[changed.get(c, F.col(f"row.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: lines, lines that go, characters and SHA-256 of what is left."""
    out = deduplicated(docs.select("doc_id", "text"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_lines", F.col("n_gone").alias("n_dropped"), F.coalesce(F.length("left"), F.lit(0)).cast("long").alias("n_chars_left"), F.sha2(F.coalesce("left", F.lit("")), 256).alias("text_sha256"))
