"""SentencePiece encoding with N-best segmentation, and decoding.

The lattice of a text has an arc for every vocabulary piece that occurs in it.  Forward Viterbi scores of its nodes are
the exact cost still to come for a backward search.  So A* follows the best arcs of what it takes from the heap to the
start at once, as their cost stays the least, and puts only the deviations into the heap: each thing taken out is one
more segmentation, in the order of the scores.  Arcs into a node are looked up when the search comes to it.

No piece crosses a place whose two characters stand next to each other in no piece, so all paths pass the node there.  The
lattice is cut at these places, and each different segment is searched once and remembered, in memory that is bounded by
bytes.  The N best of the whole text are the N best sums, for which only the N - 1 segments with the smallest gaps to
their second best matter; they are given as changes of the best one (``segmentations`` writes them out).

Cases: null stays null; an empty text has no pieces; characters outside the vocabulary become byte pieces, as does a
U+2581 of the text itself, so decoding gives every text back unchanged; runs of spaces are kept; equal scores are
ordered by the search, alike in every run; repeated rows get the same result, null ids are kept, other columns are
ignored, and an empty table gives an empty result.  Texts are taken whole; memory follows the longest segment, at about
40 bytes a character.
"""

from __future__ import annotations

import heapq
import itertools
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Bytes of remembered segments in a Python worker, and the longest segment that is remembered.
REMEMBERED, LONG = 128 << 20, 64
#: What an entry takes besides its characters and ids.
ENTRY = 350
#: How much less than the lowest piece of one character other than the space a character outside the vocabulary scores.
UNKNOWN = 10


class Memory(dict):
    """Results by segment, in about ``most`` bytes.  Half full, it becomes the older generation and starts anew; what is used again moves up."""

    def __init__(self, find, most: int = REMEMBERED):
        self.find, self.most, self.size, self.older = find, most // 2, 0, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.find(key)
        if len(key) > LONG:
            return value
        if self.size >= self.most:
            self.older, self.size = dict(self), 0
            self.clear()
        self.size += ENTRY + 6 * len(key)
        self[key] = value
        return value


class Pieces:
    """A vocabulary of (piece, score), piece ids by order; ``bytes_at`` is the id of byte piece 0."""

    def __init__(self, vocabulary: dict[str, tuple[int, float]], bytes_at: int, plain: dict[int, bytes]):
        self.bytes_at, self.plain = bytes_at, plain
        self.lowest = float(min((s for p, (_, s) in vocabulary.items() if len(p) == 1 and p != SPACE), default=0) - UNKNOWN)
        self.arcs = {p: (float(s), (i,)) for p, (i, s) in vocabulary.items()}
        self.single = {p for p in vocabulary if len(p) == 1}
        self.longest = max(map(len, vocabulary), default=1)
        self.tree: dict = {}  # by characters; the (score, ids) of a piece that ends is at ""
        for piece in vocabulary:
            node = self.tree
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = self.arcs[piece]
            if SPACE in piece.lstrip(SPACE):
                raise ValueError(f"piece {piece!r} crosses a space")
        known = sorted({c for p in vocabulary for c in p})
        self.number = np.zeros(0x110000, np.uint16)
        self.number[[ord(c) for c in known]] = np.arange(1, len(known) + 1)
        self.width = len(known) + 1
        inside = {(a, b) for p in vocabulary for a, b in zip(p, p[1:])}
        self.inside = np.zeros(self.width * self.width, bool)
        for a, b in inside:
            self.inside[int(self.number[ord(a)]) * self.width + int(self.number[ord(b)])] = True
        self.memory = Memory(self.two)

    @classmethod
    def load(cls, path: str = MODEL) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        byte = [i for i in range(size) if model.is_byte(i)]
        normal = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        vocabulary = {model.id_to_piece(i): (i, model.get_score(i)) for i in normal}
        plain = {i: model.id_to_piece(i).replace(SPACE, " ").encode() for i in normal} | {i: bytes([i - byte[0]]) for i in byte}
        return cls(vocabulary, byte[0], plain)

    def short(self, segment: str) -> list[list[tuple]]:
        """The arcs into each node as (best score by this way, begin, ids), in any order."""
        size, tree, at = len(segment), self.tree, 0.0
        arcs: list[list[tuple]] = [[] for _ in range(size + 1)]
        for i in range(size):
            node, j = tree, i
            for c in segment[i:]:
                node = node.get(c)
                if node is None:
                    break
                j += 1
                if "" in node:
                    arc = node[""]
                    arcs[j].append((at + arc[0], i, arc[1]))
            ways = arcs[i + 1]
            if segment[i] not in self.single:
                ways.append((at + self.lowest, i, self.unknown(segment[i])))
            at = max(ways)[0] if len(ways) > 1 else ways[0][0]
        return arcs

    def scores(self, segment: str) -> list[float]:
        """The best score of each node, for segments whose arcs are too many to be kept."""
        size, tree, longest = len(segment), self.tree, self.longest
        score = [0.0] + [float("-inf")] * size
        for i, here in enumerate(itertools.islice(score, size)):
            node, j = tree, i
            for c in segment[i : i + longest]:
                node = node.get(c)
                if node is None:
                    break
                j += 1
                if "" in node and here + node[""][0] > score[j]:
                    score[j] = here + node[""][0]
            if segment[i] not in self.single and here + self.lowest > score[i + 1]:
                score[i + 1] = here + self.lowest
        return score

    def into(self, segment: str):
        """A function that gives the arcs into a node, the best first."""
        if len(segment) <= LONG:
            arcs = self.short(segment)

            def kept(j: int) -> list[tuple]:
                if len(arcs[j]) > 1:
                    arcs[j].sort(reverse=True)
                return arcs[j]

            return kept
        score = self.scores(segment)

        def looked_up(j: int) -> list[tuple]:
            ways = []
            for i in range(max(0, j - self.longest), j):
                arc = self.arcs.get(segment[i:j])
                if arc:
                    ways.append((score[i] + arc[0], i, arc[1]))
            if segment[j - 1] not in self.single:
                ways.append((score[j - 1] + self.lowest, j - 1, self.unknown(segment[j - 1])))
            ways.sort(reverse=True)
            return ways

        return looked_up

    def nbest(self, segment: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations, best first, as (score, ids)."""
        into, found, count, size = self.into(segment), [], itertools.count(), len(segment)
        ways = {size: into(size)[:n]}
        top = ways[size][0][0]
        heap = [(-top, next(count), size, None)]  # cost, order, node, ids behind it
        while heap and len(found) < n:
            cost, _, j, chain = heapq.heappop(heap)
            new = []
            while j:
                if j not in ways:
                    ways[j] = into(j)[:n]
                (best, i, ids), *others = ways[j]
                new += [(cost + best - s, next(count), k, (own, chain)) for s, k, own in others]
                j, chain = i, (ids, chain)
            ids = []
            while chain is not None:
                ids.extend(chain[0])
                chain = chain[1]
            found.append((-cost, tuple(ids)))
            heap = heapq.nsmallest(n - len(found), heap + new)  # each holds a whole segmentation of just that cost
        return found

    hidden = ""

    def unknown(self, char: str) -> tuple[int, ...]:
        """The byte pieces of a character outside the vocabulary."""
        return tuple(self.bytes_at + b for b in (SPACE if char == self.hidden else char).encode("utf-8", "surrogatepass"))

    def two(self, segment: str) -> tuple[bytes, float, float]:
        """Ids of the best as little-endian 32-bit integers, its score, and the gap to the second best: the search for n = 2, where the heap holds one deviation."""
        into, j, gap, ids = self.into(segment), len(segment), float("inf"), ()
        top = into(j)[0][0]
        while j:
            ways = into(j)
            if len(ways) > 1 and ways[0][0] - ways[1][0] < gap:
                gap = ways[0][0] - ways[1][0]
            _, j, own = ways[0]
            ids = (own, ids)
        flat: list[int] = []
        while ids:
            flat.extend(ids[0])
            ids = ids[1]
        return struct.pack(f"<{len(flat)}i", *flat), top, gap

    def segments(self, text: str) -> list[str]:
        """The parts of a text that no piece crosses."""
        self.hidden = ""
        if not text:
            return []
        if SPACE in text:  # as bytes; what stands for it meanwhile is a character that the text lacks
            self.hidden = next(c for c in map(chr, itertools.chain(range(0xE000, 0xF8FF), range(0xF0000, 0x10FFFE))) if c not in text)
            text = text.replace(SPACE, self.hidden)
        text = SPACE + text.replace(" ", SPACE)
        number = self.number[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
        cuts = (np.flatnonzero(~self.inside[number[:-1] * self.width + number[1:]]) + 1).tolist()
        return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]

    def encode(self, text: str, n: int) -> tuple[bytes, list[float], list[list[tuple[int, int, tuple[int, ...]]]]]:
        """Ids of the best segmentation, the scores of the n best, and for each but the best its changes: (at, n, ids) says
        that ids stand for the best one's n pieces from place ``at`` on; the last change comes first."""
        segments = self.segments(text)
        find = self.memory.__getitem__ if SPACE not in text else self.two
        done = list(map(find, segments))
        total = sum([d[1] for d in done])
        near, gaps = [], [d[2] for d in done]
        while len(near) < n - 1 and (least := min(gaps, default=float("inf"))) < float("inf"):
            near.append((least, gaps.index(least)))
            gaps[near[-1][1]] = float("inf")
        sums: list[tuple[float, tuple]] = [(0.0, ())]
        for _, k in near:
            own = self.nbest(segments[k], n)
            options = [(0.0, ())] + [(own[0][0] - s, ((k, w),)) for w, (s, _) in enumerate(own) if w]
            sums = heapq.nsmallest(n, [(a + b, x + y) for a, x in sums for b, y in options])
        changes = []
        if len(sums) > 1:
            ways = {k: self.nbest(segments[k], n) for k in {k for _, x in sums for k, _ in x}}
            at = {k: sum(len(d[0]) for d in done[:k]) // 4 for k in ways}
            changes = [[(at[k], len(done[k][0]) // 4, ways[k][w][1]) for k, w in sorted(x, reverse=True)] for _, x in sums[1:]]
        return b"".join([d[0] for d in done]), [float(total - s) for s, _ in sums], changes

    def decode(self, ids) -> bytes:
        """UTF-8 of the text."""
        out = b"".join(map(self.plain.__getitem__, ids))
        return out[1:] if out[:1] == b" " else out


_loaded: dict[str, Pieces] = {}


def loaded(path: str) -> Pieces:
    """The vocabulary, once for each Python worker."""
    if path not in _loaded:
        _loaded[path] = Pieces.load(path)
    return _loaded[path]


def encode(docs: DataFrame, id_col="doc_id", text_col="text", n: int = 3, model: str = MODEL) -> DataFrame:
    """``id_col``, ``ids`` (array<int>) of the best segmentation, ``scores`` of the n best, ``others`` (an array of changes
    (at, n, ids) of ``ids`` for each but the best) and ``text_ok``: decoding the ids gives the text."""
    slim = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("__text"))
    change = T.StructType([T.StructField("at", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])
    kind = pa.list_(pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32()), ("ids", pa.list_(pa.int32()))])))
    schema = T.StructType([slim.schema[0], T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("scores", T.ArrayType(T.DoubleType(), False)), T.StructField("others", T.ArrayType(T.ArrayType(change))), T.StructField("text_ok", T.BooleanType())])

    def run(batches):
        tool = loaded(model)
        for whole in batches:
            for at in range(0, max(whole.num_rows, 1), 256):
                batch = whole.slice(at, 256)
                ids, offsets, scores, others, ok = [], [0], [], [], []
                for text in batch.column(1).to_pylist():
                    got, s, rest = (b"", None, None) if text is None else tool.encode(text, n)
                    ids.append(got)
                    scores.append(s)
                    others.append(None if rest is None else [[{"at": a, "n": m, "ids": new} for a, m, new in x] for x in rest])
                    ok.append(None if text is None else tool.decode(np.frombuffer(got, "<i4").tolist()) == text.encode("utf-8", "surrogatepass"))
                    offsets.append(offsets[-1] + len(got) // 4)
                values = pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32())
                mask = pa.array([s is None for s in scores], pa.bool_())
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=mask)
                yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(scores, pa.list_(pa.float64())), pa.array(others, kind), pa.array(ok, pa.bool_())], names=[f.name for f in schema])

    return slim.mapInArrow(run, schema)


def segmentations(ids: str = "ids", others: str = "others") -> Column:
    """The n best segmentations of an encoded row as arrays of ids, the best first."""

    def changed(changes: Column) -> Column:
        put = lambda now, c: F.concat(F.slice(now, F.lit(1), c["at"]), c["ids"], F.slice(now, c["at"] + c["n"] + 1, F.size(now)))
        return F.aggregate(changes, F.col(ids), put)

    return F.concat(F.array(F.col(ids)), F.transform(others, changed))


def decode(coded: DataFrame, id_col="doc_id", ids_col="ids", model: str = MODEL) -> DataFrame:
    """``id_col`` and ``text`` of arrays of ids; null for null."""
    slim = coded.select(F.col(f"`{id_col}`"), F.col(f"`{ids_col}`").cast("array<int>").alias("__ids"))
    schema = T.StructType([slim.schema[0], T.StructField("text", T.StringType())])

    def run(batches):
        tool = loaded(model)
        for whole in batches:
            for at in range(0, max(whole.num_rows, 1), 256):
                batch = whole.slice(at, 256)
                texts = [None if x is None else tool.decode(x).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[f.name for f in schema])

    return slim.mapInArrow(run, schema)


def digest(docs: DataFrame, n: int = 3, model: str = MODEL) -> DataFrame:
    """Per row of ``docs``: pieces, hashes of the best and of the other segmentations' changes, the best score, the gap to the n-th best, and whether decoding gives the text."""
    out = encode(docs, n=n, model=model)
    return out.select(
        "doc_id",
        F.when(F.col("ids").isNull(), 0).otherwise(F.size("ids")).cast("long").alias("n_pieces"),
        F.xxhash64("ids").alias("ids_hash"),
        F.xxhash64("others").alias("others_hash"),
        F.get("scores", F.lit(0)).alias("score"),
        F.size(F.coalesce("scores", F.array().cast("array<double>"))).alias("n_best"),
        (F.get("scores", F.lit(0)) - F.element_at("scores", -1)).alias("gap"),
        "text_ok",
    )
