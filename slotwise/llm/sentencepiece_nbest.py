"""SentencePiece encoding and decoding with exact N-best segmentations.

A text (with the dummy prefix space) is a lattice of vocabulary pieces.
Forward Viterbi costs of every prefix are exact heuristics for a backward
A-star search from the end of the lattice, which pops complete segmentations in
order of cost.

No piece holds a newline or a space after another character (checked when the
vocabulary is loaded), so the lattice of a text is a chain of short lattices, one
per chunk (" word", "\\n", a run of spaces).  Chunks repeat and their results are
kept in a bounded cache per Python worker; the N best of the chain come from the chunks
with the smallest second-best gaps, which is exact: a segmentation that deviates
at any other chunk has N-1 cheaper single deviations before it.

Costs are integers (micro-nats) of a unigram model: piece probabilities follow
the Zipf-Mandelbrot law over the vocabulary's rank, because the public
vocabulary is a merge list without probabilities (parameters below).  Characters
outside the vocabulary become their UTF-8 byte pieces.

The vocabulary file is read on the driver (``model_file``, a parameter) and
travels with the tasks; the Spark side is a narrow map over whole texts.

Defined cases: null and empty texts have no pieces and one empty segmentation
of cost 0; a text with fewer than N segmentations has that many.  Decoding
joins the pieces, turns the mark into a space and drops the dummy prefix;
``decode(encode(x)) == x`` for every text.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwise.llm.common import column, read_table

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 4
#: Zipf-Mandelbrot offset of the rank.
RANK_OFFSET = 2.7
#: Added cost of a byte piece, in nats.
BYTE_PENALTY = 10.0
#: Chunks kept per Python worker.
CACHE_CHUNKS = 1_000_000
_FAR = 1 << 62
_CHUNK = re.compile(r"\n| *[^ \n]+| +")

Edit = tuple[int, int, tuple[int, ...]]


@dataclass
class Vocabulary:
    """Pieces (spaces instead of the mark) with integer costs."""

    ids: dict[str, int]
    trie: dict[str, int]  # every prefix of a piece: the piece's id, or -1 for a prefix only
    costs: list[int]
    byte_ids: list[int]
    texts: list[bytes]
    longest: int
    digest: str
    _options: dict = field(default_factory=dict, repr=False)

    @classmethod
    def load(cls, model_file: str = MODEL_FILE) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        ids, byte_ids, texts = {}, [0] * 256, [b""] * size
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                byte_ids[value], texts[i] = i, bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                piece = piece.replace("▁", " ")
                ids[piece], texts[i] = i, piece.encode()
        if any("\n" in p or re.search(r"[^ ] ", p) for p in ids):
            raise ValueError("the vocabulary has pieces that cross chunks")
        norm = math.log(sum(1 / (i + RANK_OFFSET) for i in range(size)))
        costs = [round((math.log(i + RANK_OFFSET) + norm) * 1e6) for i in range(size)]
        for i in byte_ids:
            costs[i] = max(costs) + round(BYTE_PENALTY * 1e6)
        trie = {p[:k]: -1 for p in ids for k in range(1, len(p))} | ids
        digest = hashlib.sha256(repr((sorted(ids.items()), costs, byte_ids)).encode()).hexdigest()
        return cls(ids, trie, costs, byte_ids, texts, max(map(len, ids)), digest)

    def __getstate__(self):
        return {**self.__dict__, "_options": {}}

    def lattice(self, chunk: str) -> list[list[tuple[int, int, tuple[int, ...]]]]:
        """For every end position the arcs (start, cost, ids) of the pieces that end there."""
        ids, costs, n = self.ids, self.costs, len(chunk)
        arcs: list[list[tuple[int, int, tuple[int, ...]]]] = [[] for _ in range(n + 1)]
        for i in range(n):
            one = ids.get(chunk[i])
            if one is None:
                raw = tuple(self.byte_ids[b] for b in chunk[i].encode())
                arcs[i + 1].append((i, sum(costs[x] for x in raw), raw))
            else:
                arcs[i + 1].append((i, costs[one], (one,)))
            for j in range(i + 2, min(n, i + self.longest) + 1):
                piece = ids.get(chunk[i:j])
                if piece is not None:
                    arcs[j].append((i, costs[piece], (piece,)))
        return arcs

    def n_best(self, chunk: str, n: int) -> list[tuple[int, tuple[int, ...]]]:
        """The ``n`` cheapest segmentations of a chunk, (cost, ids) in order of cost."""
        arcs = self.lattice(chunk)
        ahead = [0] * len(arcs)  # forward Viterbi: cheapest cost of each prefix
        for end in range(1, len(arcs)):
            ahead[end] = min([ahead[start] + cost for start, cost, _ in arcs[end]])
        found, order = [], 0
        heap = [(ahead[-1], 0, len(chunk), 0, ())]  # (prefix bound + suffix cost, order, position, suffix cost, suffix)
        while heap and len(found) < n:
            total, _, at, behind, path = heapq.heappop(heap)
            if at == 0:
                ids: list[int] = []
                while path:
                    ids.extend(path[0])
                    path = path[1]
                found.append((total, tuple(ids)))
                continue
            for start, cost, piece in arcs[at]:
                order += 1
                heapq.heappush(heap, (ahead[start] + cost + behind, -order, start, cost + behind, (piece, path)))  # of equals the latest: one path is completed before the next is begun
        return found

    def chunk(self, chunk: str) -> tuple[list[int], int, int]:
        """(ids, cost, gap to the second best) of a chunk; the gap is ``_FAR`` if there is no second.

        The second best segmentation uses at least one arc off the best path, so its
        cost is the least of prefix cost + arc + suffix cost over those arcs.
        """
        get, costs, n = self.trie.get, self.costs, len(chunk)
        ahead = [0] + [_FAR] * n
        came, used = [0] * (n + 1), [-1] * (n + 1)  # best arc into each position: start and piece (-1: bytes)
        arcs = []
        for i in range(n):
            base, j = ahead[i], i + 1
            piece = get(chunk[i:j])
            if piece is None or piece < 0:
                cost = sum([costs[self.byte_ids[b]] for b in chunk[i].encode()])
                arcs.append((i, j, cost))
                if base + cost < ahead[j]:
                    ahead[j], came[j], used[j] = base + cost, i, -1
            while piece is not None:
                if piece >= 0:
                    cost = costs[piece]
                    arcs.append((i, j, cost))
                    if base + cost < ahead[j]:
                        ahead[j], came[j], used[j] = base + cost, i, piece
                if j == n:
                    break
                j += 1
                piece = get(chunk[i:j])
        path, at = [], n
        while at:
            piece, start = used[at], came[at]
            if piece >= 0:
                path.append(piece)
            else:
                path += [self.byte_ids[b] for b in reversed(chunk[start].encode())]
            at = start
        path.reverse()
        if len(arcs) == len(path):
            return path, ahead[n], _FAR
        on_path, at = set(), n
        while at:
            on_path.add((came[at], at))
            at = came[at]
        behind, second = [_FAR] * n + [0], _FAR
        for i, j, cost in reversed(arcs):
            cost += behind[j]
            if cost < behind[i]:
                behind[i] = cost
            cost += ahead[i]
            if cost < second and (i, j) not in on_path:
                second = cost
        return path, ahead[n], second - ahead[n] if second < _FAR else _FAR

    def options(self, chunk: str, n: int) -> list[tuple[int, tuple[int, ...]]]:
        """``n_best`` with the segmentation of :meth:`chunk` first among its equals (kept for short chunks)."""
        hit = self._options.get((chunk, n))
        if hit is None:
            path, cost, _ = self.chunk(chunk)
            ids = tuple(path)
            hit = [(cost, ids), *[x for x in self.n_best(chunk, n) if x != (cost, ids)]][:n]
            if len(self._options) >= 50_000:
                self._options.clear()
            if len(chunk) < 64:
                self._options[chunk, n] = hit
        return hit

    def encode(self, text: str | None, n: int = N_BEST) -> tuple[list[int], list[tuple[int, list[Edit]]]]:
        """Best ids, and the ``n`` cheapest segmentations as (cost, edits of the best ids).

        An edit (at, count, new) replaces ``count`` ids from position ``at``.
        """
        ids, _, found = ChunkStore(self).encode([text], n)
        return ids.tolist(), found[0]

    def decode(self, ids: list[int]) -> str:
        """Text of a list of ids."""
        return b"".join(map(self.texts.__getitem__, ids)).decode("utf-8", "replace")[1:]


class ChunkStore:
    """Best segmentations of the chunks seen so far, as arrays; encodes lists of texts.

    Texts are split at spaces.  A word is the key of the chunk of a space and the
    word; ``\x01`` before a word (after a newline) marks a chunk without the space.
    Texts with runs of spaces or these control characters are cut by the
    chunk pattern instead, ``\x02`` before a whole chunk being the key.
    """

    def __init__(self, vocabulary: Vocabulary, limit: int = CACHE_CHUNKS):
        self.vocabulary, self.limit = vocabulary, limit
        self.index: dict[str, int] = {}
        self._reset()

    def _reset(self) -> None:
        self.index.clear()
        self.keys: list[str] = []
        self.cost, self.gap, self.start = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)
        self.flat = np.zeros(0, np.int32)

    @staticmethod
    def chunk_of(key: str) -> str:
        return key[1:] if key[:1] in ("\x01", "\x02") else key if key == "\n" else " " + key

    def _add(self, keys: list[str]) -> None:
        """Segment the chunks of new keys and append them to the arrays."""
        flat, costs, gaps, ends, total = [], [], [], [], int(self.start[-1])
        find, k = self.vocabulary.chunk, len(self.cost)
        for key in keys:
            if key == "\x01":
                ids, cost, gap = [], 0, _FAR
            else:
                ids, cost, gap = find(self.chunk_of(key))
            flat += ids
            costs.append(cost)
            gaps.append(gap)
            ends.append(total + len(flat))
        self.index.update(zip(keys, range(k, k + len(keys))))
        self.keys += keys
        self.cost, self.gap = np.concatenate([self.cost, costs]), np.concatenate([self.gap, gaps])
        self.start = np.concatenate([self.start, ends])
        self.flat = np.concatenate([self.flat, np.array(flat, np.int32)])

    @staticmethod
    def split(text: str) -> list[str]:
        """Chunk keys of a non-empty text."""
        spaced = text.replace("\n", " \n \x01")
        if spaced[0] != " " and spaced[-1] != " " and "  " not in spaced and "\x02" not in text and "\x01" not in text:
            return spaced.split(" ")
        return [c[1:] if c[0] == " " and len(c) > 1 and c[1] not in " \x01\x02" else "\x02" + c for c in _CHUNK.findall(" " + text)]

    def encode(self, texts: list[str | None], n: int = N_BEST) -> tuple[np.ndarray, np.ndarray, list[list[tuple[int, list[Edit]]]]]:
        """(all ids, offsets of the texts, per text its ``n`` cheapest segmentations)."""
        if len(self.keys) > self.limit:
            self._reset()
        words, bounds = [], [0]
        for text in texts:
            if text:
                words += self.split(text)
            bounds.append(len(words))
        new = [w for w in dict.fromkeys(words) if w not in self.index]
        if new:
            self._add(new)
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        first = self.start[at]
        sizes = self.start[at + 1] - first
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat[np.arange(ends[-1]) + np.repeat(first - ends[:-1], sizes)]
        costs, gaps = self.cost[at], self.gap[at]
        found = []
        for a, b in zip(bounds, bounds[1:]):
            own = gaps[a:b]
            if n > 1 and b - a > n - 1:
                edge = np.partition(own, n - 2)[n - 2]
                low = np.flatnonzero(own < edge)
                low = np.concatenate([low, np.flatnonzero(own == edge)[: n - 1 - len(low)]])
            else:
                low = np.arange(b - a)
            low = np.sort(low[own[low] < _FAR])
            found.append(self._combine(int(costs[a:b].sum()), [(int(ends[a + k] - ends[a]), words[a + k]) for k in low.tolist()], n))
        return ids, ends[bounds], found

    def _combine(self, base: int, open_chunks: list[tuple[int, str]], n: int) -> list[tuple[int, list[Edit]]]:
        """``n`` cheapest choices over the open chunks (position of their ids, key); all others keep their best."""
        options = [self.vocabulary.options(self.chunk_of(key), n) for _, key in open_chunks]
        heap = [(base, (0,) * len(options))]
        seen, out = {heap[0][1]}, []
        while heap and len(out) < n:
            cost, pick = heapq.heappop(heap)
            out.append((cost, [(open_chunks[i][0], len(options[i][0][1]), options[i][c][1]) for i, c in enumerate(pick) if c]))
            for i, c in enumerate(pick):
                if c + 1 < len(options[i]):
                    step = (*pick[:i], c + 1, *pick[i + 1 :])
                    if step not in seen:
                        seen.add(step)
                        heapq.heappush(heap, (cost + options[i][c + 1][0] - options[i][c][0], step))
        return out


#: Stores of this Python worker, by vocabulary: tasks that follow one another share the segmentations.
_STORES: dict[str, ChunkStore] = {}


def worker_store(vocabulary: Vocabulary) -> ChunkStore:
    """The chunk store of this Python worker for a vocabulary (bounded by ``CACHE_CHUNKS``)."""
    if vocabulary.digest not in _STORES:
        _STORES.clear()
        _STORES[vocabulary.digest] = ChunkStore(vocabulary)
    return _STORES[vocabulary.digest]


def apply_edits(ids: list[int], edits: list[Edit]) -> list[int]:
    """Ids of another segmentation from the best ids and its edits."""
    out = list(ids)
    for at, count, new in sorted(edits, reverse=True):
        out[at : at + count] = new
    return out


_EDITS = pa.list_(pa.struct([("at", pa.int32()), ("count", pa.int32()), ("new_ids", pa.list_(pa.int32()))]))
_ARROW = pa.list_(pa.struct([("cost", pa.int64()), ("edits", _EDITS)]))
_EDIT_SCHEMA = T.StructType([T.StructField("at", T.IntegerType()), T.StructField("count", T.IntegerType()), T.StructField("new_ids", T.ArrayType(T.IntegerType()))])
_NBEST_SCHEMA = T.ArrayType(T.StructType([T.StructField("cost", T.LongType()), T.StructField("edits", T.ArrayType(_EDIT_SCHEMA))]))


def encode(docs: DataFrame, vocabulary: Vocabulary | None = None, n_best: int = N_BEST) -> DataFrame:
    """``docs`` without text, with ids, n_best and round_trip (columns of these names are replaced).

    ``n_best``: the cheapest segmentations in order, each with its cost and its
    edits of ``ids``; ``round_trip`` tells that decoding gives the text back.
    """
    vocabulary = vocabulary or Vocabulary.load()
    rest = [c for c in docs.columns if c not in ("text", "ids", "n_best", "round_trip")]
    fields = [docs.schema[c] for c in rest]
    schema = T.StructType([*fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_best", _NBEST_SCHEMA), T.StructField("round_trip", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = worker_store(vocabulary)
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                texts = column(part, "text").to_pylist()
                ids, offsets, found = store.encode(texts, n_best)
                best = [[{"cost": c, "edits": [{"at": a, "count": k, "new_ids": list(x)} for a, k, x in e]} for c, e in one] for one in found]
                same = [vocabulary.decode(ids[a:b].tolist()) == (x or "") for x, a, b in zip(texts, offsets, offsets[1:])]
                arrays = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids)), pa.array(best, _ARROW), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*[column(part, c) for c in rest], *arrays], [*rest, "ids", "n_best", "round_trip"])

    source = docs.select(*[F.col(f"`{c}`") for c in rest], F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """``encoded`` with ``text`` made from ``ids`` (null ids: null text)."""
    vocabulary = vocabulary or Vocabulary.load()
    rest = [c for c in encoded.columns if c != "text"]
    fields = [encoded.schema[c] for c in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else vocabulary.decode(x) for x in column(batch, "ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[column(batch, c) for c in rest], pa.array(texts, pa.string())], [*rest, "text"])

    return encoded.select(*[F.col(f"`{c}`") for c in rest]).mapInArrow(run, T.StructType([*fields, T.StructField("text", T.StringType())]))


def op4_sentencepiece_nbest(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids, n_best, round_trip of every document."""
    out = encode(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "n_best", "round_trip")
