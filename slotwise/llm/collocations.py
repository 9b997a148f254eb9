"""Phrase collocations by best-first growth under admissible score bounds.

A phrase of 2 to 5 words that occurs a times (100 at least) is scored at its weakest
cut: the least floor(1000*a*n/(l*r)) over its cuts into a first part of l and a rest
of r occurrences, n being the words of its language.  The rest occurs at least as
often as the phrase, so no phrase that grows from a prefix scores above 1000*n/f of
any first part of that prefix, the first word's bound being the lowest; in the same
way 1000*n/f of the last word bounds it from the other end.

Growth is best-first, in rounds over the corpus.  The frontier holds the words by
falling bound, that is by rising count.  A round opens the words up to a count limit
per language and grows, from every occurrence of an open word, the phrases that end
in an open word and were not grown before.  What is not open yet scores at most
1000*n/(limit+1).  A language is settled when its 2000th surviving phrase scores
*more* than that (so ties are settled too) or all its words are open; only the other
languages go on, with four times the limit.

A phrase is dropped if it lies inside a longer candidate that is as frequent.  Then
a phrase one word longer is as frequent too, that is, all occurrences are preceded,
or all are followed, by the same word inside their pieces.  So every grown phrase
carries the smallest and largest hash of both neighbours and no second search is
needed; the hash is chosen so that no two words of the corpus share a value.

Words that occur 100 times, open words and wanted parts reach the tasks as Bloom
filters of a bounded size; they only save work, since what passes wrongly is counted
in full like the rest and judged by its own count.  The filters of open words have one size
in all rounds, so each passes all that the one before passed.  Phrases are counted as text.

Cases.  Null texts are empty, a null lang is ``und``.  Rows with equal ids are
documents of their own; ids are not read.  Of equal score the more frequent phrase
and then the smaller in UTF-8 byte order comes first, so there are no ties.  An empty
table, or a language without a candidate, gives no rows.  Other columns are ignored.
Texts are cut into segments at the ends of pieces; memory is bounded by the longest
piece.  Counts are 64-bit, products 128-bit decimals.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slotwise.llm.common import column, discard, large_text, materialise, mix64, read_table

LEAST = 100
LONGEST = 5
TOP = 2000
#: The first limit is this many times the least count; later ones are GROWTH times the one before.
OPENING = 4
GROWTH = 4
#: Bloom filters hold up to this many bits (a power of two), about 16 a member below that.
FILTER_BITS = 1 << 27
#: Texts are gathered to segments of about this many bytes inside a task.
SEGMENT = 1 << 21
#: Salts of the first step of the ranking by language.
SALTS = 64
NO_LANG = "und"
#: Up to so many languages are named in a filter or broadcast with their totals; beyond it both are left to joins.
MANY = 10_000

_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?"]] = True
_BREAK[0x0A:0x0E] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


@functools.lru_cache(maxsize=1)
def _powers(bits: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """2**bits powers of an odd multiplier and of its inverse modulo 2**64."""
    count = (1 << bits) - 1
    base = (_ODD[seed % len(_ODD)] + 2 * (seed // len(_ODD))) & (1 << 64) - 1
    up = np.multiply.accumulate(np.full(count + 1, base, np.uint64))
    down = np.multiply.accumulate(np.full(count + 1, pow(base, -1, 1 << 64), np.uint64))
    return up, down


@dataclass
class Segment:
    """Words of some texts: one byte string of words with one space behind each."""

    clean: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    piece: np.ndarray
    lang: np.ndarray
    sums: np.ndarray
    down: np.ndarray

    def hashes(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """64-bit hash of the bytes from word ``first`` to the end of word ``last``."""
        start, end = self.starts[first], self.ends[last]
        return mix64((self.sums[end] - self.sums[start]) * self.down[start] ^ (end - start).astype(np.uint64))

    def texts(self, first: np.ndarray, last: np.ndarray) -> pa.Array:
        """The phrases from word ``first`` to word ``last``."""
        start = self.starts[first]
        lens = self.ends[last] - start
        offsets = np.concatenate([[0], np.cumsum(lens)])
        data = self.clean[np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], lens)]
        return pa.LargeStringArray.from_buffers(len(lens), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data))


def _segment(parts: list[bytes], langs: list[int], seed: int) -> Segment:
    lens = np.array([len(p) for p in parts], np.int64)
    data = _LOWER[np.frombuffer(b"".join(parts), np.uint8)]
    bounds = np.concatenate([[0], np.cumsum(lens)])
    inside = ~_GAP[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    edges = bounds[1:-1]
    edges = edges[edges < len(data)]
    opens[edges] = inside[edges]
    first = np.flatnonzero(opens)
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    edges = edges[edges > 0]
    closes[edges - 1] = inside[edges - 1]
    last = np.flatnonzero(closes) + 1
    text = np.searchsorted(bounds, first, side="right") - 1
    piece = np.cumsum(_BREAK[data], dtype=np.int64)[first] + text if len(first) else text
    # words side by side, each with a space behind it
    size = last - first
    ends = np.cumsum(size + 1) - 1 if len(size) else size
    starts = ends - size
    clean = np.full(int(ends[-1]) + 1 if len(ends) else 0, 0x20, np.uint8)
    to = np.ones(len(clean), bool)
    to[ends] = False
    clean[to] = data[inside]
    up, down = _powers(max(22, len(clean).bit_length()), seed)
    sums = np.zeros(len(clean) + 1, np.uint64)
    np.cumsum((clean.astype(np.uint64) + np.uint64(1)) * up[: len(clean)], out=sums[1:])
    return Segment(clean, starts, ends, piece, np.array(langs, np.int64)[text] if len(text) else text, sums, down)


def _segments(batch: pa.RecordBatch, seed: int) -> Iterator[tuple[Segment, list[str]]]:
    """The words of a batch of (lang, text) rows, and the names of the languages in it."""
    langs = column(batch, "lang").to_pylist()
    names = sorted(set(langs))
    number = {name: k for k, name in enumerate(names)}
    parts, owners, held = [], [], 0
    for lang, value in zip(langs, large_text(column(batch, "text"))):
        text = value.as_buffer().to_pybytes() if value.is_valid else b""
        start = 0
        while start < len(text):
            stop = len(text)
            if stop - start > SEGMENT:  # a long text is cut behind the end of a piece
                rest = np.frombuffer(text, np.uint8, offset=start + SEGMENT)
                breaks = np.flatnonzero(_BREAK[rest[: 1 << 16]])
                breaks = breaks if len(breaks) else np.flatnonzero(_BREAK[rest])
                stop = start + SEGMENT + int(breaks[0]) + 1 if len(breaks) else stop
            parts.append(text[start:stop])
            owners.append(number[lang])
            held += stop - start
            start = stop
            if held >= SEGMENT:
                yield _segment(parts, owners, seed), names
                parts, owners, held = [], [], 0
    if parts:
        yield _segment(parts, owners, seed), names


def _salted(hashes: np.ndarray, lang: np.ndarray, names: list[str]) -> np.ndarray:
    """Hashes made different by language, for the filters."""
    own = np.array([int.from_bytes(name.encode()[:32].ljust(8, b"\0"), "little") * _ODD[0] & (1 << 64) - 1 for name in names] or [0], np.uint64)
    return mix64(hashes ^ own[lang])


class Filter:
    """Bloom filter of two places a member, as bytes a task can test against."""

    def __init__(self, data: bytes, bits: int):
        self.table = np.frombuffer(data, np.uint8)
        self.shift = np.uint64(64 - bits.bit_length() + 1)

    def __call__(self, salted: np.ndarray) -> np.ndarray:
        out = None
        for turn in (0, 32):
            place = (salted << np.uint64(turn) | salted >> np.uint64((64 - turn) % 64) if turn else salted) >> self.shift
            hit = self.table[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1
            out = hit if out is None else out & hit
        return out.astype(bool)


def bloom(members: DataFrame, count: int) -> tuple[bytes, int]:
    """Filter of the ``salted`` hashes (64 bits) of a table, its bits or-ed together in Spark.

    The table of bits has a bounded size; it reaches the driver in blocks of 4 KB.
    """
    bits = 1 << 15
    while bits < min(16 * max(count, 1), FILTER_BITS):
        bits *= 2
    take = bits.bit_length() - 1
    places = [F.shiftrightunsigned("salted", 64 - take), F.shiftrightunsigned(F.shiftleft("salted", 32).bitwiseOR(F.shiftrightunsigned("salted", 32)), 64 - take)]
    spots = members.select(F.explode(F.array(*places)).alias("at"))
    blocks = spots.groupBy(F.shiftright("at", 15).alias("block")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit((1 << 15) - 1))).alias("bits"))
    table = bytearray(bits // 8)
    for r in blocks.collect():
        table[r["block"] << 12 : (r["block"] + 1) << 12] = r["bits"]
    return bytes(table), bits


def texts_by_lang(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, text) of all rows, a null lang as ``und``."""
    return docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(NO_LANG)).alias("lang"), F.col(f"`{text}`").cast("string").alias("text"))


def count_words(docs: DataFrame) -> tuple[DataFrame, int]:
    """(lang, word, f, hash, salted) of all words, and the seed of a hash without collisions."""
    seed = 0
    while True:

        def run(batches: Iterator[pa.RecordBatch], seed: int = seed) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for seg, names in _segments(batch, seed):
                    every = np.arange(len(seg.starts))
                    hashes = seg.hashes(every, every)
                    # one row per word and language of the segment; equal hashes are told apart by the words
                    order = np.lexsort((hashes, seg.lang))
                    if not len(order):
                        continue
                    h, g = hashes[order], seg.lang[order]
                    fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])])
                    words = seg.texts(order, order)
                    same = _equal_neighbours(words)
                    heads = np.flatnonzero(fresh | ~same)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(names).take(pa.array(g[heads])),
                            words.take(pa.array(heads)).cast(pa.string()),
                            pa.array(np.diff(np.append(heads, len(order)))),
                            pa.array(h[heads].view(np.int64)),
                            pa.array(_salted(h[heads], g[heads], names).view(np.int64)),
                        ],
                        names=["lang", "word", "f", "hash", "salted"],
                    )

        found = docs.mapInArrow(run, "lang string, word string, f long, hash long, salted long")
        words = materialise(found.groupBy("lang", "word", "hash", "salted").agg(F.sum("f").alias("f")))
        clash = words.select("word", "hash").distinct().groupBy("hash").count().filter("count > 1").limit(1).count()
        if not clash:
            return words, seed
        discard(words)
        seed += 1


def _equal_neighbours(words: pa.Array) -> np.ndarray:
    """For every string but the first, whether it equals the one before (False for the first)."""
    import pyarrow.compute as pc

    if len(words) < 2:
        return np.zeros(len(words), bool)
    return np.concatenate([[False], pc.equal(words.slice(1), words.slice(0, len(words) - 1)).to_numpy(zero_copy_only=False)])


def grow(docs: DataFrame, seed: int, frequent: tuple[bytes, int], opened: tuple[bytes, int], before: tuple[bytes, int] | None) -> DataFrame:
    """Candidates between open words that were not both open before: lang, phrase, a and the neighbours' agreement."""
    spark = docs.sparkSession
    shared = [None if x is None else (spark.sparkContext.broadcast(x[0]), x[1]) for x in (frequent, opened, before)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, now, then = (None if x is None else Filter(x[0].value, x[1]) for x in shared)
        for batch in batches:
            for seg, names in _segments(batch, seed):
                count = len(seg.starts)
                if count < 2:
                    continue
                every = np.arange(count)
                hashes = seg.hashes(every, every)
                salted = _salted(hashes, seg.lang, names)
                usable = often(salted)
                open_ = usable & now(salted)
                old = open_ & then(salted) if then else np.zeros(count, bool)
                rare = np.concatenate([[0], np.cumsum(~usable)])
                signed = hashes.view(np.int64)
                same = seg.piece[1:] == seg.piece[:-1]
                has_left, has_right = np.concatenate([[False], same]), np.concatenate([same, [False]])
                for size in range(2, min(LONGEST, count) + 1):
                    first = np.flatnonzero(open_[: count - size + 1])
                    last = first + size - 1
                    fits = open_[last] & (seg.piece[first] == seg.piece[last]) & (rare[last + 1] == rare[first]) & ~(old[first] & old[last])
                    first, last = first[fits], last[fits]
                    if not len(first):
                        continue
                    left = pa.array(signed[np.maximum(first - 1, 0)], mask=~has_left[first])
                    right = pa.array(signed[np.minimum(last + 1, count - 1)], mask=~has_right[last])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names).take(pa.array(seg.lang[first])), seg.texts(first, last).cast(pa.string()), pa.array(np.full(len(first), size, np.int32)), left, right],
                        names=["lang", "phrase", "size", "before", "after"],
                    )

    rows = docs.mapInArrow(run, "lang string, phrase string, size int, before long, after long")
    whole = lambda c: (F.count(c) == F.count(F.lit(1))) & (F.min(c) == F.max(c))
    found = rows.groupBy("lang", "phrase", "size").agg(F.count(F.lit(1)).alias("a"), whole("before").alias("__b"), whole("after").alias("__a"))
    held = (F.col("size") < LONGEST) & (F.coalesce("__b", F.lit(False)) | F.coalesce("__a", F.lit(False)))
    return found.filter(F.col("a") >= LEAST).select("lang", "phrase", "size", "a", held.alias("dropped"))


def _cuts(phrases: DataFrame) -> DataFrame:
    """Every cut of every phrase: lang, phrase, a, k, left, right."""
    words = phrases.select("lang", "phrase", "a", F.split("phrase", " ").alias("w"))
    cut = words.select("*", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    text = lambda x: F.array_join(x, " ")
    return cut.select("lang", "phrase", "a", "k", text(F.slice("w", F.lit(1), F.col("k"))).alias("left"), text(F.slice("w", F.col("k") + 1, F.size("w"))).alias("right"))


def count_parts(docs: DataFrame, seed: int, parts: DataFrame) -> DataFrame:
    """(lang, part, f) of the wanted parts of two words and more, over all documents."""
    spark = docs.sparkSession

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = column(batch, "part").to_pylist(), column(batch, "lang").to_pylist()
            names = sorted(set(langs))
            number = {x: k for k, x in enumerate(names)}
            for at in range(0, len(texts), 4096):
                raw = [t.encode() for t in texts[at : at + 4096]]
                seg = _segment(raw, [number[x] for x in langs[at : at + 4096]], seed)
                words = np.array([t.count(b" ") + 1 for t in raw])
                last = np.cumsum(words) - 1
                first = last - words + 1
                salted = _salted(seg.hashes(first, last), seg.lang[first], names)
                yield pa.RecordBatch.from_arrays([pa.array(langs[at : at + 4096]), pa.array(texts[at : at + 4096]), pa.array(salted.view(np.int64))], names=["lang", "part", "salted"])

    wanted = materialise(parts.mapInArrow(name, "lang string, part string, salted long"))
    data, bits = bloom(wanted, wanted.count())
    shared = spark.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = Filter(shared.value, bits)
        for batch in batches:
            for seg, names in _segments(batch, seed):
                count = len(seg.starts)
                for size in range(2, min(LONGEST - 1, count) + 1):
                    first = np.flatnonzero(seg.piece[: count - size + 1] == seg.piece[size - 1 :])
                    last = first + size - 1
                    hashes = seg.hashes(first, last)
                    hit = np.flatnonzero(asked(_salted(hashes, seg.lang[first], names)))
                    if not len(hit):
                        continue
                    first, last, hashes = first[hit], last[hit], hashes[hit]
                    order = np.lexsort((hashes, seg.lang[first]))
                    first, last, hashes = first[order], last[order], hashes[order]
                    lang, texts = seg.lang[first], seg.texts(first, last)
                    fresh = np.concatenate([[True], lang[1:] != lang[:-1]]) | ~_equal_neighbours(texts)
                    heads = np.flatnonzero(fresh)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names).take(pa.array(lang[heads])), texts.take(pa.array(heads)).cast(pa.string()), pa.array(np.diff(np.append(heads, len(lang))))],
                        names=["lang", "part", "f"],
                    )

    counted = docs.mapInArrow(run, "lang string, part string, f long").groupBy("lang", "part").agg(F.sum("f").alias("f"))
    return counted.join(wanted.select("lang", "part"), ["lang", "part"], "left_semi")


def score(phrases: DataFrame, counts: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) at the weakest cut, the shortest first part among equals."""
    big = lambda c: F.col(c).cast("decimal(19,0)")
    left = counts.select(F.col("lang").alias("__lang"), F.col("part").alias("left"), F.col("f").alias("l"))
    right = counts.select(F.col("lang").alias("__lang"), F.col("part").alias("right"), F.col("f").alias("r"))
    cuts = _cuts(phrases)
    cuts = cuts.join(left, (F.col("lang") == F.col("__lang")) & (cuts["left"] == left["left"])).drop("__lang", "left")
    cuts = cuts.join(right, (F.col("lang") == F.col("__lang")) & (cuts["right"] == right["right"])).drop("__lang", "right")
    cuts = cuts.join(F.broadcast(totals), "lang") if totals.count() <= MANY else cuts.join(totals, "lang")
    cuts = cuts.select("*", (big("a") * 1000 * big("n")).alias("__over"), (big("l") * big("r")).alias("__under"))
    value = F.expr("cast(__over div __under as long)")
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(value.alias("score"), "k", "l", "r")).alias("cut"), F.first("a").alias("a"), F.first("n").alias("n"))
    return best.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))


def first_by_lang(scored: DataFrame, top: int) -> DataFrame:
    """The first ``top`` phrases of each language with their rank.

    Ranks are first taken within salts of a language, so that one task sees at most
    SALTS times ``top`` rows of it in the second step.
    """
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = scored.select("*", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("__salt"))
    salted = salted.select("*", F.row_number().over(Window.partitionBy("lang", "__salt").orderBy(*order)).alias("__at")).filter(F.col("__at") <= top)
    ranked = salted.drop("__salt", "__at").select("*", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long").alias("rank"))
    return ranked.filter(F.col("rank") <= top)


def mine(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best ``top`` phrases of every language."""
    docs = texts_by_lang(docs)
    words, seed = count_words(docs)
    totals = materialise(words.groupBy("lang").agg(F.sum("f").alias("n"), F.max("f").alias("most")))
    frequent = materialise(words.filter(F.col("f") >= LEAST))
    size = frequent.count()
    filter_words = bloom(frequent, size)
    limit, before, done = LEAST * OPENING, None, None
    settled = totals.filter("false").select("lang")
    while True:
        if done is not None and not totals.join(settled, "lang", "left_anti").limit(1).count():
            return done
        through = [r["lang"] for r in settled.limit(MANY + 1).collect()]
        active = docs.filter(~F.col("lang").isin(through)) if 0 < len(through) <= MANY else docs
        opened = frequent.filter(F.col("f") <= limit)
        # one size for all rounds: what passed once passes ever after; a word that passed wrongly and
        # was shut again would have its phrases grown, and ranked, a second time
        now = bloom(opened, size)
        grown = materialise(grow(active, seed, filter_words, now, before))
        fresh = grown.filter(~F.col("dropped"))
        wanted = _cuts(fresh).select("lang", F.explode(F.array("left", "right")).alias("part")).distinct().filter(F.instr("part", " ") > 0)
        counts = materialise(count_parts(active, seed, wanted)).unionByName(frequent.select("lang", F.col("word").alias("part"), "f"))
        scored = score(fresh, counts, totals.select("lang", "n"))
        scored = scored if done is None else scored.unionByName(done.drop("rank"))
        done = materialise(first_by_lang(scored, top))
        # the bound of all that is not grown yet; strictly above it nothing can come in between, not even a tie
        reached = done.filter(F.col("rank") == top).select("lang", F.col("score").alias("__worst"))
        left = totals.join(reached, "lang", "left").select("lang", "most", "__worst", F.expr(f"cast(cast(n as decimal(19,0)) * 1000 div {limit + 1} as long)").alias("__bound"))
        settled = materialise(left.filter((F.col("most") <= limit) | (F.col("__worst") > F.col("__bound"))).select("lang"))
        before, limit = now, limit * GROWTH


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the 2000 best phrases of every language."""
    found = mine(read_table(spark, sf_dir, "documents"))
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


OP11_SQL = """WITH RECURSIVE docs AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(p, '[ \\t]+'), lambda w: w <> '') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS p FROM docs) WHERE regexp_matches(p, '[^ \\t]')),
f AS MATERIALIZED (SELECT lang, k, g AS phrase, count(*) AS f FROM (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g
  FROM pieces, range(1, 6) s(k) WHERE len(w) >= k) GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang),
c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE k >= 2),
inner_ AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS b
  FROM c, range(2, 5) s(m), range(1, 5) t(i) WHERE m < k AND i + m - 1 <= k GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN inner_ USING (lang, phrase) WHERE b IS NULL OR 100 * b < 100 * a),
cuts AS (SELECT lang, phrase, a, j, array_to_string(w[1:j], ' ') AS lp, array_to_string(w[j + 1:k], ' ') AS rp FROM kept, range(1, 5) s(j) WHERE j < k),
scored AS (SELECT cuts.lang, cuts.phrase, a, j, x.f AS l, y.f AS r, n, CAST((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = lp JOIN f y ON y.lang = cuts.lang AND y.phrase = rp JOIN n ON n.lang = cuts.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
FROM best QUALIFY rank <= 2000"""
