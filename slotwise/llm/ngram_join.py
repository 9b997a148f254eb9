"""N-gram Jaccard join: MinHash LSH forest with exact verification.

1. Texts become sets of five-word shingles (words: runs of letters and digits,
   lower-cased).  Texts with equal sets form one class, represented by its
   smallest doc_id; only representatives go on.
2. Each representative gets ``trees`` labels of ``depth`` MinHash values.  A tree
   is the sorted prefix trie of its labels; representatives that share a prefix
   meet in a node.  The prefix is shortened from ``depth`` until the chance that
   a pair at the threshold meets in some tree, 1 - (1 - s^k)^trees, reaches the
   target recall.
3. Members of a node are joined to its smallest member (linear in the node), and
   the connected components of these candidate edges bound the verification: all
   pairs of one component are checked exactly, block by block, from the texts.
   A component of any size is dealt out as pairs of blocks of at most ``block``
   texts; blocks return link counts and spanning edges, never all pairs.
4. The classes of the result are the connected components of verified links.

A link is a pair of documents with Jaccard similarity of at least ``threshold``.
Equal sets are aggregated before the shuffle, nodes and classes are joined, not
collected, so a group of copies may hold any share of the rows.

Defined cases: a null text or one without words has no link and is a class of its
own; a text of fewer than five words is one shingle; repeated rows are copies of
each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import GOLDEN, MIX_A, as_signed, column, large_text, materialise, mix64, read_table, span_hashes, text_buffers, text_chunks, word_spans
from slotwise.llm.components import connected_components

WORDS = 5
THRESHOLD = 0.8
TREES = 32
DEPTH = 8
TARGET_RECALL = 0.9999
#: Representatives of one side of a verification block.
BLOCK = 256
_LABEL_BYTES = 2
_COLUMNS = 4096


def prefix_depth(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, target: float = TARGET_RECALL) -> int:
    """Longest prefix whose recall at the threshold reaches the target (1 at least)."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < target:
        depth -= 1
    return depth


_NOT_SPACE = np.arange(256) != 0x20


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of every null-free large_string text."""
    clean = pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\pL\pN]+", " ")
    data, offsets = text_buffers(clean)
    starts, ends, owner = word_spans(data, offsets, _NOT_SPACE)
    hashes = span_hashes(data, starts, ends)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    rolled = np.zeros(len(hashes), np.uint64)
    factor = np.uint64(1)
    for j in range(words):
        factor = factor * GOLDEN + MIX_A
        rolled[: len(hashes) - j or None] += hashes[j:] * factor if j < len(hashes) else np.uint64(0)
    rolled = mix64(rolled)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            own, factor = np.uint64(b - a), np.uint64(1)
            for h in hashes[a:b]:
                factor = factor * GOLDEN + MIX_A
                own = own + h * factor
            out.append(mix64(np.array([own])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix64(np.arange(1, 2 * n + 1, dtype=np.uint64) * GOLDEN)
    return (seeds[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[n:] >> np.uint64(32)).astype(np.uint32)


def min_hashes(shingles: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    """One MinHash value per permutation x -> mul * x + add of 32-bit shingles."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(mul), 0xFFFFFFFF, np.uint32)
    for start in range(0, len(x), 1024):
        part = np.multiply.outer(mul, x[start : start + 1024])
        part += add[:, None]
        np.minimum(out, part.min(axis=1), out=out)
    return out


def signatures(docs: DataFrame, words: int = WORDS, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """(doc_id, c1, c2, n_shingles, labels) of every document; c1, c2 identify the shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mul, add = _multipliers(trees * depth)
        with np.errstate(over="ignore"):
            for batch in batches:
                texts = large_text(column(batch, "text"))
                for start, stop in text_chunks(texts):
                    sets = shingle_sets(texts.slice(start, stop - start), words)
                    c1 = np.array([mix64(s).sum(dtype=np.uint64) for s in sets], np.uint64)
                    c2 = np.array([mix64(s ^ GOLDEN).sum(dtype=np.uint64) for s in sets], np.uint64)
                    labels = [mix64(min_hashes(s, mul, add).astype(np.uint64)).astype(">u2").tobytes() if len(s) else None for s in sets]
                    yield pa.RecordBatch.from_arrays(
                        [column(batch, "doc_id").slice(start, stop - start), pa.array(as_signed(c1)), pa.array(as_signed(c2)), pa.array([len(s) for s in sets], pa.int64()), pa.array(labels, pa.binary())],
                        ["doc_id", "c1", "c2", "n_shingles", "labels"],
                    )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, c1 long, c2 long, n_shingles long, labels binary")


def candidate_edges(reps: DataFrame, prefix: int, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """(u, v): every representative with the smallest member of each trie node it shares."""
    width = depth * _LABEL_BYTES
    forest = reps.select("rep", "labels", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")).select(
        "rep", F.xxhash64("tree", F.expr(f"substring(labels, tree * {width} + 1, {prefix * _LABEL_BYTES})")).alias("node")
    )
    nodes = forest.groupBy("node").agg(F.min("rep").alias("u"), F.count("*").alias("members")).filter(F.col("members") > 1)
    return forest.join(nodes, "node").filter(F.col("rep") != F.col("u")).select("u", F.col("rep").alias("v")).distinct()


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections (matrix products over shared shingles)."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(counts > 1) - 1
    keep = counts[place] > 1
    owner, place = owner[keep], shared[place[keep]]
    out = np.zeros((len(sets), len(sets)), np.float64)
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    for start in range(0, int(place[-1]) + 1 if len(place) else 0, _COLUMNS):
        a, b = np.searchsorted(place, [start, start + _COLUMNS])
        dense = np.zeros((len(sets), min(_COLUMNS, int(place[-1]) + 1 - start)), np.float32)
        dense[owner[a:b], place[a:b] - start] = 1.0
        out += dense @ dense.T
    return out


def _verify(pdf, words: int, threshold: float):
    """Links of one pair of blocks: counts per representative and a spanning forest."""
    import pandas as pd

    pdf = pdf.sort_values("rep")
    reps, sizes, side = pdf.rep.to_numpy(), pdf["size"].to_numpy(), pdf.side.to_numpy()
    texts, sets = pa.array(pdf.text, pa.large_string()), []
    with np.errstate(over="ignore"):
        for start, stop in text_chunks(texts):
            sets += shingle_sets(texts.slice(start, stop - start), words)
    n = np.array([len(s) for s in sets], float)
    shared = _intersections(sets)
    linked = shared >= threshold * (n[:, None] + n[None, :] - shared) - 1e-9
    np.fill_diagonal(linked, False)
    if pdf.i.iloc[0] != pdf.j.iloc[0]:
        linked &= side[:, None] != side[None, :]
    counts = linked @ sizes
    parent = list(range(len(reps)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    tree = []
    for a in range(len(reps)):
        for b in np.flatnonzero(linked[a, :a]).tolist():
            ra, rb = find(a), find(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
                tree.append((int(reps[min(ra, rb)]), int(reps[max(ra, rb)])))
    rows = [(int(r), None, int(c)) for r, c in zip(reps, counts) if c] + [(u, v, None) for u, v in tree]
    return pd.DataFrame({"u": pd.array([r[0] for r in rows], "Int64"), "v": pd.array([r[1] for r in rows], "Int64"), "links": pd.array([r[2] for r in rows], "Int64")})


def verified_links(docs: DataFrame, reps: DataFrame, components: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(u, v, links): link counts per representative (v null) and spanning edges (links null)."""
    sizes = components.groupBy("label").agg(F.count("*").alias("members")).withColumn("blocks", F.ceil(F.col("members") / block).cast("int"))
    placed = components.join(sizes, "label").select(
        F.col("node").alias("rep"), "label", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("side")
    ).join(reps.select("rep", "size"), "rep")
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))
    dealt = texts.join(placed, "rep").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "label", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "rep", "size", "text"
    )

    def run(pdf):
        return _verify(pdf, words, threshold)

    return dealt.groupBy("label", "i", "j").applyInPandas(run, "u long, v long, links long")


def jaccard_join(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, target: float = TARGET_RECALL, block: int = BLOCK) -> DataFrame:
    """(doc_id, class_id, n_links) of every document.

    class_id: smallest doc_id of the documents connected by links; n_links: number
    of other documents with similarity of at least ``threshold``.
    """
    sigs = materialise(signatures(docs, words, trees, depth))
    worded = sigs.filter(F.col("n_shingles") > 0)
    reps = materialise(worded.groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"), F.min_by("labels", "doc_id").alias("labels")))
    edges = materialise(candidate_edges(reps, prefix_depth(threshold, trees, depth, target), trees, depth))
    found = materialise(verified_links(docs, reps, connected_components(edges), words, threshold, block))
    counts = found.filter(F.col("links").isNotNull()).groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("links"))
    classes = connected_components(found.filter(F.col("v").isNotNull()).select("u", "v"))
    per_class = reps.select("c1", "c2", "rep", "size").join(counts, "rep", "left").join(classes.withColumnRenamed("node", "rep"), "rep", "left").select(
        "c1", "c2", F.coalesce("label", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links")
    )
    members = worded.select("doc_id", "c1", "c2").join(per_class, ["c1", "c2"]).select("doc_id", "class_id", "n_links")
    lone = sigs.filter(F.col("n_shingles") == 0).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return members.unionByName(lone)


def op3_ngram_join(spark, sf_dir: str) -> DataFrame:
    """doc_id, class_id, n_links of every document."""
    return jaccard_join(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


OP3_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\pL\pN]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN []::UBIGINT[]
    ELSE list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: hash(w[i:i + 4])) END)) AS s
  FROM words
), classes AS (
  SELECT s, min(doc_id) AS rep, count(*) AS size FROM sets WHERE len(s) > 0 GROUP BY s
), items AS (
  SELECT rep, len(s) AS n, unnest(s) AS h FROM classes
), shared AS (
  SELECT a.rep AS u, b.rep AS v, any_value(a.n) AS nu, any_value(b.n) AS nv, count(*) AS both_
  FROM items a JOIN items b ON a.h = b.h AND a.rep <> b.rep GROUP BY 1, 2
), links AS (
  SELECT u, v FROM shared WHERE both_ >= 0.8 * (nu + nv - both_) - 1e-9
), reach(node, label) AS (
  SELECT rep, rep FROM classes
  UNION
  SELECT l.v, r.label FROM reach r JOIN links l ON l.u = r.node
), labels AS (
  SELECT node, min(label) AS label FROM reach GROUP BY node
), counts AS (
  SELECT l.u AS rep, sum(c.size) AS links FROM links l JOIN classes c ON c.rep = l.v GROUP BY 1
)
SELECT s.doc_id, coalesce(b.label, s.doc_id) AS class_id, CAST(coalesce(n.links, 0) + coalesce(c.size, 1) - 1 AS BIGINT) AS n_links
FROM sets s LEFT JOIN classes c ON c.s = s.s LEFT JOIN labels b ON b.node = c.rep LEFT JOIN counts n ON n.rep = c.rep
"""
