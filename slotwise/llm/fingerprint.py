"""Document fingerprints: Order MinHash (DataFrame functions only).

A text is cut into tokens; every run of ``KMER`` tokens is a k-mer, numbered by
its occurrence among equal k-mers of the text.  A hash of (k-mer, occurrence)
deals the numbered k-mers into ``BUCKETS`` buckets (one permutation serves all
components); each bucket keeps its ``LENGTH`` minimal ones, puts them back in
text order, and the hash of that tuple is one component.  Two texts agree in a
component if the same minimal k-mers occur in the same order, so likeness falls
with edit distance and not only with the sets of k-mers.

Everything happens inside one row with array functions: sorted 64-bit words hold
44 bits of hash and 20 bits of position (texts of over 2^20 k-mers keep the
upper 20 bits of the position).  There is no shuffle per k-mer.

Tokens are runs of up to 16 non-space characters; characters of scripts
without word spaces are tokens of their own.

Likeness of two fingerprints: share of agreeing components among those that are
not empty in both, to the power 1 / LENGTH; 1 if all are empty in both.

Defined cases: a null text is empty; a text of fewer than ``KMER`` tokens is one
k-mer; a text without tokens has only empty components.  Ids may be any long, as far
apart as they like, repeated or null (:func:`edited_pairs`).
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.llm.common import materialise, read_table

KMER = 3
BUCKETS = 32
LENGTH = 2
_BITS = 5  # log2 of BUCKETS
_POSITION = (1 << 20) - 1
# Thai, Hiragana, Katakana and Han as code point ranges (cheaper than script lookups)
_SINGLE = "\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff"
TOKEN = rf"[^\s{_SINGLE}]{{1,16}}|[{_SINGLE}]"
#: Rows and text characters of one key range of :func:`with_next`, keys that one task may order,
#: slices that ranges are cut from, and characters of one task that orders ranges.
RANGE_ROWS = 500
RANGE_CHARS = 2_000_000
ONE_TASK_KEYS = 20_000
SLICES = 256
TASK_CHARS = 64_000_000


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with the components of column ``text`` as array<bigint> ``out`` (0: empty bucket).

    The steps are separate projections; each reads the one before more than
    once, so Catalyst does not fold them into one another.
    """
    keep = [F.col(f"`{c}`") for c in df.columns]
    tokens = df.select(*keep, F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(TOKEN), F.lit(0)).alias("__t"))
    none = "CAST(array() AS array<bigint>)"
    parts = ", ".join(f"__t[i + {j}]" for j in range(KMER))  # element access: slice() copies the array
    kmers = tokens.select(*keep, F.expr(f"""
        CASE WHEN size(__t) >= {KMER} THEN transform(sequence(0, size(__t) - {KMER}), i -> xxhash64({parts}))
             WHEN size(__t) > 0 THEN array(xxhash64(__t)) ELSE {none} END""").alias("__k"))
    ordered = kmers.select(*keep, F.expr(f"""
        sort_array(transform(__k, (h, i) -> (h & {~_POSITION}L) | shiftright(CAST(i AS bigint), greatest(0, CAST(ceil(log2(size(__k) + 1)) AS int) - 20))))""").alias("__s"))
    starts = ordered.select(*keep, "__s", F.expr(f"""
        CASE WHEN size(__s) > 0 THEN filter(sequence(0, size(__s) - 1), i -> i = 0 OR shiftright(__s[i], 20) <> shiftright(__s[greatest(i - 1, 0)], 20))
             ELSE CAST(array() AS array<int>) END""").alias("__r"))
    numbered = starts.select(*keep, F.expr(f"""
        sort_array(zip_with(__s, flatten(zip_with(__r, concat(slice(__r, 2, size(__s) + 1), array(size(__s))), (a, b) -> CASE WHEN a IS NOT NULL THEN sequence(0, b - a - 1) ELSE CAST(array() AS array<int>) END)),
            (s, o) -> (xxhash64(shiftright(s, 20), o) & {~_POSITION}L) | (s & {_POSITION}L)))""").alias("__q"))
    minimal = numbered.select(*keep, F.expr(f"""
        filter(__q, (x, i) -> i < {LENGTH} OR shiftright(__q[greatest(i - {LENGTH}, 0)], {64 - _BITS}) <> shiftright(x, {64 - _BITS}))""").alias("__m"))
    half = BUCKETS // 2
    return minimal.select(*keep, F.expr(f"""
        transform(sequence(-{half}, {half - 1}), b -> coalesce(xxhash64(nullif(array_join(transform(
            array_sort(transform(filter(__m, x -> shiftright(x, {64 - _BITS}) = b), x -> struct(x & {_POSITION}L AS p, shiftright(x, 20) AS h))), y -> CAST(y.h AS string)), ' '), '')) *
            CAST(exists(__m, x -> shiftright(x, {64 - _BITS}) = b) AS bigint), 0L))""").alias(out))


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two component arrays, 0 to 1."""
    both = F.zip_with(a, b, lambda x, y: F.when((x == 0) & (y == 0), -1).when(x == y, 1).otherwise(0))
    used = F.size(F.filter(both, lambda x: x >= 0))
    same = F.size(F.filter(both, lambda x: x == 1))
    return F.when(used == 0, 1.0).otherwise(F.pow(same / used, F.lit(1.0 / LENGTH)))


def as_text(components: Column) -> Column:
    """Fingerprint as text: hexadecimal components joined by dots."""
    return F.array_join(F.transform(components, lambda x: F.lower(F.hex(x))), ".")


def key_ranges(keys: DataFrame) -> tuple[Column, int] | None:
    """(range number of ``key``, characters in all) for a table (key, chars); None if it is empty.

    Ranges follow key order.  The keys are cut at their approximate quantiles into at most
    ``SLICES`` slices, and every slice into pieces of equal width, as many as its rows and
    characters ask for, so outlying keys leave the rest spread.  Only the slices' bounds and
    sums reach the driver.
    """
    x = F.col("key").cast("double")
    n = keys.count()
    if not n:
        return None
    slices = max(1, min(SLICES, n // RANGE_ROWS))
    cuts: list[float] = []
    if slices > 1:
        found = keys.agg(F.percentile_approx(x, [i / slices for i in range(1, slices)], 10_000)).first()[0]
        cuts = sorted(set(found))
    bounds = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<double>")
    in_slice = _with(x, lambda v: F.size(F.filter(bounds, lambda c: c <= v)))
    sums = keys.groupBy(in_slice.alias("s")).agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.min(x).alias("lo"), F.max(x).alias("hi")).collect()
    low, width = [0.0] * (len(cuts) + 1), [1.0] * (len(cuts) + 1)
    for r in sums:
        pieces = max(1, r["n"] // RANGE_ROWS, r["chars"] // RANGE_CHARS)
        low[r["s"]], width[r["s"]] = r["lo"], (r["hi"] - r["lo"]) / pieces or 1.0
    lows, widths = F.array(*[F.lit(v) for v in low]), F.array(*[F.lit(v) for v in width])

    def numbered(v: Column) -> Column:
        return _with(F.size(F.filter(bounds, lambda c: c <= v)), lambda i: F.shiftleft(i.cast("long"), 40) + F.floor((v - F.get(lows, i)) / F.get(widths, i)))

    return _with(x, numbered), sum(r["chars"] for r in sums)


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once a row, not once for each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def next_keys(keys: DataFrame) -> DataFrame:
    """(key, next): the following key of a table of distinct keys; the last is followed by null.

    Keys are dealt into value ranges and ordered inside each; the first keys of
    the ranges are ordered the same way, until few enough for one task.
    """
    if keys.count() <= ONE_TASK_KEYS:
        return keys.select("key", F.lead("key").over(Window.partitionBy(F.lit(0)).orderBy("key")).alias("next"))
    number, _ = key_ranges(keys.select("key", F.lit(0).alias("chars")))
    ranged = keys.withColumn("range", number)
    firsts = materialise(ranged.groupBy("range").agg(F.min("key").alias("key")))
    follow = next_keys(firsts.select("key")).join(firsts, "key").select("range", F.col("next").alias("after"))
    own = F.lead("key").over(Window.partitionBy("range").orderBy("key"))
    return ranged.withColumn("next", own).join(follow, "range").select("key", F.coalesce("next", "after").alias("next"))


def with_next(base: DataFrame) -> DataFrame:
    """``base`` (key, text) with fp, and next_text and next_fp of the following key; the first follows the last.

    One shuffle of the texts by key range, in as many tasks as their characters ask for; the
    last row of a range takes its successor from the table of the ranges' first rows.
    """
    docs = with_fingerprint(base, "text", "fp")
    keys = materialise(base.select("key", F.length("text").cast("long").alias("chars")))
    found = key_ranges(keys)
    if found is None:
        return docs.select("*", F.col("text").alias("next_text"), F.col("fp").alias("next_fp"))
    in_range, chars = found
    firsts = materialise(keys.groupBy(in_range.alias("range")).agg(F.min("key").alias("key")))
    order = materialise(next_keys(firsts.select("key")))
    least = order.select(F.min("key")).scalar()
    after = order.join(firsts, "key").select("range", F.coalesce("next", least).alias("after"))
    # the few first rows are cut out before they are fingerprinted
    first_rows = materialise(base.join(firsts.select("key"), "key", "left_semi").groupBy("key").agg(F.min("text").alias("text")))
    head = with_fingerprint(first_rows, "text", "fp")
    ends = materialise(after.join(head, F.col("after") == F.col("key")).select("range", F.col("text").alias("end_text"), F.col("fp").alias("end_fp")))
    by = Window.partitionBy("range").orderBy("key", "text")
    tasks = max(int(base.sparkSession.conf.get("spark.sql.shuffle.partitions")), chars // TASK_CHARS)
    dealt = docs.withColumn("range", in_range).repartition(tasks, "range")
    led = dealt.withColumn("follow", F.lead(F.struct("text", "fp")).over(by))
    return led.join(ends, "range").select(
        *docs.columns, F.coalesce("follow.text", "end_text").alias("next_text"), F.coalesce("follow.fp", "end_fp").alias("next_fp")
    )


def order_key(doc_id: Column, text: Column) -> Column:
    """Place of a row as decimal: its id (null before all others), then the first seven bytes of its text.

    The order is that of (id, text), so the rows of one id, however many, may lie in several ranges.
    """
    at = F.coalesce(doc_id.cast("decimal(20,0)"), F.lit(Decimal(-(2**63) - 1)))
    start = F.rpad(F.substring(text.cast("binary"), 1, 7), 7, F.lit(b"\0"))
    return (at * F.lit(Decimal(2**56)) + F.conv(F.hex(start), 16, 10).cast("decimal(17,0)")).cast("decimal(38,0)")


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likenesses.

    Edited: the last floor(n / 4) code points replaced by the first as many (or
    all) of the next document's.  Rows of one doc_id follow each other in text
    order; a null doc_id comes before all others.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select("doc_id", order_key(F.col("doc_id").cast("long"), text).alias("key"), text.alias("text"))
    paired = with_next(base)
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.left("text", n - quarter), F.left("next_text", quarter))
    rows = paired.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fp", "next_fp")
    made = with_fingerprint(rows, "edited", "edited_fp")
    return made.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


def op9_fingerprint(spark, sf_dir: str) -> DataFrame:
    """Contract query over all documents."""
    return edited_pairs(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
