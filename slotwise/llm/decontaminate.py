"""Benchmark decontamination by template canonicalisation (DataFrame functions only).

1. A text becomes tokens (words, numbers, sentence ends).  Numbers, units after a
   number and capitalised names inside a sentence become typed placeholders;
   other words are lower-cased.  The raw tokens stay aligned with them.
2. Benchmark items with equal templates and equal slot patterns (which slots
   repeat a value) are one template.  Its windows of ``window`` tokens are hashed, and
   those of every item with its own names left as words (a text may be in capitals).
3. The windows of all documents are hash-joined with them, in both forms too: a
   capital after a colon or a quote, or in a title, is no name.
4. Matches are gathered per (document, item): coverage is the share of the item's
   windows found.  The items of a template are joined back only where the
   template can reach the coverage.
5. Slot consistency: along a diagonal (fixed offset of positions) every value of
   the item's slots must map to one value of the document.  A match with
   equal slots is verbatim, one with a consistent other mapping re-parameterised.
6. Items without a window of evidence (short ones, or mostly placeholders) are looked for
   whole: their raw words in a row, by the hash of the first ``window`` of them and an exact
   comparison of all. Documents are read for these only if the benchmark holds such items.

The benchmark side of the join is broadcast only if it has at most
``BROADCAST_WINDOWS`` rows (counted first); beyond that both sides shuffle by
window hash.  A window shared by very many documents or texts yields only
(document, template, position) rows, which are aggregated before the shuffle.

Defined cases: null and empty texts match nothing; an item shorter than
``window`` tokens is one window of its own length, below ``LEAST_TOKENS`` tokens
or with more than half of its tokens in placeholders a window is no evidence, and an item
without evidence is matched whole, case aside, from ``LEAST_WHOLE`` words on (fewer words
occur in clean text); repeated
rows of a doc_id count as one document; with no benchmark the result is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import materialise, read_table

WINDOW = 8
LEAST_TOKENS = 5
LEAST_WHOLE = 3
#: Share of a template's windows that a document must hold.
COVERAGE = 0.5
#: Share of the template's slot values that map to one value.
CONSISTENCY = 0.8
BROADCAST_WINDOWS = 500_000

# fixed values: words that stand for a number, and units
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
).split()
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces pound pounds ton tons "
    "ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years "
    "meter meters metre metres kilometer kilometers kilometre kilometres dollar dollars cent cents euro euros percent degree degrees"
).split()
TOKEN = r"[\p{L}\p{M}]+|\d+(?:[.,]\d+)*|[.!?\n]+"
_NAME = r"^\p{Lu}\p{Ll}+$"
NUM, UNIT, NAME = "<num>", "<unit>", "<name>"


def tokens_of(text: Column) -> Column:
    """Words, numbers and sentence ends of a text, in order."""
    return F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(TOKEN), F.lit(0))


def _is_number(token: Column, low: Column) -> Column:
    return F.ascii(token).between(ord("0"), ord("9")) | low.isin(NUMBER_WORDS)


def _is_end(token: Column) -> Column:
    return F.ascii(token).isin([ord(c) for c in ".!?\n"])


def slots(tokens: Column) -> Column:
    """Array of (raw, plain, named): plain has numbers and units replaced, ``named`` marks names."""

    def one(x: Column, before: Column) -> Column:
        low = F.lower(x)
        typed = F.when(_is_number(x, low), NUM).when(low.isin(UNITS) & _is_number(before, F.lower(before)), UNIT).otherwise(low)
        named = (x != low) & ~_is_end(before) & x.rlike(_NAME) & (typed == low)
        return F.struct(low.alias("raw"), typed.alias("plain"), named.alias("named"))

    before = F.slice(F.concat(F.array(F.lit("\n")), tokens), F.lit(1), F.size(tokens))
    return F.filter(F.zip_with(tokens, before, one), lambda s: ~_is_end(s["raw"]))


def tokenised(table: DataFrame, key: str) -> DataFrame:
    """(key, raw, canon, plain): aligned token arrays of every row; canon has all placeholders."""
    words = table.select(F.col(key), tokens_of(F.col("text")).alias("tokens"))
    parts = words.select(key, slots(F.col("tokens")).alias("parts"))
    # transform, not parts.raw: Catalyst folds a field access into later lambdas and would extract the array per element
    return parts.select(
        key, F.expr("transform(parts, s -> s.raw)").alias("raw"), F.expr("transform(parts, s -> s.plain)").alias("plain"),
        F.expr(f"transform(parts, s -> IF(s.named, '{NAME}', s.plain))").alias("canon"),
    )


def _window_hash(tokens: Column, at: Column, length: int) -> Column:
    """Hash of the ``length`` tokens from position ``at`` (0-based); element access, as slice() copies the array."""
    return F.xxhash64(*[F.get(tokens, at + j) for j in range(length)])


def _windows(tokens: Column, length: int) -> Column:
    """Hash of every window of ``length`` tokens."""
    n = F.size(tokens)
    hashes = F.transform(F.sequence(F.lit(0), n - length), lambda i: _window_hash(tokens, i, length))
    return F.when(n >= length, hashes).otherwise(F.array().cast("array<bigint>"))


def _differing(hashes: Column, others: Column) -> Column:
    """``hashes``, null where equal to ``others``."""
    return F.zip_with(hashes, others, lambda a, b: F.when(a != b, a))


def templates(benchmark: DataFrame) -> DataFrame:
    """(item_id, template, variant, raw, canon, plain, length): every item with the smallest item_id of its
    template and slot pattern, and of its plain form among these."""
    items = materialise(tokenised(benchmark.filter(F.col("item_id").isNotNull()), "item_id")).filter(F.size("canon") >= LEAST_TOKENS).distinct()
    pattern = F.transform("raw", lambda x, i: F.when(F.get("canon", i) != x, F.array_position("raw", x)).otherwise(F.lit(0)))
    variants = items.withColumn("pattern", pattern).groupBy("canon", "pattern", "plain").agg(F.min("item_id").alias("variant"), F.collect_list(F.struct("item_id", "raw")).alias("members"))
    variants = materialise(variants)
    made = variants.groupBy("canon", "pattern").agg(F.min("variant").alias("template"))
    each = variants.join(made, ["canon", "pattern"]).select("template", "variant", "canon", "plain", F.explode("members").alias("member"))
    return each.select("member.item_id", "template", "variant", "member.raw", "canon", "plain", F.least(F.lit(WINDOW), F.size("canon")).alias("length"))


def template_windows(made: DataFrame) -> DataFrame:
    """(hash, length, template, variant, pos): windows with enough literal words, of templates (variant null) and,
    where names make a difference, of their variants."""

    out = None
    for length in range(LEAST_TOKENS, WINDOW + 1):
        own = made.filter(F.col("length") == length)
        for form, variant in (("canon", F.lit(None).cast(made.schema["variant"].dataType)), ("plain", F.col("variant"))):
            literal = F.transform(form, lambda x: (~x.isin(NUM, UNIT, NAME)).cast("int"))
            hashes = _windows(F.col(form), length)
            if form == "plain":
                hashes = _differing(hashes, _windows(F.col("canon"), length))
            each = own.select("template", variant.alias("variant"), form, "canon").distinct()
            each = each.select("template", "variant", hashes.alias("hashes"), literal.alias("literal"))
            each = each.select("template", "variant", "literal", F.posexplode_outer("hashes").alias("at", "hash"))
            words = sum((F.get("literal", F.col("at") + j) for j in range(1, length)), F.get("literal", F.col("at")))
            part = each.filter(F.col("hash").isNotNull()).select("hash", F.lit(length).alias("length"), "template", "variant", (F.col("at") + 1).alias("pos"), words.alias("words"))
            out = part if out is None else out.unionByName(part)
    return out.filter(F.col("words") * 2 >= F.col("length")).drop("words").distinct()


def matched_windows(docs: DataFrame, windows: DataFrame, lengths: list[int], broadcast: bool) -> DataFrame:
    """(doc_id, template, variant, pos, offset, raw, canon, as_plain): document windows, canonical or ``as_plain``, that are template windows."""
    # outer explodes: Catalyst would push a plain explode's size filter below the token
    # projections and evaluate the tokens once per window
    tokens = tokenised(docs.filter(F.col("doc_id").isNotNull()), "doc_id")
    side = F.broadcast(windows) if broadcast else windows.hint("merge")
    out = None
    for length in lengths:
        canon, plain = _windows(F.col("canon"), length), _windows(F.col("plain"), length)
        hashed = tokens.select("doc_id", "raw", "canon", canon.alias("hashes"), plain.alias("plain"))
        hashed = hashed.select("doc_id", "raw", "canon", F.concat("hashes", _differing(F.col("plain"), F.col("hashes"))).alias("hashes"))
        each = hashed.select("doc_id", "raw", "canon", F.posexplode_outer("hashes").alias("at", "hash"))
        n = F.size("canon") - (length - 1)  # windows of one form
        each = each.select("doc_id", "raw", "canon", F.when(F.col("at") < n, F.col("at")).otherwise(F.col("at") - n).alias("at"), "hash", (F.col("at") >= n).alias("as_plain"))
        if broadcast:
            cut = [F.slice(c, F.col("at") + 1, F.lit(length)).alias(c) for c in ("raw", "canon")]
        else:  # both sides shuffle: cut the window before
            each = each.filter(F.col("hash").isNotNull()).select("doc_id", "at", "hash", "as_plain", *[F.slice(c, F.col("at") + 1, F.lit(length)).alias(c) for c in ("raw", "canon")])
            cut = [F.col("raw"), F.col("canon")]
        met = each.join(side.filter(F.col("length") == length).drop("length"), "hash")
        met = met.select("doc_id", "template", "variant", "pos", (F.col("at") + 1 - F.col("pos")).alias("offset"), *cut, "as_plain")
        out = met if out is None else out.unionByName(met)
    return out


def whole_items(benchmark: DataFrame, made: DataFrame, windows: DataFrame) -> DataFrame:
    """(raw, hash, length, template, members): the word sequences of items that have no window of evidence."""
    items = tokenised(benchmark.filter(F.col("item_id").isNotNull()), "item_id").filter(F.size("raw") >= LEAST_WHOLE).select("item_id", "raw").distinct()
    found = made.join(windows.select("template").distinct(), "template", "left_semi").select("item_id", "raw").distinct()
    bare = items.join(found, ["item_id", "raw"], "left_anti").groupBy("raw").agg(F.min("item_id").alias("template"), F.collect_set("item_id").alias("members"))
    first = F.least(F.lit(WINDOW), F.size("raw"))
    hashes = [F.when(first == n, _window_hash(F.col("raw"), F.lit(0), n)) for n in range(LEAST_WHOLE, WINDOW + 1)]
    return bare.select("raw", F.coalesce(*hashes).alias("hash"), first.alias("length"), "template", "members")


def whole_leaks(docs: DataFrame, whole: DataFrame, lengths: list[int]) -> DataFrame:
    """(doc_id, item_id, template) of documents that hold all words of an item of ``whole_items`` in a row."""
    tokens = tokenised(docs.filter(F.col("doc_id").isNotNull()), "doc_id")
    side = whole.withColumnRenamed("raw", "item_raw")
    side = F.broadcast(side) if whole.count() <= BROADCAST_WINDOWS else side.hint("merge")
    out = None
    for length in lengths:
        each = tokens.select("doc_id", "raw", F.posexplode_outer(_windows(F.col("raw"), length)).alias("at", "hash"))
        met = each.join(side.filter(F.col("length") == length).drop("length"), "hash")
        met = met.filter(F.slice("raw", F.col("at") + 1, F.size("item_raw")) == F.col("item_raw")).select("doc_id", "template", "members").distinct()
        out = met if out is None else out.unionByName(met)
    return out.select("doc_id", F.explode("members").alias("item_id"), "template").distinct()


def _by_variant(rows: DataFrame, variants: DataFrame) -> DataFrame:
    """``rows`` of variants as they are, those of templates once for every variant."""
    own = rows.filter(F.col("variant").isNotNull()).drop("template")
    return own.unionByName(rows.filter(F.col("variant").isNull()).drop("variant").join(variants, "template").drop("template")).distinct()


def _consistent(met: DataFrame, made: DataFrame, sizes: DataFrame, coverage: float, consistency: float) -> DataFrame:
    """The leaks that matched windows (doc_id, variant, pos, offset, raw, canon) make, as in ``item_leaks``."""
    pair = ["doc_id", "variant"]
    found = met.select(*pair, "pos").distinct().groupBy(*pair).agg(F.count("*").alias("n_windows")).join(sizes, "variant")
    found = found.withColumn("coverage", F.col("n_windows") / F.col("n_item")).filter(F.col("coverage") >= coverage)
    lines = met.groupBy(*pair, "offset").agg(F.count("*").alias("hits"))
    best = lines.groupBy(*pair).agg(F.max(F.struct(F.col("hits"), (-F.col("offset")).alias("back"))).alias("best"))
    hits = found.join(best, pair).select(*pair, "n_windows", "coverage", (-F.col("best.back")).alias("offset"))

    on_line = met.join(hits.select(*pair, "offset"), [*pair, "offset"])
    own = made.select("item_id", "template", "variant", F.col("raw").alias("item_raw"), F.col("canon").alias("item_canon"))
    hits = hits.join(own.drop("item_raw", "item_canon").distinct(), "variant")
    on_line = on_line.join(own.drop("template"), "variant")
    pair = ["doc_id", "item_id"]
    slot = F.filter(
        F.transform(F.sequence(F.lit(0), F.size("canon") - 1), lambda i: F.struct(
            (F.col("pos") + i).alias("place"), F.get("item_raw", F.col("pos") + i - 1).alias("asked"), F.get("raw", i).alias("said"), (F.get("canon", i).isin(NUM, UNIT, NAME) & F.get("item_canon", F.col("pos") + i - 1).isin(NUM, UNIT, NAME)).alias("is_slot"),
        )), lambda s: s["is_slot"],
    )
    values = on_line.select(*pair, F.explode(slot).alias("slot")).select(*pair, "slot.asked", "slot.said").distinct()
    mapped = values.groupBy(*pair, "asked").agg(F.count("*").alias("n"), F.max((F.col("said") != F.col("asked")).cast("int")).alias("other"))
    slots_of = mapped.groupBy(*pair).agg(
        F.count("*").alias("n_slots"), F.sum((F.col("n") == 1).cast("int")).alias("fine"), F.max("other").alias("other")
    )
    out = hits.join(slots_of, pair, "left").select(
        *pair, "n_windows", "coverage", F.coalesce("n_slots", F.lit(0)).cast("long").alias("n_slots"),
        F.coalesce(F.col("fine") / F.col("n_slots"), F.lit(1.0)).alias("consistency"),
        F.when(F.coalesce("other", F.lit(0)) == 0, "verbatim").otherwise("reparameterised").alias("kind"), "template",
    )
    return out.filter(F.col("consistency") >= consistency)


def item_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, consistency: float = CONSISTENCY) -> DataFrame:
    """(doc_id, item_id, n_windows, coverage, n_slots, consistency, kind, template) of every leak.

    ``kind`` is ``verbatim`` if all slot values on the best diagonal are the
    item's own, else ``reparameterised``.  A document with a question is a leak
    of every item of that template.  The figures of a leak come from the document's
    canonical windows; where these do not make it one, from its windows of both forms.
    """
    made = materialise(templates(benchmark))
    windows = materialise(template_windows(made))
    lengths = sorted(r["length"] for r in windows.select("length").distinct().collect())  # at most WINDOW values
    variants = materialise(made.select("template", "variant").distinct())
    sizes = materialise(_by_variant(windows.select("template", "variant", "pos").distinct(), variants).groupBy("variant").agg(F.count("*").alias("n_item")))
    least = variants.join(sizes, "variant").groupBy("template").agg(F.min("n_item").alias("n_least"))
    met = matched_windows(docs, windows, lengths or [WINDOW], windows.count() <= BROADCAST_WINDOWS)
    met = materialise(met.distinct())
    near = met.select("doc_id", "template", "pos").distinct().groupBy("doc_id", "template").agg(F.count("*").alias("n")).join(least, "template")
    near = near.filter(F.col("n") / F.col("n_least") >= coverage).select("doc_id", "template")
    met = materialise(_by_variant(met.join(near, ["doc_id", "template"], "left_semi"), variants))
    canonical = materialise(_consistent(met.filter(~F.col("as_plain")).drop("as_plain"), made, sizes, coverage, consistency))
    both = _consistent(met.drop("as_plain").distinct(), made, sizes, coverage, consistency)
    leaks = canonical.unionByName(both.join(canonical.select("doc_id", "item_id"), ["doc_id", "item_id"], "left_anti").select(*canonical.columns))
    whole = materialise(whole_items(benchmark, made, windows))
    lengths = sorted(r["length"] for r in whole.select("length").distinct().collect())  # at most WINDOW values
    if not lengths:
        return leaks
    more = whole_leaks(docs, whole, lengths).join(leaks.select("doc_id", "item_id"), ["doc_id", "item_id"], "left_anti")
    return leaks.unionByName(more.select(
        "doc_id", "item_id", F.lit(1).cast("long").alias("n_windows"), F.lit(1.0).alias("coverage"), F.lit(0).cast("long").alias("n_slots"),
        F.lit(1.0).alias("consistency"), F.lit("verbatim").alias("kind"), "template",
    ))


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, consistency: float = CONSISTENCY) -> DataFrame:
    """The columns of ``item_leaks`` without template, one row per (document, template): the item held verbatim
    with the smallest item_id, or else the smallest re-parameterised one."""
    leaks = item_leaks(docs, benchmark, coverage, consistency)
    columns = [c for c in leaks.columns if c != "template"]
    order = F.struct(F.col("kind") != "verbatim", F.col("item_id"))
    return leaks.groupBy("doc_id", "template").agg(F.min_by(F.struct(*columns), order).alias("first")).select(*[F.col(f"first.{c}") for c in columns])


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item."""
    leaks = item_leaks(docs.select("doc_id", "text"), benchmark).select(F.col("doc_id").alias("__leak")).distinct()
    return docs.join(leaks, F.col("doc_id") == F.col("__leak"), "left_anti")


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) leak of the whole tables."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return item_leaks(docs, read_table(spark, sf_dir, "benchmark").select("item_id", "text")).drop("template")


def _sql_list(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


_SQL_END = r"regexp_matches({}, '^[.!?\n]')"
_SQL_NUMBER = "(regexp_matches({0}, '^[0-9]') OR lower({0}) IN (" + _sql_list(NUMBER_WORDS) + "))"
#: The same result in SQL, for benchmarks whose items all have at least WINDOW tokens and a template of their own, and
#: without the leaks that need a document's plain form.
OP1_SQL = rf"""
WITH texts AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all(coalesce(text, ''), '{TOKEN}') AS t FROM documents
  UNION ALL SELECT 'b', item_id, regexp_extract_all(coalesce(text, ''), '{TOKEN}') FROM benchmark
), each_ AS (
  SELECT side, id, t, unnest(range(1, len(t) + 1)) AS i FROM texts
), placed AS (
  SELECT side, id, i, t[i] AS x, CASE WHEN i > 1 THEN t[i - 1] ELSE chr(10) END AS b FROM each_
), typed AS (
  SELECT *, lower(x) AS low, CASE WHEN {_SQL_NUMBER.format('x')} THEN '{NUM}'
    WHEN lower(x) IN ({_sql_list(UNITS)}) AND {_SQL_NUMBER.format('b')} THEN '{UNIT}' ELSE lower(x) END AS plain
  FROM placed WHERE NOT {_SQL_END.format('x')}
), named AS (
  SELECT *, CASE WHEN x <> low AND plain = low AND NOT {_SQL_END.format('b')} AND regexp_full_match(x, '\p{{Lu}}\p{{Ll}}+') THEN '{NAME}' ELSE plain END AS canon
  FROM typed
), seqs AS (
  SELECT side, id, list(low ORDER BY i) AS raw, list(plain ORDER BY i) AS plain, list(canon ORDER BY i) AS canon FROM named GROUP BY side, id
), items AS (
  SELECT canon, list_transform(range(1, len(raw) + 1), lambda k: CASE WHEN canon[k] <> raw[k] THEN list_position(raw, raw[k]) ELSE 0 END) AS pattern, id, raw, plain
  FROM seqs WHERE side = 'b'
), templates AS (
  SELECT min(id) AS item_id, arg_min(raw, id) AS raw, canon, arg_min(plain, id) AS plain FROM items GROUP BY canon, pattern
), forms AS (
  SELECT item_id, unnest(range(1, len(canon) - {WINDOW} + 2)) AS pos, canon AS form FROM templates
  UNION SELECT item_id, unnest(range(1, len(plain) - {WINDOW} + 2)), plain FROM templates
), windows AS (
  SELECT DISTINCT item_id, pos, form[pos:pos + {WINDOW - 1}] AS w FROM forms
  WHERE 2 * len(list_filter(form[pos:pos + {WINDOW - 1}], lambda x: x NOT IN ('{NUM}', '{UNIT}', '{NAME}'))) >= {WINDOW}
), doc_windows AS (
  SELECT id AS doc_id, raw, canon, unnest(range(1, len(canon) - {WINDOW} + 2)) AS at FROM seqs WHERE side = 'd'
), met AS (
  SELECT DISTINCT d.doc_id, w.item_id, w.pos, d.at - w.pos AS offset_, d.raw[d.at:d.at + {WINDOW - 1}] AS raw, d.canon[d.at:d.at + {WINDOW - 1}] AS canon
  FROM doc_windows d JOIN windows w ON d.canon[d.at:d.at + {WINDOW - 1}] = w.w
), sizes AS (
  SELECT item_id, count(DISTINCT pos) AS n_item FROM windows GROUP BY 1
), found AS (
  SELECT doc_id, item_id, count(DISTINCT pos) AS n_windows, any_value(n_item) AS n_item FROM met JOIN sizes USING (item_id) GROUP BY 1, 2
  HAVING count(DISTINCT pos) / any_value(n_item) >= {COVERAGE}
), best AS (
  SELECT doc_id, item_id, arg_max(offset_, (hits, -offset_)) AS offset_ FROM (SELECT doc_id, item_id, offset_, count(*) AS hits FROM met GROUP BY 1, 2, 3) GROUP BY 1, 2
), said AS (
  SELECT DISTINCT doc_id, item_id, t.raw[pos + k] AS asked, m.raw[k + 1] AS said
  FROM found JOIN best USING (doc_id, item_id) JOIN met m USING (doc_id, item_id, offset_) JOIN templates t USING (item_id), range(0, {WINDOW}) r(k)
  WHERE m.canon[k + 1] IN ('{NUM}', '{UNIT}', '{NAME}')
), mapped AS (
  SELECT doc_id, item_id, asked, count(*) AS n, max(CAST(said <> asked AS INTEGER)) AS other FROM said GROUP BY 1, 2, 3
), slots AS (
  SELECT doc_id, item_id, count(*) AS n_slots, sum(CAST(n = 1 AS INTEGER)) AS fine, max(other) AS other FROM mapped GROUP BY 1, 2
)
SELECT doc_id, item_id, n_windows, n_windows / n_item AS coverage, CAST(coalesce(n_slots, 0) AS BIGINT) AS n_slots,
       coalesce(fine / n_slots, 1.0) AS consistency, CASE WHEN coalesce(other, 0) = 0 THEN 'verbatim' ELSE 'reparameterised' END AS kind
FROM found LEFT JOIN slots USING (doc_id, item_id) WHERE coalesce(fine / n_slots, 1.0) >= {CONSISTENCY}
"""
