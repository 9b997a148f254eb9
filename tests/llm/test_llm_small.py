"""Edge cases of every operator: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib

import pytest
from pyspark.sql import functions as F

from slotwise.llm import decontaminate, fingerprint, html_extract, language_id, line_dedup, ngram_join, pii, quality, sentencepiece_nbest, tool_calls

LONG = " ".join(f"word{i % 977} filler{i % 13}" for i in range(40_000))
ROWS = [
    (1, "One line that is certainly long enough to be a line key here.\nshort", "a", 5),
    (2, None, None, None),
    (3, "", "b", 0),
    (4, " \n\t ", "c", 4),
    (5, LONG, "d", 1),
    (6, LONG, "d", 1),
    (6, LONG, "d", 1),
    (None, "a text without any identifier at all", "e", 2),
    (7, "日本語のテキスト 12 🙂", "f", 3),
]
# columns named like those the operators make or use inside
SCHEMA = "doc_id long, text string, label string, links long"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clash(df):
    for name in ("rep", "node", "size", "u", "v", "kind", "value", "key", "range", "at", "hash", "pos", "refs", "n_lines", "status", "ids", "score", "expected_grade", "tail_probability"):
        df = df.withColumn(name, F.lit(name))
    return df


def test_line_dedup(odd, empty, spark):
    out = {(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(clash(odd)).select("doc_id", "n_lines", "n_dropped", "text").collect()}
    assert (2, 1, 0, "") in out and (3, 1, 0, "") in out and (4, 2, 0, " \n\t ") in out
    assert len(line_dedup.dedup_lines(odd).collect()) == len(ROWS)
    assert line_dedup.dedup_lines(empty).collect() == []
    line = "This very line is found in many documents of this table."
    many = spark.createDataFrame([(i, f"{line}\nown {i}") for i in range(5)] + [(4, line), (None, f" {line.upper()}\t")], "doc_id long, text string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in line_dedup.dedup_lines(many).collect())
    assert got == [(-1, ""), (0, "own 0"), (1, "own 1"), (2, "own 2"), (3, "own 3"), (4, line), (4, f"{line}\nown 4")]
    four = many.filter("doc_id < 4")
    assert {r.n_dropped for r in line_dedup.dedup_lines(four).collect()} == {0}  # four holders only


def test_ngram_join(odd, empty):
    out = sorted(ngram_join.jaccard_join(clash(odd)).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    by = {r.doc_id: (r.class_id, r.n_links) for r in out}
    assert len(out) == len(ROWS)
    assert by[5] == (5, 2) and by[6] == (5, 2)  # three equal texts
    assert by[2] == (2, 0) and by[3] == (3, 0) and by[4] == (4, 0)  # no words: no links
    assert ngram_join.jaccard_join(empty).collect() == []


def test_quality(odd, empty, spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (5, 1, 1), (7, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    grades = {r.doc_id: r.grade for r in quality.graded(labels).collect()}
    assert grades == {1: 0, 5: 1}
    model = quality.train(odd, quality.graded(labels))
    scored = quality.score(clash(odd), model).collect()
    assert len(scored) == len(ROWS) and all(0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 2 for r in scored)
    none = quality.train(odd, quality.graded(labels.limit(0)))
    kept = quality.select(clash(odd), none)
    assert kept.count() == len(ROWS) and kept.columns == clash(odd).columns
    assert {r.expected_grade for r in kept.collect()} == {"expected_grade"}
    assert quality.score(empty, model).collect() == []


def test_language_id(odd, empty, spark):
    none = language_id.train(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in language_id.predict(odd, none).collect()} == {"und"}
    docs = spark.createDataFrame([(i, "the cat sat on the mat and the dog" if i % 2 else "der hund und die katze sind nicht hier", "en" if i % 2 else "de") for i in range(20)], "doc_id long, text string, lang string")
    model = language_id.train(docs)
    asked = spark.createDataFrame([(1, "the dog and the cat"), (2, "die katze und der hund"), (3, None), (4, ""), (5, "12 !?"), (6, "ж"), (None, "the mat")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(clash(asked), model).collect()}
    assert got[1][0] == "en" and got[2][0] == "de" and got[None][0] == "en"
    assert got[3] == got[4] == got[5] == ("und", 0.0)
    assert got[6][0] in ("de", "en") and all(0 <= s <= 1 for _, s in got.values())
    assert language_id.predict(empty, model).collect() == []


def test_sentencepiece(odd, empty):
    out = sentencepiece_nbest.encode(clash(odd))
    rows = out.collect()
    assert len(rows) == len(ROWS) and all(r.round_trip for r in rows)
    back = sorted((r.doc_id or 0, r.text) for r in sentencepiece_nbest.decode(out).collect())
    assert back == sorted((i or 0, t or "") for i, t, *_ in ROWS)
    blank = next(r for r in rows if r.doc_id == 2)
    assert blank.ids == [] and [x.cost for x in blank.n_best] == [0]
    assert sentencepiece_nbest.encode(empty).collect() == []


def test_html(spark):
    pages = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "no markup", "x"), (4, "<p>a", "x"), (4, "<p>a", "x"), (5, "<" * 3000, "x"), (6, "<div" * 2000, "x")], "page_id long, html string, kind string")
    got = sorted((r.page_id, r.text) for r in html_extract.extract(pages).collect())
    assert got[0] == (1, "") and got[1] == (2, "") and got[3] == got[4] and len(got) == 7
    assert html_extract.extract(pages.limit(0)).collect() == []


def test_decontaminate(odd, empty, spark):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "three words only"), (4, "which of these seven planets is the largest one of all"), (5, "which of these seven planets is the largest one of all")], "item_id long, text string")
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(50, "Well: WHICH of these seven planets is the largest one of all?"), (50, "Well: WHICH of these seven planets is the largest one of all?"), (51, "which of these")], "doc_id long, text string"))
    got = [(r.doc_id, r.item_id, r.kind) for r in decontaminate.contaminated(clash(docs), bench).collect()]
    assert got == [(50, 4, "verbatim")]
    assert decontaminate.contaminated(docs, bench.limit(0)).collect() == []
    assert decontaminate.contaminated(empty, bench).collect() == []
    left = decontaminate.without_leaks(clash(docs), bench)
    assert left.count() == len(ROWS) + 1 and left.columns == clash(docs).columns


def test_pii(odd, empty):
    out = pii.pseudonymise(clash(odd))
    assert sorted((r.doc_id or 0, r.text or "-") for r in out.collect()) == sorted((i or 0, t or "-") for i, t, *_ in ROWS)
    assert pii.pseudonymise(empty).collect() == []


def test_fingerprint(odd, empty):
    rows = fingerprint.edited_pairs(clash(odd)).collect()
    assert len(rows) == len(ROWS)
    texts = [t or "" for _, t in sorted(((i if i is not None else -1, t or "") for i, t, *_ in ROWS))]
    want = set()
    for k, t in enumerate(texts):
        q = len(t) // 4
        want.add(hashlib.sha256((t[: len(t) - q] + texts[(k + 1) % len(texts)][:q]).encode()).hexdigest())
    assert {r.edited_sha256 for r in rows} == want
    equal = {r.fingerprint for r in rows if r.n_chars == len(LONG)}
    assert len(equal) == 1
    assert all(r.near_next == 1.0 for r in rows if r.doc_id == 5)
    assert fingerprint.edited_pairs(empty).collect() == []


@pytest.mark.parametrize("few", [False, True])
def test_fingerprint_of_far_repeated_and_null_ids(spark, monkeypatch, few):
    if few:  # many ranges, ordered over several levels
        monkeypatch.setattr(fingerprint, "RANGE_ROWS", 3)
        monkeypatch.setattr(fingerprint, "RANGE_CHARS", 200)
        monkeypatch.setattr(fingerprint, "ONE_TASK_KEYS", 8)
    ids = [-(2**63), -9 * 10**18, 5, 9 * 10**18, 2**63 - 1, *range(100, 140), *[7] * 25, *[None] * 30]
    made = [(i, f"{k * 7919 % 1000:03d} words of text {k}" + " and more" * (k % 4)) for k, i in enumerate(ids)]
    made += [(7, "twice"), (7, "twice"), (None, ""), (None, None)]
    rows = fingerprint.edited_pairs(spark.createDataFrame(made, "doc_id long, text string")).collect()
    ordered = sorted(((i is not None, i or 0), t or "") for i, t in made)
    want = []
    for k, (at, t) in enumerate(ordered):
        q = len(t) // 4
        edited = t[: len(t) - q] + ordered[(k + 1) % len(ordered)][1][:q]
        want.append((at, hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.edited_sha256) for r in rows) == sorted(want)


def test_outlying_ids_leave_the_ranges_small(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 50)
    keys = spark.createDataFrame([(k,) for k in [*range(2000), 10**17, -(10**18)]], "key long").selectExpr("key", "1L AS chars")
    number, chars = fingerprint.key_ranges(keys)
    sizes = [r["count"] for r in keys.groupBy(number.alias("r")).count().collect()]
    assert chars == 2002 and max(sizes) <= 150 and len(sizes) >= 20


def test_tool_calls(spark):
    calls = spark.createDataFrame([], "conv_id long, turn long, pos int, call_id string, name string, arguments string, depends_on array<string>")
    results = spark.createDataFrame([], "conv_id long, turn long, call_id string, content string")
    schemas = spark.createDataFrame([], "name string, schema string")
    assert tool_calls.link_calls(calls, results, schemas).collect() == []
