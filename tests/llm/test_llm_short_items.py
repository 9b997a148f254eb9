"""Benchmark items too short or too full of numbers for a window of evidence."""

from slotwise.llm import decontaminate as dc


def test_items_without_evidence_are_found_whole(spark):
    arithmetic = "Compute 3 + 4 * 5 - 2 / 7."
    numbers = "Add 12 13 14 15 16 17 18 19 20 21 22 to 23"  # longer than a window
    bench = spark.createDataFrame([
        (1, "Who wrote Hamlet?"), (2, arithmetic), (3, "Paris"), (4, "two words"), (5, "who WROTE hamlet"), (6, numbers), (7, None),
        (8, "which of these seven planets is the largest one of all"),
    ], "item_id long, text string")
    docs = spark.createDataFrame([
        (10, "A quiz: who wrote Hamlet? Nobody knew."), (11, f"Exercise 9: {arithmetic} Then rest."), (12, "Paris and two words, Hamlet wrote who"),
        (13, "compute 3 + 4 * 5 - 2 / 8"), (14, "list: " + numbers + " and more"), (14, "list: " + numbers + " and more"), (15, numbers[:-3]), (16, None), (None, "Who wrote Hamlet?"),
        (17, "Well: which of these seven planets is the largest one of all?"),
    ], "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.kind) for r in dc.item_leaks(docs, bench).collect())
    assert (10, 1, "verbatim") in got and (10, 5, "verbatim") in got and (11, 2, "verbatim") in got and (17, 8, "verbatim") in got
    assert len([g for g in got if g[:2] == (14, 6)]) == 1
    assert {d for d, _, _ in got} == {10, 11, 14, 17}
    assert {r.doc_id for r in dc.without_leaks(docs, bench).collect()} == {12, 13, 15, 16, None}
    one = [(r.doc_id, r.item_id) for r in dc.contaminated(docs, bench).collect() if r.doc_id == 10]
    assert one == [(10, 1)]


def test_shuffled_side_of_short_items(spark, monkeypatch):
    monkeypatch.setattr(dc, "BROADCAST_WINDOWS", 0)
    bench = spark.createDataFrame([(1, "Who wrote Hamlet?")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Now: who wrote hamlet"), (2, "who wrote it")], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in dc.item_leaks(docs, bench).collect()] == [(1, 1)]
