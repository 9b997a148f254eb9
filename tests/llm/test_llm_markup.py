"""op10 on broken and deep markup; the pipeline's group stage on repeated and null ids."""

import time

import pytest

import corpus_pipeline as cp
from slotwise.llm import html_extract as H
from tests.conftest import SF001, rows


@pytest.mark.parametrize(
    "page, text",
    [
        ("<p>Before it.<!-->Kept text here.</p>", "Before it.Kept text here."),
        ("<p>Before it.<!--->Kept text here.</p>", "Before it.Kept text here."),
        ("<p>First part, <!-- left out --!>second part.</p>", "First part, second part."),
        ("<p>Hello there.</p>< 5 dollars is the price of it.", "Hello there.\n\n< 5 dollars is the price of it."),
        ("<p>One </>and </ bogus>two, three.</p>", "One and two, three."),
        ("<article><button>Menu<p>This is the long text, which stays.</p></article>", "Menu\n\nThis is the long text, which stays."),
        ("<article><button>Menu</button><p>This is the long text, which stays.</p></article>", "This is the long text, which stays."),
        ("<article><BUTTON>a<button>b</button><p>This is the long text, which stays.</p></article>", "This is the long text, which stays."),
    ],
)
def test_broken_markup(page, text):
    assert H.main_text(page) == text


@pytest.mark.parametrize("tag", ["div", "b", "p", "li", "section class=nav", "button"])
def test_deep_markup_takes_linear_time(tag):
    def seconds(n):
        page = f"<{tag}>some words here, " * n
        start = time.process_time()
        H.main_text(page)
        return time.process_time() - start

    seconds(1000)
    assert seconds(40_000) < 16 * max(seconds(10_000), 0.05)


def test_signals_are_handed_down():
    page = "<html><body><nav><div><p>Home, news, about us.</p></div></nav><article><h1>Title</h1><p>The text of it, long enough.</p></article></body></html>"
    assert H.main_text(page) == "Title\n\nThe text of it, long enough."


def _docs(spark, data):
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, class_id string")


def test_group_stage_keeps_every_distinct_text(spark):
    a = "one two three four five six seven eight nine ten"
    b = "red orange yellow green blue indigo violet black white grey"
    docs = _docs(spark, [(i, t, "en", "s", 0, "x") for i, t in [(5, a), (6, a), (6, b), (6, b), (None, "un deux trois quatre cinq six sept"), (7, None), (8, ""), (9, None)]])
    kept = cp.keep_one_per_group(spark, docs, SF001)
    assert kept.columns == docs.columns
    got = sorted(rows(kept.select("doc_id", "text")), key=str)
    assert got == sorted([(5, a), (6, b), (None, "un deux trois quatre cinq six sept"), (7, None), (8, ""), (9, None)], key=str)


def test_group_stage_of_an_empty_table(spark):
    docs = _docs(spark, [])
    assert rows(cp.keep_one_per_group(spark, docs, SF001)) == []
