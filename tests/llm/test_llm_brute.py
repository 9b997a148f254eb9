"""Operators without SQL against brute-force versions on the small driver tables."""

import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from slotwise.llm import decontaminate, fingerprint, html_extract, language_id, line_dedup, ngram_join, pii, quality, sentencepiece_nbest
from slotwise.llm.common import large_text, read_table

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return read_table(spark, SF01, "documents").cache()


# ---- line dedup ------------------------------------------------------------------------------------------


def test_line_index_is_reversible(spark):
    docs = read_table(spark, SF001, "documents").select("doc_id", "text")
    base, extra = docs.filter("doc_id % 3 > 0"), docs.filter("doc_id % 3 = 0")
    first = line_dedup.build_index(base, min_docs=2)
    grown = line_dedup.insert_documents(first, extra)
    whole = line_dedup.build_index(docs, min_docs=2)
    table = lambda index: sorted(map(tuple, index.counts.select("k1", "k2", "refs", "last_doc").collect()))
    assert table(grown) == table(whole) and table(whole) != table(first)
    back = line_dedup.delete_documents(grown, extra.select("doc_id"))
    assert table(back) == table(first)
    for index in (first, grown, back):  # the filters hold exactly the counted keys
        held = sum(int((np.frombuffer(r.buckets, np.uint16) > 0).sum()) for r in index.filters.collect())
        assert held == index.counts.count()
    text = lambda index, d: sorted((r.doc_id, r.text) for r in line_dedup.dedup_lines(d, index).collect())
    assert text(back, base) == text(first, base) and text(grown, docs) == text(whole, docs)


def test_cuckoo_filter_has_no_false_negatives():
    rng = np.random.default_rng(0)
    k1, k2 = (rng.integers(-(2**63), 2**63, 20_000) for _ in range(2))
    made = line_dedup._filter_of(k1, k2)
    assert made.contains(k1, k2).all()
    other = rng.integers(-(2**63), 2**63, 20_000)
    assert made.contains(other, k2[::-1].copy()).mean() < 0.01
    made.remove(k1[:10_000], k2[:10_000])
    assert made.contains(k1[10_000:], k2[10_000:]).all() and made.contains(k1[:10_000], k2[:10_000]).mean() < 0.01


# ---- n-gram join -----------------------------------------------------------------------------------------


def shingles(text):
    words = re.findall(r"[^\W_]+", text.lower())
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_links(texts):
    sets = {k: shingles(t) for k, t in texts.items()}
    links = defaultdict(set)
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and min(len(x), len(y)) >= 0.8 * max(len(x), len(y)):
            both = len(x & y)
            if both >= 0.8 * (len(x) + len(y) - both) - 1e-9:
                links[a].add(b)
                links[b].add(a)
    return links


def test_ngram_join_blocks_and_chains(spark):
    """A large group of near copies over several blocks, a chain, and short texts."""
    rng = np.random.default_rng(5)
    word = lambda: f"w{rng.integers(10**9)}"
    base = [word() for _ in range(120)]
    texts = {}
    for i in range(90):
        own = list(base)
        for _ in range(rng.integers(0, 4)):
            own[rng.integers(len(own))] = word()
        texts[i] = " ".join(own)
    chain = [word() for _ in range(200)]
    for i in range(100, 108):  # each shares most with the next only
        texts[i] = " ".join(chain[(i - 100) * 8 : (i - 100) * 8 + 130])
    texts |= {200: "just three words", 201: "Just THREE words!", 202: "just three word"}
    want = brute_links(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in ngram_join.jaccard_join(docs, block=16).collect()}
    assert {k: r.n_links for k, r in got.items()} == {k: len(want[k]) for k in texts}
    label = {}
    for k in sorted(texts):
        todo = [k]
        while todo:
            x = todo.pop()
            if x not in label:
                label[x] = k
                todo += want[x]
    assert {k: r.class_id for k, r in got.items()} == label


def test_prefix_is_shortened_to_the_target():
    assert ngram_join.prefix_depth(0.8, 32, 8, 0.9999) == 6
    assert ngram_join.prefix_depth(0.95, 32, 8, 0.9999) == 8
    assert ngram_join.prefix_depth(0.1, 4, 8, 0.9999) == 1


# ---- decontamination -------------------------------------------------------------------------------------


def test_decontaminate_finds_every_planted_item(spark, documents):
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(documents, read_table(spark, SF01, "benchmark")).collect()}
    norm = lambda t: " ".join(re.findall(r"[^\W\d_]+", t.lower()))
    items = {r.item_id: norm(r.text) for r in read_table(spark, SF01, "benchmark").collect()}
    want = {(r.doc_id, k) for r in documents.collect() for k, t in items.items() if t in norm(r.text)}
    assert want and got == want


def test_reparameterised_questions(spark):
    bench = spark.createDataFrame([
        (1, "A farmer has 12 sheep and buys 7 more sheep from Alice for 12 dollars each, so how many sheep does the farmer have now?"),
        (2, "A farmer has 30 sheep and buys 9 more sheep from Maria for 30 dollars each, so how many sheep does the farmer have now?"),  # the same template
    ], "item_id long, text string")
    docs = spark.createDataFrame([
        (1, "Quiz. A farmer has 45 sheep and buys 3 more sheep from Robert for 45 euros each, so how many sheep does the farmer have now? Yes."),
        (2, "Quiz. A farmer has 45 sheep and buys 3 more sheep from Robert for 46 dollars each, so how many sheep does the farmer have now?"),  # slots disagree
        (3, "a farmer has twelve sheep and buys 7 more sheep from alice for 12 dollars each, so how many sheep does the farmer have now?"),
        (4, "A farmer has many cows and sells all of them to Robert for a song, which is not a question at all."),
    ], "doc_id long, text string")
    got = {r.doc_id: (r.item_id, r.kind, r.consistency) for r in decontaminate.contaminated(docs, bench, consistency=0.9).collect()}
    assert got[1] == (1, "reparameterised", 1.0) and 2 not in got and 4 not in got
    assert {r.doc_id for r in decontaminate.contaminated(docs, bench, consistency=0.5).collect()} >= {1, 2}


def test_every_item_of_a_template_is_reported(spark):
    ask = "A farmer has {} sheep and buys {} more sheep from {} for {} dollars each, so how many sheep does the farmer have now?"
    bench = spark.createDataFrame([(1, ask.format(12, 7, "Alice", 12)), (2, ask.format(30, 9, "Maria", 30)), (3, ask.format(31, 9, "Maria", 31)), (4, ask.format(30, 9, "Maria", 30))], "item_id long, text string")
    names = "what {} and {} saw with {} in {} was old"
    bench = bench.unionByName(spark.createDataFrame([(5, names.format("Anna", "Karl", "Lena", "Rome")), (6, names.format("Peter", "Paul", "Olga", "Oslo"))], "item_id long, text string"))
    docs = spark.createDataFrame([
        (1, "Quiz. " + ask.format(30, 9, "Maria", 30)), (2, ask.format(5, 6, "Robert", 5)), (3, ask.format(31, 9, "Maria", 31).lower()),
        (4, names.format("Peter", "Paul", "Olga", "Oslo").lower()), (5, names.format("Anna", "Karl", "Lena", "Rome").upper()),
    ], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.kind for r in decontaminate.item_leaks(docs, bench).collect()}
    v, o = "verbatim", "reparameterised"
    assert {k: x for k, x in got.items() if k[0] in (1, 2)} == {(1, 1): o, (1, 2): v, (1, 3): o, (1, 4): v, (2, 1): o, (2, 2): o, (2, 3): o, (2, 4): o}
    assert got[3, 3] == v and got[3, 2] == o and got[4, 6] == v and (4, 5) not in got and got[5, 5] == v and (5, 6) not in got
    assert decontaminate.without_leaks(docs, bench).count() == 0
    one = {r.doc_id: (r.item_id, r.kind) for r in decontaminate.contaminated(docs, bench).collect()}
    assert one == {1: (2, v), 2: (1, o), 3: (3, v), 4: (6, v), 5: (5, v)}


def test_capitals_that_are_no_names(spark):
    short, long = "What is the capital of France?", "Why do the small rivers of the old valley run to the sea in spring?"
    bench = spark.createDataFrame([(1, short), (2, long)], "item_id long, text string")
    docs = spark.createDataFrame([
        (1, "Question: " + short), (2, "He asked, \u201c" + short), (3, "a) " + short), (4, "Quiz: " + long), (5, long.title()), (6, long),
        (7, "Question: What is the name of France and of its old king?"),
    ], "doc_id long, text string")
    rows = decontaminate.item_leaks(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id, r.kind) for r in rows) == [(d, 1 if d < 4 else 2, "verbatim") for d in range(1, 7)]
    assert all(r.coverage == 1.0 for r in rows if r.doc_id != 4)  # document 4 is a leak by its canonical windows alone


def test_shuffled_side_equals_broadcast_side(spark, documents):
    bench = read_table(spark, SF01, "benchmark")
    made = decontaminate.templates(bench)
    windows = decontaminate.template_windows(made)
    lengths = [decontaminate.WINDOW]
    a, b = (decontaminate.matched_windows(documents, windows, lengths, x) for x in (True, False))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and a.count()


# ---- quality ---------------------------------------------------------------------------------------------


def test_quality_separates_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = read_table(spark, sf, "documents"), quality.graded(read_table(spark, sf, "labels"))
    fit, ask = (labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0 if x else F.pmod(F.xxhash64("doc_id"), F.lit(4)) > 0) for x in (False, True))
    model = quality.train(docs, fit)
    assert (np.diff(model.thresholds) > 0).all()
    rows = quality.score(docs.join(ask, "doc_id"), model).select("grade", "tail_probability").collect()
    share = {g: np.mean([r.tail_probability >= quality.KEEP_FROM for r in rows if r.grade == g]) for g in (0, 1, 2)}
    assert share[2] > 0.97 and share[0] < 0.05 and share[1] < 0.6


def test_ordinal_gradient():
    """The fitted model is a stationary point: no small change of weights or thresholds lowers the loss."""
    rng = np.random.default_rng(1)
    x = rng.random((600, 12)) < 0.3
    true = np.array([2.0, -2.0, 1.0] + [0.0] * 9)
    y = np.digitize(x @ true + rng.logistic(size=600), [-0.5, 1.0])
    rows, ids = np.nonzero(x)
    old = quality.LEAST_Z, quality.LEAST_CORRELATION
    quality.LEAST_Z = quality.LEAST_CORRELATION = 0.0
    try:
        model = quality.fit_ordinal(rows, ids, y, dimensions=12, steps=1500)
    finally:
        quality.LEAST_Z, quality.LEAST_CORRELATION = old

    def loss(w, cuts):
        s = x @ w
        p = np.concatenate([np.zeros((600, 1)), 1 / (1 + np.exp(-(cuts[None] - s[:, None]))), np.ones((600, 1))], axis=1)
        return -np.log(p[np.arange(600), y + 1] - p[np.arange(600), y]).mean()

    at = loss(model.weights, model.thresholds)
    for k in range(12):
        for step in (0.05, -0.05):
            assert loss(model.weights + step * np.eye(12)[k], model.thresholds) > at - 1e-5
    for k in range(2):
        for step in (0.05, -0.05):
            assert loss(model.weights, model.thresholds + step * np.eye(2)[k]) > at - 1e-5


@pytest.mark.parametrize("n", [2000, 16000])
def test_rare_pure_words_get_a_weight(n):
    """A word of eight documents, all toxic, counts at every sample size; one spread like the grades does not."""
    grades = np.where(np.arange(n) % 10 == 0, 1, np.where(np.arange(n) % 7 == 0, 0, 2))
    pure, spread = np.flatnonzero(grades == 1)[:8], np.concatenate([np.flatnonzero(grades == g)[50 : 50 + k] for g, k in ((0, 1), (1, 1), (2, 6))])
    rows, ids = np.concatenate([pure, spread]), np.repeat([0, 1], 8)
    model = quality.fit_ordinal(rows, ids, grades, dimensions=2, l2=quality.L2_ROWS / n)
    assert model.weights[0] < -0.5 and model.weights[1] == 0
    with_word, without = model.tail(np.array([model.weights[0], 0.0]))[:, -1]
    assert with_word < 0.5 < quality.KEEP_FROM < without


def test_toxic_documents_of_every_language(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = read_table(spark, sf, "documents"), quality.graded(read_table(spark, sf, "labels"))
    model = quality.train(docs, labels.filter("doc_id % 4 > 0"))
    rows = quality.score(docs.join(labels.filter("doc_id % 4 = 0"), "doc_id"), model).select("lang", "grade", "tail_probability").collect()
    share = lambda g, lang=None: np.mean([r.tail_probability >= quality.KEEP_FROM for r in rows if r.grade == g and lang in (None, r.lang)])
    assert share(2) > 0.97 and share(0) < 0.05 and share(1) < 0.2
    assert all(share(1, lang) < 0.25 for lang in ("de", "en", "es", "fr"))


# ---- language --------------------------------------------------------------------------------------------


def test_language_accuracy_held_out(spark, documents):
    out = language_id.op5_language_id(spark, SF01).join(documents.select("doc_id", "lang"), "doc_id").collect()
    assert len(out) == documents.count()
    held = [r for r in out if r.held_out]
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.98


def test_filter_counts_are_exact_up_to_false_positives():
    texts = ["the cat sat on the mat", "der hund und die katze"]
    sets = []
    for t in texts:
        s = f" {t} "
        sets.append({s[i : i + n] for n in (3, 4) for i in range(len(s) - n + 1)})
    codes = [np.unique(language_id.gram_codes(large_text(pa.array([t])))[0]) for t in texts]
    assert [len(c) for c in codes] == [len(s) for s in sets]
    model = language_id.LanguageFilters.build(["en", "de"], codes)
    code, owner = language_id.gram_codes(large_text(pa.array([texts[0] + " und"])))
    total, found = model.counts(code, owner, 1)
    s = f" {texts[0]} und "
    grams = [s[i : i + n] for n in (3, 4) for i in range(len(s) - n + 1)]
    assert total[0] == len(grams)
    assert abs(found[0, 0] - sum(g in sets[0] for g in grams)) <= 2 and abs(found[0, 1] - sum(g in sets[1] for g in grams)) <= 2


def test_more_than_64_languages():
    rng = np.random.default_rng(2)
    grams = [rng.integers(0, 2**32, 50).astype(np.uint32) for _ in range(70)]
    model = language_id.LanguageFilters.build([f"l{i}" for i in range(70)], grams)
    for i in (0, 63, 64, 69):
        _, found = model.counts(grams[i], np.zeros(50, np.int64), 1)
        assert found[0].argmax() == i


# ---- SentencePiece ---------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    return sentencepiece_nbest.Vocabulary.load()


def all_segmentations(vocabulary, text):
    text = " " + text
    arcs, memo = vocabulary.lattice(text), {0: [(0, ())]}
    for end in range(1, len(text) + 1):
        memo[end] = [(c + cost, p + ids) for start, cost, ids in arcs[end] for c, p in memo[start]]
    return sorted(memo[len(text)])


@pytest.mark.parametrize("text", ["the cat", "a b\nc", "  x  ", "日本 é", "\n\n", "▁a", "aaaa b", "\na", "a \nb", "a\n b", "a\n", "\x01ab c", "\x02 d", "a  b", "\n \n", " ", "🙂", "in the then"])
def test_n_best_equals_enumeration(vocabulary, text):
    want = all_segmentations(vocabulary, text)
    ids, found = vocabulary.encode(text, 6)
    assert [c for c, _ in found] == [c for c, _ in want[:6]]
    by = {p: c for c, p in want}
    made = [tuple(sentencepiece_nbest.apply_edits(ids, e)) for _, e in found]
    assert len(set(made)) == len(made) and [by[m] for m in made] == [c for c, _ in found]
    assert vocabulary.decode(ids) == text
    chunk = vocabulary.n_best(" " + text, 6)  # the A* search over the whole lattice at once
    assert [c for c, _ in chunk] == [c for c, _ in want[:6]]


def test_decoding_agrees_with_the_library(vocabulary, documents):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_nbest.MODEL_FILE)
    store = sentencepiece_nbest.ChunkStore(vocabulary, limit=500)  # the cache is emptied again and again
    for r in documents.orderBy("doc_id").limit(200).collect():
        ids, _, _ = store.encode([r.text])
        assert model.decode(ids.tolist()) == r.text == vocabulary.decode(ids.tolist())


# ---- HTML ------------------------------------------------------------------------------------------------


def brute_cut(scores, edges):
    best = None
    for labels in itertools.product((True, False), repeat=len(scores)):
        cost = sum(max(s, 0) if not x else max(-s, 0) for s, x in zip(scores, labels)) + sum(w for a, b, w in edges if labels[a] != labels[b])
        if best is None or cost < best - 1e-12:
            best = cost
    return best


def test_min_cut_equals_enumeration():
    rng = np.random.default_rng(3)
    for _ in range(150):
        n = int(rng.integers(1, 10))
        scores = rng.normal(0, 1, n).round(2).tolist()
        edges = [(a, b, float(rng.random() * 1.5)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]
        labels = html_extract.min_cut(scores, edges)
        cost = sum(max(s, 0) if not x else max(-s, 0) for s, x in zip(scores, labels)) + sum(w for a, b, w in edges if labels[a] != labels[b])
        assert cost == pytest.approx(brute_cut(scores, edges))


def test_articles_of_the_driver_pages(spark):
    import html

    def truth(page):
        body = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S).group(1)
        parts = re.split(r"</?(?:p|h1)>", body)
        clean = (" ".join(html.unescape(re.sub(r"</?b>", "", p.replace("<br>", " "))).split()) for p in parts)
        return "\n\n".join(p for p in clean if p)

    pages = read_table(spark, SF01, "pages")
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.op10_html_extract(spark, SF01).collect()}
    for r in pages.collect():
        assert got[r.page_id] == (truth(r.html), len(truth(r.html)))


LAYOUT = """<html><head><title>T</title><style>a{}</style></head><body class="page with-sidebar">
<div id="cookie-notice"><p>We use cookies on this site, please accept them. Thank you.</p></div>
<header class="site-header"><a href="/">Home</a> <a href="/x">News</a></header>
<ul class="main-menu"><li><a href="/a">One</a><li><a href="/b">Two</a></ul>
<div class="wrap"><div class="post-content"><h1>The  title</h1><p>First &amp; foremost, a sentence that&nbsp;is long enough to count. And more.
<div class="advert"><p>Buy this now! It is the best thing you can buy, they say.</p></div>
<p>Short.</p><ul><li>An item of a list</li><li>Another item</li></ul><p>The last paragraph, with <a href="/l">a link</a> inside it, ends here.</p></div>
<aside><p>Other stories that you might like to read, too. Many of them.</p></aside></div>
<form><label>Name</label><input><textarea>write</textarea><button>Send it</button></form>
<div class="comments"><article class="comment"><p>I do not agree with this text at all, and I say so. Really.</p></article></div>
<footer>All rights reserved. <script>var x = "<p>";</script></footer></body></html>"""


def test_boilerplate_of_other_layouts():
    assert html_extract.main_text(LAYOUT).split("\n\n") == [
        "The title", "First & foremost, a sentence that is long enough to count. And more.", "Short.",
        "An item of a list", "Another item", "The last paragraph, with a link inside it, ends here.",
    ]


def test_open_head_and_self_closed_graphics():
    text = "A first sentence that is long enough to count, with a comma. And one more sentence."
    want = [text, text[::-1]]
    body = f"<article><p>{want[0]}</p>%s<p>{want[1]}</p></article>"
    heads = [
        "<html><head><title>T</title><meta charset=utf-8><body>", "<html><head><style>p {}</style><link rel=x href=y>", "<head><title>T</title><bgsound src=a><div>",
        "<html><head><title>T</title></head><body>", "<html><body><head>", "<head><head><script>if (a < b) c()</script>",
    ]
    for head in heads:
        assert html_extract.main_text(head + body % "").split("\n\n") == want, head
    for drawn in ("<svg/>", "<svg class='a > b' />", '<svg viewBox="0 0 1 1" width="1"/>', "<math/>", "<svg><text>no</text></svg>", '<svg title="/>">no</svg>', "<math><mi>no</mi></math>"):
        assert html_extract.main_text("<body>" + body % drawn).split("\n\n") == want, drawn
    assert html_extract.main_text("<head><title>T</title>" + text) == text
    assert html_extract.main_text("<head><title>T</title><meta name=a>\n</head>") == ""


# ---- PII -------------------------------------------------------------------------------------------------


def test_surrogates(spark):
    docs = spark.createDataFrame([
        (1, "Mr. John Smith wrote to john.s@mail.example.com, JOHN.S@MAIL.EXAMPLE.COM and Ms. Smith; +1 (017) 555-7713 or +1%%% (017)### 555-7713$$$"),
        (2, "Анна Петрова и Иван Петров, card 4111 1111 1111 1111 / 4111111111111111 / 1234567812345678, ip 10.1.2.3, 97.51.17.173, ssn 123-45-6789"),
        (3, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" GB82 WEST 1234 5698 7654 32 JOHN SMITH'),
        (4, "Nothing here. Version 2.0.1 of 12345, The End Of It."),
    ], "doc_id long, text string")
    out = {r.doc_id: r for r in pii.pseudonymise(docs, "k").collect()}
    again = {r.doc_id: r.text for r in pii.pseudonymise(docs.repartition(5), "k").collect()}
    assert again == {k: r.text for k, r in out.items()}
    assert out[4].text == docs.filter("doc_id = 4").first().text and out[4].n_entities == 0
    one = re.fullmatch(r"Mr\. (\w+) (\w+) wrote to (\S+@\S+), (\S+@\S+) and Ms\. (\w+); \+1 \((\d{3})\) (\d{3}-\d{4}) or \+1%%% \((\d{3})\)### (\d{3}-\d{4})\$\$\$", out[1].text)
    first, last, mail, upper, other, a, b, c, d = one.groups()
    assert first in pii.FIRST_NAMES["male_latin"] and first != "John" and last == other != "Smith" and mail.upper() == upper and (a, b) == (c, d) != ("017", "555-7713")
    assert out[3].text.endswith(f"{first.upper()} {last.upper()}")
    two = re.match(r"(\w+) (\w+) и (\w+) (\w+), card (\d{4} \d{4} \d{4} \d{4}) / (\d{16}) / (\d{16}), ip (10\.\d+\.\d+\.\d+), (\d+\.\d+\.\d+\.\d+), ssn (\d{3}-\d\d-\d{4})", out[2].text).groups()
    assert two[0] in pii.FIRST_NAMES["female_cyrillic"] and two[2] in pii.FIRST_NAMES["male_cyrillic"] and two[1].endswith("а")
    assert two[4].replace(" ", "") == two[5]

    def luhn(x):
        return sum(sum(divmod(int(ch) * (2 - i % 2), 10)) for i, ch in enumerate(x)) % 10

    assert luhn(two[5]) == 0 and luhn(two[6]) != 0


def test_surrogates_stay_distinct(spark, monkeypatch):
    """A draw with few outcomes: collisions are drawn anew until all differ and none is real."""
    real = pii._surrogate

    def narrow(kind, value, attempt, key):
        return F.concat(F.substr(real(kind, value, attempt, key), F.lit(1), F.lit(1 + attempt // 3)), F.lit("x"))

    monkeypatch.setattr(pii, "_surrogate", narrow)
    values = [("secret", f"{i:032x}") for i in range(60)] + [("secret", "3x"), ("ssn", "111223333")]
    got = pii.surrogates(spark.createDataFrame(values, "kind string, value string")).collect()
    assert len(got) == len(values)
    assert len({(r.kind, r.surrogate) for r in got}) == len(values)
    assert not {r.surrogate for r in got} & {v for _, v in values}


def test_no_entity_survives(spark, documents):
    out = {r.doc_id: r for r in pii.op6_pii_surrogates(spark, SF01).collect()}
    patterns = [r"\S+@\S+\.\w+", r"\(\d{3}\)\W{1,5}\d{3}-\d{4}", r"\b\d{16}\b", r"\b[0-9a-fA-F]{40}\b", r"\b\d+\.\d+\.\d+\.\d+\b"]
    maps = defaultdict(set)
    for r in documents.collect():
        changed = False
        for p in patterns:
            old, new = re.findall(p, r.text), re.findall(p, out[r.doc_id].text)
            assert len(old) == len(new) and not set(old) & set(new)
            changed |= bool(old)
            for x, y in zip(old, new):
                maps[re.sub(r"[^\w.@]|_", "", x).lower()].add(re.sub(r"[^\w.@]|_", "", y).lower())
        assert changed or out[r.doc_id].text == r.text
    assert maps and all(len(v) == 1 for v in maps.values())  # coreference
    assert len({next(iter(v)) for v in maps.values()}) == len(maps)  # distinctness


# ---- fingerprints ----------------------------------------------------------------------------------------


def brute_order_minhash(kmers, hashes):
    """Components from hashes of (k-mer, occurrence), by the definition."""
    seen, buckets = Counter(), defaultdict(list)
    for pos, k in enumerate(kmers):
        h = hashes[k, seen[k]] >> 20
        seen[k] += 1
        buckets[h >> (44 - fingerprint._BITS)].append((h, pos))
    out = {}
    for b, own in buckets.items():
        out[b] = tuple(h for h, _ in sorted(sorted(own)[: fingerprint.LENGTH], key=lambda x: (x[1], x[0])))
    return out


def test_components_equal_the_definition(spark):
    texts = {1: "a b c a b c a b c d e f", 2: "to be or not to be that is to be or not", 3: "one", 4: "", 5: "x y", 6: "日本語 のテキスト です"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    made = {r.doc_id: r.fp for r in fingerprint.with_fingerprint(df, "text", "fp").collect()}
    words = {k: re.findall(r"[぀-ヿ一-鿿]|[^\s぀-ヿ一-鿿]{1,16}", t) for k, t in texts.items()}
    kmers = {k: [tuple(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([tuple(w)] if w else []) for k, w in words.items()}
    every = sorted({(k, o) for own in kmers.values() for k in own for o in range(5)})
    rows = spark.createDataFrame([(list(k), o) for k, o in every], "k array<string>, o int")
    code = F.xxhash64(F.shiftright(F.xxhash64("k").bitwiseAND(~fingerprint._POSITION), 20), "o")
    hashes = {(tuple(r.k), r.o): r.h for r in rows.select("k", "o", code.alias("h")).collect()}
    tuples = {}
    for key, own in kmers.items():
        want = brute_order_minhash(own, hashes)
        for b in range(-fingerprint.BUCKETS // 2, fingerprint.BUCKETS // 2):
            got = made[key][b + fingerprint.BUCKETS // 2]
            assert (got == 0) == (b not in want)
            if got:  # equal components exactly for equal tuples
                assert tuples.setdefault(want[b], got) == got
    assert len(set(tuples.values())) == len(tuples)


def test_order_matters(spark):
    a = [f"w{i}" for i in range(300)]
    halves = a[150:] + a[:150]
    df = spark.createDataFrame([(1, " ".join(a), " ".join(a[:-3])), (2, " ".join(a), " ".join(halves)), (3, " ".join(a), " ".join(f"v{i}" for i in range(300)))], "doc_id long, t string, s string")
    both = fingerprint.with_fingerprint(fingerprint.with_fingerprint(df, "t", "x"), "s", "y")
    near = {r.doc_id: r.n for r in both.select("doc_id", fingerprint.likeness(F.col("x"), F.col("y")).alias("n")).collect()}
    assert near[1] > 0.9 and near[1] > near[2] + 0.1 and near[3] == 0.0


def test_next_keys_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "ONE_TASK_KEYS", 8)
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 5)
    keys = sorted({int(x) for x in np.random.default_rng(4).pareto(0.7, 300) * 50})
    got = {r.key: r.next for r in fingerprint.next_keys(spark.createDataFrame([(k,) for k in keys], "key long")).collect()}
    assert got == dict(zip(keys, [*keys[1:], None]))


# ---- pipeline --------------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    docs = read_table(spark, SF001, "documents")
    columns = docs.columns
    from slotwise.llm.common import materialise

    kept = materialise(cp.keep_quality(spark, docs, SF001))
    assert kept.columns == columns and kept.join(docs, columns, "left_anti").count() == 0
    lines = materialise(cp.drop_repeated_lines(spark, kept, SF001))
    assert lines.columns == columns and lines.count() == kept.count()
    assert lines.filter(F.col("n_chars") != F.length("text")).count() == 0
    single = materialise(cp.keep_one_per_group(spark, lines, SF001))
    texts = {r.doc_id: r.text for r in lines.collect()}
    links = brute_links(texts)
    label = {}
    for k in sorted(texts):
        todo = [k]
        while todo:
            x = todo.pop()
            if x not in label:
                label[x] = k
                todo += links[x]
    assert {r.doc_id for r in single.collect()} == set(label.values())
    clean = materialise(cp.drop_benchmark_leaks(spark, single, SF001))
    norm = lambda t: " ".join(re.findall(r"[^\W\d_]+", t.lower()))
    items = [norm(r.text) for r in read_table(spark, SF001, "benchmark").collect()]
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect() if not any(t in norm(r.text) for t in items)}
    out = cp.encode_pieces(spark, clean, SF001).collect()
    assert len(out) == clean.count() and all(r.round_trip for r in out)
    assert sorted(r.doc_id for r in cp.run(spark, SF001).collect()) == sorted(r.doc_id for r in out)
