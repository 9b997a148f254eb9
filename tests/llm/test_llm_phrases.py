"""Phrase collocations against a plain count of every phrase."""

import random
import re
from collections import Counter

import pytest

from slotwise.llm import collocations as C


def brute(rows, least, top):
    """lang -> ranked (phrase, a, l, r, n, score), by the definition."""
    out = {}
    for lang in {r[1] or "und" for r in rows}:
        counts, n = Counter(), 0
        for text in [r[0] or "" for r in rows if (r[1] or "und") == lang]:
            lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
                words = re.findall("[^ \t]+", piece)
                n += len(words)
                for k in range(1, 6):
                    counts.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        scored = []
        for p, a in found.items():
            if inside[p] < a:
                score, _, left, right = min((1000 * a * n // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                scored.append((" ".join(p), a, left, right, n, score))
        scored.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        out[lang] = scored[:top]
    return out


def mined(spark, rows, top):
    df = spark.createDataFrame(rows, "text string, lang string, phrase int, rank string").repartition(3)
    got = {}
    for r in C.mine(df, top).orderBy("lang", "rank").collect():
        ranked = got.setdefault(r["lang"], [])
        ranked.append((r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]))
        assert r["rank"] == len(ranked)
    return got


def corpus():
    rng = random.Random(4)
    words = ["a", "b", "Ab", "c-d", "é", "ÉT", "x_1", "the", "of", "\x1cq", "zz"]
    ends = [" ", " ", " ", "  ", "\t", ".", ", ", "\n", "\r\n", "?"]
    make = lambda k: "".join(rng.choice(words[:k]) + rng.choice(ends) for _ in range(rng.randint(0, 60)))
    rows = [(make(11), "en", 1, "x") for _ in range(60)] + [(make(4), "fr", 2, "y") for _ in range(15)] + [(make(6), None, 3, "z") for _ in range(10)]
    rows += [("one two three four five six seven", "en", 1, "copy")] * 9 + [(None, "en", 1, "x"), ("", None, 1, "x"), ("word " * 40, "de", 1, "w"), (None, "it", 1, "w")]
    return rows


@pytest.mark.parametrize(("top", "opening"), [(2000, 4), (5, 1)])
def test_phrases_equal_the_definition(spark, monkeypatch, top, opening):
    monkeypatch.setattr(C, "LEAST", 4)
    monkeypatch.setattr(C, "OPENING", opening)
    monkeypatch.setattr(C, "SEGMENT", 300)
    rows = corpus()
    want = {k: v for k, v in brute(rows, 4, top).items() if v}
    assert mined(spark, rows, top) == want


def test_words_that_pass_a_filter_wrongly_are_grown_once(spark, monkeypatch):
    """2000 words open first and 2600 next: filters of their numbers differ in size.

    Some of the 300 common words, open in the third round, pass the first filter wrongly.
    """
    monkeypatch.setattr(C, "LEAST", 2)
    monkeypatch.setattr(C, "OPENING", 1)
    rare, some, often = ([f"{x}{i}" for i in range(k)] for x, k in (("r", 2000), ("s", 600), ("o", 300)))
    pairs = [f"{w} {often[i % 300]}" for i, w in enumerate(rare)] * 2 + [f"{w}, {w}, {w}" for w in some]
    rows = [(". ".join(pairs[i : i + 500]), "en", 1, "x") for i in range(0, len(pairs), 500)]
    assert mined(spark, rows, 5000) == brute(rows, 2, 5000)


def test_no_text_no_phrase(spark):
    assert mined(spark, [(None, None, 1, "x")], 10) == {}
    df = spark.createDataFrame([], "text string, lang string")
    assert C.mine(df).count() == 0


def test_filters_hold_their_members(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    keys = rng.integers(-(2**63), 2**63 - 1, 5000)
    data, bits = C.bloom(spark.createDataFrame([(int(k),) for k in keys], "salted long"), len(keys))
    asked = C.Filter(data, bits)
    assert asked(keys.view(np.uint64)).all()
    assert asked(rng.integers(-(2**63), 2**63 - 1, 20000).view(np.uint64)).mean() < 0.05
