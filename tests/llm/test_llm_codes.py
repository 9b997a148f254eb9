"""Byte-level BPE against the tokenizers library, vector codes against a plain Lloyd in integers."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from slotwise.llm import bpe, vector_codes
from slotwise.llm.common import read_table

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


# ---- byte-level BPE ----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.tokenizer_path())


@pytest.fixture(scope="module")
def vocab():
    return bpe.Vocabulary(bpe.tokenizer_path())


def same(vocab, library, texts):
    for text, packed in zip(texts, vocab.encode(texts)):
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(packed, "<u4").tolist() == ids, text[:80]
        assert vocab.decode(packed) == library.decode(ids, skip_special_tokens=False)


def test_pieces_of_every_code_point(library):
    split = library.pre_tokenizer.pre_tokenize_str
    for cp in [*range(0xD800), *range(0xE000, 0x110000)]:
        for text in ("a" + chr(cp), "1" + chr(cp), "!" + chr(cp)):
            assert len(bpe.pieces(text)) == len(split(text)), hex(cp)


def test_every_document(vocab, library):
    from pyarrow import parquet

    same(vocab, library, parquet.read_table(f"{SF01}/documents.parquet").column("text").to_pylist())


def test_random_texts(vocab, library):
    rng = random.Random(7)
    parts = ["a", "b", "ab", " ", "  ", "\n", "\t", "　", "é", "ß", "中", "文", "1", "23", "²", "'s", "'t", "don't", "!", "...", "<|endoftext|>", "<|end", "😀", "\x1c", "́", "the", "ing", "=", "_", "\r\n", "\U000323b0", "\x00"]
    same(vocab, library, ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(20000)])


def test_long_words_and_blocks(vocab, library, monkeypatch):
    rng = random.Random(3)
    letters = "".join(rng.choice("abcdefghij") for _ in range(100000))
    same(vocab, library, ["a" * 100000, "ab" * 30000, letters, "=" * 5000, " " * 5000, "x" * 64, "x" * 65, "é" * 40])
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 7)
    monkeypatch.setattr(bpe, "BLOCK_PIECES", 5)
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 11)
    monkeypatch.setattr(bpe, "CACHED", 20)
    same(vocab, library, ["one  two\n three four   five six", "seven eight nine ten \n\n eleven twelve", " " * 40 + "a b c d e f", letters[:300], ""])


def test_decoding_of_any_ids(vocab, library):
    rng = random.Random(5)
    for _ in range(2000):
        ids = [rng.randrange(50257) for _ in range(rng.randint(0, 8))]
        assert vocab.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_bpe_rows(spark, library):
    rows = [(1, "Hi there", "x"), (1, "Hi there", "y"), (None, None, None), (2, "", "z"), (3, "a" * 3000, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.encode(docs, keep=["doc_id", "ids"], emit=["ids", "n_tokens", "decoded", "packed"])
    assert got.columns == ["doc_id", "ids", "n_tokens", "decoded", "packed"]
    found = sorted(((r.doc_id or 0, r.n_tokens, r.decoded, r.ids) for r in got.collect()), key=str)
    want = sorted(((i or 0, len(library.encode(t or "", add_special_tokens=False).ids), t or "", library.encode(t or "", add_special_tokens=False).ids) for i, t, _ in rows), key=str)
    assert found == want
    back = bpe.decode(got.select("doc_id", "ids"))
    assert sorted(r.decoded for r in back.collect()) == sorted(t or "" for _, t, _ in rows)
    assert bpe.encode(docs.limit(0)).count() == 0


def test_bpe_query(spark, library):
    texts = {r.doc_id: r.text or "" for r in read_table(spark, SF001, "documents").collect()}
    for r in bpe.op13_bpe(spark, SF001).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


# ---- vector codes ------------------------------------------------------------------------------------------


def floor_scaled(x):
    from fractions import Fraction

    y = Fraction(x) * 4096
    return y.numerator // y.denominator


def lloyd(vectors, parts=8, entries=16, rounds=6):
    """Codes, errors and books of vectors given in the order of their ids, by the definition."""
    rows = [[floor_scaled(x) for x in v] for v in vectors]
    w = len(rows[0]) // parts
    cut = [[tuple(v[p * w : (p + 1) * w]) for p in range(parts)] for v in rows]
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda p, x: min((far(x, e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            mine = [near(p, v[p])[1] for v in cut]
            for k in range(len(books[p])):
                chosen = [v[p] for v, m in zip(cut, mine) if m == k]
                if chosen:
                    books[p][k] = tuple(sum(c) // len(chosen) for c in zip(*chosen))
    found = [[near(p, v[p]) for p in range(parts)] for v in cut]
    text = ",".join(str(x) for b in books for e in b for x in e)
    return ["".join(f"{k:02x}" for _, k in f) for f in found], [sum(d for d, _ in f) for f in found], hashlib.sha256(text.encode()).hexdigest()


def codes_of(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, codes string")
    state, books = vector_codes.compress(df, **how)
    return {r.id: (r.codes.hex(), r.dist) for r in state.collect()}, books.digest()


def test_codes_of_small_vectors_with_ties(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-1, 0, 0, 1, 2]) / 4096 for _ in range(16)], i % 3, "x") for i in range(300)]
    got, digest = codes_of(spark, rows)
    codes, errors, want = lloyd([r[1] for r in rows])
    assert digest == want
    assert [got[i][0] for i in range(300)] == codes and [sum(got[i][1]) for i in range(300)] == errors


def test_codes_of_huge_components(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([1e300, -1e300, 0.1, 3e15, 1e9]) for _ in range(8)], 0, None) for i in range(60)]
    got, digest = codes_of(spark, rows, entries=4, rounds=3)
    codes, errors, want = lloyd([r[1] for r in rows], entries=4, rounds=3)
    assert digest == want and [got[i][0] for i in range(60)] == codes


def test_only_moved_entries_are_compared(monkeypatch):
    seen = []
    real = vector_codes._distances
    monkeypatch.setattr(vector_codes, "_distances", lambda points, entry: seen.append((entry, len(points))) or real(points, entry))
    points = np.array([[0], [10], [21]])
    code, far = vector_codes.reassign(points, [(0,), (9,), (30,)], None, np.zeros(3, np.int64), np.full(3, -1))
    assert code.tolist() == [0, 1, 2] and far.tolist() == [0, 1, 81]
    seen.clear()
    code, far = vector_codes.reassign(points, [(0,), (9,), (21,)], [False, False, True], code, far)
    assert code.tolist() == [0, 1, 2] and far.tolist() == [0, 1, 0]
    assert seen == [((0,), 1), ((9,), 1), ((21,), 3)]  # the third point's entry moved, the others look at it alone
    seen.clear()
    code, far = vector_codes.reassign(np.array([[5]]), [(0,), (10,)], [True, False], np.array([1]), np.array([25]))
    assert code.tolist() == [0] and seen == [((0,), 1)]  # an equal distance goes to the lower index


def test_codes_drop_and_keep(spark):
    nan, inf = float("nan"), float("inf")
    good = [(7, [0.5] * 8, 1, "a"), (7, [0.25] * 8, None, "a"), (None, [1.0] * 8, None, "b")]
    bad = [(1, None, 1, "c"), (2, [nan] * 8, 1, "c"), (3, [inf] + [0.0] * 7, 1, "c"), (4, [None] + [0.0] * 7, 1, "c"), (5, [], 1, "c"), (6, [1.0] * 9, 1, "c")]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>, label int, dist string")
    state, books = vector_codes.compress(df)
    assert sorted((r.id or 0, r.codes.hex()) for r in state.collect()) == [(0, "02" * 8), (7, "00" * 8), (7, "01" * 8)]
    empty, books = vector_codes.compress(df.filter("vec_id = 1"))
    assert empty.count() == 0 and books.digest() == hashlib.sha256(b"").hexdigest()


def test_label_error(spark):
    rows = [(1, 5, 1), (2, 7, 1), (3, 1, None), (4, 2, None), (5, None, 2), (6, 1, 2), (7, 2**62, 3), (8, 2**62, 3)]
    for share in (1, 4, 200):
        vector_codes.HOT_SHARE, old = share, vector_codes.HOT_SHARE
        try:
            out = vector_codes.with_label_error(spark.createDataFrame(rows, "vec_id long, error long, label int"))
            assert {r.vec_id: r.label_error for r in out.collect()} == {1: 12, 2: 12, 3: 3, 4: 3, 5: None, 6: None, 7: None, 8: None}
        finally:
            vector_codes.HOT_SHARE = old


def test_vector_query(spark):
    rows = sorted((r.vec_id, r.embedding, r.label) for r in read_table(spark, SF001, "embeddings").filter(F.col("embedding").isNotNull()).collect())
    codes, errors, digest = lloyd([v for _, v, _ in rows])
    got = {r.vec_id: r for r in vector_codes.op12_vector_codes(spark, SF001).collect()}
    assert [got[i].code for i, _, _ in rows] == codes and [got[i].error for i, _, _ in rows] == errors
    assert {r.codebooks_sha256 for r in got.values()} == {digest}


# ---- ties of the N-best pieces -------------------------------------------------------------------------------


def test_tied_pieces_end_and_cost_what_enumeration_says():
    from slotwise.llm.sentencepiece_nbest import Vocabulary

    pieces = Vocabulary.load()
    assert len(pieces.n_best("aaaaaaa|" * 1000, 4)) == 4

    def every(word):
        arcs = pieces.lattice(word)
        ways = [[0]] + [[] for _ in word]
        for end in range(1, len(word) + 1):
            ways[end] = [cost + before for start, cost, _ in arcs[end] for before in ways[start]]
        return sorted(ways[-1])

    for word in ("aaaaaaa|", "aaaa|aaaa|", "ababab", "|||||"):
        assert [cost for cost, _ in pieces.n_best(word, 6)] == every(word)[:6]
