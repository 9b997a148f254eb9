"""Byte-level BPE encoding and decoding by dynamic programming over prefixes.

The BPE encoding of a piece of text is the only sequence of tokens whose
neighbours are all *compatible*: merging by rank would never have joined
anything across the border between the two.  So every prefix of a piece has one
last token, found left to right without running the merges:

1. the automaton of the vocabulary reports, for every prefix, the tokens that are
   suffixes of it;
2. of these, the one compatible with the stored last token of the prefix in
   front of it is the last token of this prefix (there is exactly one);
3. following the stored tokens back from the end gives the ids.

The work is linear in the text: a word of a million letters takes no other path.

The pieces that a block of text shows for the first time are solved together, as
numpy arrays: matches come from a trie walked from every byte at once and are dealt
with by their end, longest first; pair tests go down the merges of both sides in
step.

Cases.  A null text is an empty one and has no tokens.  The strings of special
tokens inside a text give their ids, as ``encode`` of the tokenizer does when
special tokens are only not *added*.  Rows repeat as often as they occur, an
empty table gives an empty result.  Input columns kept beside the result keep
their names; one that is named like an emitted column gives way to it.  Texts
are handled whole, in blocks that end where a pre-token ends.  A worker remembers
a bounded number of short pieces and of pair tests; that never changes a result.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import struct
import sys
import unicodedata
from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from slotwise.llm.common import GOLDEN, column, large_text, read_table, text_chunks

#: Tokenizer file of the registered query.
TOKENIZER = "byte_bpe_50k.json"
#: A worker remembers pieces of at most this many characters, in two generations of CACHED each.
CACHED_CHARS = 32
CACHED = 600_000
#: Remembered pair tests, as a power of two.
PAIR_BITS = 20
#: Characters of a block of one text, pre-tokens and bytes of new pre-tokens handled at once.
BLOCK_CHARS = 1 << 20
BLOCK_PIECES = 1 << 18
BLOCK_BYTES = 1 << 19
#: Pieces of more bytes are solved one by one.
LONG_BYTES = 64

# The pre-tokenizer's pattern (letters L and digits N filled in below)
# and the letters and digits that Unicode 16.0 has beyond 15.1, as code point ranges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?(?:(?!\s|{L}|{N}).)+|\s+(?!\S)|\s+"
LETTERS_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
DIGITS_16 = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))

_ANY = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# the same pattern for the standard module, for texts of Latin letters alone: there \w without \d and _ is \p{L}, \d is \p{N}
_LATIN = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\w\t-\r \x85\xa0]|_)+|[\t-\r \x85\xa0]+(?![^\t-\r \x85\xa0])|[\t-\r \x85\xa0]+")
_BEYOND_LATIN = re.compile("[\xb2\xb3\xb9\xbc-\xbe\u0250-\U0010ffff]")


@functools.lru_cache(maxsize=1)
def _newer() -> tuple[regex.Pattern, regex.Pattern]:
    """Code points that this ``regex`` calls letters or digits and the tokenizer does
    not yet, and the pattern without them.

    ``regex`` follows a newer Unicode than the tokenizer (16.0), Python an older one:
    a letter or digit unknown to Python and outside the 16.0 ranges is too new.
    """
    known = {c for lo, hi in LETTERS_16 + DIGITS_16 for c in range(lo, hi + 1)}
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
    new = [ord(c) for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn" and ord(c) not in known]
    firsts = [c for k, c in enumerate(new) if not k or new[k - 1] != c - 1]
    lasts = [c for k, c in enumerate(new) if k == len(new) - 1 or new[k + 1] != c + 1]
    chars = "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(firsts, lasts)) + "]" if new else r"[^\s\S]"
    letters, digits = rf"(?:(?!{chars})\p{{L}})", rf"(?:(?!{chars})\p{{N}})"
    return regex.compile(chars), regex.compile(PATTERN.replace("{L}", letters).replace("{N}", digits), regex.DOTALL)


def pieces(text: str) -> list[str]:
    """The pre-tokens of a text; joined they are the text."""
    if text.isascii() or not _BEYOND_LATIN.search(text):
        return _LATIN.findall(text)
    newer, pattern = _newer()
    return (pattern if newer.search(text) else _ANY).findall(text)


def blocks(text: str) -> Iterator[str]:
    """A text in stretches of about BLOCK_CHARS, cut before a space that follows no white
    space: a pre-token begins there whatever comes before or after."""
    start = 0
    while len(text) - start > BLOCK_CHARS:
        cut = text.find(" ", start + BLOCK_CHARS)
        while cut > 0 and text[cut - 1].isspace():
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[start:cut]
        start = cut
    yield text[start:] if start else text


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Table:
    """Hash table from non-negative 64-bit keys to non-negative 32-bit values, as arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, -1, np.int32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.keys[slot] < 0
            _, first = np.unique(slot, return_index=True)  # one newcomer per free place and round
            put = first[free[first]]
            self.keys[slot[put]], self.values[slot[put]] = keys[todo[put]], values[todo[put]]
            rest = np.ones(len(todo), bool)
            rest[put] = False
            todo, slot = todo[rest], (slot[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * GOLDEN) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of every key, -1 where there is none."""
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], -1)
        todo = np.flatnonzero((held != keys) & (held >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            held = self.keys[slot[todo]]
            same = held == keys[todo]
            out[todo[same]] = self.values[slot[todo[same]]]
            todo = todo[~same & (held >= 0)]
        return out


class Vocabulary:
    """Tokens, merges, the trie of the tokens and the pair tests of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        ids: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t["special"]}
        self.special_pattern = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.tokens: list[bytes] = [b""] * (1 + max([*ids.values(), *self.special.values()]))
        for name, i in ids.items():
            self.tokens[i] = bytes(byte_of[c] for c in name)
        for name, i in self.special.items():
            self.tokens[i] = name.encode()
        self.lens = np.array([len(t) for t in self.tokens], np.int64)
        self.starts = np.cumsum(self.lens) - self.lens
        self.flat = np.frombuffer(b"".join(self.tokens), np.uint8)
        # rank of the merge of a pair; halves and rank of every merged token (single bytes: rank -1)
        self.left = np.arange(len(self.tokens))
        self.right = self.left.copy()
        self.made = np.full(len(self.tokens), -1, np.int64)
        ranks: dict[int, int] = {}
        for r, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            whole = ids[a + b]
            ranks.setdefault(ids[a] << 32 | ids[b], r)
            if self.made[whole] < 0:
                self.left[whole], self.right[whole], self.made[whole] = ids[a], ids[b], r
        self.end = len(spec["model"]["merges"])
        self.rank_of = ranks
        self.halves = list(zip(self.left.tolist(), self.right.tolist(), self.made.tolist()))
        self.ranks = Table(np.array(list(ranks), np.int64), np.array(list(ranks.values()), np.int32))
        self.pair_keys = np.full(1 << PAIR_BITS, -1, np.int64)
        self.pair_fits = np.zeros(1 << PAIR_BITS, bool)
        # a token that the merges do not make of its own bytes is none
        usable = np.array([i for name, i in ids.items() if name not in self.special and (self.made[i] >= 0 or self.lens[i] == 1)])
        merged = self.made[usable] >= 0
        reached = ~merged
        reached[merged] = self._meet(self.left[usable[merged]], self.right[usable[merged]], self.made[usable[merged]])
        self.single = {self.tokens[i]: int(i) for i in usable[reached]}
        nodes: dict[int, int] = {}
        token_at = {0: -1}
        for word, i in self.single.items():
            node = 0
            for byte in word:
                node = nodes.setdefault(node << 8 | byte, len(nodes) + 1)
            token_at[node] = i
        self.trie = Table(np.array(list(nodes), np.int64), np.array(list(nodes.values()), np.int32))
        self.token_at = np.array([token_at.get(k, -1) for k in range(len(nodes) + 1)], np.int64)
        self.matcher = ahocorasick.Automaton()
        for word, i in self.single.items():
            self.matcher.add_word(word.decode("latin-1"), (i, len(word)))
        self.matcher.make_automaton()
        self._pieces: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def _meet(self, a: np.ndarray, b: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Whether no merge of a rank below ``before`` crosses the border of tokens a and b.

        At the border, a shows in turn the tokens down its right edge and b those down its
        left edge.  Each is there from its own merge until the merge that swallows it; two
        that are there at the same time and have a merge of a rank in that time would join.
        Of equal ranks the one further left goes first, so a's own merge beats the crossing
        one and the crossing one beats b's.
        """
        fits = np.ones(len(a), bool)
        at = np.arange(len(a))
        a, b, ends_a, ends_b, end = a.copy(), b.copy(), before.copy(), before.copy(), before
        while len(at):
            rank = self.ranks.get(a << 32 | b)
            joins = (rank >= 0) & (rank < ends_a) & ((rank < ends_b) | ((rank == ends_b) & (ends_b < end)))
            fits[at[joins]] = False
            made_a, made_b = self.made[a], self.made[b]
            go = ~joins & ((made_a >= 0) | (made_b >= 0))
            at, a, b, ends_a, ends_b, end, made_a, made_b = (x[go] for x in (at, a, b, ends_a, ends_b, end, made_a, made_b))
            undo_a = made_a > made_b  # step back before the later of the two merges
            ends_a, ends_b = np.where(undo_a, made_a, ends_a), np.where(undo_a, ends_b, made_b)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
        return fits

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether token b may follow token a inside a piece, for arrays of pairs."""
        keys = a << 32 | b
        slot = ((keys.view(np.uint64) * GOLDEN) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        fits = self.pair_fits[slot]
        new = np.flatnonzero(self.pair_keys[slot] != keys)
        if len(new):
            pairs, back = np.unique(keys[new], return_inverse=True)
            found = self._meet(pairs >> 32, pairs & 0xFFFFFFFF, np.full(len(pairs), self.end))
            fits[new] = found[back]
            slot = ((pairs.view(np.uint64) * GOLDEN) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
            _, one = np.unique(slot, return_index=True)  # of pairs with one place, one is remembered
            self.pair_keys[slot[one]], self.pair_fits[slot[one]] = pairs[one], found[one]
        return fits

    def last_tokens(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The last token of every prefix of every piece.

        ``data`` are the bytes of the pieces, piece k from ``offsets[k]`` on.  Prefixes
        are numbered ``offsets[k] + k + length``; the empty ones hold -1.
        """
        piece = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        at, begin, node, limit = np.arange(len(data)), np.arange(len(data)), np.zeros(len(data), np.int64), offsets[1:][piece]
        begins, sizes, tokens = [], [], []
        size = 0
        while len(at):
            node = self.trie.get(node << 8 | data[at]).astype(np.int64)
            size += 1
            on = node >= 0
            at, begin, node, limit = at[on] + 1, begin[on], node[on], limit[on]
            token = self.token_at[node]
            whole = token >= 0
            begins.append(begin[whole])
            tokens.append(token[whole])
            sizes.append(np.full(len(begins[-1]), size))
            on = at < limit
            at, begin, node, limit = at[on], begin[on], node[on], limit[on]
        begin, size, token = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (begins, sizes, tokens))
        own = piece[begin]
        length = begin + size - offsets[:-1][own]
        order = np.lexsort((-size, length))
        begin, size, token, own, length = (x[order] for x in (begin, size, token, own, length))
        cuts = np.flatnonzero((np.diff(length) != 0) | (np.diff(size) != 0)) + 1
        last = np.full(len(data) + len(offsets), -1, np.int64)
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(token)]):
            to = begin[lo:hi] + own[lo:hi] + size[lo:hi]
            open_ = np.flatnonzero(last[to] < 0)
            if not len(open_):
                continue
            to, new = to[open_], token[lo:hi][open_]
            if size[lo] < length[lo]:
                fits = self.compatible(last[to - size[lo]], new)
                to, new = to[fits], new[fits]
            last[to] = new
        return last

    def encode_pieces(self, words: list[str]) -> list[bytes]:
        """Packed ids of pre-tokens: prefixes solved together, then back-pointers followed from the ends."""
        raw = [w.encode("utf-8") for w in words]
        single = self.single
        out = [b""] * len(raw)
        hard = []
        for k, word in enumerate(raw):
            token = single.get(word)
            if token is not None:
                out[k] = struct.pack("<I", token)
            elif len(word) > LONG_BYTES:
                out[k] = self._encode_long(word)
            else:
                hard.append(k)
        while hard:
            total, some = 0, []
            while hard and (not some or total + len(raw[hard[-1]]) <= BLOCK_BYTES):
                some.append(hard.pop())
                total += len(raw[some[-1]])
            data = np.frombuffer(b"".join([raw[k] for k in some]), np.uint8).astype(np.int64)
            offsets = np.concatenate([[0], np.cumsum([len(raw[k]) for k in some])]).astype(np.int64)
            last = self.last_tokens(data, offsets)
            at = offsets[1:] + np.arange(len(some))
            own, first = np.arange(len(some)), offsets[:-1] + np.arange(len(some))
            pieces_, ids = [], []
            while len(at):
                token = last[at]
                pieces_.append(own)
                ids.append(token)
                at = at - self.lens[token]
                on = at > first[own]
                at, own = at[on], own[on]
            own, token = np.concatenate(pieces_)[::-1], np.concatenate(ids)[::-1]
            packed = token[np.argsort(own, kind="stable")].astype("<u4").tobytes()
            ends = np.cumsum(np.bincount(own, minlength=len(some))) * 4
            for k, lo, hi in zip(some, [0, *ends.tolist()], ends.tolist()):
                out[k] = packed[lo:hi]
        return out

    def _fits(self, a: int, b: int) -> bool:
        """:meth:`compatible` for one pair."""
        ends_a = ends_b = self.end
        while True:
            rank = self.rank_of.get(a << 32 | b)
            if rank is not None and rank < ends_a and (rank < ends_b or rank == ends_b < self.end):
                return False
            made_a, made_b = self.halves[a][2], self.halves[b][2]
            if made_a < 0 and made_b < 0:
                return True
            if made_a > made_b:
                ends_a, a = made_a, self.halves[a][1]
            else:
                ends_b, b = made_b, self.halves[b][0]

    def _encode_long(self, word: bytes) -> bytes:
        """Packed ids of one long piece, position by position over the automaton's matches."""
        last = [-1] * (len(word) + 1)
        known: dict[int, bool] = {}
        for at, (token, size) in self.matcher.iter(word.decode("latin-1")):
            at += 1
            if last[at] < 0:
                if at > size:
                    before = last[at - size]
                    key = before << 32 | token
                    fits = known.get(key)
                    if fits is None:
                        fits = known[key] = self._fits(before, token)
                    if not fits:
                        continue
                last[at] = token
        ids, at = [], len(word)
        while at:
            ids.append(last[at])
            at -= len(self.tokens[ids[-1]])
        return np.array(ids[::-1], "<u4").tobytes()

    def _solved(self, wanted: set[str]) -> dict[str, bytes]:
        """Packed ids of at least the wanted pre-tokens, remembered or solved together."""
        if len(self._pieces) + len(wanted) > CACHED:
            self._older, self._pieces = {p: ids for p, ids in self._pieces.items() if len(p) <= CACHED_CHARS}, {}
        known, older = self._pieces, self._older
        missing = wanted.difference(known)
        again = {p: older[p] for p in missing if p in older}
        known.update(again)
        new = list(missing.difference(again))
        known.update(zip(new, self.encode_pieces(new)))
        return known

    def _parts(self, text: str) -> Iterator[str | list[str]]:
        """A text as special tokens (strings) and blocks of pre-tokens (lists)."""
        if self.special_pattern is None or not self.special_pattern.search(text):
            yield from map(pieces, blocks(text))
            return
        for k, part in enumerate(self.special_pattern.split(text)):
            if k % 2:
                yield part
            else:
                yield from map(pieces, blocks(part))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, str | list[str]]] = []
        size = 0

        def flush():
            solved = self._solved(set().union(*[part for _, part in held if isinstance(part, list)]))
            for k, part in held:
                out[k].append(b"".join(map(solved.__getitem__, part)) if isinstance(part, list) else struct.pack("<I", self.special[part]))
            held.clear()

        for k, text in enumerate(texts):
            for part in self._parts(text):
                held.append((k, part))
                size += len(part)
                if size >= BLOCK_PIECES:
                    flush()
                    size = 0
        flush()
        return [b"".join(x) for x in out]

    def decode(self, packed: bytes) -> str:
        """Text of packed ids; bytes that are no UTF-8 become U+FFFD, unknown ids vanish."""
        ids = np.frombuffer(packed, "<u4")
        out = []
        for start in range(0, len(ids), 1 << 18):
            part = ids[start : start + (1 << 18)]
            part = part[part < len(self.tokens)]
            lens = self.lens[part]
            ends = np.cumsum(lens)
            total = int(ends[-1]) if len(ends) else 0
            out.append(self.flat[np.arange(total) + np.repeat(self.starts[part] - ends + lens, lens)].tobytes())
        return b"".join(out).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a tokenizer file, once per worker."""
    return Vocabulary(path)


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Place of a public tokenizer file on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: What :func:`encode` can emit, with the Spark type.
EMITTED = {
    "n_tokens": "long",
    "ids": "array<int>",
    "packed": "binary",
    "decoded": "string",
    "ids_sha256": "string",
    "decoded_sha256": "string",
}


def _schema_with(df: DataFrame, keep: Sequence[str], emit: Sequence[str]):
    from pyspark.sql import types as T

    out = T.StructType([df.schema[c] for c in keep if c not in emit])
    for name in emit:
        out = out.add(name, T.DataType.fromDDL(EMITTED[name]))
    return out


def encode(
    df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), emit: Sequence[str] = ("ids",), tokenizer: str = TOKENIZER
) -> DataFrame:
    """The ``keep`` columns and what ``emit`` names of :data:`EMITTED`, per row.

    ``ids`` are the token ids, ``packed`` the same as little-endian unsigned 32-bit
    integers, ``decoded`` the text that the ids decode to.  Map-only; ``tokenizer``
    names a file of the public tokenizers or is a path.
    """
    from pyspark.sql import functions as F

    keep = [c for c in keep if c not in emit]
    out = _schema_with(df, keep, emit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(tokenizer if "/" in tokenizer else tokenizer_path(tokenizer))
        decodes = {"decoded", "decoded_sha256"} & set(emit)
        for batch in batches:
            got: dict[str, list] = {name: [] for name in emit}
            texts = large_text(column(batch, "__text"))
            for lo, hi in text_chunks(texts):
                for packed in vocab.encode(texts.slice(lo, hi - lo).to_pylist()):
                    decoded = vocab.decode(packed) if decodes else ""
                    for name in emit:
                        if name == "n_tokens":
                            got[name].append(len(packed) // 4)
                        elif name == "ids":
                            got[name].append(np.frombuffer(packed, "<u4").astype(np.int32))
                        elif name == "packed":
                            got[name].append(packed)
                        elif name == "decoded":
                            got[name].append(decoded)
                        elif name == "ids_sha256":
                            got[name].append(hashlib.sha256(packed).hexdigest())
                        else:
                            got[name].append(hashlib.sha256(decoded.encode()).hexdigest())
            kinds = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "packed": pa.binary()}
            arrays = [column(batch, c) for c in keep] + [pa.array(got[n], kinds.get(n, pa.string())) for n in emit]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *emit])

    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text")).mapInArrow(run, out)


def decode(df: DataFrame, ids: str = "ids", keep: Sequence[str] = ("doc_id",), tokenizer: str = TOKENIZER) -> DataFrame:
    """The ``keep`` columns and ``decoded``: the text of an array of ids (null: empty; null ids vanish)."""
    from pyspark.sql import functions as F

    keep = [c for c in keep if c != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(tokenizer if "/" in tokenizer else tokenizer_path(tokenizer))
        for batch in batches:
            texts = [vocab.decode(np.array([i for i in row or [] if i is not None and i >= 0], "<u4").tobytes()) for row in column(batch, "__ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[column(batch, c) for c in keep], pa.array(texts, pa.string())], names=[*keep, "decoded"])

    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{ids}`").alias("__ids")).mapInArrow(run, _schema_with(df, keep, ["decoded"]))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count, digest of the ids and digest of the decoded text of every document."""
    docs = read_table(spark, sf_dir, "documents")
    return encode(docs, keep=["doc_id"], emit=["n_tokens", "ids_sha256", "decoded_sha256"])
