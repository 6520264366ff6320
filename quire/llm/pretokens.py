"""Byte-level BPE vocabularies: pre-tokens, the word cache, and the library's own encoder behind it.

BPE never merges across pre-tokens, so a text's ids are those of its pre-tokens in a row.  Words repeat; a
worker keeps what it has encoded.  Texts with characters on which regular-expression engines can differ
(beyond Latin letters and common signs) go to the library whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa

from quire.llm.spans import BYTE_VALUE, Prefix, chunks, flat

#: Fixed value: the pre-token pattern of the public vocabulary, for the characters of ``PLAIN`` texts.
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: A text with any of these is not plain: exotic scripts, marks and signs, control characters, fractions.
NOT_PLAIN = re.compile("[\x1c-\x1f\x85\xa0²³¹¼½¾]|[^\x00-\u024f\u2010-\u2027\u20ac]")
#: Entries of a worker's word table.
CACHE_WORDS = 2_000_000


@lru_cache(maxsize=4)
def vocabulary(path: str) -> tuple[dict[bytes, int], list[bytes], dict[tuple[int, int], tuple[int, int]], dict[str, int]]:
    """Ids of byte strings, byte strings by id, (left, right) -> (rank, merged id), special strings."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    byte_of = _byte_of()
    raw = {token: bytes(byte_of[c] for c in token) for token in spec["model"]["vocab"]}
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    size = 1 + max([*spec["model"]["vocab"].values(), *special.values()])
    by_id = [b""] * size
    for token, i in spec["model"]["vocab"].items():
        by_id[i] = raw[token]
    for token, i in special.items():
        by_id[i] = token.encode()
    ids = {raw[token]: i for token, i in spec["model"]["vocab"].items()}
    merges = {}
    for rank, pair in enumerate(spec["model"]["merges"]):
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        a, b = raw[left], raw[right]
        merges[ids[a], ids[b]] = (rank, ids[a + b])
    return ids, by_id, merges, special


def _byte_of() -> dict[str, int]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    out.update({chr(0x100 + n): b for n, b in enumerate(b for b in range(256) if b not in set(plain))})
    return out


class PackedWords:
    """Ids by pre-token: an open-addressing table from 64-bit hashes to runs of a flat id pool.

    Look-ups and inserts are vectorised.  At ``CACHE_WORDS`` entries the table starts anew, so memory stays
    bounded (some 90 MB) whatever the vocabulary of the corpus.
    """

    def __init__(self, many: Callable[[list[str]], list[np.ndarray]]) -> None:
        self.many = many
        self.slots = 1 << (2 * CACHE_WORDS - 1).bit_length()
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(self.slots, dtype=np.uint64)
        self.entry = np.zeros(self.slots, dtype=np.int32)
        self.pool = np.zeros(1 << 16, dtype=np.int32)
        self.start = np.zeros(1 << 14, dtype=np.int64)
        self.size = self.used = 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Entries of hashes; -1 where there is none."""
        mask = np.uint64(self.slots - 1)
        at = (h & mask).astype(np.int64)
        out = np.full(len(h), -1, dtype=np.int64)
        key = self.keys[at]
        hit = key == h
        out[hit] = self.entry[at[hit]]
        todo = np.flatnonzero(~hit & (key != 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & (self.slots - 1)
            key = self.keys[at[todo]]
            hit = key == h[todo]
            out[todo[hit]] = self.entry[at[todo[hit]]]
            todo = todo[~hit & (key != 0)]
        return out

    def add(self, h: np.ndarray, ids: list[np.ndarray]) -> None:
        """New, distinct hashes and their ids."""
        n = len(h)
        lengths = np.array([len(x) for x in ids], dtype=np.int64)
        flat_ids = np.concatenate(ids)
        while self.size + n + 1 > len(self.start):
            self.start = np.append(self.start, np.zeros_like(self.start))
        while self.used + len(flat_ids) > len(self.pool):
            self.pool = np.append(self.pool, np.zeros_like(self.pool))
        self.pool[self.used : self.used + len(flat_ids)] = flat_ids
        self.start[self.size + 1 : self.size + n + 1] = self.used + np.cumsum(lengths)
        self.used += len(flat_ids)
        entry = np.arange(self.size, self.size + n, dtype=np.int32)
        self.size += n
        at = (h & np.uint64(self.slots - 1)).astype(np.int64)
        todo = np.arange(n)
        while len(todo):
            free = todo[self.keys[at[todo]] == 0]
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.keys[at[won]], self.entry[at[won]] = h[won], entry[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            at[todo] = (at[todo] + 1) & (self.slots - 1)

    def ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens in a row, and how many each has."""
        h = Prefix(data, BYTE_VALUE).of(starts, ends) | np.uint64(1)
        found = self.find(h)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            if self.size + len(missing) > CACHE_WORDS and self.size:
                self.clear()
                missing = np.arange(len(h))
            new, first = np.unique(h[missing], return_index=True)
            at = missing[first]
            whole = data.tobytes()
            self.add(new, self.many([whole[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist())]))
            found[missing] = self.find(h[missing])
        begin, count = self.start[found], self.start[found + 1] - self.start[found]
        return self.pool[np.repeat(begin - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum())], count


_LETTER, _DIGIT, _SPACE, _OTHER = 1, 2, 3, 4
_CLASS = np.full(256, _OTHER, dtype=np.uint8)
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _CLASS[0x80:] = _LETTER
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = _SPACE
#: Bytes whose rows are read by the regular expressions instead: leads of signs and of characters beyond
#: U+024F, control characters that engines take differently, and the apostrophe of contractions.
_DOUBTFUL = np.zeros(256, dtype=bool)
_DOUBTFUL[0xCA:] = _DOUBTFUL[[0xC2, 0x27]] = _DOUBTFUL[0x1C:0x20] = True


def _boundaries(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens of plain rows: runs of one class, each with the space before it."""
    kind = _CLASS[data]
    edge = np.ones(len(data) + 1, dtype=bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[offsets] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1].copy(), at[1:].copy()
    space = np.flatnonzero(kind[starts] == _SPACE)
    last = np.zeros(len(data) + 1, dtype=bool)
    last[offsets] = True
    space = space[~last[ends[space]]]  # the spaces before something in the same row
    blank = data[ends[space] - 1] == 0x20
    starts[space[blank] + 1] -= 1
    ends[space[blank]] -= 1
    cut = space[~blank]
    cut = cut[ends[cut] - starts[cut] > 1]  # all but the last of them, and the last
    starts = np.concatenate([starts, ends[cut] - 1])
    ends[cut] -= 1
    ends = np.concatenate([ends, ends[cut] + 1])
    kept = np.flatnonzero(ends > starts)
    order = kept[np.argsort(starts[kept], kind="stable")] if len(cut) else kept
    return starts[order], ends[order]


def encode_rows(column: pa.Array, words: PackedWords, whole: Callable[[str], list[int] | np.ndarray], special: Iterable[str] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of an Arrow column in a row, and each text's place in them (one more than rows).

    ``words`` has the ids of pre-tokens, ``whole`` those of a text that is not plain.
    """
    data, offsets = flat(column)
    n = len(offsets) - 1
    apart = np.zeros(n + 1, dtype=bool)
    apart[np.searchsorted(offsets, np.flatnonzero(_DOUBTFUL[data]), side="right") - 1] = True
    sign = np.flatnonzero(data[:-1] == 0xC3)
    sign = sign[(data[sign + 1] == 0x97) | (data[sign + 1] == 0xB7)]
    apart[np.searchsorted(offsets, sign, side="right") - 1] = True
    for s in special:
        mark = np.frombuffer(s.encode(), dtype=np.uint8)
        found = np.flatnonzero(data[: max(0, len(data) - len(mark) + 1)] == mark[0])
        for j in range(1, len(mark)):
            found = found[data[found + j] == mark[j]]
        apart[np.searchsorted(offsets, found, side="right") - 1] = True
    parts: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    for a, b in chunks(offsets):
        base, rows = offsets[a], offsets[a : b + 1] - offsets[a]
        piece = data[base : offsets[b]]
        starts, ends = _boundaries(piece, rows)
        odd = np.flatnonzero(apart[a:b])
        if len(odd):
            row = np.searchsorted(rows, starts, side="right") - 1
            keep = ~apart[a:b][row]
            starts, ends, row = starts[keep], ends[keep], row[keep]
        ids, count = words.ids(piece, starts, ends) if len(starts) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        total = np.append(0, np.cumsum(count))
        of_row = np.diff(total[np.searchsorted(starts, rows)])
        if len(odd):
            cut, pieces, done = np.append(0, np.cumsum(of_row)), [], 0
            for i in odd.tolist():
                own = np.asarray(whole(column[a + i].as_py() or ""), dtype=np.int32)
                pieces += [ids[done : cut[i]], own]
                done, of_row[i] = cut[i], len(own)
            ids = np.concatenate([*pieces, ids[done:]])
        parts.append(ids)
        counts.append(of_row)
    return (np.concatenate(parts), np.append(0, np.cumsum(np.concatenate(counts)))) if parts else (np.zeros(0, np.int32), np.zeros(1, np.int64))


@lru_cache(maxsize=4)
def library(path: str):
    """The tokenizers library's encoder with truncation and padding off."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=4)
def widths(path: str) -> np.ndarray:
    """Bytes of every id."""
    return np.array([len(b) for b in vocabulary(path)[1]], dtype=np.int64)


@lru_cache(maxsize=4)
def library_words(path: str) -> PackedWords:
    """Ids of pre-tokens by the library.

    Letters after a space stay a pre-token of their own wherever they stand, so such words are encoded as one
    text, whose ids are cut by their bytes; the rest are encoded each by itself.
    """
    t, width = library(path), widths(path)

    def many(ws: list[str]) -> list[np.ndarray]:
        apart = [w for w in ws if not (w[0] == " " and w[1:].isalpha())]
        out = dict(zip(apart, (np.array(e.ids, dtype=np.int32) for e in t.encode_batch_fast(apart, add_special_tokens=False))))
        joined = [w for w in ws if w not in out]
        if joined:
            ids = np.array(t.encode("".join(joined), add_special_tokens=False).ids, dtype=np.int32)
            ends = np.searchsorted(np.cumsum(width[ids]), np.cumsum([len(w.encode()) for w in joined])) + 1
            out.update(zip(joined, np.split(ids, ends[:-1])))
        return [out[w] for w in ws]

    return PackedWords(many)


@lru_cache(maxsize=4)
def special_pattern(path: str):
    special = vocabulary(path)[3]
    return re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None


def library_ids(path: str, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, as ``encode(text, add_special_tokens=False).ids`` has them, and each text's place."""
    t = library(path)
    return encode_rows(column, library_words(path), lambda x: t.encode(x, add_special_tokens=False).ids, vocabulary(path)[3])
