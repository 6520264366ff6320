"""Byte-pair encoding and decoding by a contiguous rank array.

A word's part boundaries and the ranks of its adjacent pairs lie in two short arrays.  The smallest rank is
searched again and again, its boundary deleted, and the ranks to both sides refreshed.  Words over
``LONG_WORD`` bytes, for which repeated scans would be quadratic, use a heap over the same ranks.

Defined results: null counts as the empty text, which has no ids and decodes to the empty text.  Repeated
rows each get a row.  Columns of the input other than those asked for never enter; a kept one must not have a made
one's name (ValueError).
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm.pretokens import NOT_PLAIN, PIECE, PackedWords, encode_rows, library, special_pattern, vocabulary
from quire.llm.session import bounded_batches, column, free_names, lean

LONG_WORD = 160
_NONE = 1 << 60
_SHIFT = 20


class RankArray:
    """Merges of one vocabulary over single words."""

    def __init__(self, path: str) -> None:
        ids, _, merges, _ = vocabulary(path)
        self.first = [ids[bytes([b])] for b in range(256)]
        #: (left id, right id) -> rank and merged id in one number
        self.rank = {a << _SHIFT | b: rank << _SHIFT | i for (a, b), (rank, i) in merges.items()}

    def encode(self, word: bytes) -> list[int]:
        parts = [self.first[b] for b in word]
        if len(parts) > LONG_WORD:
            return self.encode_long(parts)
        get = self.rank.get
        ranks = [get(a << _SHIFT | b, _NONE) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            i = ranks.index(least)
            parts[i] = least & ((1 << _SHIFT) - 1)
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] << _SHIFT | parts[i], _NONE)
            if i < len(ranks):
                ranks[i] = get(parts[i] << _SHIFT | parts[i + 1], _NONE)
        return parts

    def encode_long(self, parts: list[int]) -> list[int]:
        n, get = len(parts), self.rank.get
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := get(a << _SHIFT | b, _NONE)) != _NONE]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j], after[i] = r & ((1 << _SHIFT) - 1), False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (s := get(parts[x] << _SHIFT | parts[y], _NONE)) != _NONE:
                    heapq.heappush(heap, (s, x, parts[x], parts[y]))
        return [p for p, a in zip(parts, alive) if a]


@lru_cache(maxsize=4)
def _words(path: str) -> PackedWords:
    array = RankArray(path)
    return PackedWords(lambda ws: [np.array(array.encode(w.encode()), dtype=np.int32) for w in ws])


def pieces(path: str, text: str) -> list[str]:
    """Pre-tokens of a text that has no special string; the library's own splitter where engines may differ."""
    if NOT_PLAIN.search(text):
        return [text[a:b] for _, (a, b) in library(path).pre_tokenizer.pre_tokenize_str(text)]
    return PIECE.findall(text)


@lru_cache(maxsize=4)
def _array(path: str) -> RankArray:
    return RankArray(path)


def encode(path: str, text: str) -> list[int]:
    """Ids of a text; the vocabulary's special strings are single ids, as the library takes them."""
    special, pattern, out = vocabulary(path)[3], special_pattern(path), []
    for n, part in enumerate(pattern.split(text) if pattern and any(s in text for s in special) else [text]):
        if n % 2:
            out.append(special[part])
            continue
        for p in pieces(path, part):
            out += _array(path).encode(p.encode())
    return out


def encode_column(path: str, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, and each text's place in them; words are encoded once and kept."""
    return encode_rows(column, _words(path), lambda x: encode(path, x), vocabulary(path)[3])


def decode(path: str, ids: list[int]) -> str:
    """Text of ids, special strings included; bytes that are no UTF-8 become U+FFFD.  Unknown ids have no bytes."""
    by_id = vocabulary(path)[1]
    size = len(by_id)
    return b"".join([by_id[i] for i in ids if 0 <= i < size]).decode("utf-8", "replace")


def round_trip(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), finish: Callable[[list[int], str], tuple] | None = None, fields: tuple[tuple[str, pa.DataType, str], ...] = ()) -> DataFrame:
    """Encodes and decodes every text.

    Columns: ``keep`` as they are, then ``ids array<int>`` and ``decoded string`` - or, with ``finish``, what it
    makes of both (``fields``: name, Arrow type, Spark type), so that large outputs needn't leave the worker.
    A narrow map: no shuffle, whatever the sources or copies.
    """
    bounded_batches(docs.sparkSession)
    fields = fields or (("ids", pa.list_(pa.int32()), "array<int>"), ("decoded", pa.string(), "string"))
    free_names(keep, tuple(n for n, _, _ in fields))
    source = docs.select(*(column(docs, c).alias(c) for c in keep), column(docs, "text").cast("string").alias("_text_"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]] + [f"{n} {s}" for n, _, s in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            flat, at = encode_column(path, batch.column(len(keep)))
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                ids = flat[a:b].tolist()
                back = decode(path, ids)
                rows.append(finish(ids, back) if finish else (ids, back))
            made = [pa.array([r[i] for r in rows], type=kind) for i, (_, kind, _) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], [*keep, *(n for n, _, _ in fields)])

    return source.mapInArrow(lean(run), schema)


def digests(ids: list[int], back: str) -> tuple[int, str, str]:
    """Count, SHA-256 of the decimal ids joined by commas, SHA-256 of the decoded text."""
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode("utf-8", "replace")).hexdigest()


DIGEST_FIELDS = (("n_tokens", pa.int64(), "bigint"), ("ids_sha256", pa.string(), "string"), ("decoded_sha256", pa.string(), "string"))
