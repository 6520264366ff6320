"""Periodic runs of words: a suffix tree a document, its branching tandem repeats, and the maximal runs they end.

A run is a stretch of consecutive words with smallest period q and a length of at least ``least`` words and of
three periods, which no neighbouring word extends.  The tree is the Cartesian tree of the suffixes' common
prefixes (a suffix tree whose nodes have two children).  At a node of depth D two suffixes D apart, one below
each child, are a tandem repeat that the next word breaks; it is found from the leaves of the smaller child
alone, so that all nodes together look at n log n leaves.  Such a repeat is the right end of exactly one stretch
of period D; rotating it to the left gives the whole stretch, and of stretches that are the same the smallest
period counts.

Trees are grown over the parts of a document that grams of sixteen words cover which repeat there, no further
away than a third of their part: a run is covered by such grams, as it has at least sixteen words that return
one period on.  Documents without such grams need no tree.

Defined results: null and empty texts, and those under ``least`` words, have no runs.  Every row counts for
itself, whatever its id or copies.  A document is one row and is handled whole; the arrays of its tree take some
200 bytes a word of the repeating parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.session import bounded_batches, column, free_names, lean

#: Words of the grams that choose the parts; leaves looked at together.
GRAM, TOGETHER = 16, 1 << 20
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def _parts(x: np.ndarray) -> list[tuple[int, int]]:
    """The parts of a sequence of whole numbers that can hold a run."""
    n = len(x) - GRAM + 1
    h = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        step, width = np.uint64(0x9E3779B97F4A7C15), 1
        while width < GRAM:
            h = (h[:-width] ^ h[:-width] >> np.uint64(29)) * step + (h[width:] ^ h[width:] >> np.uint64(31))
            step, width = step * np.uint64(0xBF58476D1CE4E5B9) | np.uint64(1), 2 * width
    in_order = np.sort(h)
    if not (in_order[1:] == in_order[:-1]).any():
        return []
    order = np.argsort(h, kind="stable")
    gap = np.where(h[order[1:]] == h[order[:-1]], np.diff(order), len(x))
    near = np.full(n, len(x))
    near[order[1:]] = gap
    near[order[:-1]] = np.minimum(near[order[:-1]], gap)
    grams = np.flatnonzero(near < len(x))
    while len(grams):
        apart = np.flatnonzero(np.diff(grams) > GRAM)
        firsts, lasts = np.append(0, apart + 1), np.append(apart, len(grams) - 1)
        a, b = grams[firsts], grams[lasts] + GRAM
        stay = near[grams] * 3 <= np.repeat(b - a, lasts - firsts + 1)
        if stay.all():
            return list(zip(a.tolist(), b.tolist()))
        grams = grams[stay]
    return []


def _suffixes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes in order, each one's rank, and the common prefix of each with the one before."""
    n = len(x)
    rank = np.unique(x, return_inverse=True)[1].astype(np.int64)
    levels, width = [], 1
    while True:
        levels.append(rank.astype(np.int32))
        following = np.zeros(n, dtype=np.int64)
        following[: max(0, n - width)] = rank[width:] + 1
        key = rank * (n + 1) + following
        order = np.argsort(key, kind="stable")
        new = np.empty(n, dtype=np.int64)
        new[order] = np.append(0, np.cumsum(key[order[1:]] != key[order[:-1]]))
        rank, width = new, 2 * width
        if rank[order[-1]] == n - 1:
            break
    i, j = order[1:].copy(), order[:-1].copy()
    common = np.zeros(n - 1, dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = (i < n) & (j < n)
        same = np.flatnonzero(inside)[levels[k][i[inside]] == levels[k][j[inside]]]
        for y in (i, j, common):
            y[same] += 1 << k
    return order, rank, np.append(0, common)


def _children(common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the node at each place of ``common``: where its left child begins and its right child ends."""
    n, values = len(common), common.tolist()
    begin, end, open_ = [0] * n, [n] * n, []
    for k in range(1, n):
        v = values[k]
        while open_ and values[open_[-1]] >= v:
            end[open_.pop()] = k
        open_.append(k)
    open_ = []
    for k in range(n - 1, 0, -1):
        v = values[k]
        while open_ and values[open_[-1]] > v:
            begin[open_.pop()] = k
        open_.append(k)
    return np.array(begin), np.array(end)


def _branching(x: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of the branching tandem repeats that can end a run."""
    n = len(x)
    order, rank, depth = _suffixes(x)
    begin, end = _children(depth)
    node = np.flatnonzero((depth > 0) & (3 * depth <= n))
    mid, a, b = node, begin[node], end[node]
    left = mid - a <= b - mid  # the smaller child's leaves, and where the other's are
    first, size = np.where(left, a, mid), np.minimum(mid - a, b - mid)
    low, high = np.where(left, mid, a), np.where(left, b, mid)
    upto = np.cumsum(size)
    starts, periods, at = [], [], 0
    while at < len(node):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + TOGETHER, side="right")))
        s = size[at:to]
        of = np.repeat(np.arange(at, to), s)
        p = order[np.arange(len(of)) - np.repeat(np.cumsum(s) - s, s) + first[of]]
        d = depth[node[of]]
        for start, other in ((p, p + d), (p - d, p - d)):
            ok = np.flatnonzero((other >= 0) & (other < n))
            r = rank[other[ok]]
            ok = ok[(r >= low[of[ok]]) & (r < high[of[ok]])]
            starts.append(start[ok])
            periods.append(d[ok])
        at = to
    i, d = np.concatenate([np.zeros(0, np.int64), *starts]), np.concatenate([np.zeros(0, np.int64), *periods])
    more = np.maximum(least, 3 * d) - 2 * d  # words that the stretch must have before the repeat
    ok = i >= more
    i, d, more = i[ok], d[ok], more[ok]
    ok = (more <= 0) | (x[i - 1] == x[i - 1 + d]) & (x[i - more] == x[i - more + d])
    return i[ok], d[ok]


def runs(x: np.ndarray, least: int = 24) -> list[tuple[int, int, int]]:
    """All runs of a sequence of whole numbers as (start, length, period), in order of start and period."""
    found: dict[tuple[int, int], int] = {}
    for a, b in _parts(x) if len(x) >= least else []:
        part = x[a:b]
        i, d = _branching(part, least)
        for period in np.unique(d).tolist():
            breaks = np.append(-1, np.flatnonzero(part[:-period] != part[period:]))
            ends = i[d == period]
            start = breaks[np.searchsorted(breaks, ends) - 1] + 1
            for s, e in zip(start.tolist(), (ends + 2 * period).tolist()):
                if e - s >= max(least, 3 * period):
                    found[a + s, a + e] = min(period, found.get((a + s, a + e), period))
    return sorted((s, e - s, q) for (s, e), q in found.items())


def _numbers(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def of_words(words: list[bytes], least: int = 24) -> list[tuple[int, int, int]]:
    """All runs of a list of words."""
    if len(words) < least or not _parts(np.fromiter(map(hash, words), np.int64, len(words))):
        return []
    return runs(_numbers(words), least)


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), least: int = 24) -> DataFrame:
    """``keep``, ``n_words``, ``runs array<struct<start, length, period>>`` (words from 0) and ``collapsed``: the
    words, joined by single spaces, without those that a run has after its first period.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the column ``text``.  A narrow map of whole texts: no shuffle.
    """
    if least < 24:
        raise ValueError("least must be 24 at least, as grams of sixteen words choose where trees are grown")
    bounded_batches(docs.sparkSession)
    free_names(keep, ("n_words", "runs", "collapsed"))
    source = docs.select(*(column(docs, c).alias(c) for c in keep), column(docs, "text").cast("string").cast("binary").alias("_text_"))
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, flat, at, texts = [], [], [0], []
            for text in batch.column(len(keep)):
                words = (text.as_py() or b"").split()  # of bytes: at the six ASCII blanks
                found = of_words(words, least)
                if found:
                    drop = np.zeros(len(words) + 1, dtype=np.int64)
                    for s, length, q in found:
                        drop[s + q] += 1
                        drop[s + length] -= 1
                    words_left = [words[i] for i in np.flatnonzero(np.cumsum(drop)[:-1] == 0).tolist()]
                n.append(len(words))
                flat += found
                at.append(len(flat))
                texts.append(b" ".join(words_left if found else words).decode())
            columns = np.array(flat, dtype=np.int64).reshape(-1, 3).T
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([pa.array(c) for c in columns], fields=list(kind)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(n, pa.int64()), lists, pa.array(texts, pa.string())], [*keep, "n_words", "runs", "collapsed"])

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]]
    return source.mapInArrow(lean(run), ", ".join([*kept, "n_words bigint", f"runs {RUNS}", "collapsed string"]))


def planted(doc_id: Column, text: Column) -> Column:
    """The text with the periodic tail that the query gives to a tenth of the ids (a missing id counts as empty)."""
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10).cast("bigint")

    def tail(words: Column) -> Column:
        n = F.size(words).cast("bigint")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + (i - a) % p).cast("int")))), " ")

    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    return F.when((h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), F.transform(F.array(words), tail)[0]).otherwise(text)


def report(found: DataFrame) -> DataFrame:
    """One row a document: counts, the run of greatest exponent and digests."""
    better = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    best = F.aggregate("runs", F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"), better)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    rows = found.withColumn("best", best)
    return rows.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), *(F.col("best")[c].alias(c) for c in ("start", "length", "period")),
        F.floor(1000 * F.col("best")["length"] / F.col("best")["period"]).cast("bigint").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
