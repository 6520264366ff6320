"""Suffix-array dedup: removes every byte covered by a long string that also starts earlier in the corpus.

A sparse suffix array does it.  Of the ``LENGTH - GRAM + 1`` grams of a string of LENGTH bytes one is its anchor,
chosen by the string's own bytes, so equal strings have their anchors at one offset, and only suffixes at
anchors (about one in 40 bytes) need be sorted.  Strings that follow each other and share an anchor are one
context: at most ``2 * LENGTH - GRAM`` bytes, which travel with it.

1. A sample of the texts gives the splitters (quantiles of its anchors' leading tokens) and the heavy grams.
   The anchor of a string is its gram of the smallest hash; a heavy gram is taken only where all are heavy.  So
   a common line's neighbours are told apart by rarer grams, and what is anchored at a heavy gram lies wholly
   inside repeated text.
2. Suffixes are range-partitioned by leading token (the hash of the gram) in one shuffle, at places that
   balance the partitions.  Tasks combine equal contexts first.
3. A bucket sorts its contexts.  Of contexts with equal bytes all but the earliest are repeats.  What is left
   of a token with several contexts is sorted string by string by multikey quicksort, eight leading bytes at a
   time, where ties alone go on; equal strings but the earliest are repeats.
4. Heavy tokens are cut: their contexts are dealt over many buckets, each keeps the earliest of equal ones, and
   what buckets kept is compared across their boundaries in a second, small round.  So is a bucket that stays
   over ``JUDGE_BYTES`` once equal contexts are combined, whatever the sample said.
5. A round deals what it gets by more leading bytes: a context's strings are cut by the place of the anchor in
   the string into pieces of ``widths()`` places, and go by all bytes that any strings of such a piece share (58, 79, 90
   and so on up to the whole string).  Rounds end when no bucket is over the bound; in the last one strings are
   whole, so nothing but equal ones comes together.
6. The repeats go back to their texts.

Hashes choose anchors, buckets and the order in which things are looked at; bytes alone decide what is equal.

Texts without any repeat (most, by a bitmap) are never shuffled again.  Order is by doc_id, then by a hash of
the text, then by start; a missing doc_id comes first.  Defined results: null counts as the empty text; texts
under LENGTH bytes lose nothing; rows alike in doc_id and text count as one document and get the same result
each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.membership import bitmap, has, size_for
from quire.llm.session import bounded_batches, column, free_names, lean, materialised, partitions, places, shared_folder
from quire.llm.spans import BYTE_VALUE, Prefix, chunks, flat, mix

LENGTH, GRAM = 100, 16
#: One text in so many is sampled for splitters and heavy grams.
SAMPLE = 256
#: A gram of as many sampled places is heavy; the HEAVY_GRAMS most frequent are listed.
HEAVY, HEAVY_GRAMS = 16, 1 << 20
#: Splitters that are sampled; finer buckets cut the ranges between them evenly.
SPLITTERS = 4096
#: Buckets of a partition, and anchors of a task that are combined at once.
BUCKETS, COMBINE = 4, 300_000
#: Bytes of contexts that a bucket may hold in one worker, and of those in one row for the next round.
JUDGE_BYTES, CARRIED = 128 << 20, 4 << 20
#: Bytes of one text that are scanned at once; the next piece begins LENGTH - 1 bytes before this one's end.
PIECE_BYTES = 1 << 20
#: Repeats that a task has found, in one row of the shuffle.
LOCAL_ROWS = 2_000
_ROW = np.dtype([("gram", "<u8"), ("key", "<u8"), ("doc", "<i8"), ("h", "<i8"), ("lo", "<u4"), ("back", "u1"), ("span", "u1")])
_SENT = ("doc", "h", "lo", "back", "span")
_RANGE = np.dtype([("doc", "<i8"), ("h", "<i8"), ("start", "<i8"), ("end", "<i8")])
_LEAST = -(2**63)
#: Kinds of rows in the shuffle.
_PLAIN, _HEAVY, _RANGES = 0, 1, 2


class Heavy:
    """A sorted list of gram hashes behind a sieve of their low bits."""

    def __init__(self, grams: np.ndarray) -> None:
        self.grams = np.sort(grams.astype(np.uint64))
        self.sieve = np.zeros(1 << 20, dtype=bool)
        self.sieve[(self.grams & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def at(self, grams: np.ndarray) -> np.ndarray:
        """Places of the heavy ones."""
        if not len(self.grams):
            return np.zeros(0, dtype=np.int64)
        maybe = np.flatnonzero(self.sieve[(grams & np.uint64(0xFFFFF)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.grams, grams[maybe]), len(self.grams) - 1)
        return maybe[self.grams[place] == grams[maybe]]


def _context(prefix: Prefix, start: np.ndarray, end: np.ndarray, back: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """A hash of a context's bytes and of its anchor's place."""
    return mix(prefix.of(start, end) ^ mix(back.astype(np.uint64)) ^ gram)


def anchors(data: np.ndarray, offsets: np.ndarray, heavy: Heavy | None = None, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Contexts of rows in one flat byte array: row; gram, a hash of the context, whether the gram is heavy; and,
    from the row's beginning, the anchor and the first and last start of the strings that it anchors.

    The anchor is the leftmost gram of the smallest hash, by its upper 56 bits: a function of the string's bytes.
    """
    n, width = len(data) - length + 1, length - gram + 1
    if n <= 0:
        return {}
    prefix = Prefix(data, BYTE_VALUE)
    grams = prefix.fixed(gram)
    key = grams >> np.uint64(8) << np.uint64(7)
    if heavy is not None:
        key[heavy.at(grams)] |= np.uint64(1 << 63)
    padded = np.full(-(-len(key) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(key)] = key
    blocks = padded.reshape(-1, width)
    blocks |= np.arange(width, dtype=np.uint64)  # place within a block of the window's width
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
    head = np.minimum.accumulate(blocks, axis=1).ravel()[width - 1 : width - 1 + n]
    at = np.arange(n) // width * width
    right = head >> np.uint64(7) < tail >> np.uint64(7)
    at[right] = (np.flatnonzero(right) + width - 1) // width * width
    least = np.where(right, head, tail)
    at += (least & np.uint64(127)).astype(np.int64)
    starts, ends = offsets[:-1], offsets[1:] - length + 1
    real = ends > starts
    edge = np.zeros(n + 1, dtype=np.int32)
    edge[starts[real]] += 1
    edge[ends[real]] -= 1
    valid = np.cumsum(edge[:-1]) > 0
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (at[1:] != at[:-1])
    last = valid.copy()
    last[:-1] &= ~valid[1:] | (at[1:] != at[:-1])
    lo, hi = np.flatnonzero(new), np.flatnonzero(last)
    row = np.searchsorted(offsets, lo, side="right") - 1
    at = at[lo]
    key = _context(prefix, lo, hi + length, at - lo, grams[at])
    return {"row": row, "gram": grams[at], "heavy": least[lo] >> np.uint64(63) > 0, "key": key, "lo": lo - offsets[row], "hi": hi - offsets[row], "at": at - offsets[row], "src": lo}


def _scanned(data: np.ndarray, offsets: np.ndarray, heavy: Heavy | None) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """Contexts by chunk, and the chunk's bytes.  Long texts are scanned in pieces that overlap, so that every
    string is in just one."""
    for a, b in chunks(offsets):
        begin, end = int(offsets[a]), int(offsets[b])
        if b == a + 1 and end - begin > PIECE_BYTES + LENGTH:
            for at in range(begin, end - LENGTH + 1, PIECE_BYTES):
                part = data[at : min(end, at + PIECE_BYTES + LENGTH - 1)]
                found = anchors(part, np.array([0, len(part)]), heavy)
                if found:
                    found["row"] = found["row"] + a
                    for c in ("lo", "hi", "at"):
                        found[c] = found[c] + (at - begin)
                    yield found, part
            continue
        part = data[begin:end]
        found = anchors(part, offsets[a : b + 1] - begin, heavy)
        if found:
            found["row"] = found["row"] + a
            yield found, part


class Contexts:
    """Contexts with their bytes: ``rows`` (records), and where in ``data`` each begins."""

    def __init__(self, rows: np.ndarray, src: np.ndarray, data: np.ndarray) -> None:
        self.rows, self.src, self.data = rows, src, data

    @classmethod
    def joined(cls, parts: list[Contexts]) -> Contexts:
        base = np.cumsum([0, *(len(p.data) for p in parts)])
        return cls(np.concatenate([p.rows for p in parts]), np.concatenate([p.src + b for p, b in zip(parts, base)]), np.concatenate([p.data for p in parts]))

    @property
    def lengths(self) -> np.ndarray:
        return self.rows["span"].astype(np.int64) + LENGTH

    def take(self, at: np.ndarray) -> Contexts:
        return Contexts(self.rows[at], self.src[at], self.data)

    def bytes(self) -> np.ndarray:
        """All contexts' bytes, one after another."""
        n = self.lengths
        return self.data[np.repeat(self.src - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())] if len(n) else np.zeros(0, dtype=np.uint8)

    def alike(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether contexts a and b (arrays of indices) are equal, byte by byte."""
        r = self.rows
        same = (r["gram"][a] == r["gram"][b]) & (r["back"][a] == r["back"][b]) & (r["span"][a] == r["span"][b])
        for i in range(0, len(a), 20_000):
            at = np.flatnonzero(same[i : i + 20_000]) + i
            if len(at):
                x, y = self.take(a[at]), self.take(b[at])
                equal = x.bytes() == y.bytes()
                same[at] = np.logical_and.reduceat(equal, np.append(0, np.cumsum(x.lengths)[:-1]))
        return same

    def combined(self) -> tuple[np.ndarray, np.ndarray]:
        """Indices of contexts that no earlier one equals, and of those that repeat one.  What the hash takes
        for equal and the bytes don't is kept; rows of one place count once."""
        r = self.rows
        order = np.lexsort((r["lo"], r["h"], r["doc"], r["key"]))
        new = np.ones(len(order), dtype=bool)
        new[1:] = r["key"][order[1:]] != r["key"][order[:-1]]
        later = order[~new]
        first = order[np.flatnonzero(new)[np.cumsum(new)[~new] - 1]] if len(later) else later
        same = self.alike(later, first)
        elsewhere = (r["doc"][later] != r["doc"][first]) | (r["h"][later] != r["h"][first]) | (r["lo"][later] != r["lo"][first])
        return np.concatenate([order[new], later[~same]]), later[same & elsewhere]

    def ranges(self, at: np.ndarray) -> np.ndarray:
        out, r = np.empty(len(at), dtype=_RANGE), self.rows[at]
        out["doc"], out["h"], out["start"], out["end"] = r["doc"], r["h"], r["lo"], r["lo"].astype(np.int64) + r["span"] + LENGTH
        return out

    def packed(self) -> bytes:
        """Compressed rows and bytes, without the hashes, which the bytes give again."""
        import zstandard

        whole = b"".join([len(self.rows).to_bytes(4, "little"), *(self.rows[f].tobytes() for f in _SENT), self.bytes().tobytes()])
        return zstandard.ZstdCompressor(level=3).compress(whole)

    @classmethod
    def unpacked(cls, blob: bytes) -> Contexts:
        import zstandard

        whole = zstandard.ZstdDecompressor().decompress(blob)
        n, at = int.from_bytes(whole[:4], "little"), 4
        rows = np.empty(n, dtype=_ROW)
        for f in _SENT:
            rows[f] = np.frombuffer(whole, dtype=_ROW[f], count=n, offset=at)
            at += n * _ROW[f].itemsize
        out = cls(rows, np.zeros(n, dtype=np.int64), np.frombuffer(whole, dtype=np.uint8, offset=at))
        out.src[1:] = np.cumsum(out.lengths)[:-1]
        prefix = Prefix(out.data, BYTE_VALUE)
        rows["gram"] = prefix.at(out.src + rows["back"], GRAM)
        rows["key"] = _context(prefix, out.src, out.src + out.lengths, rows["back"], rows["gram"])
        return out


def _sample(texts: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the buckets (one less than buckets), and the heavy grams; both of bounded size on the driver."""
    some = texts.where(F.pmod(F.xxhash64("doc", "h"), F.lit(SAMPLE)) == 0).select("text")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found, part in _scanned(*flat(batch.column(0)), None):
                gram, many = np.unique(Prefix(part, BYTE_VALUE).fixed(GRAM), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(many.astype(np.int64))], ["gram", "n"])

    counts = some.mapInArrow(lean(grams), "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    often = counts.where(F.col("n") >= HEAVY).orderBy(F.desc("n"), "gram")  # sorted by ranges, read only as far as needed
    heavy = np.array([r["gram"] for r in islice(often.toLocalIterator(), HEAVY_GRAMS)], dtype=np.int64).view(np.uint64)
    table = Heavy(heavy)

    def leading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found, _ in _scanned(*flat(batch.column(0)), table):
                yield pa.RecordBatch.from_arrays([pa.array((found["gram"][~found["heavy"]] >> np.uint64(1)).view(np.int64))], ["half"])

    many = min(buckets, SPLITTERS)
    cut = some.mapInArrow(lean(leading), "half bigint").agg(F.percentile_approx("half", [i / many for i in range(1, many)] or [1.0], 20 * many).alias("q")).first()["q"]
    if not cut:
        return np.linspace(0, 2.0**64, buckets + 1)[1:-1].astype(np.uint64), heavy
    known = np.array([0, *(2 * x for x in cut[: many - 1]), 2**64 - 1], dtype=np.float64)
    return np.interp(np.linspace(0, len(known) - 1, buckets + 1)[1:-1], np.arange(len(known)), known).astype(np.uint64), heavy


def _suffixes(texts: DataFrame, cuts: np.ndarray, heavy: np.ndarray, labels: np.ndarray) -> DataFrame:
    """Packed contexts by bucket of the leading token, heavy ones dealt out by task, and repeats that a task found."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast((cuts, heavy, labels))
    spread = max(1, int(len(labels) ** 0.5))

    def flush(held: list[Contexts], heavies: list[np.ndarray], task: int) -> Iterator[pa.RecordBatch]:
        cuts, _, labels = shared.value
        whole, hot = Contexts.joined(held), np.concatenate(heavies)
        kept, repeats = whole.combined()
        salt = int(mix(np.array([task], dtype=np.uint64))[0]) % spread * (len(labels) // spread)
        bucket = np.searchsorted(cuts, whole.rows["gram"][kept], side="right")
        bucket = np.where(hot[kept], (bucket + salt) % len(labels), bucket)
        order = np.lexsort((whole.rows["gram"][kept], hot[kept], bucket))
        kept, bucket = kept[order], bucket[order]
        cut = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (hot[kept[1:]] != hot[kept[:-1]]))) if len(kept) else np.zeros(0, dtype=np.int64)
        for i in range(0, len(cut), 64):
            some = cut[i : i + 64]
            ends = np.append(cut[i + 1 : i + 65], len(kept))[: len(some)]
            blobs = [whole.take(kept[a:b]).packed() for a, b in zip(some.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(labels[bucket[some]], pa.int32()), pa.array(np.where(hot[kept[some]], _HEAVY, _PLAIN), pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "kind", "blob"])
        found = whole.ranges(repeats)
        if len(found):
            parts = np.array_split(found, 1 + len(found) // LOCAL_ROWS)
            where = mix(np.arange(len(parts), dtype=np.uint64) + (np.uint64(task) << np.uint64(32))) % np.uint64(len(labels))
            yield pa.RecordBatch.from_arrays([pa.array(labels[where.astype(np.int64)], pa.int32()), pa.array(np.full(len(parts), _RANGES), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["bucket", "kind", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: list[Contexts] = []
        hot: list[np.ndarray] = []
        size, task, table = 0, TaskContext.get().partitionId(), Heavy(shared.value[1])
        for batch in batches:
            doc, h = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for found, part in _scanned(*flat(batch.column(2)), table):
                rows = np.empty(len(found["lo"]), dtype=_ROW)
                rows["gram"], rows["key"], rows["lo"] = found["gram"], found["key"], found["lo"]
                rows["doc"], rows["h"] = doc[found["row"]], h[found["row"]]
                rows["back"], rows["span"] = found["at"] - found["lo"], found["hi"] - found["lo"]
                held.append(Contexts(rows, found["src"], part.copy()))
                hot.append(found["heavy"])
                size += len(rows)
                if size >= COMBINE:
                    yield from flush(held, hot, task)
                    held, hot, size = [], [], 0
        if held:
            yield from flush(held, hot, task)

    return texts.select("doc", "h", "text").mapInArrow(lean(run), "bucket int, kind int, blob binary")


_FOUND = "doc bigint, h bigint, start bigint, end bigint, kind int, blob binary"


def _found(ranges: np.ndarray) -> pa.RecordBatch:
    n = len(ranges)
    return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(ranges[c])) for c in _RANGE.names), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], [*_RANGE.names, "kind", "blob"])


def _carried(contexts: Contexts) -> Iterator[pa.RecordBatch]:
    """Contexts for the next round, in rows of bounded size."""
    each = CARRIED // (2 * LENGTH - GRAM)
    for i in range(0, len(contexts.rows), each):
        blob = contexts.take(np.arange(i, min(i + each, len(contexts.rows)))).packed()
        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, pa.int64()) for _ in _RANGE.names), pa.array([_PLAIN], pa.int32()), pa.array([blob], pa.binary())], [*_RANGE.names, "kind", "blob"])


def widths() -> list[int]:
    """Places of the anchor that a round's pieces span: all of them, then halves, down to one."""
    out = [LENGTH - GRAM + 1]
    while out[-1] > 1:
        out.append(-(-out[-1] // 2))
    return out


def pieces(whole: Contexts, width: int) -> tuple[Contexts, np.ndarray]:
    """Contexts cut where the place of the anchor in their strings passes a multiple of ``width``, and a hash of the
    bytes that any strings of such a piece share.  Hashes of contexts are left to ``unpacked``."""
    r = whole.rows
    back, span = r["back"].astype(np.int64), r["span"].astype(np.int64)
    low, high = (back - span) // width, back // width  # the first string has its anchor furthest in
    many = high - low + 1
    own = np.repeat(np.arange(len(r)), many)
    piece = high[own] - (np.arange(len(own)) - np.repeat(np.append(0, np.cumsum(many)[:-1]), many))
    first, last = np.minimum(back[own], (piece + 1) * width - 1), np.maximum(back[own] - span[own], piece * width)
    skipped = back[own] - first
    rows, src = r[own], whole.src[own] + skipped
    rows["lo"] += skipped.astype(np.uint32)
    rows["back"], rows["span"] = first, first - last
    anchor = src + first
    most = np.minimum((piece + 1) * width, LENGTH - GRAM + 1) - 1
    shared = Prefix(whole.data, BYTE_VALUE).of(anchor - piece * width, anchor - most + LENGTH)
    return Contexts(rows, src, whole.data), mix(shared ^ mix(piece.astype(np.uint64)))


def equal_strings(data: np.ndarray, starts: np.ndarray, group: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the strings that equal another of their group, and numbers that equal strings share.

    Multikey quicksort: all strings are sorted by their next eight bytes within ties; whatever no longer ties
    is left behind.
    """
    whole = np.append(data, np.zeros(8, dtype=np.uint8))
    eight = np.ndarray((len(whole) - 7,), dtype=">u8", buffer=whole, strides=(1,))
    at, tie = np.arange(len(starts)), group.astype(np.int64)
    for depth in [*range(0, length - 8, 8), max(0, length - 8)]:
        word = eight[starts[at] + depth].astype(np.uint64)
        order = np.lexsort((word, tie))
        at, word, tie = at[order], word[order], tie[order]
        new = np.ones(len(at) + 1, dtype=bool)
        new[1:-1] = (word[1:] != word[:-1]) | (tie[1:] != tie[:-1])
        keep = ~(new[:-1] & new[1:])
        tie = np.cumsum(new[:-1])[keep]
        at = at[keep]
        if not len(at):
            break
    return at, tie


#: Bytes of contexts that are sorted at once, unless one token has more.
_SORT_BYTES = 1 << 20


def _sorted_strings(some: Contexts) -> np.ndarray:
    """Repeats among the strings of contexts that share tokens; strings of one context differ or repeat like others."""
    r, data = some.rows, some.bytes()
    lengths = some.lengths
    base = np.append(0, np.cumsum(lengths)[:-1])
    many = lengths - LENGTH + 1
    own = np.repeat(np.arange(len(r)), many)
    offset = np.arange(many.sum()) - np.repeat(np.append(0, np.cumsum(many)[:-1]), many)
    # Equal strings have their anchors at one offset, so the place of the anchor in the string is a token too.
    tie = np.cumsum(np.append(True, r["gram"][1:] != r["gram"][:-1]))[own] * 256 + (r["back"].astype(np.int64)[own] - offset)
    at, tie = equal_strings(data, base[own] + offset, tie)
    start = r["lo"].astype(np.int64)[own[at]] + offset[at]
    doc, h = r["doc"][own[at]], r["h"][own[at]]
    order = np.lexsort((start, h, doc, tie))
    at, tie, start, doc, h = at[order], tie[order], start[order], doc[order], h[order]
    new = np.ones(len(at), dtype=bool)
    new[1:] = tie[1:] != tie[:-1]
    first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(at) else at
    at = np.sort(at[(doc != doc[first]) | (h != h[first]) | (start != start[first])])
    if not len(at):
        return np.zeros(0, dtype=_RANGE)
    run = np.ones(len(at), dtype=bool)
    run[1:] = (own[at[1:]] != own[at[:-1]]) | (offset[at[1:]] != offset[at[:-1]] + 1)
    begin = np.flatnonzero(run)
    last = np.append(begin[1:], len(at)) - 1
    out, who = np.empty(len(begin), dtype=_RANGE), own[at[begin]]
    out["doc"], out["h"] = r["doc"][who], r["h"][who]
    out["start"] = r["lo"][who] + offset[at[begin]]
    out["end"] = r["lo"][who] + offset[at[last]] + LENGTH
    return out


def _judge(held: list[Contexts]) -> Iterator[np.ndarray]:
    """All repeats of a bucket of whole tokens."""
    whole = Contexts.joined(held)
    kept, repeats = whole.combined()
    yield whole.ranges(repeats)
    kept = kept[np.argsort(whole.rows["gram"][kept], kind="stable")]
    gram = whole.rows["gram"][kept]
    new = np.ones(len(gram) + 1, dtype=bool)
    new[1:-1] = gram[1:] != gram[:-1]
    several = kept[~(new[:-1] & new[1:])]
    gram = whole.rows["gram"][several]
    begins = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])) if len(gram) else np.zeros(0, dtype=np.int64)
    size = np.append(0, np.cumsum(whole.lengths[several]))[begins]
    a = 0
    while a < len(begins):
        b = max(a + 1, int(np.searchsorted(size, size[a] + _SORT_BYTES)))
        yield _sorted_strings(whole.take(several[begins[a] : begins[b] if b < len(begins) else len(several)]))
        a = b


def _judged(suffixes: DataFrame, parts: int, last: bool = False) -> DataFrame:
    """Repeats of every bucket; and what is kept of heavy contexts and of buckets over the bound (but in the last
    round), for the comparison across buckets."""

    def settled(held: list[Contexts]) -> tuple[Contexts, pa.RecordBatch]:
        whole = Contexts.joined(held)
        kept, repeats = whole.combined()
        kept = whole.take(kept)
        return Contexts(kept.rows, np.append(0, np.cumsum(kept.lengths)[:-1]), kept.bytes()), _found(whole.ranges(repeats))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, over = None, False
        held: dict[int, list[Contexts]] = {_PLAIN: [], _HEAVY: []}
        size = {_PLAIN: 0, _HEAVY: 0}

        def end() -> Iterator[pa.RecordBatch]:
            if held[_PLAIN] and not over:
                for found in _judge(held[_PLAIN]):
                    yield _found(found)
            for some in (held[_HEAVY], held[_PLAIN] if over else []):
                if some:
                    kept, found = settled(some)
                    yield found
                    yield from _carried(kept)

        for batch in batches:
            for bucket, kind, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == _RANGES:
                    yield _found(np.frombuffer(blob, dtype=_RANGE))
                    continue
                if bucket != key:
                    yield from end()
                    key, over, held, size = bucket, False, {_PLAIN: [], _HEAVY: []}, {_PLAIN: 0, _HEAVY: 0}
                own = Contexts.unpacked(blob)
                held[kind].append(own)
                size[kind] += len(own.data)
                if size[kind] > JUDGE_BYTES:
                    kept, found = settled(held[kind])
                    yield found
                    if last or 2 * len(kept.data) <= JUDGE_BYTES:  # whole strings are combined to one each
                        held[kind], size[kind] = [kept], len(kept.data) if not last else 0
                    else:
                        yield from _carried(kept)
                        held[kind], size[kind] = [], 0
                        over = over or kind == _PLAIN
        yield from end()

    dealt = suffixes.repartition(parts, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(lean(run), _FOUND)


def _dealt_again(carried: DataFrame, width: int, labels: np.ndarray) -> DataFrame:
    """Pieces of the contexts that buckets kept, by what their strings share."""
    shared = carried.sparkSession.sparkContext.broadcast(labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = shared.value

        def deal(held: list[Contexts]) -> pa.RecordBatch:
            whole, leading = pieces(Contexts.joined(held), width)
            bucket = (leading % np.uint64(len(labels))).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            some, at = np.unique(bucket[order], return_index=True)
            blobs = [whole.take(o).packed() for o in np.split(order, at[1:])]
            return pa.RecordBatch.from_arrays([pa.array(labels[some], pa.int32()), pa.array(np.full(len(some), _PLAIN), pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "kind", "blob"])

        held, size = [], 0
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                held.append(Contexts.unpacked(blob))
                size += len(held[-1].data)
                if size >= 8 * CARRIED:
                    yield deal(held)
                    held, size = [], 0
        if held:
            yield deal(held)

    return carried.mapInArrow(lean(run), "bucket int, kind int, blob binary")


def _rounds(judged: DataFrame, folder: str) -> DataFrame:
    """Repeats of the first round and of all later ones, which get what a round has carried on."""
    spark = judged.sparkSession
    repeats = judged.where("blob is null").select(*_RANGE.names)
    for n, width in enumerate(widths()[1:]):
        carried = judged.where("blob is not null").select("blob")
        size = carried.agg(F.sum(F.octet_length("blob"))).first()[0]
        if not size:
            break
        # Blobs are compressed, to a fourth at the least as a rule, and pieces overlap.
        parts = max(partitions(spark), 16 * size // (BUCKETS * JUDGE_BYTES))
        judged = materialised(_judged(_dealt_again(carried, width, places(parts, BUCKETS)), parts, width == 1), folder, f"again{n}")
        repeats = repeats.unionByName(judged.where("blob is null").select(*_RANGE.names))
    return repeats


def _key(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    return mix(doc.view(np.uint64) ^ mix(h.astype(np.uint64) + np.uint64(1)))


def _bits(rows: DataFrame) -> np.ndarray:
    """The bitmap of the texts that these rows name."""
    many = rows.agg(F.approx_count_distinct(F.xxhash64("doc", "h"))).first()[0]
    return bitmap(rows.select("doc", "h"), lambda b: _key(b.column(0).to_numpy(), b.column(1).to_numpy()), size_for(many))


def _marked(texts: DataFrame, bits: np.ndarray) -> DataFrame:
    """Rows that a bitmap of (doc, h) has."""
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(has(shared.value, _key(batch.column("doc").to_numpy(), batch.column("h").to_numpy()))))

    return texts.mapInArrow(lean(run), texts.schema)


def find(docs: DataFrame, folder: str, keep: tuple[str, ...] = ("doc_id",)) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """The texts with their keys; the removed byte ranges (doc, h, start, end; they may overlap); and the
    bitmap of texts that have any."""
    spark = docs.sparkSession
    texts = docs.select(*(column(docs, c).alias(c) for c in keep), F.coalesce(column(docs, "doc_id").cast("bigint"), F.lit(_LEAST)).alias("doc"), column(docs, "text").cast("string").alias("text"))
    h = F.xxhash64("text")  # its lower half, unsigned, comes first in the order
    texts = texts.withColumn("h", F.shiftleft(h, 32).bitwiseOR(F.shiftrightunsigned(h, 32)).bitwiseXOR(F.lit(_LEAST)))
    labels = places(partitions(spark), BUCKETS)
    cuts, heavy = _sample(texts, len(labels))
    judged = materialised(_judged(_suffixes(texts, cuts, heavy, labels), partitions(spark)), folder, "judged")
    ranges = _rounds(judged, folder)
    return texts, ranges, _bits(ranges)


def cut(text: str | None, ranges: list[tuple[int, int]], characters: bool = False) -> tuple[bytes, int, list[tuple[int, int]]]:
    """Remaining bytes, byte count, and maximal removed runs; with ``characters`` a character of which a byte
    goes, goes whole."""
    data = np.frombuffer((text or "").encode("utf-8", "replace"), dtype=np.uint8)
    edge = np.zeros(len(data) + 2, dtype=np.int32)
    for s, e in ranges:
        edge[s] += 1
        edge[e] -= 1
    gone = np.cumsum(edge[:-2]) > 0
    if characters and len(data):
        first = np.flatnonzero((data & 0xC0) != 0x80)
        gone = np.repeat(np.logical_or.reduceat(gone, first), np.diff(np.append(first, len(data))))
    step = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
    return data[~gone].tobytes(), len(data), list(zip(step[::2].tolist(), step[1::2].tolist()))


def dedupe(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), characters: bool = False) -> DataFrame:
    """``keep``, ``n_bytes bigint``, ``spans array<struct<start, end>>`` (maximal removed runs of bytes) and
    ``kept binary`` of every text (which is why the text itself can't be kept)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    free_names(keep, ("doc", "h", "text", "ranges", "n_bytes", "spans", "kept"))
    texts, ranges, bits = find(docs, shared_folder(spark), keep)
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields[: len(keep)]]
    schema = ", ".join([*kept, "n_bytes bigint", "spans array<struct<start: bigint, end: bigint>>", "kept binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("ranges").to_pylist()
            made = [cut(t, [(r["start"], r["end"]) for r in x or ()], characters) for t, x in zip(batch.column("text").to_pylist(), own)]
            spans = pa.array([[{"start": a, "end": b} for a, b in m[2]] for m in made], span_type)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array([m[1] for m in made], pa.int64()), spans, pa.array([m[0] for m in made], pa.binary())], [*keep, "n_bytes", "spans", "kept"])

    shared = spark.sparkContext.broadcast(bits)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marked = has(shared.value, _key(batch.column("doc").to_numpy(), batch.column("h").to_numpy()))
            batch = batch.filter(pa.array(~marked))
            data = batch.column("text").fill_null("").cast(pa.binary())
            n = pc.fill_null(pc.binary_length(data), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], n, pa.array([[]] * batch.num_rows, span_type), data], [*keep, "n_bytes", "spans", "kept"])

    whole = texts.mapInArrow(lean(clean), schema)
    by_text = ranges.groupBy("doc", "h").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    changed = _marked(texts, bits).join(by_text, ["doc", "h"], "left").select(*keep, "text", "ranges").mapInArrow(lean(run), schema)
    return whole.unionByName(changed)


def report(found: DataFrame) -> DataFrame:
    """The digest columns of ``dedupe``'s rows."""
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
