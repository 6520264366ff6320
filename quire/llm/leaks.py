"""Benchmark decontamination: a prefix-filtered set join on rare shingles.

A window of ``window`` item words occurs in a document only if each of its shingles does, so one shingle a window
is the necessary prefix.  Shingles are ordered by rarity in the corpus, which one pass counts in ``SLOTS`` counters
for all items together (any order is right, a good one is fast), and each window joins by its rarest.  A joined
position gives the window's start in the document; length and position bounds follow, and the whole window is then
compared.

The item side is a stated query set, broadcast in blocks of bounded bytes (``BLOCK_WINDOWS`` windows at most);
longer items are cut between windows.  A document's row passes one block after the other and carries what it has found, so blocks need neither
row numbers nor a join; after every ``CHAIN`` blocks rows are written to the shared folder.

Defined results: null and empty texts have no words; items without words have no window; items of fewer words than
a window are one window; repeated item rows count once by item_id; windows of items without item_id count for
spans, but not among items; documents are judged row by row.  Kept columns must not have the names of made ones
(ValueError, whatever the number of blocks).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.membership import bitmap, has
from quire.llm.session import bounded_batches, column, free_names, lean, materialised, shared_folder
from quire.llm.spans import ALNUM, LOWER_VALUE, Prefix, chunks, flat, shingles, words

#: Windows of a broadcast block and bytes of one with its tables (64 MB a block), and blocks that a document's row
#: passes in one job.
BLOCK_WINDOWS, WINDOW_BYTES, CHAIN = 320_000, 200, 4
#: Counters of the items' shingles.
SLOTS = 1 << 20
SHINGLE = 4


class Block:
    """Windows of some items: word hashes, items, and shingle tables."""

    def __init__(self, items: list[tuple[str | None, np.ndarray]], window: int) -> None:
        self.items = [i for i, _ in items]
        self.lengths: dict[int, dict] = {}
        rows: dict[int, list[tuple[int, np.ndarray]]] = {}
        for n, (_, hashes) in enumerate(items):
            size = min(window, len(hashes))
            for at in range(len(hashes) - size + 1):
                rows.setdefault(size, []).append((n, hashes[at : at + size]))
        for size, some in rows.items():
            table = np.array([h for _, h in some], dtype=np.uint64)
            k = min(SHINGLE, size)
            grams = np.array([shingles(r, k) for r in table], dtype=np.uint64).reshape(len(table), size - k + 1)
            self.lengths[size] = {"owner": np.array([o for o, _ in some]), "words": table, "k": k, "grams": grams}

    def order(self, counts: np.ndarray) -> None:
        """Chooses each window's rarest shingle (ties: the smaller hash) as its prefix token."""
        for x in self.lengths.values():
            g = x["grams"]
            rarity = counts[(g & np.uint64(SLOTS - 1)).astype(np.int64)]
            best = np.lexsort((g, rarity), axis=1)[:, 0]
            token = g[np.arange(len(g)), best]
            by = np.argsort(token, kind="stable")
            x["token"], x["offset"], x["row"] = token[by], best[by], by
            unique, first = np.unique(x["token"], return_index=True)
            x["unique"], x["first"], x["last"] = unique, first, np.append(first[1:], len(token))
            x["filter"] = np.zeros(1 << 16, dtype=bool)
            x["filter"][(unique & np.uint64(0xFFFF)).astype(np.int64)] = True
            del x["grams"]


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = words(data, offsets, ALNUM)
    return Prefix(data, LOWER_VALUE).of(starts, ends), first


def _members(values: np.ndarray, table: np.ndarray, sieve: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of values that the sorted table has, and their places in it."""
    at = np.flatnonzero(sieve[(values & np.uint64(0xFFFF)).astype(np.int64)])
    place = np.searchsorted(table, values[at])
    place[place == len(table)] = 0
    hit = table[place] == values[at]
    return at[hit], place[hit]


def find(block: Block, hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray]]:
    """(document row, start word, length, item number) of every occurring window, by length."""
    for size, x in block.lengths.items():
        grams = shingles(hashes, x["k"])
        if not len(grams):
            continue
        at, place = _members(grams, x["unique"], x["filter"])
        if not len(at):
            continue
        many = (x["last"] - x["first"])[place]
        pos = np.repeat(at, many)
        entry = np.repeat(x["first"][place] - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(many.sum())
        start = pos - x["offset"][entry]
        row = np.searchsorted(first, pos, side="right") - 1
        ok = (start >= first[row]) & (start + size <= first[row + 1])
        start, row, entry = start[ok], row[ok], entry[ok]
        window = x["row"][entry]
        for j in range(size):
            same = hashes[start + j] == x["words"][window, j]
            start, row, window = start[same], row[same], window[same]
        if len(start):
            yield row, start - first[row], size, x["owner"][window]


def _blocks(items: DataFrame, window: int) -> Iterator[Block]:
    """Blocks of the item side; the driver holds one at a time."""
    held: list[tuple[str | None, np.ndarray]] = []
    size = 0
    for item, text in items.toLocalIterator():
        data = np.frombuffer((text or "").encode(), dtype=np.uint8)
        hashes, _ = _word_hashes(data, np.array([0, len(data)]))
        many = max(1, len(hashes) - window + 1)
        for at in range(0, many if len(hashes) else 0, BLOCK_WINDOWS):
            part = hashes[at : at + BLOCK_WINDOWS + window - 1]
            own = WINDOW_BYTES * max(1, len(part) - window + 1) + len(item or "")
            if held and size + own > BLOCK_WINDOWS * WINDOW_BYTES:
                yield Block(held, window)
                held, size = [], 0
            held.append((item, part))
            size += own
    if held:
        yield Block(held, window)


def _counts(docs: DataFrame, items: DataFrame, window: int) -> np.ndarray:
    """How often the items' shingles occur in all documents, by counter; one pass for all items."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, first = _word_hashes(*flat(batch.column(0)))
            for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                k = min(SHINGLE, window, b - a)
                if k:
                    own = np.unique(shingles(hashes[a:b], k))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), k)), pa.array(own.view(np.int64))], ["k", "gram"])

    asked = items.select("text").mapInArrow(lean(grams), "k bigint, gram bigint")
    sizes = [r["k"] for r in asked.select("k").distinct().toLocalIterator()]  # SHINGLE at most
    table = np.zeros(SLOTS, dtype=np.int64)
    if not sizes:
        return table
    marks = bitmap(asked.select("gram"), lambda b: b.column(0).to_numpy().view(np.uint64), SLOTS)
    shared = docs.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, dtype=np.int64)
        for batch in batches:
            data, offsets = flat(batch.column(0))
            for a, b in chunks(offsets):
                hashes, _ = _word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for k in sizes:
                    own = shingles(hashes, k)
                    slot, n = np.unique((own[has(shared.value, own)] & np.uint64(SLOTS - 1)).astype(np.int64), return_counts=True)
                    total[slot] += n
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["slot", "n"])

    found = docs.select(column(docs, "text").cast("string").alias("text")).mapInArrow(lean(run), "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    for r in found.toLocalIterator():
        table[r["slot"]] = r["n"]
    return table


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame, items: DataFrame, window: int = 10, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Benchmark passages in every document.

    ``docs`` has ``text``, ``items`` has ``item_id`` and ``text``.  Returns ``keep``, ``n_words bigint``,
    ``spans array<struct<start, end>>`` (merged word ranges inside occurring windows, end excluded) and
    ``items array<string>`` (sorted as strings).
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    free_names(keep, ("n_words", "spans", "items", "_text_"))
    wanted = items.select(column(items, "item_id").cast("string").alias("item"), column(items, "text").cast("string").alias("text"))
    empty = F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)"), F.expr("cast(array() as array<string>)")
    rows = docs.select(*(column(docs, c).alias(c) for c in keep), column(docs, "text").cast("string").alias("_text_"), F.lit(0).cast("bigint").alias("n_words"), empty[0].alias("spans"), empty[1].alias("items"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    at = len(keep)

    def passed(rows: DataFrame, block: Block | None) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = flat(batch.column(at))
                counts: list[np.ndarray] = []
                spans: dict[int, list] = {}
                hit: dict[int, set] = {}
                for a, b in chunks(offsets):
                    hashes, first = _word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    counts.append(np.diff(first))
                    for row, start, size, owner in find(shared.value, hashes, first) if shared.value else ():
                        for r, s, o in zip(row.tolist(), start.tolist(), owner.tolist()):
                            spans.setdefault(a + r, []).append((s, s + size))
                            hit.setdefault(a + r, set()).update(() if (item := shared.value.items[o]) is None else (item,))
                n = np.concatenate(counts) if counts else np.zeros(0, dtype=np.int64)
                all_spans, all_items = batch.column(at + 2).to_pylist(), batch.column(at + 3).to_pylist()
                for r, own in spans.items():
                    all_spans[r] = [{"start": s, "end": e} for s, e in merged([*((x["start"], x["end"]) for x in all_spans[r]), *own])]
                    all_items[r] = sorted({*all_items[r], *hit[r]})
                made = [pa.array(n.astype(np.int64)), pa.array(all_spans, type=_SPANS), pa.array(all_items, type=pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[: at + 1], *made], batch.schema.names)

        return rows.mapInArrow(lean(run), schema)

    counts = _counts(docs, wanted, window)
    n = 0
    for n, block in enumerate(_blocks(wanted, window), 1):
        if n > 1 and n % CHAIN == 1:
            rows = materialised(rows, shared_folder(spark), "rows")
        block.order(counts)
        rows = passed(rows, block)
    return (rows if n else passed(rows, None)).drop("_text_")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def report(found: DataFrame) -> DataFrame:
    """The digest columns of ``scan``'s rows."""
    return found.select(
        "doc_id", "n_words",
        F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"]).alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )
