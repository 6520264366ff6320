"""Hard negatives by distributed radix selection over integer scores.

Anchors (a stated query set) are cut into blocks of bounded size.  A block's vectors are broadcast, and every
task scores its own rows against them.  A window is a range of scores of one anchor and, for negatives, one
positive.  Selecting the first k rows of all windows takes a few passes over the rows: tasks count scores in 32
buckets a window, the counts are summed by window, and the bucket with the kth score becomes the next range, digit
by digit, until what is at or above it is few rows or one score.  The last pass gathers only rows at or above the
threshold that was found, and of those at most k a task and window, first ones first, so that thousands of equal
vectors cost no more than k rows of each task.  The same selection with k positives finds each anchor's positives
among the rows of its label.

The driver holds one block's vectors, windows and bucket counts (``BLOCK_BYTES``), never rows.  Blocks follow one
another; each reads the rows again, so that nothing but histograms and chosen rows is shuffled.

Defined results: rows with a null id, label or vector, or with a null or non-finite component take no part, nor do
those with a component of 2^54 and more after scaling.  Vectors of different lengths have no score.  Scores of 2^62
and more in size take no part.  Rows with one id are rows of their own, none of them "other" to an anchor of that
id; of several rows with an anchor's id the one with the smallest label, then vector, is the anchor.  Windows of a
positive with a negative score are empty, as 0.5 p > 0.95 p there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.session import bounded_batches, column, drop, lean, materialised, shared_folder

#: Bytes of a block of anchors with its windows and counts; buckets of a histogram (a power of two); a window
#: needs no finer buckets once so few rows are left at or above its threshold; scores held at once.
BLOCK_BYTES, BUCKETS, FEW, SCORES = 16 << 20, 32, 64, 1 << 21
_DIGIT, _MOST = BUCKETS.bit_length() - 1, (1 << 62) - 1
SCHEMA = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def _rows(batch: pa.RecordBatch, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels, lengths, first places and scaled components of a batch's rows that take part."""
    lists = batch.column(2)
    size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    with np.errstate(invalid="ignore", over="ignore"):
        x = np.floor(flat.fill_null(np.nan).to_numpy(zero_copy_only=False) * scale)
        bad = ~(np.abs(x) < float(1 << 54))
    at = np.cumsum(size) - size
    ok = np.bincount(np.repeat(np.arange(len(size)), size)[bad], minlength=len(size)) == 0
    for i in range(3):
        ok &= ~batch.column(i).is_null().to_numpy(zero_copy_only=False)
    ids, labels = (batch.column(i).fill_null(0).to_numpy(zero_copy_only=False) for i in (0, 1))
    return ids[ok], labels[ok], size[ok], at[ok], np.where(bad, 0, x).astype(np.int64)


def _by_length(size: np.ndarray, at: np.ndarray, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for d in np.unique(size).tolist():
        which = np.flatnonzero(size == d)
        yield d, which, x[at[which][:, None] + np.arange(d)]


@dataclass
class Block:
    """Anchors and their windows; a slot is a window's number: anchor times windows an anchor, plus its place."""

    ids: np.ndarray
    labels: np.ndarray
    by_length: dict[int, tuple[np.ndarray, np.ndarray]]
    kind: type  # of the scores: exact for these vectors
    same: bool  # rows of the anchor's label, or of others
    low: np.ndarray = field(default_factory=lambda: np.zeros((0, 1), np.int64))
    high: np.ndarray = field(default_factory=lambda: np.zeros((0, 1), np.int64))
    width: np.ndarray = field(default_factory=lambda: np.zeros((0, 1), np.int64))
    open: np.ndarray = field(default_factory=lambda: np.zeros((0, 1), bool))

    def hits(self, batch: pa.RecordBatch, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Slots, scores and ids of a batch's rows in open windows."""
        ids, labels, size, at, x = _rows(batch, scale)
        low = np.where(self.open, self.low, _MOST).min(axis=1)
        high = np.where(self.open, self.high, -_MOST).max(axis=1)
        for d, which, vectors in _by_length(size, at, x):
            if d not in self.by_length:
                continue
            anchors, matrix = self.by_length[d]
            wanted = np.flatnonzero(low[anchors] <= high[anchors])
            anchors, matrix, side = anchors[wanted], matrix[wanted], vectors.astype(self.kind).T
            own, own_ids = labels[which], ids[which]
            step = max(1, SCORES // max(1, len(which)))
            for a in range(0, len(anchors), step):
                some = anchors[a : a + step]
                scores = matrix[a : a + step] @ side
                fits = (scores >= low[some, None].astype(self.kind)) & (scores <= high[some, None].astype(self.kind))
                if self.kind is np.int64:  # products may wrap
                    fits &= np.abs(matrix[a : a + step].astype(np.float64) @ side.astype(np.float64)) < float(_MOST)
                fits &= (self.labels[some, None] == own) == self.same
                if self.same:
                    fits &= self.ids[some, None] != own_ids
                i, j = np.nonzero(fits)
                s, i = scores[i, j].astype(np.int64), some[i]
                for w in range(self.low.shape[1]):
                    inside = np.flatnonzero(self.open[i, w] & (s >= self.low[i, w]) & (s <= self.high[i, w]))
                    yield i[inside] * self.low.shape[1] + w, s[inside], own_ids[j[inside]]


def _histograms(rows: DataFrame, block: Block, scale: float) -> np.ndarray:
    """Rows of every slot and bucket, the highest scores first."""
    spark, n = rows.sparkSession, block.low.size
    shared = spark.sparkContext.broadcast(block)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        counts, high, width = np.zeros(n * BUCKETS, dtype=np.int64), b.high.ravel(), b.width.ravel()
        for batch in batches:
            for slot, score, _ in b.hits(batch, scale):
                counts += np.bincount(slot * BUCKETS + (high[slot] - score) // width[slot], minlength=n * BUCKETS)
        counts = counts.reshape(n, BUCKETS)
        used = np.flatnonzero(counts.any(axis=1))
        lists = pa.FixedSizeListArray.from_arrays(pa.array(counts[used].ravel()), BUCKETS).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(used), lists], ["slot", "counts"])

    made = rows.mapInArrow(lean(count), "slot bigint, counts array<bigint>").groupBy("slot").agg(*(F.sum(F.col("counts")[b]).alias(f"c{b}") for b in range(BUCKETS))).toArrow()
    shared.unpersist()
    out = np.zeros((n, BUCKETS), dtype=np.int64)
    out[made["slot"].to_numpy()] = np.stack([made[f"c{b}"].to_numpy() for b in range(BUCKETS)], axis=1) if made.num_rows else 0
    return out


def _thresholds(rows: DataFrame, block: Block, low: np.ndarray, high: np.ndarray, k: int, scale: float) -> np.ndarray:
    """The least score of each window that is worth gathering: at or above it are its first k rows, or all."""
    floor = low.copy()
    block.low, block.high, block.open = low.copy(), high.copy(), low <= high
    span = np.where(block.open, high - low, 0)
    bits = np.array([int(v).bit_length() for v in span.ravel().tolist()], dtype=np.int64).reshape(span.shape)
    block.width = np.left_shift(np.int64(1), np.maximum(0, bits - _DIGIT))
    above = np.zeros(low.shape, dtype=np.int64)
    while block.open.any():
        upto = above[..., None] + np.cumsum(_histograms(rows, block, scale).reshape(*low.shape, BUCKETS), axis=-1)
        reached = upto >= k
        at = np.where(reached.any(axis=-1), reached.argmax(axis=-1), -1)
        here = np.maximum(at, 0)
        n = np.take_along_axis(upto, here[..., None], -1)[..., 0]
        before = np.where(here > 0, np.take_along_axis(upto, np.maximum(here - 1, 0)[..., None], -1)[..., 0], above)
        top = block.high - here * block.width
        bottom = np.maximum(block.low, top - block.width + 1)
        done = block.open & ((at < 0) | (n <= max(k, FEW)) | (block.width == 1))
        floor = np.where(done & (at >= 0), bottom, floor)
        block.open &= ~done
        block.high, block.low, above = np.where(block.open, top, block.high), np.where(block.open, bottom, block.low), np.where(block.open, before, above)
        block.width = np.where(block.open, np.maximum(1, block.width >> _DIGIT), block.width)
    return floor


def _first(slot: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every slot the first k rows: highest score, then smallest id."""
    order = np.lexsort((ids, -score, slot))
    slot, score, ids = slot[order], score[order], ids[order]
    begins = np.flatnonzero(np.append(True, slot[1:] != slot[:-1])) if len(slot) else np.zeros(0, np.int64)
    ok = np.arange(len(slot)) - np.repeat(begins, np.diff(np.append(begins, len(slot)))) < k
    return slot[ok], score[ok], ids[ok]


def _select(rows: DataFrame, block: Block, low: np.ndarray, high: np.ndarray, k: int, scale: float) -> DataFrame:
    """``slot``, ``score``, ``id`` and ``rank`` of the first k rows of every window."""
    block.low, block.high, block.open = _thresholds(rows, block, low, high, k, scale), high.copy(), low <= high
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, held = shared.value, (np.zeros(0, np.int64),) * 3
        for batch in batches:
            for found in b.hits(batch, scale):
                held = _first(*(np.concatenate(x) for x in zip(held, found)), k)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], ["slot", "score", "id"])

    chosen = rows.mapInArrow(lean(gather), "slot bigint, score bigint, id bigint")
    order = Window.partitionBy("slot").orderBy(F.col("score").desc(), "id")
    return chosen.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _reach(rows: DataFrame, scale: float) -> float:
    """The greatest norm of all rows that take part."""

    def greatest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = 0.0
        for batch in batches:
            _, _, size, at, x = _rows(batch, scale)
            most = max([most, *(float(np.sqrt((v.astype(np.float64) ** 2).sum(axis=1)).max(initial=0)) for _, _, v in _by_length(size, at, x))])
        yield pa.RecordBatch.from_arrays([pa.array([most])], ["norm"])

    return rows.mapInArrow(lean(greatest), "norm double").agg(F.max("norm")).first()[0] or 0.0


def _anchors(rows: DataFrame, chosen: Column, scale: float) -> DataFrame:
    """One row an anchor's id: the smallest label, then vector, of those that take part."""

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, size, at, x = _rows(batch, scale)
            kept = np.repeat(at, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(x[kept]))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(labels), lists], ["id", "label", "vector"])

    clean = rows.where(chosen).mapInArrow(lean(scaled), "id bigint, label bigint, vector array<bigint>")
    return clean.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("least")).select("id", "least.label", "least.vector")


def mine(
    frame: DataFrame, chosen: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0,
    id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
) -> DataFrame:
    """For each anchor (rows with ``chosen``, a condition on ``id``) and each of its first positives the first
    negatives with ``low`` to ``high`` percent of the positive's score.

    Columns: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.  Components are
    floor(scale * x); scores are integer inner products, higher ones first, then smaller ids.
    """
    if not 0 <= low <= high <= 100:
        raise ValueError("0 <= low <= high <= 100")
    spark = frame.sparkSession
    bounded_batches(spark)
    names = ((id_column, "id", "bigint"), (label_column, "label", "bigint"), (vector_column, "vector", "array<double>"))
    rows = frame.select(*(column(frame, c).cast(kind).alias(n) for c, n, kind in names))
    folder = shared_folder(spark)
    anchors = materialised(_anchors(rows, chosen, scale), folder, "anchors")
    n, longest = anchors.agg(F.count("*"), F.max(F.size("vector"))).first()
    if not n:
        drop(spark, folder)
        return spark.createDataFrame([], SCHEMA)
    each = 8 * longest + positives * (16 * BUCKETS + 64)
    blocks = max(1, -(-n * each // BLOCK_BYTES))
    anchors.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).write.partitionBy("block").parquet(f"{folder}/blocks")
    drop(spark, f"{folder}/anchors")
    reach, cut = _reach(rows, scale), spark.read.parquet(f"{folder}/blocks")
    for b in range(blocks):
        _mine_block(rows, cut.where(F.col("block") == b), reach, (positives, negatives, low, high, scale), f"{folder}/negatives")
    drop(spark, f"{folder}/blocks")
    return spark.read.schema(SCHEMA).parquet(f"{folder}/negatives")


def _percent(score: np.ndarray, percent: int) -> np.ndarray:
    """floor(percent * score / 100) without leaving 64 bits."""
    return percent * (score // 100) + percent * (score % 100) // 100


def _mine_block(rows: DataFrame, anchors: DataFrame, reach: float, settings: tuple, to: str) -> None:
    """Adds the rows of one block's anchors to the table at ``to``."""
    positives, negatives, low, high, scale = settings
    own = anchors.select("id", "label", "vector").toArrow()
    if not own.num_rows:
        return
    ids, labels = own["id"].to_numpy(), own["label"].to_numpy()
    lists = own["vector"].combine_chunks()
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    vectors = list(_by_length(size, np.cumsum(size) - size, lists.flatten().to_numpy(zero_copy_only=False)))
    norms = np.zeros(len(ids))
    for _, which, v in vectors:
        norms[which] = np.sqrt((v.astype(np.float64) ** 2).sum(axis=1))
    bound = np.minimum(norms * reach * (1 + 1e-9) + 1, float(_MOST)).astype(np.int64)[:, None]
    bound = np.minimum(bound, _MOST)
    most = int(bound.max(initial=0))
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    by_length = {d: (which, v.astype(kind)) for d, which, v in vectors}
    block = Block(ids, labels, by_length, kind, True)
    found = _select(rows, block, -bound, bound, positives, scale).select("slot", "rank", "id", "score").toArrow()
    slot, place = found["slot"].to_numpy(), found["rank"].to_numpy() - 1
    positive, score, there = (np.zeros((len(ids), positives), t) for t in (np.int64, np.int64, bool))
    positive[slot, place], score[slot, place], there[slot, place] = found["id"].to_numpy(), found["score"].to_numpy(), True
    at_least, at_most = -_percent(score, -low), _percent(score, high)
    at_least, at_most = np.where(there, at_least, 1), np.where(there, at_most, 0)
    block = Block(ids, labels, by_length, kind, False)
    chosen = _select(rows, block, at_least, at_most, negatives, scale)
    pairs = rows.sparkSession.createDataFrame(pa.table({"slot": np.arange(positive.size), "anchor_id": np.repeat(ids, positives), "positive_id": positive.ravel(), "positive_score": score.ravel()}))
    made = chosen.join(F.broadcast(pairs), "slot").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    made.write.mode("append").option("compression", "zstd").parquet(to)
