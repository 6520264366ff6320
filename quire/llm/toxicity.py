"""Toxicity by compression distance.

Zstandard dictionaries are trained on toxic and on ordinary text, and a text's windows are compressed with both: a
window's distance is what it takes with the ordinary dictionaries less what it takes with the toxic ones.

Text is compressed in word codes, ``CODE`` bytes a word, so that a match means a whole word.  Letters as they are
don't do here: a match of a few letters saves about a byte of a window, less than chance syllables do (README has
the figures).  Dictionaries are trained in rounds, so that they hold what tells the classes apart:

* the base, on half of the ordinary texts; both sides share it;
* the toxic and the other ordinary dictionary, at first on the text of their class that the base leaves uncovered;
* then, in each round, the ordinary one on ordinary text that the toxic one compresses better (false alarms), and
  the toxic one on toxic text that it still compresses better.

Sizes and rounds are tried on a quarter of the labelled rows, held out of training; so are the threshold, from which
on a window counts, and a logistic curve over a text's largest, three largest, mean and counted distances, which
makes a score of them.

Fitting takes at most ``TRAIN_TOXIC`` and ``TRAIN_ORDINARY`` labelled rows, chosen by a hash of doc_id; scoring
reads every word of every text.  Labels, language, source and doc_id are no inputs of a score.

Defined results: null and empty texts get the score of a text without windows.  Without labels of both kinds the
score is the smoothed rate of toxic labels, 0.5 where there are none.  Labels other than 0 and 1, and rows without
doc_id, are left out of fitting; a doc_id with several labels counts as toxic if one is; equal texts are fitted
once a class.  A kept column must not have the score's name (ValueError).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.session import bounded_batches, column, free_names, lean, release
from quire.llm.spans import ALNUM, LOWER_VALUE, Prefix, chunks, flat, mix, words

#: Bounds of the labelled sample, in rows.
TRAIN_TOXIC, TRAIN_ORDINARY = 2000, 4000
#: Words of a window, and bytes of a word's code.
WINDOW, CODE = 4, 12
#: Bytes of the base, sizes that are tried for a class's own dictionary, and rounds.
BASE, SIZES, ROUNDS = 128 << 10, (4096, 8192), 4
#: Segments (of the base, of the others) and grams from which dictionaries are put together, in bytes.
SEGMENTS, GRAM = (24, 16), 8
#: One labelled row in so many is held out of the dictionaries.
HELD = 4
#: Bytes of leading text to a byte of text that is trained on.
LEAD = 0.25
#: Bytes that a word must save with one dictionary to be trained on again.
SAVES = 2
#: Level of compression.
LEVEL = 3


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    threshold: int
    weights: tuple[float, ...]


def compressor(content: bytes) -> Callable[[bytes], bytes]:
    import zstandard as z

    d = z.ZstdCompressionDict(content or b" ", dict_type=z.DICT_TYPE_RAWCONTENT)
    p = z.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
    d.precompute_compress(compression_params=p)
    return z.ZstdCompressor(dict_data=d, compression_params=p).compress


def trained(texts: list[bytes], size: int, segment: int, lead: list[bytes] = ()) -> bytes:
    """A dictionary of ``size`` bytes trained on texts; of too few to train on, their last bytes, repeated.

    The library makes room for its header by cutting off the segments that it found first, which are the best of
    the first texts.  So texts of ``lead`` go first, as many bytes as the others have.
    """
    import zstandard as z

    many = int(np.searchsorted(np.cumsum([len(t) for t in lead]), LEAD * sum(map(len, texts)))) + 1
    texts = [*lead[:many], *texts]
    try:
        made = z.train_dictionary(size, [t for t in texts if len(t) >= GRAM], k=segment, d=GRAM).as_bytes()
    except z.ZstdError:
        made = b"".join(texts)[-size:]
    return np.resize(np.frombuffer(made or b" ", dtype=np.uint8), size).tobytes()


def _hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = words(data, offsets, ALNUM)
    return Prefix(data, LOWER_VALUE).of(starts, ends), first


def _code(h: np.ndarray) -> np.ndarray:
    out = np.empty((len(h), CODE), dtype=np.uint8)
    out[:, :8] = h.view(np.uint8).reshape(-1, 8)
    out[:, 8:] = mix(h ^ np.uint64(0x5851F42D4C957F2D)).view(np.uint8).reshape(-1, 8)[:, : CODE - 8]
    return out


def codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A matrix of word codes, and the index of each row's first word (one more than rows)."""
    h, first = _hashes(data, offsets)
    return _code(h), first


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model, self.by_toxic, self.by_ordinary = model, compressor(model.toxic), compressor(model.ordinary)

    def distances(self, matrix: np.ndarray) -> list[int]:
        """Of the windows of one text's codes."""
        t, o, whole, step = self.by_toxic, self.by_ordinary, memoryview(matrix).cast("B") if len(matrix) else b"", CODE * WINDOW
        return [len(o(w)) - len(t(w)) for w in (whole[i : i + step] for i in range(0, len(whole), step))]

    def all_distances(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[list[int]]:
        for a, b in chunks(offsets):
            matrix, first = codes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            for i, j in zip(first[:-1].tolist(), first[1:].tolist()):
                yield self.distances(matrix[i:j])

    def scores(self, column: pa.Array) -> list[float]:
        return [_logistic(features(d, self.model.threshold), self.model.weights) for d in self.all_distances(*flat(column))]


def features(distances: list[int], threshold: int) -> tuple[float, ...]:
    if not distances:
        return 1.0, 0.0, 0.0, 0.0, 0.0
    hits = sum(d >= threshold for d in distances)
    return 1.0, max(distances) / 10, sum(sorted(distances)[-3:]) / 30, sum(distances) / len(distances), math.log1p(hits)


def _logistic(x: tuple[float, ...], weights: tuple[float, ...]) -> float:
    z = sum(a * b for a, b in zip(x, weights))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _fit(rows: np.ndarray, labels: np.ndarray) -> tuple[float, ...]:
    """Ridge-penalised logistic regression by Newton steps."""
    w = np.zeros(rows.shape[1])
    penalty = np.diag([1e-3] + [0.1] * (rows.shape[1] - 1))
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        step = np.linalg.solve((rows * (p * (1 - p))[:, None]).T @ rows + penalty, rows.T @ (labels - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def _f1(hit: np.ndarray, y: np.ndarray) -> float:
    return 2 * (hit & (y == 1)).sum() / max(1, hit.sum() + (y == 1).sum())


def _candidates(toxic: list[np.ndarray], ordinary: list[np.ndarray]) -> Iterator[Model]:
    """Dictionaries of every size and round from rows of word hashes; a row's words count once."""
    blank = len(compressor(b" ")(bytes(range(CODE))))
    base = trained([_code(r).tobytes() for r in ordinary[::2] or ordinary], min(BASE, max(256, sum(map(len, ordinary)) * CODE // 4)), SEGMENTS[0])
    every = np.unique(np.concatenate([*toxic, *ordinary, np.zeros(0, np.uint64)]))
    lengths = lambda rows, content: np.fromiter(map(len, map(compressor(content), (memoryview(c).cast("B") for c in _code(rows)))), np.int64, len(rows))
    every = every[lengths(every, base) >= blank]  # what the base leaves uncovered
    among = lambda r, kept: r[kept[np.minimum(np.searchsorted(kept, r), len(kept) - 1)] == r] if len(kept) else r[:0]
    text = lambda rows, kept: [_code(k).tobytes() for k in (among(r, kept) for r in rows) if len(k)]
    lead = [_code(r).tobytes() for r in ordinary[::2]]
    for size in SIZES:
        make = lambda rows, kept: trained(text(rows, kept), size, SEGMENTS[1], lead)  # noqa: B023, E731
        own, other = make(toxic, every), make(ordinary[1::2] or ordinary, every)
        for _ in range(ROUNDS):
            by_toxic = lengths(every, own + base)
            other = make(ordinary, every[lengths(every, other + base) - by_toxic >= SAVES])
            yield Model(own + base, other + base, 0, ())
            own = make(toxic, every[lengths(every, other + base) - by_toxic >= SAVES])


def train(rows: list[np.ndarray], labels: list[int]) -> Model:
    """Dictionaries, threshold and curve from labelled rows of word hashes."""
    y = np.array(labels, dtype=np.int64)
    n = len(y)
    if not n or y.min() == y.max():
        rate = (y.sum() + 1) / (n + 2) if n else 0.5
        return Model(b" ", b" ", 1 << 20, (math.log(rate / (1 - rate)), 0.0, 0.0, 0.0, 0.0))
    # What judges the dictionaries is held out of them, or they would judge what they hold.
    out = np.arange(n) % HELD == HELD - 1
    if min(y[out].sum(), (1 - y[out]).sum(), y[~out].sum(), (1 - y[~out]).sum()) < 3:
        out = np.zeros(n, dtype=bool)
    held = np.flatnonzero(out) if out.any() else np.arange(n)
    truth = y[held]
    once = lambda some: [r[np.sort(np.unique(r, return_index=True)[1])] for r in (rows[i] for i in np.flatnonzero(some).tolist())]
    best: tuple = (-1.0,)
    for made in _candidates(once(~out & (y == 1)), once(~out & (y == 0))):
        scorer = Scorer(made)
        distances = [scorer.distances(_code(rows[i])) for i in held.tolist()]
        top = np.array([max(d, default=0) for d in distances])
        threshold = max(range(1, 2 * CODE), key=lambda t: (_f1(top >= t, truth), -t))
        x = np.array([features(d, threshold) for d in distances])
        weights = _fit(x, truth)
        best = max(best, (_f1(x @ np.array(weights) >= 0, truth), made.toxic, made.ordinary, threshold, weights))
    return Model(*best[1:])


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The bounded labelled sample: text and label.

    Ids are chosen on the label side first, so the documents join a table of at most TRAIN_TOXIC +
    TRAIN_ORDINARY rows, which is what is broadcast; no text is shuffled.
    """
    own = labels.select(column(labels, "doc_id").alias("doc_id"), column(labels, "toxic").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    own = own.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).groupBy("doc_id").agg(F.max("y").alias("y"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = own.where("y = 1").orderBy(*order).limit(TRAIN_TOXIC).unionByName(own.where("y = 0").orderBy(*order).limit(TRAIN_ORDINARY))
    rows = docs.select(column(docs, "doc_id").alias("doc_id"), column(docs, "text").cast("string").alias("text"))
    # One text an id, so that repeated rows don't exceed the bound.
    return rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of these tables; the driver holds the bounded sample's word hashes alone."""
    found: dict[tuple[int, bytes], tuple] = {}
    for r in training_rows(docs, labels).toLocalIterator():
        own = _hashes(*flat(pa.array([r["text"] or ""], pa.large_string())))[0]
        key = r["y"], own.tobytes()
        found[key] = min(found.get(key, (r["doc_id"], own)), (r["doc_id"], own), key=lambda x: x[0])
    rows = sorted(((d, y, own) for (y, _), (d, own) in found.items()), key=lambda x: x[:2])
    try:
        return train([x[2] for x in rows], [x[1] for x in rows])
    finally:
        release()


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """``keep`` and a score from 0 to 1 of every text; a narrow map without a shuffle."""
    spark = docs.sparkSession
    bounded_batches(spark)
    free_names(keep, (name,))
    shared = spark.sparkContext.broadcast(model)
    source = docs.select(*(column(docs, c).alias(c) for c in keep), column(docs, "text").cast("string").alias("_text_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            scores = pa.array(scorer.scores(batch.column(len(keep))), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], scores], [*keep, name])

    return source.mapInArrow(lean(run), ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]] + [f"`{name}` double"]))
