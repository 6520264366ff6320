"""Heavy grams beyond the list's size, and buckets over their bound: results stay those of brute force."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F
from test_operators import brute_repeats, collected, same

COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def _rows(seed: int) -> list[tuple[int, str]]:
    """A common line between unlike texts, whole copies, passages that differ from one place on."""
    r = random.Random(seed)
    some = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    line, copy, passage = some(70), some(700), some(400)
    rows = [(i, some(r.randint(20, 200)) + line + some(r.randint(20, 200)) if i % 3 else copy + some(i % 4) + " " * 300) for i in range(80)]
    return rows + [(100 + i, passage[: r.randint(90, 400)] + some(30) + passage[r.randint(0, 300) :]) for i in range(40)]


def test_a_full_list_keeps_the_most_frequent_grams(spark, monkeypatch):
    from quire.llm import repeats

    rows = _rows(1)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    texts = docs.select(F.col("doc_id").alias("doc"), F.lit(0).cast("bigint").alias("h"), "text")
    monkeypatch.setattr(repeats, "SAMPLE", 1)
    monkeypatch.setattr(repeats, "HEAVY", 3)
    every = repeats._sample(texts, 8)[1]
    monkeypatch.setattr(repeats, "HEAVY_GRAMS", 8)
    assert len(every) > 8
    counts: dict[bytes, int] = {}
    for _, t in rows:
        b = t.encode()
        for i in range(max(0, len(b) - 15)):
            counts[b[i : i + 16]] = counts.get(b[i : i + 16], 0) + 1
    hashed = {int(repeats.Prefix(np.frombuffer(g, np.uint8), repeats.BYTE_VALUE).fixed(16)[0]): n for g, n in counts.items()}
    few = [hashed[int(g)] for g in repeats._sample(texts, 8)[1]]
    assert len(few) == 8 and sorted(few) == sorted(hashed.values())[-8:]
    want = brute_repeats(rows, {t: i for i, (_, t) in enumerate(rows)})
    same(collected(repeats.report(repeats.dedupe(docs.repartition(5))), *COLUMNS), want)


def test_buckets_over_the_bound_are_cut_by_following_bytes(spark, monkeypatch, tmp_path):
    from quire.llm import repeats

    rows = _rows(2)
    want = brute_repeats(rows, {t: i for i, (_, t) in enumerate(rows)})
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    rounds, width_of = [], repeats._dealt_again
    monkeypatch.setattr(repeats, "_dealt_again", lambda carried, width, labels: rounds.append(width) or width_of(carried, width, labels))
    for bound in (40_000, 300):  # the second is below what a few contexts have, so that every round is run
        monkeypatch.setattr(repeats, "JUDGE_BYTES", bound)
        monkeypatch.setattr(repeats, "BUCKETS", 1 if bound > 300 else 4)
        monkeypatch.setattr(repeats, "partitions", lambda spark: 2)
        same(collected(repeats.report(repeats.dedupe(docs)), *COLUMNS), want)
    assert rounds[-7:] == repeats.widths()[1:] == [43, 22, 11, 6, 3, 2, 1]


def test_pieces_hold_each_string_once_and_equal_ones_together():
    from quire.llm import repeats

    r = np.random.default_rng(5)
    data = r.integers(97, 101, 9000, dtype=np.uint8)
    data[4000:6000] = data[1000:3000]
    found = repeats.anchors(data, np.array([0, 9000]))
    rows = np.zeros(len(found["lo"]), dtype=repeats._ROW)
    rows["gram"], rows["lo"], rows["back"], rows["span"] = found["gram"], found["lo"], found["at"] - found["lo"], found["hi"] - found["lo"]
    whole = repeats.Contexts(rows, found["src"], data)
    for width in repeats.widths():
        cut, leading = repeats.pieces(whole, width)
        assert (cut.rows["span"] < width).all() and (cut.rows["lo"].astype(np.int64) == cut.src).all()
        assert (cut.rows["lo"].astype(np.int64) + cut.rows["back"] == np.repeat(found["at"], [((cut.rows["gram"] == g) & (cut.rows["lo"] + cut.rows["back"] == a)).sum() for g, a in zip(found["gram"], found["at"])])).all()
        starts = [(int(lo) + i, int(k)) for lo, span, k in zip(cut.rows["lo"], cut.rows["span"], leading) for i in range(span + 1)]
        assert sorted(s for s, _ in starts) == list(range(8901))
        to: dict[bytes, int] = {}
        assert all(to.setdefault(data[s : s + 100].tobytes(), k) == k for s, k in starts)
