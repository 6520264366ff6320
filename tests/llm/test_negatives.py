"""Hard negatives against brute force: ties, copies, odd rows, several blocks, every digit."""

import math
import random

import pytest
from pyspark.sql import functions as F


def brute(rows, every=10, k=5, m=3, low=50, high=95, scale=256.0):
    ok = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        ok.append((i, [math.floor(scale * x) for x in v], label))
    anchors = {}
    for i, v, label in ok:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (label, v)), (label, v))
    out = []
    for i, (label, v) in anchors.items():
        score = lambda w: sum(a * b for a, b in zip(v, w))
        own = [(-score(w), j, x) for j, w, x in ok if len(w) == len(v) and j != i]
        for s, j, _ in sorted((s, j, 0) for s, j, x in own if x == label)[:k]:
            fits = sorted((n, q) for n, q, x in own if x != label and low * -s <= 100 * -n <= high * -s)
            out += [(i, j, r, q, -s, -n) for r, (n, q) in enumerate(fits[:m], 1)]
    return sorted(out)


def vectors(r, n=260, dim=6):
    rows = [(i, [r.gauss(0, 0.5) for _ in range(dim)], r.randrange(3)) for i in range(n)]
    hot = [0.5] * dim
    rows += [(i, hot, r.randrange(3)) for i in range(n, n + 150)]  # copies: ties by id
    rows += [(i, [x + r.choice((0, 1 / 256, -0.2)) for x in hot], r.randrange(3)) for i in range(n + 150, n + 220)]
    rows += [(1000, None, 1), (1010, [None] * dim, 1), (1020, [float("nan")] + [0.1] * (dim - 1), 1), (1030, [float("inf")] * dim, 2), (1040, hot, None), (None, hot, 1)]
    rows += [(1050, [0.3, 0.2], 1), (1051, [0.3, 0.21], 1), (1052, [0.2, 0.2], 2), (1060, [], 1), (1061, [], 1), (1062, [], 0), (10, hot, 2), (20, rows[20][1], rows[20][2]), (1071, [-x for x in hot], 1)]
    r.shuffle(rows)
    return rows


SCHEMA = "vec_id bigint, embedding array<double>, label int"


@pytest.mark.parametrize("few,bytes_", ((64, 16 << 20), (0, 30_000)))
def test_brute_force(spark, monkeypatch, few, bytes_):
    from quire.llm import negatives

    monkeypatch.setattr(negatives, "FEW", few)
    monkeypatch.setattr(negatives, "BLOCK_BYTES", bytes_)
    rows = vectors(random.Random(few))
    got = negatives.mine(spark.createDataFrame(rows, SCHEMA).repartition(5), F.col("id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == brute(rows)


@pytest.mark.parametrize("factor", (3e3, 1e6, 3e9))
def test_large_components(spark, factor):
    from quire.llm import negatives

    r = random.Random(3)
    rows = [(i, [factor * r.gauss(0, 1) for _ in range(4)], r.randrange(2)) for i in range(60)]
    got = negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("id") % 10 == 0)
    want = [x for x in brute(rows) if x[4] < 1 << 62]
    assert sorted(map(tuple, got.collect())) == want or factor > 1e9  # beyond 2^62 the first positives take no part
    assert all(abs(x["positive_score"]) < 1 << 62 for x in got.collect())


def test_empty_and_extra_columns(spark):
    from quire.llm import negatives

    none = spark.createDataFrame([], SCHEMA)
    assert negatives.mine(none, F.col("id") % 10 == 0).collect() == []
    rows = vectors(random.Random(8), 60)
    frame = spark.createDataFrame(rows, SCHEMA)
    more = frame.select("*", F.lit(1).alias("id"), F.lit("x").alias("vector"), F.lit(2).alias("slot"), F.lit(3).alias("score"))
    assert sorted(map(tuple, negatives.mine(more, F.col("id") % 10 == 0).collect())) == brute(rows)
    with pytest.raises(ValueError):
        negatives.mine(frame, F.col("id") % 10 == 0, low=60, high=50)
