"""Frequency classes of shingles stay apart at any fill of the counters; blocks of unlinked texts don't form."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F


def test_counters_follow_the_input():
    from quire.llm import jaccard

    assert jaccard.counters_for(0) == jaccard.COUNTERS == jaccard.counters_for(jaccard.COUNTERS * jaccard.SHARE)
    assert jaccard.counters_for(jaccard.COUNTERS * jaccard.SHARE + 1) == 2 * jaccard.COUNTERS
    assert jaccard.counters_for(1 << 60) == jaccard.MOST_COUNTERS


def test_classes_do_not_collapse_when_counters_fill():
    from quire.llm import jaccard

    r = np.random.default_rng(1)
    for mean in (0.1, 3, 200, 70_000, 2_000_000):  # the last is some hundreds of terabytes of text
        table = r.poisson(mean, (32, jaccard.COUNTER_ROW)).astype(np.uint32)
        table[0, :4] += np.array([4, 40, 400, 4000], dtype=np.uint32) * np.uint32(1 + mean**0.5)
        found = jaccard.classes_of(table)
        assert found[3] > found[2] > found[1] > found[0], mean
        assert np.mean(found == 0) >= 0.85
    table[0, 0] = 2**32 - 1
    assert jaccard.classes_of(table)[0] > found[3]
    assert (jaccard.classes_of(np.zeros((2, 8), dtype=np.uint32)) == 0).all()


def test_counts_add_up_over_tasks(spark, monkeypatch):
    from quire.llm import jaccard

    monkeypatch.setattr(jaccard, "COUNTERS", 1 << 16)
    monkeypatch.setattr(jaccard, "MOST_COUNTERS", 1 << 16)
    seen = []
    monkeypatch.setattr(jaccard, "classes_of", lambda table: seen.append(table.copy()) or np.zeros(table.size, dtype=np.uint8))
    docs = spark.createDataFrame([("a b c d",)] * 700 + [("a b c d e",)] * 30 + [(None,), ("",), ("x",)], "text string").repartition(3)
    jaccard.frequency_classes(docs, 4)
    assert sorted(seen[0][seen[0] > 0].tolist()) == [1, 30, 730]  # over 255 in a task
    jaccard.frequency_classes(docs.limit(0), 4)
    assert not seen[1].any()


def test_texts_that_share_a_phrase_form_no_block_with_full_counters(spark, monkeypatch):
    """Counters as full as those of terabytes: the shared phrase still leaves the prefixes."""
    from quire.llm import jaccard

    monkeypatch.setattr(jaccard, "COUNTERS", 1 << 16)
    monkeypatch.setattr(jaccard, "MOST_COUNTERS", 1 << 16)
    r = random.Random(4)
    words = lambda n: " ".join(f"w{r.randrange(10**9)}" for _ in range(n))
    phrase = words(20)
    rows = [(i, f"{words(100)} {phrase} {words(100)}") for i in range(3000)]
    texts = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    classes = jaccard.frequency_classes(texts, 4)
    assert len(classes) == 1 << 16  # some ten shingles a counter
    postings = jaccard._features(texts, 4, 85, classes).select("node", "n", F.explode("prefix").alias("token"))
    assert postings.groupBy("token").count().agg(F.max("count")).first()[0] < 10
