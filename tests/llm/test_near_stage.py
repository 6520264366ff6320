"""The pipeline's near-duplicate stage against brute force: five words, similarity from 0.8 on."""

import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"


def shingles(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) > 4 else {tuple(ws)} if ws else set()


def test_near_stage(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    words = [f"w{i}" for i in range(50)]  # one word changed: 41 of 51 at five words, 43 of 51 at four
    near = [(10**6, " ".join(words)), (10**6 + 1, " ".join([*words[:25], "changed", *words[26:]]))]
    docs = docs.unionByName(spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in near], docs.schema))
    rows = [(r["doc_id"], shingles(r["text"])) for r in docs.collect()]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows[:i]):
            if a and b and 10 * len(a & b) >= 8 * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    kept = sorted(r["doc_id"] for r in stage(spark, docs, DATA).collect())
    assert kept == sorted(d for i, (d, a) in enumerate(rows) if not a or least[root(i)] == d) and 10**6 in kept and 10**6 + 1 not in kept
