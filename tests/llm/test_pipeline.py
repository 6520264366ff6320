"""The pipeline on small data against its stages in brute force."""

import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    from quire.llm import jaccard, leaks, toxicity

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "repeats", "decontamination", "bpe"]
    step, by = docs, {}
    for name, f in corpus_pipeline.STAGES:
        step = f(spark, step, DATA).cache()
        by[name] = step.collect()
        if name != "bpe":
            assert step.columns == docs.columns
    model = toxicity.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    assert {r["doc_id"] for r in by["toxicity"]} == {r["doc_id"] for r in toxicity.score(docs, model).where("score < 0.5").collect()}

    def shingles(x):
        ws = re.findall(r"[^\x20\x09-\x0D]+", (x or "").lower())
        return {tuple(ws[i : i + 4]) for i in range(len(ws) - 3)} if len(ws) > 3 else {tuple(ws)} if ws else set()

    kept = [shingles(r["text"]) for r in by["near_duplicates"]]
    assert all(100 * len(a & b) < 85 * len(a | b) for i, a in enumerate(kept) for b in kept[:i] if a and b)
    gone = {r["doc_id"] for r in by["toxicity"]} - {r["doc_id"] for r in by["near_duplicates"]}
    component = {r["doc_id"]: r["component_id"] for r in jaccard.components(spark.createDataFrame(by["toxicity"], docs.schema)).collect()}
    assert gone == {d for d, c in component.items() if d != c}
    seen = set()
    for r in sorted(by["repeats"], key=lambda r: r["doc_id"]):
        assert r["n_chars"] == len(r["text"])
    before = {r["doc_id"]: r["text"] or "" for r in by["near_duplicates"]}
    for d in sorted(before):
        b = before[d].encode()
        again = any(b[p : p + 100] in seen for p in range(len(b) - 99))
        own = [b[p : p + 100] for p in range(len(b) - 99)]
        again |= len(set(own)) < len(own)
        seen.update(own)
        after = next(r["text"] for r in by["repeats"] if r["doc_id"] == d)
        assert (after != before[d]) == again
    hit = {r["doc_id"] for r in leaks.scan(spark.createDataFrame(by["repeats"], docs.schema), spark.read.parquet(f"{DATA}/benchmark.parquet")).where("size(items) > 0").collect()}
    assert {r["doc_id"] for r in by["repeats"]} - {r["doc_id"] for r in by["decontamination"]} == hit
    assert sorted(r["doc_id"] for r in by["bpe"]) == sorted(r["doc_id"] for r in by["decontamination"])
    run = corpus_pipeline.run(spark, DATA)
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, by["bpe"]))


def test_queries_are_registered():
    import __spark_entry__ as e

    names = [n for n in e.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in e.queries()
