"""Kept columns with names that an operator makes have one defined result: a ValueError, at any size."""

import pytest

P = pytest.importorskip("public_tokenizers")


def test_taken_names(spark):
    from quire.llm import bpe, leaks, pages, repeats, token_counts, toxicity

    names = "doc_id bigint, text string, ids string, decoded string, sections string, n_tokens bigint, score double, items string, spans string, n_words bigint, html string, kept string"
    docs = spark.createDataFrame([], names)
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k l")], "item_id bigint, text string")
    path, model = P.path("byte_bpe_50k.json"), toxicity.Model(b" ", b" ", 1, (0.0,) * 5)
    cases = {
        lambda keep: bpe.round_trip(docs, path, keep): ("ids", "decoded"),
        lambda keep: token_counts.attribute(docs, path, keep=keep): ("sections", "n_tokens"),
        lambda keep: toxicity.score(docs, model, keep): ("score",),
        lambda keep: leaks.scan(docs, bench, keep=keep): ("items", "spans", "n_words"),
        lambda keep: leaks.scan(docs, bench.limit(0), keep=keep): ("items",),
        lambda keep: pages.extract(docs, keep): ("text",),
        lambda keep: repeats.dedupe(docs, keep): ("kept", "spans"),
    }
    for f, taken in cases.items():
        for name in taken:
            with pytest.raises(ValueError):
                f(("doc_id", name))
            with pytest.raises(ValueError):  # as Spark compares names
                f(("doc_id", name.upper()))
        with pytest.raises(ValueError):
            f(("doc_id", "doc_id"))


def test_names_of_representatives(spark):
    from quire.llm import jaccard

    for name in ("_d", "_H", "_n"):
        with pytest.raises(ValueError):
            jaccard.representatives(spark.createDataFrame([], f"doc_id bigint, text string, `{name}` int"))
