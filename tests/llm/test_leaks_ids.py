"""Benchmark items without an id taint documents like others."""


def test_items_without_id(spark):
    from quire.llm import leaks

    passage, other = (" ".join(f"{x}{i}" for i in range(12)) for x in "ab")
    docs = spark.createDataFrame([(1, f"x {passage} y"), (2, f"x {other} y"), (3, "clean")], "doc_id bigint, text string").coalesce(1)
    bench = spark.createDataFrame([(None, passage), (7, other)], "item_id bigint, text string")
    limit = leaks.BLOCK_WINDOWS
    try:
        for leaks.BLOCK_WINDOWS in (limit, 1):  # in one block, and in several
            found = {r["doc_id"]: (r["n_hit"], r["n_items"], r["contaminated"]) for r in leaks.report(leaks.scan(docs, bench)).collect()}
            assert found == {1: (12, 0, True), 2: (12, 1, True), 3: (0, 0, False)}
    finally:
        leaks.BLOCK_WINDOWS = limit
