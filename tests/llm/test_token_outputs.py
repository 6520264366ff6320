"""Token counts of the query against brute force, and what the token files' footers say."""

import random

import pytest

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")
DATA = "/root/testdata/sf0.001"


def test_counts_of_lines(spark):
    from quire.llm.queries import QUERIES

    library = tokenizers.Tokenizer.from_file(PATH)
    want = {}
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        text = r["text"] or ""
        offsets = library.encode(text, add_special_tokens=False).offsets
        bounds, at = [], 0
        for line in text.split("\n") if text else []:
            bounds.append((at, min(len(text), at + len(line) + 1)))
            at = bounds[-1][1]
        own = [sum(a <= s < b for s, _ in offsets) for a, b in bounds]
        crossed = sum(any(s < x < e for s, e in offsets for x in (a, b)) for a, b in bounds if b > a)
        outside = sum(not any(a <= s < b for a, b in bounds) for s, _ in offsets)
        want[r["doc_id"]] = (len(offsets), outside, len(bounds), sum(own), max(own, default=0), crossed)
    columns = ("n_tokens", "n_outside", "n_sections", "n_allocated", "largest", "n_crossed")
    got = {r["doc_id"]: tuple(r[c] for c in columns) for r in QUERIES["op2_token_counts"](spark, DATA).collect()}
    assert got == want


def test_footers(spark, tmp_path):
    import pyarrow.parquet as pq

    from quire.llm import token_files

    r = random.Random(1)
    rows = [(i, " ".join(r.choice(("river", "market", "stone", "light", "water")) for _ in range(400))) for i in range(4000)]
    token_files.write(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), PATH, str(tmp_path / "ids"), files=2)
    files = sorted((tmp_path / "ids").glob("*.parquet"))
    assert len(files) == 2
    for f in files:
        meta = pq.ParquetFile(f).metadata
        ids = [c for c in range(meta.num_columns) if meta.schema.column(c).path.startswith("ids")][0]
        for g in range(meta.num_row_groups):
            chunk = meta.row_group(g).column(ids)
            assert "RLE_DICTIONARY" in chunk.encodings and chunk.has_offset_index and chunk.has_column_index
            assert meta.row_group(g).total_byte_size <= 2 * token_files.ROW_GROUP_BYTES
        others = sum(meta.row_group(g).column(c).total_compressed_size for g in range(meta.num_row_groups) for c in range(meta.num_columns) if c != ids)
        assert others * 4 < f.stat().st_size  # metadata alone is a small read
    plan = token_files.read(spark, str(tmp_path / "ids"), with_ids=False)._jdf.queryExecution().executedPlan().toString()
    assert "ids:" not in plan.split("ReadSchema")[1].split(">")[0]
    assert token_files.read(spark, str(tmp_path / "ids")).where("doc_id = 7").select("n_tokens").first()[0] > 400
