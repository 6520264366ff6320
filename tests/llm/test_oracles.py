"""Queries against their SQL, over whole tables."""

import pytest

pytest.importorskip("public_tokenizers")
DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ("op1_fingerprints", "op3_licenses", "op5_repeats", "op6_near_duplicates", "op9_decontamination", "op11_hard_negatives", "op12_chat_format", "op13_periodic_runs"))
def test_matches_sql(spark, name):
    import duckdb

    from quire.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    con.execute(ORACLES[name])
    cell = lambda v: f"{v:.9f}" if isinstance(v, float) else str(v)
    names = [c[0] for c in con.description]
    want = sorted(tuple(map(cell, r)) for r in con.fetchall())
    found = QUERIES[name](spark, DATA)
    assert sorted(found.columns) == sorted(names)
    assert sorted(tuple(map(cell, r)) for r in found.select(*names).collect()) == want
