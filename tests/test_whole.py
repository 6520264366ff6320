"""Queries over whole columns and tables, against SQL without cuts."""

import duckdb
import pytest

from quire.plans import catalog

DATA = "/root/testdata/sf0.01"
ESCAPED = catalog._ESCAPE.format(x="html")
WHOLE = {
    "d11_run_books": "SELECT source AS book_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id))::INTEGER AS idx, source || ' ' || doc_id AS title, true AS translated FROM documents",
    "x8_escape": f"SELECT page_id, {ESCAPED} AS escaped FROM pages",
    "x11_data_uri": "SELECT doc_id, 'data:text/plain;base64,' || to_base64(encode(text)) AS uri FROM documents",
    "w2_carry_previous": "SELECT doc_id, coalesce(substr(last_value(CASE WHEN lang <> 'de' THEN text END IGNORE NULLS) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1, 12000), '') AS previous FROM documents",
    "w3_prefix_tail": "SELECT conv_id, turn, coalesce(right(string_agg(text, '' ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6000), '') AS tail FROM conversations",
}


@pytest.mark.parametrize("name", WHOLE)
def test_whole(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, DATA)
    con.execute(WHOLE[name])
    assert df.columns == [c[0] for c in con.description]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, con.fetchall()))
