import duckdb
import pytest

from quire.plans import catalog

DATA = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cell = lambda v: "null" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(names), sorted(tuple(cell(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, DATA)
    con.execute(catalog.ORACLES[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([c[0] for c in con.description], con.fetchall())


def test_split_pages(spark):
    assert catalog.QUERIES["d06_split_chapter"](spark, DATA).where("error is not null and length(xhtml) < 800").count() == 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 51 and set(e.oracle_sql()) <= set(e.queries())
