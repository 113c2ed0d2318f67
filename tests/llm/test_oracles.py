import duckdb
import pytest

from locusmill.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.sql(queries.ORACLES[name])
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(want.columns)
    assert sorted((tuple(r) for r in df.select(*want.columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_names():
    assert sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0])) == list(queries.QUERIES) and len(queries.QUERIES) == 13
