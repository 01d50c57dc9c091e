"""Every registered query against its SQL on DuckDB, over the smallest tables."""

import duckdb
import pandas as pd
import pytest

from quillon import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def normal(df: pd.DataFrame) -> list[tuple]:
    def cell(x):
        if x is None or x is pd.NaT or x is pd.NA or x != x:
            return None
        return round(float(x), 6) + 0.0 if isinstance(x, (int, float)) or hasattr(x, "dtype") else str(x)

    df = df[sorted(df.columns)]
    return sorted((tuple(cell(x) for x in row) for row in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    sql = registry.ORACLE_SQL.get(name)
    if sql is None:
        assert len(got.columns) and len(got)
        return
    want = con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)
