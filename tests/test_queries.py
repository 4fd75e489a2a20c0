"""Every registered query that has SQL against DuckDB on the smallest tables; the others give rows."""

import math
import os

import pytest

from swathline.plans import all_oracles, all_queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df, columns):
    plain = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else v
    values = df[columns].astype(object).where(df[columns].notna(), None).values.tolist()
    return sorted((tuple(plain(v) for v in r) for r in values), key=str)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, duck, name):
    got = all_queries()[name](spark, SF).toPandas()
    if name not in all_oracles():
        assert len(got) > 0
        return
    want = duck.sql(all_oracles()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(want.columns)) == rows(want, sorted(want.columns))


def test_every_oracle_has_a_query():
    assert set(all_oracles()) <= set(all_queries())
