"""The queries of this subpackage that have SQL return the SQL's rows."""

import duckdb
import pytest

from tessera.llm.queries import ORACLES, QUERIES
from tests.test_oracle import SF, TABLES, canon


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(ORACLES[name]).fetchdf()
    got = QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and canon(got) == canon(want)
