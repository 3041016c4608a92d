"""The training-data queries against their SQL on the smallest tables."""

import duckdb
import pytest

from ragloom.llm import queries

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    wanted = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, DIR).select(*wanted.columns).collect()
    rounded = lambda rows: sorted(str(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in rows)
    assert rounded(got) == rounded(wanted.fetchall())
