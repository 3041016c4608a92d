"""The registered queries against their SQL on the smallest tables, and the contract's functions."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_module

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
catalog = pytest.importorskip("ragloom.plans.catalog")
NAMES = list(catalog.ORACLE_SQL)


def canonical(rows):
    def value(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else round(x, 6) + 0.0
        return x

    return sorted(str(tuple(value(x) for x in r)) for r in rows)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    result = db.execute(catalog.ORACLE_SQL[name])
    assert sorted(d[0] for d in result.description) == columns
    wanted = db.execute(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({catalog.ORACLE_SQL[name]})").fetchall()
    assert canonical(got) == canonical(wanted)


def test_contract_functions(spark):
    queries, oracles = entry_module.queries(), entry_module.oracle_sql()
    assert set(oracles) <= set(queries) and set(catalog.QUERIES) <= set(queries)
    assert entry_module.entry(spark).count() > 0
