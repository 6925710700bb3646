"""Every catalog query with a DuckDB statement must agree with it (sf0.001)."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from quire.sources.tables import DRIVER_TABLES

from conftest import SF_SMALL

SLOW = {"op6_chosen_path"}
NAMES = [n for n in E.oracle_sql() if n not in SLOW]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in DRIVER_TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def canon(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def n(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, 6)
        return v
    return sorted((tuple(n(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_duckdb(spark, con, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    res = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(sdf.columns) == sorted(dcols)
    types = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    rel = con.sql(E.oracle_sql()[name])
    dtypes = {n: str(t) for n, t in zip(rel.columns, rel.types)}
    for f in sdf.schema.fields:
        assert types.get(f.dataType.simpleString(), f.dataType.simpleString()) == dtypes[f.name], f.name
    assert canon(sdf.columns, [tuple(r) for r in sdf.collect()]) == canon(dcols, res.fetchall())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and df.columns == ["query_id", "rank", "vec_id", "label", "similarity"]


def test_every_query_has_a_callable():
    assert set(E.oracle_sql()) <= set(E.queries())
