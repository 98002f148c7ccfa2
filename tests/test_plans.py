"""Every plan against its SQL on the same tables."""

import math

import duckdb
import pytest

import __spark_entry__
from tesserae.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def clean(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 3)
    return v


def rows_of(rows, names):
    return sorted((tuple(clean(r[c]) for c in names) for r in rows), key=str)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_plan_equals_sql(spark, sf, duck, name):
    out = catalog.QUERIES[name](spark, sf)
    got = out.collect()
    if name not in catalog.ORACLES:
        assert got
        return
    rel = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(out.columns) == sorted(names)
    assert rows_of(got, names) == rows_of([dict(zip(names, r, strict=True)) for r in rel.fetchall()], names)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
