"""Every query of the catalogue against DuckDB, and the plans that matter."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from strata.plans import catalog

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    return c


def plain(v):
    v = v.item() if hasattr(v, "item") else v
    return None if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_equals_sql(spark, db, name):
    df = catalog.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = db.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    one = plan(catalog.queries()["transform_discounted"](spark, SMALL))
    assert "Join" not in one and "Exchange" not in one and "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double,l_discount:double>" in one.replace(" ", " ")
    gate = plan(catalog.queries()["gate_even"](spark, SMALL))
    assert "Exchange" not in gate
    unfolded = plan(catalog.queries()["unfold_parent_join"](spark, SMALL))
    assert "Join" not in unfolded  # the parent's value travels with its children
    chain = plan(catalog.queries()["fold_of_fold"](spark, SMALL))
    assert "partial_sum" in chain and "Window" not in chain


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).agg(F.count(F.lit(1))).first()[0] == 1
    assert set(e.oracle_sql()) <= set(e.queries())
