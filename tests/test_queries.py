"""Every registered query against its SQL in DuckDB."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from tallyvox.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
LATER = ("op", "pipeline")


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(([plain(x) for x in r] for r in df.itertuples(index=False)), key=lambda r: [(x is None, isinstance(x, str), x if x is not None else 0) for x in r])


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), con.execute(catalog.SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_plans_push_down_and_prune(spark):
    plan = catalog.QUERIES["m01_m06_confusion"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan.split("ReadSchema")[1] and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_seeded_sample_repeats(spark):
    f = catalog.QUERIES["t04_seeded_sample"]
    assert f(spark, SF).collect() == f(spark, SF).collect()
