"""Every named query against its SQL twin on the smallest tables."""

import importlib

import pytest
from compare import compare, duck

FOLDER = "/root/testdata/sf0.001"
entry = importlib.import_module("__spark_entry__")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equal_to_sql(spark, con, name):
    assert compare(QUERIES[name](spark, FOLDER), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() >= 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "severity" in df.columns


def test_many_rules_do_not_hang_on_the_ids_of_a_table(spark, tmp_path):
    for name in ("events", "customer", "supplier", "part", "benchmark", "documents"):
        df = spark.read.parquet(f"{FOLDER}/{name}.parquet")
        if name == "events":
            df = df.withColumn("event_id", df["event_id"] + 1_000_000)
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    assert QUERIES["custom_rules_many"](spark, str(tmp_path)).count() > 0
