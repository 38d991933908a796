"""Every registered query against its SQL, on the smallest data."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from compare import compare, duck
from incident_signals.catalog import CHECKS, QUERIES


@pytest.fixture(scope="module")
def connection(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, connection, name):
    ok, message = compare(spark, sf_dir, name, QUERIES, CHECKS, connection)
    assert ok, message


def test_every_check_has_a_query():
    assert set(CHECKS) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_report_table_derives_only_the_columns_asked_for(spark, sf_dir):
    from incident_signals.catalog import adapter

    whole = adapter.derive_enriched(spark, sf_dir, list(adapter.DIMENSIONS))
    bare = adapter.derive_enriched(spark, sf_dir, [], truth=False)
    assert not any("lineitem" in name for name in bare.inputFiles())
    assert {tuple(r) for r in bare.collect()} == {tuple(r) for r in whole.select(*bare.columns).collect()}
    some = adapter.derive_enriched(spark, sf_dir, ["predicted_barrier_failures"])
    assert not any("supplier" in name for name in some.inputFiles())

    def rows(df):
        lists = df.withColumn("predicted_barrier_failures", F.array_sort("predicted_barrier_failures"))
        return sorted(str(r) for r in lists.select(*some.columns).collect())

    assert rows(some) == rows(whole)
