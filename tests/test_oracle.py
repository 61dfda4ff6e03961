"""Every registered query against its SQL at the smallest scale."""

import pytest

import oracle
from memspark.plans import load_registry


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(load_registry()))
def test_query(spark, con, sf_dir, name):
    ok, info = oracle.compare(spark, con, sf_dir, name, load_registry()[name])
    assert ok, info


def test_entry_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(pytest.importorskip("pyspark.sql").SparkSession.getActiveSession()).columns == ["query_id", "doc_id", "score", "rank"]
