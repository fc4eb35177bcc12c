"""Every query that SQL can express gives the rows that DuckDB gives."""

import oracle
import pytest

from brevia import queries as engine


@pytest.fixture(scope="module")
def duck(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(engine.ORACLES))
def test_same_rows(name, spark, sf_dir, duck):
    got = engine.QUERIES[name](spark, sf_dir).toPandas()
    assert oracle.difference(got, duck.execute(engine.ORACLES[name]).df()) == ""


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
