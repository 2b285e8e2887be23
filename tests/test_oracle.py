"""Every registered query against its DuckDB oracle on the smallest tables."""

import pytest

from meshlens.plans import catalog
from meshlens.plans.verify import check_one, duck_connect

NAMES = sorted(catalog.queries())


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck_connect(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, sf_dir, name):
    r = check_one(spark, con, name, sf_dir)
    assert r["status"] in ("OK", "rows-only"), r


def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() >= 0
    assert set(e.oracle_sql()) <= set(e.queries())
