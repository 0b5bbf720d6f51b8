"""Every registered query against its DuckDB oracle (the driver's gate) at sf0.001."""
import pytest

import __spark_entry__ as entry
from haulage.plans import oracle, registry
from tools.check_oracle import compare, duck
from conftest import SMALL_SF

QUERIES = registry.build()
ORACLE = oracle.build()


@pytest.fixture(scope="module")
def con():
    return duck(SMALL_SF)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["id_driver", "driver_full_name", "experience_years", "completed_trips",
                          "trips_in_progress", "total_payment", "total_bonuses", "total_earned"]


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, con, key):
    r = compare(spark, con, key, QUERIES[key], ORACLE[key], SMALL_SF)
    assert r["ok"], r
