"""Queries that SQL can express, against DuckDB on whole tables."""
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from haulage.llm import oracles, queries  # noqa: E402
from tools.check_oracle import canon, duck  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracles.build()))
def test_query_equals_sql(spark, name):
    df = queries.build()[name](spark, SF)
    found = canon(df.columns, [tuple(r) for r in df.collect()])
    con = duck(SF)
    result = con.execute(oracles.build()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert canon(names, result.fetchall()) == found


def test_every_operator_is_registered():
    import __spark_entry__ as entry

    names = list(entry.queries())
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names
