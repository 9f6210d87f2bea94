"""Every core query with SQL gives the oracle's rows; the others run with a stable schema."""

import pytest

from lodestrata.plans.catalog import ORACLES, QUERIES
from tests.helpers import both


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(name, spark, small, duck):
    columns, expected_columns, got, expected = both(QUERIES[name], ORACLES[name], spark, small, duck)
    assert columns == expected_columns
    assert got == expected


#: Queries of which the small tables may have no rows.
MAY_BE_EMPTY = {"synthesis_scores", "ranked_findings"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(name, spark, small):
    df = QUERIES[name](spark, small)
    assert len(df.columns) == len(set(df.columns))
    rows = sorted(map(repr, df.collect()))
    assert rows or name in MAY_BE_EMPTY
    assert rows == sorted(map(repr, QUERIES[name](spark, small).collect()))  # the same rows every time


def test_entry(spark, small):
    import __spark_entry__ as entry

    buckets = {r["bucket"]: r["n"] for r in entry.entry(spark).collect()}
    assert buckets and set(buckets) <= {"keep", "leak", "neardup", "overlength"}
    assert set(entry.oracle_sql()) <= set(entry.queries())
