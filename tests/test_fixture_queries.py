"""Queries over literal records, each against its DuckDB SQL."""

import duckdb
import pytest

from textloom.plans.catalogue import FIXTURE_SQL, FIXTURES, QUERIES


def norm(v):
    if isinstance(v, float):
        return repr(round(v, 9))
    return "[" + ",".join(map(norm, v)) + "]" if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(FIXTURES))
def test_equals_its_sql(spark, name):
    found = FIXTURES[name](spark, "/root/testdata/sf0.001")
    wanted = duckdb.connect().sql(FIXTURE_SQL[name])
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns) and name not in QUERIES
    order = [wanted.columns.index(c) for c in columns]
    rows = sorted(tuple(norm(r[c]) for c in columns) for r in found.collect())
    assert rows == sorted(tuple(norm(r[i]) for i in order) for r in wanted.fetchall()) and rows
