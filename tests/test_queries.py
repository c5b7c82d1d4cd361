"""Every query over the small tables; those with SQL give DuckDB's rows."""

import math

import pytest

from lodestar.plans import QUERIES, SQL


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return round(float(value), 6) if type(value).__name__ == "Decimal" else value


def ordered(rows, columns, names):
    at = [columns.index(n) for n in names]
    return sorted([tuple(plain(r[i]) for i in at) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, duck, name):
    found = QUERIES[name](spark, small)
    rows = [tuple(r) for r in found.collect()]
    if name not in SQL:
        assert found.columns
        return
    told = duck.execute(SQL[name])
    columns = [d[0] for d in told.description]
    assert sorted(columns) == sorted(found.columns)
    assert ordered(rows, found.columns, sorted(columns)) == ordered(told.fetchall(), columns, sorted(columns))
