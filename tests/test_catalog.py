"""Every registered query against its SQL on the smallest tables."""

import pytest

from kgloom.plans import catalog


def norm(v):
    if isinstance(v, float):
        return "null" if v != v else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    return "null" if v is None else str(v)


def rows(table):
    cols = sorted(table.column_names)
    return cols, sorted(zip(*[map(norm, table[c].to_pylist()) for c in cols]))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, sf, name):
    got = catalog.QUERIES[name](spark, sf).toArrow()
    if name in catalog.ORACLES:
        assert rows(got) == rows(duck.execute(catalog.ORACLES[name]).to_arrow_table())
    else:
        assert got.num_rows > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())
