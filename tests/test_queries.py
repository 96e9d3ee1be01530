import pytest

import __spark_entry__ as entry
from tests.conftest import SF
from tidegraph.plans import core, pipeline  # noqa: F401 (pipeline registers its queries)


def rows(t):
    cols = sorted(t.column_names)
    return cols, sorted(tuple(f"{x:.5f}" if isinstance(x, float) else str(x) for x in r) for r in zip(*(t[c].to_pylist() for c in cols)))


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query_against_sql(spark, duck, name):
    got = core.QUERIES[name](spark, SF).toArrow()
    if name in core.SQL:
        assert rows(got) == rows(duck.execute(core.SQL[name]).to_arrow_table())


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
