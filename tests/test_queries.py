"""Every core query against its SQL, and rows for those that SQL can't express."""

import pytest
from conftest import SF, rows_of

from quillon import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(queries.ORACLE_SQL[name])
    assert got == rows_of([c[0] for c in cur.description], cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_has_rows(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0
