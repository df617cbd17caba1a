"""Every query against its oracle on the smallest tables."""

from __future__ import annotations

import pytest

from driftmode.queries import ORACLE_SQL, QUERIES


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE_SQL)


def rows(columns, records):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted(tuple(repr(r[i]) for i in at) for r in records)


@pytest.mark.parametrize("name", list(QUERIES))
def test_oracle(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    cur = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    got, want = rows(df.columns, [tuple(r) for r in df.collect()]), rows(columns, cur.fetchall())
    assert len(got) == len(want) and got == want


def test_entry_point(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert e.entry(spark).count() > 0
