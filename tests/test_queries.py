"""Every registered query against its SQL twin on the smallest tables."""

import math

import pytest

import __spark_entry__ as contract

QUERIES, SQL = contract.queries(), contract.oracle_sql()
# A narrow selection may be empty on the smallest tables.
MAY_BE_EMPTY = {"filter_portfolio", "impact_base", "churn_drivers", "stay_drivers"}


def normal(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4) + 0.0
    return v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, folder, name):
    df = QUERIES[name](spark, folder)
    got = [tuple(r) for r in df.collect()]
    assert got or name in MAY_BE_EMPTY
    if name not in SQL:
        return
    res = duck.execute(SQL[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == sorted(df.columns)
    want = rows(names, res.fetchall())
    have = rows(df.columns, got)
    assert len(have) == len(want)
    assert have == want


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_matches_flagship(spark, duck):
    df = contract.entry(spark)
    assert df.count() == len(duck.execute(SQL[contract.FLAGSHIP]).fetchall())
