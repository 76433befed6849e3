"""Every query against its SQL twin on the shared tables."""

import datetime as dt
import math

import pytest

from pricetide.catalog import QUERIES, SQL



def plain(value):
    if isinstance(value, dt.datetime):
        return value.isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, data_dir, name):
    frame = QUERIES[name](spark, data_dir)
    rows = frame.collect()
    if name not in SQL:
        assert rows
        return
    result = duck.execute(SQL[name])
    columns = [d[0] for d in result.description]
    want_columns, want = table_of(columns, result.fetchall())
    have_columns, have = table_of(frame.columns, [tuple(r) for r in rows])
    assert have_columns == want_columns
    assert want, "the query should not be empty on the shared tables"
    assert len(have) == len(want)
    different = [(h, w) for h, w in zip(have, want) if h != w]
    assert not different, different[:3]


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
