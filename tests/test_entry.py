import math
import os

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_every_check_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 8))
    return str(v)


@needs_data
@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith(("p2", "p4", "p6", "p7", "p8"))))
def test_query_equals_sql(spark, name):
    import duckdb

    sql = duckdb.connect()
    sql.execute("set timezone = 'UTC'")
    for f in os.listdir(FOLDER):
        sql.execute(f"create view {f.split('.')[0]} as select * from '{FOLDER}/{f}'")
    df = entry.queries()[name](spark, FOLDER)
    got = sql.execute(entry.oracle_sql()[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted(tuple(plain(r[names.index(c)]) for c in order) for r in got.fetchall())
    assert sorted(tuple(plain(r[c]) for c in order) for r in df.collect()) == want


@needs_data
def test_flagship_has_rows(spark):
    assert entry.entry(spark).count() > 0
