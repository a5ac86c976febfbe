import os

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", ["p2_found", "p2_cover", "p6_cover"])
def test_queries_equal_sql(spark, name):
    import duckdb

    sql = duckdb.connect()
    for f in os.listdir(FOLDER):
        sql.execute(f"create view {f.split('.')[0]} as select * from '{FOLDER}/{f}'")
    got = sql.execute(entry.oracle_sql()[name])
    names = [c[0] for c in got.description]
    df = entry.queries()[name](spark, FOLDER)
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(map(str, r)) for r in df.select(*names).collect()) == sorted(tuple(map(str, r)) for r in got.fetchall())
