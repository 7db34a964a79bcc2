"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = "customer orders lineitem events documents embeddings conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    yield con
    con.close()


def _plain(cols, rows):
    place = sorted(range(len(cols)), key=lambda i: cols[i])
    cells = [tuple(r[i].isoformat() if hasattr(r[i], "isoformat") else r[i] for i in place) for r in rows]
    return [cols[i] for i in place], sorted(cells, key=repr)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    got = _plain(df.columns, df.collect())
    assert got[1]
    if name in entry.oracle_sql():
        cur = con.execute(entry.oracle_sql()[name])
        assert got == _plain([d[0] for d in cur.description], cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 15


def test_sql_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("n", [1, 7])
@pytest.mark.parametrize("name", ["rules_all_splits", "interpolate_by_event_type", "position_by_event_type", "tests_of_all_pairs"])
def test_partition_count_does_not_matter(spark, con, partitions, name, n):
    partitions(n)
    test_query(spark, con, name)
