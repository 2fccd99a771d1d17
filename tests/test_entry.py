"""The registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def normal(rows):
    return sorted(repr([None if v is None else float(v) if isinstance(v, float) else v for v in r]) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables here")
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.sql(f"create view {f[:-8]} as select * from '{SMALL}/{f}'")
    out = entry.queries()[name](spark, SMALL)
    found = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(out.columns)
    order = sorted(names)
    expected = [[row[names.index(c)] for c in order] for row in found.fetchall()]
    assert normal([list(r) for r in out.select(*order).collect()]) == normal(expected)


def test_entry(spark):
    assert entry.entry(spark).count() == 814


def test_events_of_users_without_some_fields(spark, tmp_path):
    """Users with few events lack fields; the others keep the table's numbers."""
    con = duckdb.connect()
    con.sql("create table events as select i as event_id, timestamp '2024-01-01' + to_hours(i * 7 % 3) as ts, i * 31 % 83 as user_id, ['view', 'click'][i % 2 + 1] as event_type, (i * 17 % 23)::double as value from range(400) t(i) where i % 5 <> i * 31 % 83 % 7 and i % 13 <> 0")
    con.sql(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    expected = con.execute(entry.oracle_sql()["event_responses"]).fetchall()
    assert sum('"fieldIndex":4' in r[2] and '"fieldCount":4' in r[2] and '"links":[{' in r[2] for r in expected) > 3 and any(r[1] == 400 for r in expected)
    assert sorted(map(tuple, entry.queries()["event_responses"](spark, str(tmp_path)).collect())) == sorted(expected)
