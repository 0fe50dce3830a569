"""Every query against its SQL on the smallest tables."""

import datetime as dt
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None).isoformat()
    if hasattr(x, "asDict"):
        x = x.asDict()
    if isinstance(x, dict):
        return {k: plain(v) for k, v in x.items()}
    return [plain(v) for v in x] if isinstance(x, list) else x


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted([[plain(r[k]) for k in order] for r in data], key=repr)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = duck.execute(SQL[name])
    names = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [list(r) for r in df.collect()]) == rows(names, [list(r) for r in got.fetchall()])


def events(con, folder, *times):
    """Events of users 1, 2, ... by turns, at these seconds of a day."""
    values = ", ".join(f"({n + 1}, TIMESTAMP '2024-01-01' + to_microseconds({round(t * 1e6)}), {n % 2 + 1}, 'view', {n}.5, '')" for n, t in enumerate(times))
    con.execute(f"COPY (SELECT event_id::BIGINT AS event_id, ts, user_id::BIGINT AS user_id, event_type, value::DOUBLE AS value, props FROM (VALUES {values}) AS e (event_id, ts, user_id, event_type, value, props)) TO '{folder}/events.parquet'")
    con.execute(f"CREATE VIEW events AS FROM '{folder}/events.parquet'")


def agree(spark, con, folder, name):
    got = con.execute(SQL[name])
    names = [c[0] for c in got.description]
    df = QUERIES[name](spark, str(folder))
    return rows(df.columns, [list(r) for r in df.collect()]) == rows(names, [list(r) for r in got.fetchall()])


def test_as_of_half_way_in_parts_of_a_second(spark, tmp_path):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    events(con, tmp_path, 0.2, 0.3, 10.2, 10.25, 20.4, 20.6)  # half way: 10.4
    assert agree(spark, con, tmp_path, "as_of")


def test_retention_half_way_in_parts_of_a_second(spark, tmp_path):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    events(con, tmp_path, 0.2, 0.3, 10.2, 10.25, 10.35, 10.38, 20.4, 20.6)  # half way: 10.4, past all four between
    assert agree(spark, con, tmp_path, "retention")


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert os.path.isdir(DATA)
