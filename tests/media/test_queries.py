"""Every registered query that has SQL against DuckDB, on the smallest tables."""

from __future__ import annotations

import math
import os
import random

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    answer = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    expected = [tuple(plain(r[names.index(c)]) for c in columns) for r in answer.fetchall()]
    key = lambda row: tuple((x is None, str(x)) for x in row)
    assert sorted(got, key=key) == sorted(expected, key=key)


def differences(spark, folder, name):
    """Rows of a query on tables in a folder that its SQL lacks, and the other way round. On one thread, SQL takes rows in the order of the file."""
    c = duckdb.connect(config={"threads": 1})
    for t in TABLES:
        if os.path.exists(f"{folder}/{t}.parquet"):
            c.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df = entry.queries()[name](spark, str(folder))
    expected = c.execute(f"select {', '.join(df.columns)} from ({entry.oracle_sql()[name]})").fetchall()
    got, expected = ({tuple(map(plain, r)) for r in rows} for rows in (df.collect(), expected))
    return got - expected, expected - got


def test_times_of_long_streams_are_wider_than_an_int(spark, tmp_path):
    """Step 53,688 of 40,000 microseconds is beyond 32 bits."""
    duckdb.execute(f"copy (select i as event_id, 'view' as event_type from range(54000) t(i)) to '{tmp_path}/events.parquet' (format parquet)")
    assert differences(spark, tmp_path, "frame_rate_changes") == (set(), set())
    assert entry.queries()["frame_rate_changes"](spark, str(tmp_path)).count() == 2 * (54_000 // 97)


def test_navigation_where_ids_fall_while_times_rise(spark, tmp_path):
    """In every other run of 20 frames; no two frames share a time."""
    duckdb.execute(
        f"""copy (select if(i // 20 % 2 = 0, i, i // 20 * 20 + 19 - i % 20) as event_id, timestamp '2024-01-01' + to_milliseconds(i * 400) as ts, 'view' as event_type, 1.0::double as value
        from range(240) t(i)) to '{tmp_path}/events.parquet' (format parquet)"""
    )
    assert differences(spark, tmp_path, "frame_navigation") == (set(), set())


def test_a_block_on_the_relative_gate_does_not_hang_on_the_order_of_rows(spark, tmp_path):
    """The fourth block is 10 LU under the mean, to the last bit of the sum: in the order of events it passes. SQL sees that order, Spark others."""
    levels = [115.48, 97.76, 94.95, 90.98, 103.4, 98.76, 148.18, 105.21, 269.83]
    rows = [(i, user, value) for i, value in enumerate(levels) for user in range(1, 7)]
    ordered = duckdb.connect(config={"threads": 1})
    ordered.execute("create table events (event_id bigint, user_id bigint, value double)")
    ordered.executemany("insert into events values (?, ?, ?)", rows)
    expected = set(ordered.execute(entry.oracle_sql()["loudness_gate"]).fetchall())
    assert {r[2] for r in expected} == {8}
    spark.createDataFrame(random.Random(2).sample(rows, len(rows)), "event_id long, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {(r.stream, r.lufs, r.blocks) for r in entry.queries()["loudness_gate"](spark, str(tmp_path)).collect()}
    assert {tuple(map(plain, r)) for r in got} == {tuple(map(plain, r)) for r in expected}


def test_measurements_of_means_half_way_do_not_hang_on_the_order_of_rows(spark, tmp_path):
    """Eight values of an odd sum of hundredths: the mean over 500 lies half way between two texts of six decimals."""
    rng = random.Random(6)
    rows = [(i, i % 300, rng.randint(1_000, 30_000)) for i in range(8 * 300)]
    total = [sum(cents for _, user, cents in rows if user == k) for k in range(300)]
    rows = [(i, user, (cents + (i < 300 and total[user] % 2 == 0)) / 100) for i, user, cents in rows]
    ordered = duckdb.connect(config={"threads": 1})
    ordered.execute(f"create view orders as select * from '{DATA}/orders.parquet'; create table events (event_id bigint, user_id bigint, value double)")
    ordered.executemany("insert into events values (?, ?, ?)", rows)
    columns = ["asset_id", "rule_id", "measurements"]
    expected = set(ordered.execute(f"select {', '.join(columns)} from ({entry.oracle_sql()['findings_csv']}) where rule_id = 'AUDIO.DC_OFFSET'").fetchall())
    os.symlink(f"{DATA}/orders.parquet", tmp_path / "orders.parquet")
    spark.createDataFrame(random.Random(2).sample(rows, len(rows)), "event_id long, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {tuple(r) for r in entry.queries()["findings_csv"](spark, str(tmp_path)).where("rule_id = 'AUDIO.DC_OFFSET'").select(*columns).collect()}
    assert len(expected) == 300 and got == expected


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
