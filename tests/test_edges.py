"""Queries against their SQL on rows that the given tables have few of: equal bounds, unknown and fractional times, users without a strong row."""

from datetime import datetime, timedelta

import duckdb
import pytest

from reelspan.plans import QUERIES, SQL


def both(spark, tmp_path, name, table, schema, rows):
    """The rows of a query and of its SQL over one table."""
    folder = str(tmp_path)
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    con = duckdb.connect()
    con.execute("SET threads = 1")  # rows that tie keep one order in all windows of the SQL
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    ours, theirs = QUERIES[name](spark, folder).toArrow(), con.execute(SQL[name]).to_arrow_table()
    columns = sorted(ours.column_names)
    assert columns == sorted(theirs.column_names)
    return [sorted((tuple(r[c] for c in columns) for r in t.to_pylist()), key=repr) for t in (ours, theirs)]


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
DAY = datetime(2024, 1, 1)


@pytest.mark.parametrize("tenths", [7, 28])
def test_loudness_that_equals_a_bound(spark, tmp_path, tenths):
    rows, user = [], 0
    for mean in range(1000, 3000, 10):
        bound = mean * tenths // 10
        if (bound / 100) * 100 != bound or mean * tenths / 10 == mean * (tenths / 10):
            continue
        user += 1
        rest = 9 * mean - bound  # of eight further rows, so that the mean of nine is the mean
        values = [bound, *[rest // 8] * 7, rest - rest // 8 * 7]
        rows += [(63 * user + 9 * k + 1 + 3 * (k % 3), DAY, user, "view", v / 100) for k, v in enumerate(values)]
    assert user > 10
    ours, theirs = both(spark, tmp_path, "audio_events", "events", EVENTS, rows)
    assert ours == theirs


def test_users_without_a_strong_row_keep_six(spark, tmp_path):
    rows = [(1000 * user + i, DAY + timedelta(hours=i), user, "view", 1.0 if user < 3 else 60.0) for user in range(6) for i in range(4 + 5 * user)]
    ours, theirs = both(spark, tmp_path, "trimmed_openings", "events", EVENTS, rows)
    assert ours == theirs
    assert len([r for r in ours if r[1] == 2]) == 6


def test_unknown_and_fractional_dates_of_islands(spark, tmp_path):
    day = timedelta(days=1)
    rows = [
        (1, DAY + timedelta(microseconds=250_000), 1.0), (1, DAY + 2 * day + timedelta(microseconds=750_000), 1.0), (1, DAY + 9 * day, None), (1, None, 3.0), (1, None, None),
        (2, DAY, None), (2, DAY + day, 1.0), (2, DAY + 8 * day, 2.0), (3, None, 1.0), (3, None, 2.0), (None, DAY, 1.0),
    ]
    ours, theirs = both(spark, tmp_path, "interval_union", "lineitem", "l_partkey long, l_shipdate timestamp_ntz, l_quantity double", rows)
    assert ours == theirs


def test_neighbours_of_zero_and_unknown_vectors(spark, tmp_path):
    rows = [(100 * i, [1.0, 0.1 * i]) for i in range(4)] + [(7, [0.0, 0.0]), (8, None), (400, None), (500, [0.0, 0.0]), (9, [1.0, 0.05])]
    ours, theirs = both(spark, tmp_path, "cosine_neighbors", "embeddings", "vec_id long, embedding array<float>", rows)
    assert ours == theirs
