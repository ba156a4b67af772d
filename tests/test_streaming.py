"""Streams in append mode: closed windows, dropped state, late rows."""

from __future__ import annotations

import datetime as dt
import os
import time

import pytest

import tables
from tillmark.plans.catalog import QUERIES
from tillmark.streaming import windows

SCHEMA = "ts timestamp, user_id long, value double"


def at(day, hour, minute=0):
    return dt.datetime(2024, 1, day, hour, minute)


@pytest.fixture
def folder(spark, tmp_path):
    """Three batches: two days, then one two days later, then a row of the first day and one of the next."""
    batches = [
        [(at(1, h), h % 3, 1.0) for h in range(24)] + [(at(2, 1), 1, 10.0)],
        [(at(4, h), h % 3, 2.0) for h in range(12)],
        [(at(1, 5), 7, 100.0), (at(4, 13), 1, 4.0), (at(6, 0), 1, 8.0)],
    ]
    for k, rows in enumerate(batches):
        path = f"{tmp_path}/one-{k}"
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(path)
        file = next(f for f in os.listdir(path) if f.endswith(".parquet"))
        os.makedirs(f"{tmp_path}/in", exist_ok=True)
        os.rename(f"{path}/{file}", f"{tmp_path}/in/{k}.parquet")
        os.utime(f"{tmp_path}/in/{k}.parquet", (time.time() - 100 + k, time.time() - 100 + k))
    return f"{tmp_path}/in"


def stream(spark, folder):
    return windows.file_stream(spark, folder, spark.createDataFrame([], SCHEMA).schema, files_per_batch=1)


def test_windows_close_once_and_leave_no_state(spark, folder):
    progress = []
    rows = windows.run_once(windows.window_kpis(stream(spark, folder), [], "1 day"), "append", progress).collect()
    # the late row of the first day is not in its total, and the last day is still open
    assert {(r["window_start"].day, r["events"], r["total"]) for r in rows} == {(1, 24, 24.0), (2, 1, 10.0), (4, 13, 28.0)} and len(rows) == 3
    held, dropped = [p[0] for p in progress], sum(p[1] for p in progress)
    assert max(held) >= 2 and held[-1] == 1 and dropped == 1


def test_sessions_close_once(spark, folder):
    progress = []
    rows = windows.run_once(windows.session_kpis(stream(spark, folder), "user_id", "4 hours"), "append", progress).collect()
    assert all(r["end"] <= at(5, 23) for r in rows) and not any(r["user_id"] == 7 for r in rows)
    assert sum(r["total"] for r in rows) == 24 + 10 + 24 + 4 and progress[-1][0] == 1


def test_late_rows_are_kept(spark, folder):
    late = windows.late_rows(stream(spark, folder), "1 day").collect()
    assert [tuple(r) for r in late] == [(at(1, 5), 7, 100.0)]


@pytest.fixture
def events(tmp_path):
    """Two users over three days; the last day and the last sessions are open when the file ends."""
    times = [(at(1, 5), 1), (at(1, 5, 30), 1), (at(1, 23), 2), (at(2, 8), 1), (at(3, 10), 2), (at(3, 10, 20), 2), (at(3, 10, 40), 1)]
    rows = [{"event_id": k, "ts": ts, "user_id": user, "event_type": "view", "value": 2.0**k} for k, (ts, user) in enumerate(times)]
    return tables.write(tmp_path / "events", events=rows)


def test_window_query_has_the_open_windows(spark, events):
    got = {r["window_start"][:10]: (r["events"], r["total"]) for r in QUERIES["stream_window_kpis"](spark, events).collect()}
    assert got == {"2024-01-01": (3, 7.0), "2024-01-02": (1, 8.0), "2024-01-03": (3, 112.0)}


def test_session_query_has_the_open_sessions(spark, events):
    got = {(r["user_id"], r["start"][5:16]): (r["events"], r["total"]) for r in QUERIES["stream_session_kpis"](spark, events).collect()}
    assert got == {(1, "01-01 05:00"): (2, 3.0), (2, "01-01 23:00"): (1, 4.0), (1, "01-02 08:00"): (1, 8.0), (2, "01-03 10:00"): (2, 48.0), (1, "01-03 10:40"): (1, 64.0)}
