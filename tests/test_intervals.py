"""Runs of intervals and the time per session, against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

import tokentariff as tt

START = dt.datetime(2024, 5, 1, tzinfo=dt.timezone.utc)
ROWS = "session_id long, human boolean, ts timestamp, ended timestamp"


def at(seconds):
    return None if seconds is None else START + dt.timedelta(seconds=seconds)


def union(spans, gap=0):
    runs = []
    for lo, hi, n in sorted((s, max(s, e if e is not None else s), 1) for s, e in spans):
        if runs and lo - runs[-1][1] <= gap:
            runs[-1] = (runs[-1][0], max(runs[-1][1], hi), runs[-1][2] + n)
        else:
            runs.append((lo, hi, n))
    return runs


def some_rows(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        start = rng.randrange(20_000)
        rows.append((rng.choice([1, 1, 1, 2, 3, None]), rng.choice([True, False, False, None]),
                     rng.choice([start, start, start, None]),
                     rng.choice([None, start - 5, start, start + rng.randrange(900)])))
    return rows


def frame_of(spark, rows):
    return spark.createDataFrame([(k, h, at(s), at(e)) for k, h, s, e in rows], ROWS)


def seconds(moment):
    return (moment.astimezone(dt.timezone.utc) - START).total_seconds()


@pytest.mark.parametrize("gap", [0, 30, 5_000])
def test_runs(spark, gap):
    rows = some_rows(900) + [(1, None, i, i + 3) for i in range(30_000, 32_000)]
    got = tt.interval_runs(frame_of(spark, rows), ["session_id"], F.col("ts"), F.col("ended"), gap)
    want = [(k, *run) for k in {r[0] for r in rows}
            for run in union([(s, e) for x, _, s, e in rows if x == k and s is not None], gap)]
    assert sorted(((r[0], seconds(r[1]), seconds(r[2]), r[3]) for r in got.collect()), key=repr) \
        == sorted(((k, float(a), float(b), n) for k, a, b, n in want), key=repr)


def test_a_long_interval_spans_ranges(spark):
    """One interval covers thousands that begin after it, in other ranges than its own."""
    rows = [(1, False, 0, 100_000)] + [(1, False, 10 * i, 10 * i + 1) for i in range(9_000)]
    got = tt.interval_runs(frame_of(spark, rows), ["session_id"], F.col("ts"), F.col("ended"))
    assert [(seconds(r[1]), seconds(r[2]), r[3]) for r in got.collect()] == [(0.0, 100_000.0, 9_001)]


def test_session_time(spark):
    rows = some_rows(500) + [(7, True, 5, None), (8, False, 5, 65)]
    got = tt.session_time(frame_of(spark, rows), F.col("human"), F.col("ts"), F.col("ended"),
                          pause_seconds=120, usd_per_hour=30.0)
    want = []
    for key in {r[0] for r in rows}:
        human = union([(s, s) for k, h, s, _ in rows if k == key and h and s is not None], 120)
        agent = union([(s, e) for k, h, s, e in rows if k == key and not h and s is not None])
        minutes = [sum(b - a for a, b, _ in runs) / 60 for runs in (human, agent)]
        counts = [x for runs in (human, agent) for x in (sum(n for *_, n in runs), len(runs))]
        want.append((key, *counts, *minutes, minutes[0] / 60 * 30))
    got = sorted(map(tuple, got.collect()), key=repr)
    assert [r[:5] for r in got] == [tuple(r[:5]) for r in sorted(want, key=repr)]
    for g, w in zip(got, sorted(want, key=repr)):
        assert g[5:] == pytest.approx(w[5:])


def test_overlaps_between_sessions_count_once_for_a_wider_key(spark):
    rows = [("u", 0, 100), ("u", 50, 150), ("v", 0, 10)]
    frame = spark.createDataFrame([(u, at(s), at(e)) for u, s, e in rows],
                                  "user string, ts timestamp, ended timestamp")
    runs = tt.interval_runs(frame, ["user"], F.col("ts"), F.col("ended"))
    assert sorted((r[0], seconds(r[2]) - seconds(r[1]), r[3]) for r in runs.collect()) == [
        ("u", 150.0, 2), ("v", 10.0, 1)]


def test_nothing(spark):
    frame = frame_of(spark, [])
    assert tt.session_time(frame, F.col("human"), F.col("ts"), F.col("ended")).collect() == []
