"""Calls rolled up to sessions: by session, by run of calls, and as a stream."""

import datetime as dt
import random

import pytest

import tokentariff as tt
from tokentariff.operators.calls import CALL_SCHEMA, TOKENS

START = dt.datetime(2024, 5, 1, tzinfo=dt.timezone.utc)


def at(seconds):
    return None if seconds is None else START + dt.timedelta(seconds=seconds)


def make_calls(n=600, seed=2):
    """Sessions of few and of very many calls, with pauses, ties and nulls in any column."""
    rng = random.Random(seed)
    rows, clock = [], {}
    for _ in range(n):
        session = rng.choice([1, 1, 1, 2, 3, 4, 5, None])
        clock[session] = clock.get(session, 0) + rng.choice([0, 1, 5, 60, 60, 61, 400])
        tokens = [rng.choice([None, rng.randrange(1_000)]) for _ in TOKENS]
        rows.append((session, rng.choice([None, "a", "b"]), clock[session], *tokens))
    rng.shuffle(rows)
    return rows


def frame_of(spark, rows):
    return spark.createDataFrame([(r[0], r[1], at(r[2]), *r[3:]) for r in rows], CALL_SCHEMA)


def rolled(rows, idle=None):
    groups = {}
    for session in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == session and (idle is None or r[2] is not None)),
                      key=lambda r: (r[2] is None, r[2] or 0))
        run, last = 0, None
        for r in mine:
            if idle is not None and last is not None and r[2] - last > idle:
                run += 1
            last = r[2]
            groups.setdefault((session, run), []).append(r)
    out = []
    for (session, _), mine in groups.items():
        named = min(((r[2] is None, r[2] or 0, r[1]) for r in mine if r[1] is not None), default=None)
        sums = [sum(r[3 + i] or 0 for r in mine) for i in range(len(TOKENS))]
        span = () if idle is None else (at(min(r[2] for r in mine)), at(max(r[2] for r in mine)))
        out.append((session, *span, named and named[2], *sums, len(mine)))
    return sorted(out, key=repr)


def result(frame):
    zone = dt.timezone.utc
    return sorted((tuple(v.astimezone(zone) if isinstance(v, dt.datetime) else v for v in r)
                   for r in frame.collect()), key=repr)


def test_sessions_from_calls(spark):
    rows = make_calls() + [(6, "z", None, 1, None, None, None)]
    got = tt.sessions_from_calls(frame_of(spark, rows))
    assert result(got) == rolled(rows)
    assert got.columns == ["session_id", "agent", *TOKENS, "api_call_count"]


def test_runs_of_calls(spark):
    rows = make_calls() + [(6, "z", None, 1, None, None, None)]
    assert result(tt.sessions_from_calls(frame_of(spark, rows), 60)) == rolled(rows, 60)


def test_one_session_spans_many_ranges(spark):
    """A session with nearly all calls, more than a range holds, in one run and in many."""
    rows = [(1, "a", 30 * i, 1, 2, 3, 4) for i in range(5_000)] + make_calls(50)
    calls = frame_of(spark, rows)
    for idle in (29, 30, 400):
        assert result(tt.sessions_from_calls(calls, idle)) == rolled(rows, idle)


def test_missing_columns_and_rows_that_are_no_calls(spark):
    calls = spark.createDataFrame([(1, 5, True), (1, 6, False), (2, None, None)],
                                  "session_id long, input_tokens long, is_call boolean")
    assert result(tt.sessions_from_calls(calls)) == [
        (1, None, 11, 0, 0, 0, 1), (2, None, 0, 0, 0, 0, 0)]
    assert tt.sessions_from_calls(calls.limit(0)).collect() == []
    assert tt.sessions_from_calls(frame_of(spark, []), 60).collect() == []


@pytest.fixture
def streamed(spark, tmp_path):
    """Write batches of calls as files one after another, and run the stream over them."""
    def run(batches, idle, late):
        folder, out = str(tmp_path / "calls"), str(tmp_path / "out")
        for i, rows in enumerate(batches):
            frame_of(spark, rows).coalesce(1).write.mode("append").parquet(folder)
        sessions = tt.stream_sessions_from_calls(
            tt.streaming.stream_calls(spark, folder, maxFilesPerTrigger=1), idle, late)
        query = (sessions.writeStream.format("parquet").outputMode("append")
                 .option("path", out).option("checkpointLocation", str(tmp_path / "state"))
                 .trigger(availableNow=True).start())
        query.awaitTermination()
        return spark.read.schema(sessions.schema).parquet(out)
    return run


def test_stream_equals_batch(spark, streamed):
    """Calls that come out of order but in time give the batch's rows, each once."""
    rows = [r for r in make_calls(300) if r[2] is not None]
    rows.sort(key=lambda r: r[2] + random.Random(r[2]).randrange(300))
    end = [(99, None, 10_000_000, None, None, None, None)]
    batches = [rows[:100], rows[100:200], rows[200:], end]
    got = streamed(batches, idle=60, late=100_000).where("session_id IS NULL OR session_id <> 99")
    assert result(got) == rolled(rows, 60)


def test_calls_later_than_the_watermark_are_dropped(spark, streamed):
    call = (None,) * len(TOKENS)
    batches = [[(1, "a", 0, *call), (2, "b", 1_000, *call)], [(3, "a", 5_000, *call)],
               [(1, "a", 10, *call), (2, "b", 4_950, *call)], [(99, None, 10_000_000, *call)]]
    got = streamed(batches, idle=60, late=100).where("session_id <> 99")
    assert [(r[0], r[-1]) for r in result(got)] == [(1, 1), (2, 1), (2, 1), (3, 1)]
