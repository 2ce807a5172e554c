"""Runs of intervals that follow each other without a long pause, and the time they take.

An interval belongs to the run before it if it begins no later than ``gap`` after the latest end so far.
With a gap of 0 the runs are the union of the intervals, in which overlaps count once; with points in
place of intervals they are sittings, such as a person's turns.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import in_ranges, max_of, running

SECOND = 1_000_000  # microseconds


def with_runs(intervals: DataFrame, keys: list[str], start: Column, end: Column,
              gap_seconds: float = 0) -> DataFrame:
    """The rows with ``_start`` and ``_end`` in microseconds, and ``_run``, the start of their run.

    Rows without a start are left out. An end that is null or before its start is that start. Null
    keys are a key of their own.
    """
    begins = F.unix_micros(start)
    placed = (intervals.withColumn("_start", begins)
              .withColumn("_end", F.greatest(begins, F.unix_micros(end)))
              .where(F.col("_start").isNotNull()))
    order = [F.col("_start"), F.col("_end")]
    ranges = in_ranges(placed, *map(F.col, keys), *order)
    followed = running(ranges, keys, order, _before=max_of(F.col("_end")))
    pause = F.col("_start") - F.col("_before") > int(gap_seconds * SECOND)
    opens = F.when(F.col("_before").isNull() | pause, F.col("_start"))
    # Starts rise, so the run of a row is the largest start of a run up to it.
    return running(followed.withColumn("_opens", opens), keys, order, inclusive=True,
                   _run=max_of(F.col("_opens"))).drop("_before", "_opens", "_range")


def interval_runs(intervals: DataFrame, keys: list[str], start: Column, end: Column,
                  gap_seconds: float = 0) -> DataFrame:
    """One row per run: the keys, ``started``, ``ended`` and ``n_intervals``."""
    return (with_runs(intervals, keys, start, end, gap_seconds).groupBy(*keys, "_run")
            .agg(F.timestamp_micros(F.max("_end")).alias("ended"), F.count("*").alias("n_intervals"))
            .select(*keys, F.timestamp_micros("_run").alias("started"), "ended", "n_intervals"))


def run_minutes(runs: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Per key: intervals, runs and minutes in them, each once; columns begin with ``name``."""
    micros = F.unix_micros("ended") - F.unix_micros("started")
    return runs.groupBy(*keys).agg(
        F.sum("n_intervals").alias(f"{name}_events"), F.count("*").alias(f"{name}_runs"),
        (F.sum(micros) / (60.0 * SECOND)).alias(f"{name}_minutes"))


def session_time(events: DataFrame, human: Column, start: Column, end: Column,
                 pause_seconds: float = 1_800, usd_per_hour: float = 0.0,
                 key: str = "session_id") -> DataFrame:
    """Per session: what people and agents spent on it.

    Rows for which ``human`` holds are points of attention: those no more than ``pause_seconds``
    apart are one sitting, which lasts from its first to its last. All others are agent work from start
    to end, of which overlaps count once. ``attention_usd`` prices the sittings. A session with only
    one of both has zeros for the other. These semantics are our own.
    """
    kind = F.coalesce(human, F.lit(False))
    attention = run_minutes(interval_runs(
        events.where(kind), [key], start, start, pause_seconds), [key], "attention")
    work = run_minutes(interval_runs(events.where(~kind), [key], start, end), [key], "agent")
    both = attention.join(work.withColumnRenamed(key, "_key"),
                          F.col(key).eqNullSafe(F.col("_key")), "full")
    # A full join leaves the key of one side null, and a null key is a session too.
    found = F.when(F.col("attention_runs").isNull(), F.col("_key")).otherwise(F.col(key))
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in (
        "attention_events", "attention_runs", "agent_events", "agent_runs")]
    minutes = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("attention_minutes", "agent_minutes")]
    return both.select(found.alias(key), *counts, *minutes).withColumn(
        "attention_usd", F.col("attention_minutes") / 60.0 * usd_per_hour)
