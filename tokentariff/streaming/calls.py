"""Sessions rolled up from a stream of calls."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.calls import CALL_SCHEMA, session_totals
from ..sources.sessions import TOKEN_COLUMNS

MERGE_FIRST = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"


def stream_calls(spark: SparkSession, path: str, schema=CALL_SCHEMA, **options) -> DataFrame:
    """Read call files as they arrive."""
    return spark.readStream.schema(schema).options(**options).parquet(path)


def stream_sessions_from_calls(calls: DataFrame, idle_seconds: float,
                               late_seconds: float) -> DataFrame:
    """The rows of ``sessions_from_calls(calls, idle_seconds)`` as a stream, in append mode.

    A run of calls is given out, once, when the watermark has passed its last call by ``idle_seconds``; until
    then its sums are state, one row per open run. The watermark is the latest time seen less
    ``late_seconds``. Calls may arrive in any order within that: a late one can join two open runs. Calls older than
    the watermark are dropped; those of a run still open are older than it only if they come late by
    more than ``late_seconds``. Calls without a time are left out. Tasks merge the calls of a session in
    each batch before the shuffle, so that a hot session sends a row for each run and task.
    """
    calls.sparkSession.conf.set(MERGE_FIRST, "true")
    window = F.session_window("ts", f"{int(idle_seconds * 1_000_000)} microseconds")
    totals = (calls.where(F.col("ts").isNotNull())
              .withWatermark("ts", f"{int(late_seconds * 1_000_000)} microseconds")
              .groupBy("session_id", window.alias("run"))
              .agg(*session_totals(calls), F.max("ts").alias("ended")))
    return totals.select("session_id", F.col("run")["start"].alias("started"), "ended", "agent",
                         *TOKEN_COLUMNS)
