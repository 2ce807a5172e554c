"""Roll rows of a transcript, one for each call, up to the sessions table.

The reference tables of this package start at sessions; these jobs make them from calls. What a row
holds is our own choice: ``session_id, agent, ts`` and the four token counts, of which any but the id
may be missing or null, and optionally ``is_call``, false for rows that only add tokens.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.sessions import TOKEN_COLUMNS
from .intervals import with_runs

TOKENS = TOKEN_COLUMNS[:-1]
CALL_SCHEMA = T.StructType(
    [T.StructField("session_id", T.LongType()), T.StructField("agent", T.StringType()),
     T.StructField("ts", T.TimestampType())]
    + [T.StructField(name, T.LongType()) for name in TOKENS])


def session_totals(calls: DataFrame) -> list[Column]:
    """The columns of the sessions table as aggregates that partial sums can be merged into. The agent
    is that of the earliest call that names one; of calls at the same time, the least name."""
    columns = set(calls.columns)

    def total(name: str) -> Column:
        value = F.col(name).cast("long") if name in columns else F.lit(None).cast("long")
        return F.coalesce(F.sum(value), F.lit(0).cast("long")).alias(name)

    counted = F.coalesce(F.col("is_call"), F.lit(False)) if "is_call" in columns else F.lit(True)
    if "agent" in columns:
        at = F.col("ts") if "ts" in columns else F.lit(None).cast("timestamp")
        first = F.min(F.when(F.col("agent").isNotNull(), F.struct(
            at.isNull().alias("untimed"), at.alias("ts"), F.col("agent"))))["agent"]
    else:
        first = F.lit(None).cast("string")
    return [first.alias("agent"), *map(total, TOKENS), F.count_if(counted).alias("api_call_count")]


def sessions_from_calls(calls: DataFrame, idle_seconds: float | None = None) -> DataFrame:
    """One row per session, with the columns of the sessions table; tasks add up before the shuffle.

    With ``idle_seconds`` a session that pauses for longer is several: a row for each run of
    calls, with ``started`` and ``ended``. Calls without a time are left out then. A session of any share
    of the rows is cut at the ranges of its sorted calls. Null ids are one session.
    """
    if idle_seconds is None:
        return calls.groupBy("session_id").agg(*session_totals(calls))
    runs = with_runs(calls, ["session_id"], F.col("ts"), F.col("ts"), idle_seconds)
    return (runs.groupBy("session_id", "_run")
            .agg(*session_totals(calls), F.timestamp_micros(F.max("_end")).alias("ended"))
            .withColumn("started", F.timestamp_micros("_run"))
            .select("session_id", "started", "ended", "agent", *TOKEN_COLUMNS))
