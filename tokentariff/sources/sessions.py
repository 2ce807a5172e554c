"""The sessions table: one row per agent session."""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..defaults import AGENTS

TOKEN_COLUMNS = ("input_tokens", "output_tokens", "cache_creation_tokens",
                 "cache_read_tokens", "api_call_count")

SESSION_SCHEMA = T.StructType(
    [T.StructField("session_id", T.LongType()), T.StructField("agent", T.StringType())]
    + [T.StructField(name, T.LongType()) for name in TOKEN_COLUMNS])


def load_sessions(spark: SparkSession, path: str, agents: Iterable[str] = AGENTS,
                  id_column: str = "session_id") -> DataFrame:
    """Read a parquet sessions table; only the named columns and matching rows leave the scan."""
    return select_sessions(spark.read.parquet(path), agents, id_column)


def select_sessions(raw: DataFrame, agents: Iterable[str] = AGENTS,
                    id_column: str = "session_id") -> DataFrame:
    """Keep the sessions of the given agents (exact match), with null counts as zero.

    The id keeps its own type; agent must be a string and the counts numeric. Counts are whole: a
    fraction, a NaN or a number beyond a long stops the job with the name of its column.
    """
    _check(raw, id_column)
    kept = raw.where(F.col("agent").isin(list(agents)))
    counts = [F.coalesce(_whole(raw, c), F.lit(0).cast("long")).alias(c) for c in TOKEN_COLUMNS]
    return kept.select(F.col(id_column).alias("session_id"), "agent", *counts)


def _whole(raw: DataFrame, name: str) -> Column:
    value = F.col(name)
    if isinstance(raw.schema[name].dataType, T.IntegralType):
        return value.cast("long")
    number = value.cast("double")
    good = ~F.isnan(number) & (number == F.floor(number)) & (F.abs(number) < 2.0 ** 63)
    wrong = F.concat(F.lit(f"{name} must hold whole numbers, found "), value.cast("string"))
    return F.when(value.isNull() | good, value.cast("long")).otherwise(
        F.raise_error(wrong).cast("long"))


def _check(raw: DataFrame, id_column: str) -> None:
    types = {field.name: field.dataType for field in raw.schema}
    missing = [c for c in (id_column, "agent", *TOKEN_COLUMNS) if c not in types]
    if missing:
        raise ValueError(f"sessions table lacks the columns {missing}")
    wrong = [c for c in TOKEN_COLUMNS if not isinstance(types[c], T.NumericType)]
    if not isinstance(types["agent"], T.StringType):
        wrong.append("agent")
    if wrong:
        raise ValueError(f"sessions table has the wrong type for {wrong}")
