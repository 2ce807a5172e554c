"""The sessions table as a stream of files.

``session_cost``, ``session_split`` and the compact ``chunk_prices`` take the stream as it is, in
append mode. ``corpus_baseline`` and ``split_grid`` keep a few rows of state, in complete mode.
"""

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from ..defaults import AGENTS
from ..sources.sessions import SESSION_SCHEMA, select_sessions


def stream_sessions(spark: SparkSession, path: str, agents: Iterable[str] = AGENTS,
                    schema=SESSION_SCHEMA, id_column: str = "session_id",
                    **options) -> DataFrame:
    """Read session files as they arrive, with the same columns and rows as ``load_sessions``.

    ``options`` go to the file stream, such as ``maxFilesPerTrigger``.
    """
    return select_sessions(spark.readStream.schema(schema).options(**options).parquet(path),
                           agents, id_column)
