"""The distribution of piece prices over a stream of sessions."""

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..defaults import DEFAULT_RATES, PERCENTILES, REPORT_ALPHA, THRESHOLDS
from ..functions.pricing import Rates
from ..operators.pieces import chunk_prices
from ..operators.sketches import ACCURACY, bin_counts, bin_percentiles


def stream_distribution(sessions: DataFrame, out: str, checkpoint: str,
                        thresholds: Iterable = THRESHOLDS, alpha: float = REPORT_ALPHA,
                        rates: Rates = DEFAULT_RATES, percentiles: Iterable[float] = PERCENTILES,
                        accuracy: float = ACCURACY, **trigger) -> StreamingQuery:
    """Start a query that writes the distribution of all pieces so far, after every trigger, to the folder
    ``out/trigger=N``.

    State are the counts of the price bins, a bounded number of rows per threshold whatever has
    streamed. After the last file the rows are those of ``sketch_percentiles`` over all sessions. A trigger that
    runs again writes the same folder again.
    """
    percentiles = list(percentiles)
    chunks = chunk_prices(sessions, list(thresholds), alpha, rates, compact=True)

    def report(bins: DataFrame, number: int) -> None:
        bin_percentiles(bins, ["threshold"], percentiles, accuracy).write.mode(
            "overwrite").parquet(f"{out}/trigger={number}")

    writer = bin_counts(chunks, ["threshold"], accuracy).writeStream.outputMode("complete")
    return (writer.foreachBatch(report).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
