"""The price of every single piece of every session."""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..defaults import DEFAULT_RATES, REPORT_ALPHA
from ..functions import geometry as g
from ..functions.pricing import (PRICE_COLUMNS, Rates, TokenPrices, summary_dollars, token_cost,
                                 with_prices, work_cost)
from ..sources.sessions import TOKEN_COLUMNS

FIRST, MIDDLE, LAST = 0, 1, 2
RUN = 65_536


def chunk_prices(sessions: DataFrame, threshold, alpha: float = REPORT_ALPHA,
                 rates: Rates = DEFAULT_RATES, compact: bool = False) -> DataFrame:
    """One row per piece, for one threshold or several.

    All middle pieces of a session are alike, so the compact form has at most three rows per
    session, with a ``multiplicity``; it is what the totals and the distribution work on.
    """
    thresholds = threshold if isinstance(threshold, Iterable) else [threshold]
    priced, prices = with_prices(sessions, rates)
    rows = _compact(priced, prices, thresholds, alpha)
    return rows if compact else expand_pieces(rows)


def _compact(sessions: DataFrame, prices: TokenPrices, thresholds: Iterable,
             alpha: float) -> DataFrame:
    calls, read = F.col("api_call_count"), F.col("cache_read_tokens")
    peak, k, slot = F.col("peak"), F.col("k"), F.col("slot")
    height, own_calls = F.col("height"), F.col("calls")
    limit = F.col("threshold").cast("double")
    price_columns = PRICE_COLUMNS if prices.per_row else ()
    slots = (F.when(k == 1, _slots(FIRST)).when(k == 2, _slots(FIRST, LAST))
             .otherwise(_slots(FIRST, MIDDLE, LAST)))
    return (
        sessions.select("session_id", *TOKEN_COLUMNS, *price_columns,
                        g.ramp_peak(read, calls).alias("peak"))
        .withColumn("threshold", F.explode(g.literal_thresholds(thresholds)))
        .withColumn("k", g.piece_count(peak, limit))
        .withColumn("slot", F.explode(slots))
        .withColumn("height", F.when(k == 1, peak).when(slot == LAST, g.last_height(peak, k, limit))
                    .otherwise(limit))
        .withColumn("calls", F.when(k == 1, calls.cast("double"))
                    .otherwise(g.piece_calls(height, calls, peak)))
        .withColumn("cost", F.when(k == 1, token_cost(prices, read))
                    .otherwise(_piece_cost(prices, alpha * limit)))
        .select("session_id", "threshold",
                F.when(slot == LAST, k - 1).otherwise(slot.cast("long")).alias("chunk_idx"),
                height, own_calls, "cost", (slot == FIRST).alias("is_first"),
                F.when(slot == MIDDLE, k - 2).otherwise(F.lit(1).cast("long"))
                .alias("multiplicity")))


def _slots(*kinds: int) -> Column:
    return F.array(*[F.lit(kind) for kind in kinds])


def _piece_cost(prices: TokenPrices, summary: Column) -> Column:
    """A piece as a session of its own: its share of the work, its own cache-read triangle and,
    unless it is the first, the summary it starts with."""
    share = F.col("calls") / F.col("api_call_count")
    triangle = F.col("calls") * F.col("height") / 2.0
    carried = summary * summary_dollars(prices, F.lit(1), g.later_calls(F.col("calls"))).total
    return (work_cost(prices) * share + triangle * prices.cache_read
            + F.when(F.col("slot") == FIRST, 0.0).otherwise(carried))


def expand_pieces(compact: DataFrame, run: int = RUN) -> DataFrame:
    """One row per piece from the compact form.

    A session may have any number of pieces. Rows are cut into runs of ``run`` pieces at most, and
    the runs are dealt out before they are expanded, so no task has to produce them all. The
    input is read once.
    """
    kept = [c for c in compact.columns if c not in ("chunk_idx", "multiplicity")]
    many = F.col("multiplicity")

    starts = F.sequence(F.lit(0).cast("long"), many - 1, F.lit(run).cast("long"))
    runs = (compact.withColumn("start", F.explode(starts))
            .repartition("session_id", "threshold", "chunk_idx", "start"))
    places = F.sequence(F.col("start"), F.least(F.col("start") + run, many) - 1)
    return (runs.withColumn("offset", F.explode(places))
            .select(*kept, (F.col("chunk_idx") + F.col("offset")).alias("chunk_idx"))
            .select("session_id", "threshold", "chunk_idx", "height", "calls", "cost",
                    "is_first"))
