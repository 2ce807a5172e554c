"""What sessions would have cost if cut at a threshold, per session and in total.

A summary is alpha times the threshold, and the overhead is linear in it. So the per-row work
depends on the threshold only, and alpha is brought in last.
"""

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..defaults import ALPHAS, DEFAULT_RATES, SWEEP, THRESHOLDS
from ..functions import geometry as g
from ..functions.pricing import (PRICE_COLUMNS, Rates, SummaryDollars, TokenPrices,
                                 summary_dollars, summed, token_cost, with_prices)
from ..sources.sessions import TOKEN_COLUMNS


def all_thresholds(thresholds: Iterable = THRESHOLDS, sweep: Iterable = SWEEP) -> tuple:
    """Thresholds that the reports need together."""
    return tuple(sorted(set(thresholds) | set(sweep)))


def _cut(sessions: DataFrame, prices: TokenPrices, thresholds: Iterable, *ids: str) -> DataFrame:
    """One row per session and threshold: its pieces, its cost after the cut without summaries
    (``base``), and the number of calls that would read a summary again (``rereads``)."""
    calls, read = F.col("api_call_count"), F.col("cache_read_tokens")
    peak, pieces, last = F.col("peak"), F.col("k"), F.col("last")
    threshold = F.col("threshold").cast("double")
    price_columns = PRICE_COLUMNS if prices.per_row else ()
    split = pieces > 1
    return (
        sessions.select(*ids, *TOKEN_COLUMNS, *price_columns,
                        g.ramp_peak(read, calls).alias("peak"),
                        token_cost(prices, read).alias("full_cost"))
        .withColumn("threshold", F.explode(g.literal_thresholds(thresholds)))
        .withColumn("k", g.piece_count(peak, threshold))
        .withColumn("last", g.last_height(peak, pieces, threshold))
        .withColumn("read_after", F.when(
            split, g.split_cache_read(peak, pieces, last, threshold, calls)).otherwise(read))
        .withColumn("base", token_cost(prices, F.col("read_after")))
        .withColumn("rereads", F.when(
            split, g.summary_rereads(peak, pieces, last, threshold, calls)).otherwise(0.0)))


def _overheads(dollars: SummaryDollars) -> dict:
    summary = F.col("alpha") * F.col("threshold")
    parts = SummaryDollars(*[summary * part for part in dollars])
    return {"oh_gen": parts.generated, "oh_write": parts.written, "oh_reread": parts.reread,
            "oh_total": parts.total}


def session_split(sessions: DataFrame, thresholds: Iterable = all_thresholds(),
                  alphas: Iterable = ALPHAS, rates: Rates = DEFAULT_RATES) -> DataFrame:
    """One row per session, threshold and alpha. No shuffle."""
    priced, prices = with_prices(sessions, rates)
    return (
        _cut(priced, prices, thresholds, "session_id")
        .withColumn("alpha", F.explode(g.literal_alphas(alphas)))
        .withColumns(_overheads(summary_dollars(prices, F.col("k") - 1, F.col("rereads"))))
        .withColumn("split_cost", F.col("base") + F.col("oh_total"))
        .withColumn("saved", F.col("full_cost") - F.col("split_cost"))
        .select("session_id", "threshold", "alpha", "peak", "k", "split_cost", "saved",
                "oh_total", "oh_gen", "oh_write", "oh_reread"))


def split_grid(sessions: DataFrame, thresholds: Iterable = all_thresholds(),
               alphas: Iterable = ALPHAS, rates: Rates = DEFAULT_RATES) -> DataFrame:
    """Totals per threshold and alpha.

    Sessions are summed per threshold, a few partial rows per task; alphas multiply the result.
    The few result rows are one partition, so the reports on them shuffle nothing more.
    """
    return grid_of(grid_totals(sessions, thresholds, rates), alphas)


def grid_totals(sessions: DataFrame, thresholds: Iterable = all_thresholds(),
                rates: Rates = DEFAULT_RATES) -> DataFrame:
    """One row per threshold: sums over the sessions that all alphas and the baseline share."""
    priced, prices = with_prices(sessions, rates)
    new = F.col("k") - 1
    return (
        _cut(priced, prices, thresholds)
        .withColumn("cache_read_cost", F.col("cache_read_tokens") * prices.cache_read)
        .groupBy("threshold")
        .agg(F.count("*").alias("n_sessions"),
             F.sum("full_cost").alias("full_cost"),
             F.sum("cache_read_cost").alias("cache_read_cost"),
             F.sum("base").alias("base"),
             F.sum("k").alias("pieces"),
             F.count_if(F.col("k") > 1).alias("n_split"),
             summed(new, prices.generated).alias("generated"),
             summed(new, prices.cache_write).alias("written"),
             summed(F.col("rereads"), prices.cache_read).alias("reread"))
        .repartition(1))


def grid_of(totals: DataFrame, alphas: Iterable = ALPHAS) -> DataFrame:
    """The grid from its totals."""
    return (
        totals.withColumn("alpha", F.explode(g.literal_alphas(alphas)))
        .withColumns(_overheads(SummaryDollars(*map(F.col, SummaryDollars._fields))))
        .withColumn("split_cost", F.col("base") + F.col("oh_total"))
        .withColumn("saved", F.col("full_cost") - F.col("split_cost"))
        .select("threshold", "alpha", "n_sessions", "full_cost", "split_cost", "saved",
                "oh_total", "oh_gen", "oh_write", "oh_reread", "n_split",
                (F.col("pieces") / F.col("n_sessions")).alias("avg_chunks"),
                (100 * F.col("saved") / F.nullif("full_cost", F.lit(0.0))).alias("saved_pct")))
