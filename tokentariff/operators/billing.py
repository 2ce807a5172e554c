"""The bill as it was, before any split."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..defaults import DEFAULT_RATES
from ..functions.pricing import PRICE_COLUMNS, Rates, token_cost, with_prices


def session_cost(sessions: DataFrame, rates: Rates = DEFAULT_RATES) -> DataFrame:
    """Add each session's four cost parts and their total, in dollars."""
    priced, prices = with_prices(sessions, rates)
    costed = priced.withColumns({
        "input_cost": F.col("input_tokens") * prices.fresh,
        "output_cost": F.col("output_tokens") * prices.generated,
        "cache_write_cost": F.col("cache_creation_tokens") * prices.cache_write,
        "cache_read_cost": F.col("cache_read_tokens") * prices.cache_read,
        "full_cost": token_cost(prices, F.col("cache_read_tokens"))})
    added = ["input_cost", "output_cost", "cache_write_cost", "cache_read_cost", "full_cost"]
    return costed.drop(*PRICE_COLUMNS).select(*sessions.columns, *added)


def corpus_baseline(costed: DataFrame) -> DataFrame:
    """One row: sessions, total cost and cache-read cost. Ratios of an empty corpus are null."""
    return baseline_of(costed.select(F.lit(1).cast("long").alias("n_sessions"), "full_cost",
                                     "cache_read_cost"))


def baseline_of(sums: DataFrame) -> DataFrame:
    """The baseline from rows of sums over parts of the corpus, or from no row."""
    totals = sums.agg(
        F.coalesce(F.sum("n_sessions"), F.lit(0).cast("long")).alias("n_sessions"),
        F.coalesce(F.sum("full_cost"), F.lit(0.0)).alias("full_cost"),
        F.coalesce(F.sum("cache_read_cost"), F.lit(0.0)).alias("cache_read_cost"))
    count = F.nullif("n_sessions", F.lit(0))
    return totals.select(
        "n_sessions", "full_cost", (F.col("full_cost") / count).alias("full_per_session"),
        "cache_read_cost", (F.col("cache_read_cost") / count).alias("cache_read_per_session"),
        (100 * F.col("cache_read_cost") / F.nullif("full_cost", F.lit(0.0)))
        .alias("cache_read_pct"))
