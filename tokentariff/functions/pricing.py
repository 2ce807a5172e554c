"""What a token costs, and what a session's tokens cost."""

from typing import NamedTuple, Union

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..defaults import DEFAULT_RATES, RateCard

Price = Union[float, Column]
Rates = Union[RateCard, DataFrame]

BROADCAST_ROWS = 100_000


class TokenPrices(NamedTuple):
    """Dollars for one token of each kind: plain numbers, or columns of the row."""

    fresh: Price
    generated: Price
    cache_write: Price
    cache_read: Price

    @property
    def per_row(self) -> bool:
        return isinstance(self.fresh, Column)


def prices_from(card) -> TokenPrices:
    """Turn four rates (numbers or columns) into dollars per token."""
    per_in, per_out, write, read = card
    return TokenPrices(per_in / 1e6, per_out / 1e6, per_in * write / 1e6, per_in * read / 1e6)


PRICE_COLUMNS = tuple(f"price_{kind}" for kind in TokenPrices._fields)


def with_prices(sessions: DataFrame, rates: Rates = DEFAULT_RATES):
    """Return ``(sessions, TokenPrices)``.

    One rate card gives plain numbers and leaves the frame alone. A table of rates, with the
    ``RateCard`` columns and one key column that sessions have too, gives price columns on every
    row. A null field of the table has its default, and rows whose key is not in the table get the
    default rates.
    """
    if not isinstance(rates, DataFrame):
        return sessions, prices_from(RateCard(*rates))
    keys = [c for c in rates.columns if c not in RateCard._fields]
    if len(keys) != 1 or keys[0] not in sessions.columns:
        raise ValueError("a rates table needs one key column, and sessions need it too")
    key = keys[0]
    prices = prices_from([F.coalesce(F.col(name).cast("double"), F.lit(default))
                          for name, default in DEFAULT_RATES._asdict().items()])
    table = rates.select(F.col(key), *[p.alias(n) for n, p in zip(PRICE_COLUMNS, prices)])
    joined = _join_rates(sessions, table, key)
    fallback = prices_from(DEFAULT_RATES)
    filled = joined.withColumns(
        {n: F.coalesce(n, F.lit(p)) for n, p in zip(PRICE_COLUMNS, fallback)})
    return filled, TokenPrices(*[F.col(n) for n in PRICE_COLUMNS])


def _join_rates(sessions: DataFrame, table: DataFrame, key: str) -> DataFrame:
    table = table.where(F.col(key).isNotNull())
    size = table.groupBy(key).count().agg(
        F.count("*").alias("keys"), F.max("count").alias("most")).first()
    if size["most"] is not None and size["most"] > 1:
        raise ValueError(f"rates table has more than one row for a value of {key!r}")
    if size["keys"] <= BROADCAST_ROWS:
        return sessions.join(F.broadcast(table), key, "left")
    # Too many keys to ship everywhere: shuffle. Adaptive execution may split the sessions of a
    # busy key, since they are the left side.
    return sessions.join(table.hint("merge"), key, "left")


def token_cost(prices: TokenPrices, cache_read: Column) -> Column:
    """Dollars for a session's own tokens, with the given number of cache-read tokens."""
    return work_cost(prices) + cache_read * prices.cache_read


def work_cost(prices: TokenPrices) -> Column:
    """Dollars for the tokens that a split shares out but never reduces."""
    return (F.col("input_tokens") * prices.fresh
            + F.col("output_tokens") * prices.generated
            + F.col("cache_creation_tokens") * prices.cache_write)


class SummaryDollars(NamedTuple):
    """What each token of the carried summaries costs; times the summary size, the overhead."""

    generated: Column
    written: Column
    reread: Column

    @property
    def total(self) -> Column:
        return self.generated + self.written + self.reread


def summary_dollars(prices: TokenPrices, new_pieces, rereads: Column) -> SummaryDollars:
    """A summary is generated and cached for every new piece, and read again by later calls."""
    return SummaryDollars(new_pieces * prices.generated, new_pieces * prices.cache_write,
                          rereads * prices.cache_read)


def summed(quantity: Column, price: Price) -> Column:
    """Total of quantity times price; a constant price is applied once, after the sum."""
    if isinstance(price, Column):
        return F.sum(quantity * price)
    return F.sum(quantity) * price
