"""The formulas of the model as column expressions. All of them stay inside the JVM."""

from .geometry import (last_height, later_calls, piece_calls, piece_count, ramp_peak,
                       split_cache_read, summary_rereads)
from .pricing import (SummaryDollars, TokenPrices, prices_from, summary_dollars, token_cost,
                      with_prices, work_cost)

__all__ = ["SummaryDollars", "TokenPrices", "last_height", "later_calls", "piece_calls",
           "piece_count", "prices_from", "ramp_peak", "split_cache_read", "summary_dollars",
           "summary_rereads", "token_cost", "with_prices", "work_cost"]
