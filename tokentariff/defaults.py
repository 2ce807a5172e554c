"""Fixed values of the study. Every job takes them as parameters."""

from typing import NamedTuple


class RateCard(NamedTuple):
    """Dollar rates per million tokens, and the cache multiples of the input rate."""

    # The published numbers depend on these.
    input_usd_per_mtok: float = 4.75
    output_usd_per_mtok: float = 23.75
    cache_write_factor: float = 1.25
    cache_read_factor: float = 0.10


# The published numbers depend on these.
DEFAULT_RATES = RateCard()
AGENTS = ("Claude Code", "claude-code")
ALPHAS = (0.05, 0.10, 0.15, 0.20)
THRESHOLDS = (100_000, 150_000)
SWEEP = (100_000, 110_000, 120_000, 130_000, 140_000, 150_000)
REPORT_ALPHA = 0.10
PERCENTILES = (10, 50, 90)
