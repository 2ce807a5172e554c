"""The whole study over one sessions table."""

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame

from ..defaults import ALPHAS, DEFAULT_RATES, REPORT_ALPHA, SWEEP, THRESHOLDS
from ..functions.pricing import Rates
from ..operators import (best_threshold, chunk_distribution, chunk_prices, overhead_breakdown,
                         savings_table, threshold_sweep)
from ..operators.billing import baseline_of
from ..operators.splitting import all_thresholds, grid_of, grid_totals


class Study(NamedTuple):
    baseline: DataFrame
    totals: DataFrame
    grid: DataFrame
    savings: DataFrame
    overhead: DataFrame
    sweep: DataFrame
    best: DataFrame
    distribution: DataFrame


def run_study(sessions: DataFrame, thresholds: Iterable = THRESHOLDS, sweep: Iterable = SWEEP,
              alphas: Iterable = ALPHAS, rates: Rates = DEFAULT_RATES,
              report_alpha: float = REPORT_ALPHA) -> Study:
    """All reports.

    Totals, a row per threshold, are kept for the reports drawn from them; call
    ``totals.unpersist()`` when done. Sessions are read once for these, and in each pass of the
    distribution: give a plain table, or a ``staged`` one if they are costly to derive.
    """
    alphas = list(alphas)
    grid_alphas = sorted({*alphas, report_alpha})
    needed = all_thresholds(thresholds, sweep)
    totals = grid_totals(sessions, needed, rates).persist()
    grid = grid_of(totals, grid_alphas)
    chosen = grid.where(grid["alpha"].isin(alphas))
    return Study(
        baseline=baseline_of(totals.where(totals["threshold"] == needed[0])),
        totals=totals,
        grid=grid,
        savings=savings_table(chosen, thresholds),
        overhead=overhead_breakdown(grid, report_alpha, thresholds),
        sweep=threshold_sweep(chosen, sweep, alphas),
        best=best_threshold(chosen, sweep),
        distribution=chunk_distribution(
            chunk_prices(sessions, thresholds, report_alpha, rates, compact=True)))
