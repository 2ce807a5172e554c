"""Reports on the split grid, a few rows for each threshold and alpha."""

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..defaults import ALPHAS, REPORT_ALPHA, SWEEP, THRESHOLDS


def _saved_per_session():
    return (F.col("saved") / F.col("n_sessions")).alias("saved_per_session")


def savings_table(grid: DataFrame, thresholds: Iterable = THRESHOLDS) -> DataFrame:
    """Savings per alpha at the thresholds of the detail tables."""
    return (grid.where(F.col("threshold").isin(list(thresholds)))
            .select("alpha", "threshold", "saved", _saved_per_session(), "saved_pct",
                    "oh_total", "avg_chunks")
            .orderBy("alpha", "threshold"))


def overhead_breakdown(grid: DataFrame, alpha: float = REPORT_ALPHA,
                       thresholds: Iterable = THRESHOLDS) -> DataFrame:
    """Where the summary dollars go, at one alpha."""
    wanted = F.col("threshold").isin(list(thresholds)) & (F.col("alpha") == alpha)
    return (grid.where(wanted)
            .select("threshold", "oh_total", "oh_gen", "oh_write", "oh_reread")
            .orderBy("threshold"))


def alpha_column(alpha: float) -> str:
    """Name of the matrix column of an alpha: 0.05 gives ``saved_pct_a05``."""
    whole, _, rest = f"{100 * alpha:.10g}".partition(".")
    return f"saved_pct_a{whole:0>2}" + (f"_{rest}" if rest else "")


def threshold_sweep(grid: DataFrame, sweep: Iterable = SWEEP,
                    alphas: Iterable = ALPHAS) -> DataFrame:
    """Matrix of saved percent: thresholds down, alphas across."""
    alphas = list(alphas)
    matrix = (grid.where(F.col("threshold").isin(list(sweep)))
              .groupBy("threshold", "avg_chunks")
              .pivot("alpha", alphas)
              .agg(F.first("saved_pct"))
              .toDF("threshold", "avg_chunks", *map(alpha_column, alphas)))
    return (matrix.select("threshold", *map(alpha_column, alphas), "avg_chunks")
            .orderBy("threshold"))


def best_threshold(grid: DataFrame, sweep: Iterable = SWEEP) -> DataFrame:
    """Threshold of the largest saving per alpha; the smallest threshold wins a tie."""
    row = F.struct("threshold", "saved", _saved_per_session(), "saved_pct")
    rank = F.struct("saved", (-F.col("threshold")).alias("smaller"))
    return (grid.where(F.col("threshold").isin(list(sweep)))
            .groupBy("alpha").agg(F.max_by(row, rank).alias("best"))
            .select("alpha", "best.*")
            .orderBy("alpha"))
