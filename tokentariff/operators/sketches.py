"""Approximate percentiles of piece prices from mergeable sketches.

A sketch counts prices in bins that grow by a constant factor, so that every price in a bin is within
``accuracy``, relatively, of the value that stands for it. Counts of bins add up: sketches of days or agents
can be stored and merged at any later time, in any order, with the result of one sketch over all. A
sketch has a bounded number of bins, whatever it has counted: at an accuracy of 1 % some 115 for each factor of
ten. The number of prices, their sum, the least and the largest are kept exactly.
"""

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..defaults import PERCENTILES

ACCURACY = 0.01
FINEST = 0.0002
OFFSET = 4_000_000  # more than the number of bins on either side of 1, at the finest accuracy
TOTALS = {"n_chunks": "long", "cost": "double", "calls": "double", "least": "double", "most": "double"}


def growth(accuracy: float) -> float:
    """Factor between the bounds of a bin whose middle value is within ``accuracy`` of both."""
    if not FINEST <= accuracy < 1:
        raise ValueError(f"accuracy must be at least {FINEST} and below 1")
    return (1 + accuracy) / (1 - accuracy)


def bin_of(value: Column, accuracy: float = ACCURACY) -> Column:
    """Number of the bin: rises with the value, 0 for 0."""
    size = F.ceil(F.log(F.abs(value)) / math.log(growth(accuracy))) + OFFSET
    return F.when(value > 0, size).when(value < 0, -size).otherwise(F.lit(0).cast("long"))


def value_of(bin_: Column, accuracy: float = ACCURACY) -> Column:
    """The value that stands for all values of a bin."""
    factor = growth(accuracy)
    size = 2.0 * F.pow(F.lit(factor), F.abs(bin_) - OFFSET) / (factor + 1)
    return F.when(bin_ == 0, 0.0).otherwise(F.signum(bin_.cast("double")) * size)


def bin_counts(chunks: DataFrame, keys: list[str], accuracy: float = ACCURACY) -> DataFrame:
    """(keys, bin, n_chunks, cost, calls, least, most): one row for each key and bin that occurs. Tasks count
    before the shuffle. On a stream this is its state."""
    weight = F.col("multiplicity") if "multiplicity" in chunks.columns else F.lit(1).cast("long")
    return chunks.groupBy(*keys, bin_of(F.col("cost"), accuracy).alias("bin")).agg(
        F.sum(weight).alias("n_chunks"), F.sum(F.col("cost") * weight).alias("cost"),
        F.sum(F.col("calls") * weight).alias("calls"),
        F.min("cost").alias("least"), F.max("cost").alias("most"))


def summed_bins(bins: DataFrame, keys: list[str]) -> DataFrame:
    return bins.groupBy(*keys, "bin").agg(
        F.sum("n_chunks").alias("n_chunks"), F.sum("cost").alias("cost"),
        F.sum("calls").alias("calls"), F.min("least").alias("least"), F.max("most").alias("most"))


def price_sketches(chunks: DataFrame, keys: list[str], accuracy: float = ACCURACY) -> DataFrame:
    """One row per key with a ``sketch`` column, to be stored: the totals and a map from bins to counts.
    Rows whose cost is null are left out."""
    return _packed(bin_counts(chunks.where(F.col("cost").isNotNull()), keys, accuracy), keys)


def _packed(bins: DataFrame, keys: list[str]) -> DataFrame:
    return bins.groupBy(*keys).agg(F.struct(
        F.sum("n_chunks").alias("n_chunks"), F.sum("cost").alias("cost"),
        F.sum("calls").alias("calls"), F.min("least").alias("least"), F.max("most").alias("most"),
        F.map_from_entries(F.collect_list(F.struct("bin", "n_chunks"))).alias("bins"))
        .alias("sketch"))


def merge_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of fewer keys from stored ones of the same accuracy."""
    counted = sketches.select(*keys, F.explode("sketch.bins").alias("bin", "n"))
    bins = (counted.groupBy(*keys, "bin").agg(F.sum("n").alias("n"))
            .groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("bins")))
    totals = sketches.groupBy(*keys).agg(
        F.sum("sketch.n_chunks").alias("n_chunks"), F.sum("sketch.cost").alias("cost"),
        F.sum("sketch.calls").alias("calls"), F.min("sketch.least").alias("least"),
        F.max("sketch.most").alias("most"))
    same = F.lit(True)
    for key in keys:
        same = same & F.col(f"t.{key}").eqNullSafe(F.col(f"b.{key}"))
    return totals.alias("t").join(bins.alias("b"), same).select(
        *[F.col(f"t.{key}") for key in keys],
        F.struct(*[F.col(f"t.{name}") for name in TOTALS], F.col("b.bins")).alias("sketch"))


def sketch_percentiles(sketches: DataFrame, keys: list[str],
                       percentiles: Iterable[float] = PERCENTILES,
                       accuracy: float = ACCURACY) -> DataFrame:
    """Per sketch: number, mean, approximate percentiles (by the rank rule of ``chunk_distribution``), largest
    cost and mean calls. A percentile is within ``accuracy`` of the price at its rank."""
    bins = sketches.select(*keys, *[F.col("sketch")[name].alias(name) for name in TOTALS],
                           F.explode("sketch.bins").alias("bin", "count"))
    return _percentiles(bins, keys, percentiles, accuracy)


def bin_percentiles(bins: DataFrame, keys: list[str],
                    percentiles: Iterable[float] = PERCENTILES,
                    accuracy: float = ACCURACY) -> DataFrame:
    """The same from ``bin_counts``."""
    whole = Window.partitionBy(*keys)
    totals = {"n_chunks": F.sum, "cost": F.sum, "calls": F.sum, "least": F.min, "most": F.max}
    wide = bins.withColumn("count", F.col("n_chunks")).withColumns(
        {name: total(name).over(whole) for name, total in totals.items()})
    return _percentiles(wide, keys, percentiles, accuracy)


def _percentiles(bins: DataFrame, keys: list[str], percentiles: Iterable[float],
                 accuracy: float) -> DataFrame:
    upto = (Window.partitionBy(*keys).orderBy("bin")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    n = F.col("n_chunks")
    value = F.greatest(F.least(value_of(F.col("bin"), accuracy), F.col("most")), F.col("least"))

    def at(p: float) -> Column:
        rank = F.least(n - 1, F.floor(F.lit(float(p) / 100) * n))
        return F.min(F.when(F.col("upto") > rank, F.struct("bin", value.alias("value"))))["value"]

    return (bins.withColumn("upto", F.sum("count").over(upto))
            .groupBy(*keys, *TOTALS).agg(*[at(p).alias(f"approx_p{p:g}") for p in percentiles])
            .select(*keys, n, (F.col("cost") / n).alias("mean_cost"),
                    *[F.col(f"`approx_p{p:g}`") for p in percentiles], F.col("most").alias("max_cost"),
                    (F.col("calls") / n).alias("mean_calls")))
