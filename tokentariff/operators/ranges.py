"""Running totals in sorted order, without a task that holds a whole key or the whole table.

A frame is sorted into ranges of about equal size and written, so that the number of a row's range
holds for every later read. What precedes a row is then put together from two parts: the ranges before
its own, summed up to one row per key and range, and the rows before it in its own range. A key with
any share of the rows spans many ranges; a key's rows in one range are at most that range.
"""

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import kept


class Total(NamedTuple):
    """An aggregate that can be merged from parts, of which either may be null."""

    function: Callable[[Column], Column]
    merge: Callable[[Column, Column], Column]
    column: Column


def sum_of(column: Column) -> Total:
    zero = F.lit(0)
    return Total(F.sum, lambda a, b: F.coalesce(a, zero) + F.coalesce(b, zero), column)


def max_of(column: Column) -> Total:
    return Total(F.max, F.greatest, column)


def in_ranges(frame: DataFrame, *order: Column, parts: int = 0) -> DataFrame:
    """The frame written in ranges of the order, which starts with the keys, and read back with the
    number of its range in ``_range``. There are as many ranges as shuffle partitions, or ``parts``
    if that is more."""
    least = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = frame.repartitionByRange(parts, *order) if parts > least else frame.repartitionByRange(*order)
    return kept(cut.withColumn("_range", F.spark_partition_id()))


def running(ranges: DataFrame, keys: list[str], order: list[Column], inclusive: bool = False,
            **totals: Total) -> DataFrame:
    """Add each total over the rows of the same keys that come before the row, and with the row
    itself if ``inclusive``. ``ranges`` come from ``in_ranges``, sorted by the keys and ``order``."""
    parts = ranges.groupBy(*keys, "_range").agg(
        *[total.function(total.column).alias(name) for name, total in totals.items()])
    # One row for each range that holds rows of the key.
    earlier = (Window.partitionBy(*keys).orderBy("_range")
               .rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select(
        *[F.col(key).alias(f"_key{i}") for i, key in enumerate(keys)], F.col("_range").alias("_of"),
        *[total.function(name).over(earlier).alias(f"_to_{name}") for name, total in totals.items()])
    same = F.col("_range") == F.col("_of")
    for i, key in enumerate(keys):
        same = same & F.col(key).eqNullSafe(F.col(f"_key{i}"))
    within = (Window.partitionBy(*keys, "_range").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    return ranges.join(starts, same).select(
        *[F.col(f"`{c}`") for c in ranges.columns],
        *[total.merge(F.col(f"_to_{name}"), total.function(total.column).over(within)).alias(name)
          for name, total in totals.items()])
