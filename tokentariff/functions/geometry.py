"""Shape of a session's context: a straight ramp from zero to a peak, cut into pieces.

A cut at T leaves ``k - 1`` pieces of height T and one last piece of the rest. Totals over the
pieces have closed forms, so a session costs the same to price whatever its number of pieces.
"""

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def ramp_peak(cache_read: Column, calls: Column) -> Column:
    """Peak whose ramp over ``calls`` has the area ``cache_read``; null if there is no ramp."""
    return F.when((calls > 0) & (cache_read > 0), 2.0 * cache_read / calls)


def piece_count(peak: Column, threshold: Column) -> Column:
    """Pieces a cut at the threshold gives; a peak at or under it, or none, stays whole."""
    return F.when(peak > threshold, F.ceil(peak / threshold)).otherwise(F.lit(1).cast("long"))


def last_height(peak: Column, pieces: Column, threshold: Column) -> Column:
    return peak - (pieces - 1) * threshold


def piece_calls(height: Column, calls: Column, peak: Column) -> Column:
    """Calls that fall into a piece: its share of the ramp. Fractional."""
    return height * calls / peak


def split_cache_read(peak: Column, pieces: Column, last: Column, threshold: Column,
                     calls: Column) -> Column:
    squares = (pieces - 1) * threshold * threshold + last * last
    return calls / (2.0 * peak) * squares


def later_calls(calls: Column) -> Column:
    """Calls of a piece after its first one, never below zero."""
    return F.greatest(calls - 1.0, F.lit(0.0))


def summary_rereads(peak: Column, pieces: Column, last: Column, threshold: Column,
                    calls: Column) -> Column:
    """Calls that read a carried summary again, over all pieces but the first."""
    full = later_calls(piece_calls(threshold, calls, peak))
    rest = later_calls(piece_calls(last, calls, peak))
    return (pieces - 2) * full + rest


def literal_thresholds(thresholds: Iterable) -> Column:
    """Array literal of the distinct thresholds, in ascending order."""
    values = sorted(set(thresholds))
    if not values or values[0] <= 0:
        raise ValueError("thresholds must be positive, and at least one is needed")
    kind = "long" if all(isinstance(v, int) for v in values) else "double"
    return F.array(*[F.lit(v).cast(kind) for v in values])


def literal_alphas(alphas: Iterable) -> Column:
    """Array literal of the distinct summary fractions, in ascending order."""
    values = sorted({float(a) for a in alphas})
    if not values:
        raise ValueError("at least one alpha is needed")
    return F.array(*[F.lit(a) for a in values])
