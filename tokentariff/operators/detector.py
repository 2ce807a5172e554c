"""How well a detector's score agrees with labels, at every threshold it can have.

A row counts as found at a threshold if its score is at least that. Rows are counted per distinct
score first, in the tasks; counts of higher scores come from running totals over sorted ranges, so
no sort runs in one task. All counts are exact, ties included.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranges import in_ranges, running, sum_of


def detector_curve(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """One row per distinct score, as a threshold: ``positives`` and ``negatives`` with that very score,
    ``true_positives``, ``false_positives``, ``false_negatives``, ``true_negatives``, ``precision``,
    ``recall``, ``fall_out``. Labels are 1 and 0 or booleans; rows whose score is null or NaN, or whose
    label is null, are left out. A ratio whose divisor is 0 is null."""
    value = F.col(score).cast("double")
    counts = (scored.select((value + 0.0).alias("threshold"),
                            F.col(label).cast("int").alias("label"))
              .where(F.col("threshold").isNotNull() & ~F.isnan("threshold")
                     & F.col("label").isin(0, 1))
              .groupBy("threshold").agg(F.count_if(F.col("label") == 1).alias("positives"),
                                        F.count_if(F.col("label") == 0).alias("negatives")))
    falling = F.col("threshold").desc()
    ranges = in_ranges(counts, falling)
    total = ranges.agg(F.sum("positives").alias("p"), F.sum("negatives").alias("n")).first()
    every, none = F.lit(total["p"] or 0).cast("long"), F.lit(total["n"] or 0).cast("long")
    found = running(ranges, [], [falling], inclusive=True,
                    true_positives=sum_of(F.col("positives")),
                    false_positives=sum_of(F.col("negatives")))
    tp, fp = F.col("true_positives"), F.col("false_positives")
    zero = F.lit(0).cast("long")
    return found.select(
        "threshold", "positives", "negatives", "true_positives", "false_positives",
        (every - tp).alias("false_negatives"), (none - fp).alias("true_negatives"),
        (tp / (tp + fp)).alias("precision"), (tp / F.nullif(every, zero)).alias("recall"),
        (fp / F.nullif(none, zero)).alias("fall_out"))


def detector_summary(curve: DataFrame) -> DataFrame:
    """One row from the curve: ``positives``, ``negatives``, ``area`` under the curve of recall over
    fall-out (the share of pairs that the score puts in order, ties half), ``average_precision``, and
    the threshold with the best balance of precision and recall (the highest, if several), ``best_f1``."""
    wide = "decimal(38,0)"
    tp, fp, fn = map(F.col, ("true_positives", "false_positives", "false_negatives"))
    below = (F.col("true_negatives") * 2 + F.col("negatives")).cast("decimal(19,0)")
    ordered = F.sum((F.col("positives").cast("decimal(19,0)") * below).cast(wide))
    f1 = 2.0 * tp / F.nullif(2 * tp + fp + fn, F.lit(0).cast("long"))
    best = F.max_by(F.struct("threshold", f1.alias("f1")), F.struct(f1, F.col("threshold")))
    sums = curve.agg(
        F.coalesce(F.sum("positives"), F.lit(0).cast("long")).alias("positives"),
        F.coalesce(F.sum("negatives"), F.lit(0).cast("long")).alias("negatives"),
        ordered.alias("ordered"),
        F.sum(F.col("precision") * F.col("positives")).alias("precisions"), best.alias("best"))
    pairs = 2.0 * F.col("positives") * F.col("negatives")
    return sums.select(
        "positives", "negatives",
        (F.col("ordered").cast("double") / F.nullif(pairs, F.lit(0.0))).alias("area"),
        (F.col("precisions") / F.nullif("positives", F.lit(0).cast("long")))
        .alias("average_precision"),
        F.col("best")["threshold"].alias("best_threshold"), F.col("best")["f1"].alias("best_f1"))
