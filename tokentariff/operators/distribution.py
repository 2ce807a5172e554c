"""Distribution of piece prices: count, mean, maximum and exact percentiles by rank.

The percentile here is the value at position ``int(p / 100 * n)`` of the ascending prices, which
no built-in percentile gives. Sorting every price to find a few positions would shuffle the whole
table, so the ranks are found by counting: each pass over the prices counts them in bins, and the
bin that holds the wanted position becomes the range of the next pass. A pass shuffles a bounded
number of bin counts per task, however many prices there are and however often one repeats.
"""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..defaults import PERCENTILES

LOG_BINS = 24        # bins per factor of e in the first pass
LOG_OFFSET = 20_000  # more than LOG_BINS times the logarithm of any double
RANGE_BINS = 16_384  # bins per range in the passes after it
EXACT_ROWS = 1_000_000  # a range with no more rows than this is resolved value by value

RESULT = ("threshold {kind}, n_chunks long, mean_cost double, {percentiles}, "
          "max_cost double, mean_calls double")


def chunk_distribution(chunks: DataFrame, percentiles: Iterable[float] = PERCENTILES) -> DataFrame:
    """One row per threshold, from the compact or the expanded pieces.

    Runs its passes when called, and gives back the few result rows. If ``chunks`` is costly to
    derive, derive it from a ``staged`` sessions table.
    """
    percentiles = [float(p) for p in percentiles]
    weight = F.col("multiplicity") if "multiplicity" in chunks.columns else F.lit(1).cast("long")
    prices = chunks.select("threshold", "cost", "calls", weight.alias("weight"))
    found = {(row["threshold"], row["p"]): row for row in _first_pass(prices, percentiles)}
    while unsettled := [row for row in found.values() if row["lo"] < row["hi"]]:
        narrowed = _next_pass(prices, unsettled)
        if len(narrowed) < len(unsettled):
            raise RuntimeError("the prices changed between passes; stage the sessions first")
        found |= {(row["threshold"], row["p"]): row for row in narrowed}
    return _result(chunks, found, percentiles)


def _log_bin(value: Column) -> Column:
    """Bin number that never falls as the value grows, over the whole range of doubles."""
    size = F.floor(F.log(F.abs(value)) * LOG_BINS) + LOG_OFFSET
    return F.when(value > 0, size).when(value < 0, -size).otherwise(F.lit(0).cast("long"))


def _first_pass(prices: DataFrame, percentiles: list) -> list:
    bins = (prices.groupBy("threshold", _log_bin(F.col("cost")).alias("bin"))
            .agg(*_bin_totals(),
                 F.sum(F.col("cost") * F.col("weight")).alias("cost"),
                 F.sum(F.col("calls") * F.col("weight")).alias("calls")))
    whole = Window.partitionBy("threshold")
    count = F.col("n")
    ranks = F.array(*[
        F.struct(F.lit(p).alias("p"),
                 F.least(count - 1, F.floor(F.lit(p / 100) * count)).alias("rank"))
        for p in percentiles])
    ranked = (bins.withColumns({
        "n": F.sum("weight").over(whole),
        "cost": F.sum("cost").over(whole),
        "calls": F.sum("calls").over(whole),
        "max_cost": F.max("hi").over(whole)})
        .withColumn("want", F.explode(ranks))
        .select("*", "want.*"))
    return _bins_with_rank(ranked).collect()


def _next_pass(prices: DataFrame, unsettled: list) -> list:
    """Narrow each unsettled range. ``unsettled`` has a row per threshold and percentile."""
    spark = prices.sparkSession
    ranges = spark.createDataFrame(
        [(r["threshold"], r["p"], r["rank"], r["lo"], r["hi"], r["rows"], r["n"], r["cost"],
          r["calls"], r["max_cost"]) for r in unsettled],
        f"threshold {_kind(prices)}, p double, rank long, range_lo double, range_hi double, "
        "range_rows long, n long, cost_total double, calls_total double, max_cost double")
    lo, hi, cost = F.col("range_lo"), F.col("range_hi"), F.col("cost")
    part = (cost - lo) / (hi - lo) * RANGE_BINS
    linear = F.least(F.floor(part), F.lit(RANGE_BINS - 1).cast("long")).cast("double")
    keys = ["threshold", "p", "rank", "n", "cost_total", "calls_total", "max_cost"]
    # A null-safe test keeps the optimizer from pushing a null check of the cost below the cost's
    # own computation, where it would be computed a second time.
    inside = (prices.join(F.broadcast(ranges), "threshold")
              .where(((cost >= lo) & (cost <= hi)).eqNullSafe(True))
              .withColumn("bin", F.when(F.col("range_rows") <= EXACT_ROWS, cost)
                          .otherwise(linear)))
    bins = inside.groupBy(*keys, "bin").agg(*_bin_totals())
    ranked = bins.withColumnsRenamed({"cost_total": "cost", "calls_total": "calls"})
    return _bins_with_rank(ranked).collect()


def _bin_totals() -> list:
    return [F.sum("weight").alias("weight"), F.count("*").alias("rows"),
            F.min("cost").alias("lo"), F.max("cost").alias("hi")]


def _bins_with_rank(bins: DataFrame) -> DataFrame:
    """The bin that holds each wanted rank, with the rank counted from the start of that bin."""
    order = (Window.partitionBy("threshold", "p").orderBy("bin")
             .rowsBetween(Window.unboundedPreceding, 0))
    before = F.col("through") - F.col("weight")
    return (bins.withColumn("through", F.sum("weight").over(order))
            .where((F.col("rank") >= before) & (F.col("rank") < F.col("through")))
            .select("threshold", "p", (F.col("rank") - before).alias("rank"), "rows", "lo", "hi",
                    "n", "cost", "calls", "max_cost"))


def _kind(frame: DataFrame) -> str:
    return frame.schema["threshold"].dataType.simpleString()


def _result(chunks: DataFrame, found: dict, percentiles: list) -> DataFrame:
    rows = []
    for threshold in sorted({t for t, _ in found}):
        one = found[threshold, percentiles[0]]
        rows.append((threshold, one["n"], one["cost"] / one["n"],
                     *[found[threshold, p]["lo"] for p in percentiles],
                     one["max_cost"], one["calls"] / one["n"]))
    schema = RESULT.format(kind=_kind(chunks),
                           percentiles=", ".join(f"p{p:g} double" for p in percentiles))
    return chunks.sparkSession.createDataFrame(rows, schema)
