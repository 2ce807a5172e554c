"""Mixing sources to target weights: Efraimidis-Spirakis sampling to token budgets.

Each source gets a budget of tokens (here words): budgets share ``share`` of all tokens by weight,
and none exceeds ``most`` times its source; what one cannot take is shared again by weight.
A budget of e whole sources and a rest takes every document e times, and then documents in
the order of exponential keys, -ln(u) / weight, with u drawn from the document's id: the first
ones whose prefix sum of tokens is nearest to the rest.

A source may hold any share of the rows, so no window spans one: rows are sorted into ranges, which
are summed first, and the prefix sums run within a range on top of the ranges before it. Since these
sums rise, what is taken of a source is all up to one place in its order, and this place is all that goes
back to the documents: a row per source, broadcast up to BROADCAST_SOURCES of them. Texts are
read once; the kept columns, id, source, tokens and key are written to the shared folder, and only id,
source, tokens and key are shuffled.

Null texts have 0 tokens; null sources are one source, last in order. Documents with equal keys
are ordered by id (nulls first), tokens and a hash of the text; equal rows are interchangeable.
A source without tokens has target 0 and takes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokentariff.llm.text import word_count, without, work_folder, written
from tokentariff.operators.ranges import in_ranges, running, sum_of

SYMBOLS = "#*$%&|<>"
RANGE_ROWS = 1_000_000
BROADCAST_SOURCES = 10_000
SEED = "mix"


def text_quality(text: Column) -> Column:
    """Weight of a document, 0.1 to 1: a fifth of symbols among its characters gives the least."""
    length = F.length(text)
    symbols = length - F.length(without(text, SYMBOLS))
    return F.coalesce(
        F.greatest(F.lit(0.1), F.lit(1.0) - F.lit(5.0) * symbols / F.nullif(length, F.lit(0))),
        F.lit(1.0))


def exponential_key(doc_id: Column, weight: Column, seed: str = SEED) -> Column:
    """-ln(u) / weight with u in (0, 1) from the first 13 hex digits of an md5 of the id."""
    digits = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"),
                                                              F.lit("null")))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(16**13))
    return -F.ln(u) / weight


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), percent: int = 150,
                   most: int = 2) -> DataFrame:
    """(source, rows, source_size) with weight and target: one row a source, few beside documents.

    A source stops at ``most`` times its size if its share by weight of what the sources that stop
    earlier leave is larger; they stop in the order of that bound over their weight.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    weighted = (sizes.withColumn("weight", F.element_at(
        F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double"))
        .withColumn("cap", F.lit(most) * F.col("source_size")))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything) * F.lit(percent) / F.lit(100.0)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(rest)
    stops = weighted.withColumn("level", level).withColumn(
        "stops", F.col("cap") <= F.col("level") * F.col("weight"))
    shared = F.max(F.when(~F.col("stops"), F.col("level"))).over(everything)
    return stops.withColumn("target", F.when(
        F.col("stops"), F.col("cap").cast("double")).otherwise(shared * F.col("weight"))).select(
        "source", "rows", "source_size", "weight", "target")


def mix(documents: DataFrame, weights: tuple[int, ...] = (3, 1, 2), percent: int = 150,
        most: int = 2, weight: Column | None = None, keep: tuple[str, ...] = ("doc_id",),
        range_rows: int = RANGE_ROWS) -> DataFrame:
    """``keep`` columns of every row with source, size, source_size, target and taken, which
    replace columns of these names."""
    made = ("source", "size", "source_size", "target", "taken")
    keep = tuple(c for c in keep if c.lower() not in made)
    given = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(None)
    quality = text_quality(F.col("text")) if weight is None else weight
    rows = documents.select(
        given.alias("_given"), "source", F.col("doc_id").alias("_id"),
        F.xxhash64("text").alias("_tie"), word_count(F.col("text")).alias("size"),
        exponential_key(F.col("doc_id"), quality).alias("_key"))
    folder = work_folder(documents.sparkSession, "mix")
    rows = written(rows, f"{folder}/rows")
    sizes = rows.groupBy("source").agg(F.count("*").alias("rows"),
                                       F.sum("size").alias("source_size"))
    targets = written(source_targets(sizes, weights, percent, most).select(
        F.col("source").alias("_source"), "rows", "source_size", "target",
        F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0))
        .alias("_epochs")), f"{folder}/targets")
    counted = targets.agg(F.count("*"), F.sum("rows")).first()
    few = counted[0] <= BROADCAST_SOURCES
    of_source = F.col("source").eqNullSafe(F.col("_source"))

    def with_source(frame: DataFrame, of: DataFrame) -> DataFrame:
        return frame.join(F.broadcast(of) if few else of, of_source, "left")

    order = [F.col(c) for c in ("_key", "_id", "size", "_tie")]
    ranges = in_ranges(rows.select("source", *order), F.col("source"), *order,
                       parts=-(-(counted[1] or 0) // range_rows))
    upto = with_source(running(ranges, ["source"], order, inclusive=True,
                               _upto=sum_of(F.col("size"))), targets)
    rest = F.col("target") - F.col("_epochs") * F.col("source_size")
    middle = F.col("_upto") - F.col("size") / 2.0
    place = F.struct(*order)
    last = (upto.where((F.col("_epochs") < most) & (middle <= rest))
            .groupBy("source").agg(F.max(place).alias("_last"))
            .withColumnRenamed("source", "_of"))
    cuts = written(targets.join(last, F.col("_source").eqNullSafe(F.col("_of")), "left").drop("_of"),
                   f"{folder}/cuts")
    once_more = F.when(place <= F.col("_last"), 1).otherwise(0)
    return with_source(rows, cuts).withColumn(
        "taken", (F.col("size") * (F.col("_epochs") + once_more)).cast("long")).select(
        *[F.col(f"_given.`{c}`") for c in keep], *made)
