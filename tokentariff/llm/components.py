"""Connected components by alternating large and small stars, as joins over tables of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokentariff.llm.text import written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Connect the neighbours of every node to the smallest of them and itself.

    ``links`` (a > b). Large: neighbours above a node; small: the node and neighbours below it.
    """
    if large:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
            links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("w"), F.least("u", "m").alias("m"))
    joined = both.join(least, F.col("u") == F.col("w"))
    if large:
        new = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"),
                                                           F.col("m").alias("b"))
    else:
        new = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(
            least.select(F.col("w").alias("a"), F.col("m").alias("b")))
    new = new.where(F.col("a") > F.col("b"))
    return new if large else new.distinct()


def _is_forest_of_stars(links: DataFrame) -> bool:
    """No node has two smaller neighbours, and none is both above and below another."""
    ends = links.select(F.col("a").alias("u"), F.lit(1).alias("above")).unionAll(
        links.select(F.col("b").alias("u"), F.lit(0).alias("above")))
    return ends.groupBy("u").agg(
        F.sum("above").alias("times"), F.min("above").alias("least")).where(
        (F.col("times") > 1) | ((F.col("times") > 0) & (F.col("least") == 0))).isEmpty()


def components(links: DataFrame, folder: str) -> DataFrame:
    """(id, component): the smallest id of every component that has a link (a, b long).

    Every step is written below ``folder`` and read back, so a lost executor costs one step. A
    forest of stars is where it ends.
    """
    now = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(
        F.col("a") > F.col("b")).distinct()
    now, step = written(now, f"{folder}/links"), 0
    while not _is_forest_of_stars(now):
        now = written(_star(_star(now, large=True), large=False), f"{folder}/step-{step}")
        step += 1
    roots = now.select("b").distinct().select(F.col("b").alias("id"), F.col("b").alias("component"))
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(roots)
