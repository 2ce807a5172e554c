"""The rank of every piece among all pieces of its threshold."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranges import in_ranges, running, sum_of


def piece_ranks(chunks: DataFrame) -> DataFrame:
    """The rows with ``rank``, the number of pieces before them, ``n_chunks``, their number in all, and
    ``percentile``, the share of pieces that are before, in percent.

    Pieces are in the order of cost, then session and piece number. A row of the compact form stands for
    ``multiplicity`` pieces that follow each other; its rank is that of the first. So the compact and
    the expanded form give the same ranks. Rows that agree in all of these are in any order.
    """
    weight = F.col("multiplicity") if "multiplicity" in chunks.columns else F.lit(1).cast("long")
    order = [F.col(c) for c in ("cost", "session_id", "chunk_idx")]
    ranges = in_ranges(chunks, F.col("threshold"), *order)
    # One row per threshold.
    totals = ranges.groupBy("threshold").agg(F.sum(weight).alias("n_chunks"))
    ranked = running(ranges, ["threshold"], order, rank=sum_of(weight))
    return ranked.join(totals, "threshold").select(
        *chunks.columns, "rank", "n_chunks",
        (100.0 * F.col("rank") / F.col("n_chunks")).alias("percentile"))
