"""Price a split whose pieces are given as a table, instead of cut at a threshold."""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..defaults import DEFAULT_RATES
from ..functions import geometry as g
from ..functions.pricing import (PRICE_COLUMNS, Rates, TokenPrices, summary_dollars, token_cost,
                                 with_prices, work_cost)
from ..sources.sessions import TOKEN_COLUMNS

BLOCK = 65_536
BLOCKS = 4_096
TOLERANCE = 1e-6


def price_supplied_chunks(sessions: DataFrame, chunks: DataFrame, threshold, alpha,
                          rates: Rates = DEFAULT_RATES, peak_mode: str = "ramp",
                          tolerance: float = TOLERANCE) -> DataFrame:
    """Cost per session of the pieces in ``chunks`` (``session_id, chunk_idx, height``).

    ``peak_mode='ramp'`` takes the peak from the cache reads and stretches the heights to add up
    to it; ``'heights'`` takes the sum of the heights as the peak. ``heights_ok`` says whether
    the heights as given add up to the ramp peak, within a relative tolerance; it is null where
    there are no heights or no ramp. Sessions that cannot be split so are billed as they were.

    ``threshold`` and ``alpha`` only set the size of the summary. Either may be several values: the
    result then has a row and the columns ``threshold`` and ``alpha`` for each pair of them, from
    the same one pass over the pieces.

    ``chunks`` may be a table of ``stored_pieces``: its buckets take the place of the shuffle.

    Every session row gives a result row, with a null id (it has no pieces) or a repeated one too.
    Piece numbers are unique in a session, and the smallest is its first piece; a session with a
    piece that has no number is billed as it was and has ``heights_ok`` false. A null height is 0,
    and pieces without a session id belong to no session.
    """
    several = any(isinstance(value, Iterable) for value in (threshold, alpha))
    thresholds, alphas = (value if isinstance(value, Iterable) else [value]
                          for value in (threshold, alpha))
    outlined, spread, prices = _prepared(sessions, chunks, rates, peak_mode, tolerance)
    counted = _with_rereads(outlined, spread)
    dollars = summary_dollars(prices, F.col("n_chunks") - 1, F.col("rereads"))
    summary = F.col("alpha") * F.col("threshold")
    total = summary * dollars.total
    priced = (
        counted.withColumn("threshold", F.explode(g.literal_thresholds(thresholds)))
        .withColumn("alpha", F.explode(g.literal_alphas(alphas)))
        .withColumns({"oh_gen": summary * dollars.generated, "oh_write": summary * dollars.written,
                      "oh_reread": summary * dollars.reread, "oh_total": total})
        .withColumn("split_cost", F.col("base") + F.col("oh_total"))
        .withColumn("saved", F.col("full_cost") - F.col("split_cost")))
    return priced.select(
        "session_id", *(["threshold", "alpha"] if several else []), "n_chunks", "peak",
        "cache_read_split", "split_cost", "oh_total", "oh_gen", "oh_write", "oh_reread", "saved",
        "heights_ok")


def supplied_piece_prices(sessions: DataFrame, chunks: DataFrame, threshold: float, alpha: float,
                          rates: Rates = DEFAULT_RATES, peak_mode: str = "ramp") -> DataFrame:
    """One row per supplied piece: its height as stretched, its calls and its cost.

    The costs of a session add up to its ``split_cost``. A session that cannot be split has one
    row, with its bill. Columns are those of ``chunk_prices``, so ``chunk_distribution`` takes the
    result; parameters and rules are those of ``price_supplied_chunks``.
    """
    outlined, spread, prices = _prepared(sessions, chunks, rates, peak_mode, TOLERANCE)
    calls, height = F.col("calls"), F.col("height")
    first = F.col("chunk_idx") == F.col("first_idx")
    carried = alpha * threshold * summary_dollars(
        prices, F.lit(1), g.later_calls(calls)).total
    own = (F.col("work") * calls / F.col("api_call_count") + calls * height / 2.0
           * prices.cache_read + F.when(first, 0.0).otherwise(carried))
    kind = "long" if isinstance(threshold, int) else "double"
    limit = F.lit(threshold).cast(kind).alias("threshold")
    # Matched pieces only: the left rows that have blocks have a piece in each of them.
    split = (
        outlined.where(F.col("blocks").isNotNull())
        .withColumn("block", F.explode("blocks")).drop("blocks")
        .join(spread.withColumnRenamed("height", "given"), ["session_id", "block"])
        .withColumn("calls", F.col("given") * F.col("calls_per_token"))
        .withColumn("height", F.col("given") * F.col("peak") / F.col("total"))
        .select("session_id", limit, "chunk_idx", "height", "calls", own.alias("cost"),
                first.alias("is_first")))
    whole = outlined.where(F.col("blocks").isNull()).select(
        "session_id", limit, F.lit(0).cast("long").alias("chunk_idx"), F.col("ramp").alias("height"),
        F.col("api_call_count").cast("double").alias("calls"), F.col("full_cost").alias("cost"),
        F.lit(True).alias("is_first"))
    return split.unionByName(whole)


def _prepared(sessions: DataFrame, chunks: DataFrame, rates: Rates, peak_mode: str,
              tolerance: float) -> tuple[DataFrame, DataFrame, TokenPrices]:
    if peak_mode not in ("ramp", "heights"):
        raise ValueError("peak_mode must be 'ramp' or 'heights'")
    priced, prices = with_prices(sessions, rates)
    spread = _spread(chunks)
    return _outlined(priced, _outlines(spread), prices, peak_mode, tolerance), spread, prices


def stored_pieces(chunks: DataFrame, table: str, buckets: int | None = None,
                  path: str | None = None) -> DataFrame:
    """Write pieces as a table for repeated runs, in buckets of session and block of piece numbers.

    ``price_supplied_chunks`` and ``supplied_piece_prices`` shuffle no piece of such a table. Use as many buckets
    as runs have shuffle partitions (the default): with fewer, Spark may shuffle after all. A table of
    that name is replaced.
    """
    spark = chunks.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = _blocks(chunks).repartition(buckets, "session_id", "block").write.mode("overwrite")
    if path is not None:
        writer = writer.option("path", path)
    writer.bucketBy(buckets, "session_id", "block").sortBy("session_id", "block").saveAsTable(table)
    return spark.table(table)


def _blocks(chunks: DataFrame) -> DataFrame:
    """Pieces with their block of piece numbers, so that a session with a great share of all pieces is
    many groups."""
    index = F.col("chunk_idx")
    block = F.coalesce(F.pmod(F.floor(index / BLOCK), F.lit(BLOCKS)), F.lit(0).cast("long"))
    height = F.coalesce(F.col("height").cast("double"), F.lit(0.0))
    return (chunks.select("session_id", index, height.alias("height"), block.alias("block"))
            .where(F.col("session_id").isNotNull()))


def _spread(chunks: DataFrame) -> DataFrame:
    """Pieces by session and block. Both uses of the pieces share this one shuffle, or the buckets of a
    stored table; the null check is the one the join would add to one use only."""
    if chunks.columns == ["session_id", "chunk_idx", "height", "block"]:
        return chunks.where(F.col("session_id").isNotNull())
    return _blocks(chunks).repartition("session_id", "block")


def _outlines(spread: DataFrame) -> DataFrame:
    """Per session: totals of its heights, its first piece, and the blocks its pieces are in."""
    blocks = spread.groupBy("session_id", "block").agg(
        F.count("*").alias("pieces"),
        F.count_if(F.col("chunk_idx").isNull()).alias("unnumbered"),
        F.sum("height").alias("total"),
        F.sum(F.col("height") * F.col("height")).alias("squares"),
        F.min("chunk_idx").alias("first_idx"))
    return blocks.groupBy("session_id").agg(
        F.sum("pieces").alias("pieces"),
        F.sum("unnumbered").alias("unnumbered"),
        F.sum("total").alias("total"),
        F.sum("squares").alias("squares"),
        F.min("first_idx").alias("first_idx"),
        F.collect_list("block").alias("blocks"))


def _outlined(sessions: DataFrame, outlines: DataFrame, prices: TokenPrices, peak_mode: str,
              tolerance: float) -> DataFrame:
    """Sessions priced from their outline, in all but the summaries. ``blocks`` is null for
    sessions that cannot be priced so."""
    calls, read = F.col("api_call_count"), F.col("cache_read_tokens")
    total, ramp, peak, splits = F.col("total"), F.col("ramp"), F.col("peak"), F.col("splits")
    possible = (calls > 0) & (total > 0) & (F.col("unnumbered") == 0)
    if peak_mode == "ramp":
        possible = possible & (read > 0)
    stretched = F.col("squares") * (peak / total) * (peak / total)
    price_columns = PRICE_COLUMNS if prices.per_row else ()
    fits = (F.col("unnumbered") == 0) & (F.abs(total - ramp) <= tolerance * ramp)
    return (
        sessions.select("session_id", *TOKEN_COLUMNS, *price_columns)
        .join(outlines, "session_id", "left")
        .withColumn("ramp", g.ramp_peak(read, calls))
        .withColumn("splits", F.coalesce(possible, F.lit(False)))
        .withColumn("peak", F.when(splits, ramp if peak_mode == "ramp" else total))
        .withColumn("cache_read_split", F.when(splits, calls / (2.0 * peak) * stretched)
                    .otherwise(read.cast("double")))
        .select("session_id", *price_columns, "api_call_count", "peak", "ramp", "total",
                "cache_read_split",
                F.when(splits, F.col("pieces")).otherwise(F.lit(1).cast("long"))
                .alias("n_chunks"),
                work_cost(prices).alias("work"),
                token_cost(prices, F.col("cache_read_split")).alias("base"),
                token_cost(prices, read).alias("full_cost"),
                fits.alias("heights_ok"),
                _when(splits, calls / total, "calls_per_token"),
                _when(splits, F.col("first_idx"), "first_idx"),
                _when(splits, F.col("blocks"), "blocks")))


def _when(condition: Column, value: Column, name: str) -> Column:
    return F.when(condition, value).alias(name)


def _with_rereads(outlined: DataFrame, spread: DataFrame) -> DataFrame:
    """Add the number of calls that read a summary again.

    It needs the session's totals at each piece. They go to the blocks that hold its pieces, at
    most ``BLOCKS`` rows per session, and the sums come back to the session rows, which are all
    kept. Sessions that share an id have the same pieces, so calls per token tell them apart.
    """
    keys = ["session_id", "calls_per_token"]
    calls = g.later_calls(F.col("height") * F.col("calls_per_token"))
    later = F.when(F.col("chunk_idx") > F.col("first_idx"), calls)
    sums = (
        outlined.where(F.col("blocks").isNotNull()).groupBy(*keys)
        .agg(F.first("first_idx").alias("first_idx"), F.first("blocks").alias("blocks"))
        .withColumn("block", F.explode("blocks")).drop("blocks")
        .join(spread, ["session_id", "block"])
        .groupBy(*keys).agg(F.sum(later).alias("rereads")))
    return outlined.join(sums, keys, "left").withColumn(
        "rereads", F.coalesce("rereads", F.lit(0.0)))
