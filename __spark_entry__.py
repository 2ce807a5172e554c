"""

Sessions come from ``orders`` and ``lineitem``, supplied pieces from ``conversations``. Totals
are rounded because the order of a float sum is not fixed; row-level results are not.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import tokentariff as tt
from tokentariff.sources import kept, shared_folder
from tokentariff.sources.samples import (conversation_calls, conversation_pieces,
                                         conversation_sessions, conversation_turns, event_calls,
                                         event_work, order_sessions, symbol_scores)

SUPPLIED_THRESHOLD, SUPPLIED_ALPHA = 400, 0.10
IDLE, PAUSE, USD_PER_HOUR = 6 * 3_600, 4 * 3_600, 60.0
NUDGE = 3.1e-11
PARTS = ("oh_gen", "oh_write", "oh_reread")
DOLLARS = ("split_cost", "oh_total", "saved")
AGENT_RATES = [("Claude Code", 4.7513, 23.7531, 1.2507, 0.1003),
               ("claude-code", 3.1019, 15.3717, 1.2011, 0.0803)]
# One agent has a null field, the other is missing: both take defaults.
PARTIAL_RATES = [("claude-code", 3.1019, 15.3717, None, 0.0803)]


def entry(spark: SparkSession) -> DataFrame:
    return queries()["threshold_sweep"](spark, "/root/testdata/sf0.001")


def _sessions(spark: SparkSession, folder: str) -> DataFrame:
    return tt.select_sessions(order_sessions(spark, folder))


def _grid(spark: SparkSession, folder: str) -> DataFrame:
    return tt.split_grid(_sessions(spark, folder))


def _rates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(AGENT_RATES, ["agent", *tt.RateCard._fields])


def _rounded(frame: DataFrame, digits: int = 4, keep: tuple = (), nudge: float = 0.0) -> DataFrame:
    return frame.select(*[
        F.round(F.col(name) + nudge, digits).alias(name)
        if kind == "double" and name not in keep else name
        for name, kind in frame.dtypes])


def _nine(frame: DataFrame, keep: tuple = ()) -> DataFrame:
    """Nine digits. Prices are short decimals, so many results lie between two roundings; the nudge
    moves them off that point, where the last bit of a sum would decide."""
    return _rounded(frame, 9, keep, NUDGE)


def _nine_of(frame: DataFrame, *names: str) -> DataFrame:
    """Nine digits of the named columns without the detour of ``round`` through decimals."""
    return frame.withColumns({
        name: F.floor((F.col(name) + NUDGE) * 1e9 + 0.5) / 1e9 for name in names})


def _partial_rates(spark: SparkSession) -> DataFrame:
    kinds = ", ".join(f"{name} double" for name in tt.RateCard._fields)
    return spark.createDataFrame(PARTIAL_RATES, f"agent string, {kinds}")


def _conversations(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Sessions and their pieces. Texts are read once, for the pieces that are kept."""
    pieces = kept(conversation_pieces(conversation_turns(spark, folder)))
    return conversation_sessions(pieces), pieces.select("session_id", "chunk_idx", "height")


def _supplied(mode: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark, folder):
        tokens = ("peak", "cache_read_split")
        priced = tt.price_supplied_chunks(
            *_conversations(spark, folder), SUPPLIED_THRESHOLD, SUPPLIED_ALPHA, peak_mode=mode)
        return _rounded(_rounded(priced.drop(*PARTS), 12, keep=tokens), 6, keep=DOLLARS)
    return query


def _supplied_stored(spark: SparkSession, folder: str) -> DataFrame:
    """Priced from a bucketed table of the pieces, as repeated runs would be."""
    sessions, pieces = _conversations(spark, folder)
    name = f"pieces_{uuid.uuid4().hex}"
    stored = tt.stored_pieces(pieces, name, path=f"{shared_folder(spark).rstrip('/')}/{name}")
    priced = tt.price_supplied_chunks(sessions, stored, SUPPLIED_THRESHOLD, SUPPLIED_ALPHA)
    return _rounded(_rounded(priced.drop(*PARTS), 12, keep=("peak", "cache_read_split")), 6,
                    keep=DOLLARS)


def _sketched(spark: SparkSession, folder: str) -> DataFrame:
    """Sketches of every weekday's sessions, merged for the percentiles of all."""
    chunks = tt.chunk_prices(_sessions(spark, folder), [100_000, 150_000], compact=True)
    days = tt.price_sketches(chunks.withColumn("day", F.col("session_id") % 7), ["threshold", "day"])
    merged = tt.merge_sketches(kept(days), ["threshold"])
    return _rounded(tt.sketch_percentiles(merged, ["threshold"]))


def _supplied_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return tt.supplied_piece_prices(
        *_conversations(spark, folder), SUPPLIED_THRESHOLD, SUPPLIED_ALPHA)


def _supplied_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return _nine(tt.chunk_distribution(kept(_supplied_pieces(spark, folder))))


def _supplied_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Several thresholds and alphas from one pass over the pieces."""
    return _nine(tt.price_supplied_chunks(
        *_conversations(spark, folder), [200, 400], [0.05, 0.10])).drop("heights_ok")


def _rates_supplied(spark: SparkSession, folder: str) -> DataFrame:
    sessions = _sessions(spark, folder)
    pieces = tt.chunk_prices(sessions, 100_000).select("session_id", "chunk_idx", "height")
    priced = tt.price_supplied_chunks(sessions, pieces, 100_000, 0.10, _partial_rates(spark))
    return _rounded(priced)


def _supplied_uniform(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of a uniform cut, given as a table: the same prices as the cut itself."""
    sessions = _sessions(spark, folder)
    pieces = tt.chunk_prices(sessions, 100_000).select("session_id", "chunk_idx", "height")
    return _rounded(tt.price_supplied_chunks(sessions, pieces, 100_000, 0.10).drop(*PARTS))


def _distribution(spark: SparkSession, folder: str) -> DataFrame:
    with tt.staged(_sessions(spark, folder)) as sessions:
        chunks = tt.chunk_prices(sessions, [100_000, 150_000], 0.10, compact=True)
        return _rounded(tt.chunk_distribution(chunks), keep=("p10", "p50", "p90", "max_cost"))


def _ranks(compact: bool) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark, folder):
        return tt.piece_ranks(tt.chunk_prices(
            _sessions(spark, folder), [100_000, 150_000], compact=compact))
    return query


def _session_time(spark: SparkSession, folder: str) -> DataFrame:
    return tt.session_time(event_work(spark, folder), F.col("human"), F.col("ts"), F.col("ended"),
                           PAUSE, USD_PER_HOUR)


def _training_data():
    """The queries and SQL of the training-data operators, where they are installed."""
    try:
        import corpus_pipeline
        from tokentariff.llm import queries as llm
    except ImportError:
        return {}, {}
    found, sql = llm.queries(), llm.oracle_sql()
    found["pipeline"] = corpus_pipeline.run
    if corpus_pipeline.ORACLE_SQL:
        sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found, sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    deterministic = ("alpha", "oh_gen", "oh_write")
    # The SQL adds these up piece by piece; all else has the same bits.
    summed = ("split_cost", "saved", "oh_total", "oh_reread")
    return {
        **_training_data()[0],
        "load_sessions": _sessions,
        "session_cost": lambda s, f: tt.session_cost(_sessions(s, f)),
        "corpus_baseline": lambda s, f: _rounded(
            tt.corpus_baseline(tt.session_cost(_sessions(s, f)))),
        "session_split": lambda s, f: _nine_of(tt.session_split(_sessions(s, f)), *summed),
        "split_grid": lambda s, f: _rounded(_grid(s, f), keep=deterministic),
        "savings_table": lambda s, f: _rounded(tt.savings_table(_grid(s, f))),
        "overhead_breakdown": lambda s, f: _rounded(
            tt.overhead_breakdown(_grid(s, f)), keep=deterministic),
        "threshold_sweep": lambda s, f: _rounded(tt.threshold_sweep(_grid(s, f))),
        "best_threshold": lambda s, f: _rounded(tt.best_threshold(_grid(s, f))),
        "chunk_prices": lambda s, f: tt.chunk_prices(_sessions(s, f), [100_000, 150_000]),
        "chunk_prices_compact": lambda s, f: tt.chunk_prices(
            _sessions(s, f), [100_000, 150_000], compact=True),
        "chunk_distribution": _distribution,
        "supplied_chunks_ramp": _supplied("ramp"),
        "supplied_chunks_heights": _supplied("heights"),
        "supplied_chunks_uniform": _supplied_uniform,
        "supplied_chunks_stored": _supplied_stored,
        "sketched_distribution": _sketched,
        "supplied_piece_prices": lambda s, f: _nine(_supplied_pieces(s, f)),
        "supplied_distribution": _supplied_distribution,
        "supplied_chunks_parts": _supplied_parts,
        "rates_by_agent_session_split": lambda s, f: _nine_of(
            tt.session_split(_sessions(s, f), rates=_partial_rates(s)), *summed),
        "rates_by_agent_chunk_prices": lambda s, f: _nine(
            tt.chunk_prices(_sessions(s, f), 100_000, rates=_partial_rates(s))),
        "rates_by_agent_supplied": _rates_supplied,
        "rates_by_agent_session_cost": lambda s, f: tt.session_cost(_sessions(s, f), _rates(s)),
        "rates_by_agent_split_grid": lambda s, f: _rounded(
            tt.split_grid(_sessions(s, f), rates=_rates(s))),
        "sessions_from_calls": lambda s, f: tt.sessions_from_calls(
            conversation_calls(conversation_turns(s, f))),
        "session_runs_from_calls": lambda s, f: tt.sessions_from_calls(
            event_calls(s, f), IDLE).withColumns({
                name: F.unix_micros(name) for name in ("started", "ended")}),
        "turn_replies": lambda s, f: tt.turn_replies(s.read.parquet(f"{f}/conversations.parquet")),
        "session_time": _session_time,
        "detector_curve": lambda s, f: tt.detector_curve(symbol_scores(s, f)),
        "detector_summary": lambda s, f: _rounded(
            tt.detector_summary(tt.detector_curve(symbol_scores(s, f))), 9, ("best_threshold",)),
        "piece_ranks": _ranks(compact=False),
        "piece_ranks_compact": _ranks(compact=True),
    }


# --------------------------------------------------------------------------------------------
# SQL side
# --------------------------------------------------------------------------------------------

ORDER_SESSIONS = """
sessions AS (
  SELECT session_id, agent, COALESCE(input_tokens, 0) AS input_tokens,
         COALESCE(output_tokens, 0) AS output_tokens,
         COALESCE(cache_creation_tokens, 0) AS cache_creation_tokens,
         COALESCE(cache_read_tokens, 0) AS cache_read_tokens,
         COALESCE(api_call_count, 0) AS api_call_count
  FROM (
    SELECT o.o_orderkey AS session_id,
           CASE o.o_orderkey % 5 WHEN 0 THEN 'Claude Code' WHEN 1 THEN 'claude-code'
                WHEN 2 THEN 'Claude Code' WHEN 3 THEN 'CLAUDE CODE' ELSE NULL END AS agent,
           CAST(CASE WHEN o.o_orderkey % 13 = 0 THEN NULL ELSE l.qty * 40 END AS BIGINT)
             AS input_tokens,
           CAST(l.qty * 90 AS BIGINT) AS output_tokens,
           CAST(FLOOR(l.cents / 100.0) AS BIGINT) AS cache_creation_tokens,
           CAST(FLOOR(l.cents / 100.0) AS BIGINT)
             * (1 + (o.o_orderkey % 11) * 3) * (1 + o.o_orderkey % 4) AS cache_read_tokens,
           CASE WHEN o.o_orderkey % 17 = 0 THEN NULL
                ELSE l.n_lines * (1 + (o.o_orderkey % 11) * 3) END AS api_call_count
    FROM orders o
    LEFT JOIN (SELECT l_orderkey, COUNT(*) AS n_lines,
                      CAST(SUM(CAST(ROUND(l_quantity) AS BIGINT)) AS BIGINT) AS qty,
                      CAST(SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents
               FROM lineitem GROUP BY l_orderkey) l
      ON l.l_orderkey = o.o_orderkey)
  WHERE agent IN ('Claude Code', 'claude-code'))"""

# Dollars per token of each kind, on every session row.
PRICES = """
priced AS (
  SELECT *, usd_in / 1e6 AS p_fresh, usd_out / 1e6 AS p_gen, usd_in * wf / 1e6 AS p_write,
         usd_in * rf / 1e6 AS p_read
  FROM (SELECT *, {usd_in} AS usd_in, {usd_out} AS usd_out, {wf} AS wf, {rf} AS rf
        FROM sessions)),
costed AS (
  SELECT *, input_tokens * p_fresh AS input_cost, output_tokens * p_gen AS output_cost,
         cache_creation_tokens * p_write AS cache_write_cost,
         cache_read_tokens * p_read AS cache_read_cost,
         input_tokens * p_fresh + output_tokens * p_gen + cache_creation_tokens * p_write
           + cache_read_tokens * p_read AS full_cost
  FROM priced)"""

ONE_RATE = PRICES.format(usd_in="4.75e0", usd_out="23.75e0", wf="1.25e0", rf="0.1e0")
BY_AGENT = PRICES.format(
    usd_in="CASE agent WHEN 'Claude Code' THEN 4.7513e0 ELSE 3.1019e0 END",
    usd_out="CASE agent WHEN 'Claude Code' THEN 23.7531e0 ELSE 15.3717e0 END",
    wf="CASE agent WHEN 'Claude Code' THEN 1.2507e0 ELSE 1.2011e0 END",
    rf="CASE agent WHEN 'Claude Code' THEN 0.1003e0 ELSE 0.0803e0 END")

PARTIAL_BY_AGENT = PRICES.format(
    usd_in="CASE agent WHEN 'claude-code' THEN 3.1019e0 ELSE 4.75e0 END",
    usd_out="CASE agent WHEN 'claude-code' THEN 15.3717e0 ELSE 23.75e0 END",
    wf="1.25e0", rf="CASE agent WHEN 'claude-code' THEN 0.0803e0 ELSE 0.1e0 END")

# A row per session and threshold, with the shape of its cut.
SHAPES = """
scenarios AS (
  SELECT c.*, t.threshold,
         CASE WHEN api_call_count > 0 AND cache_read_tokens > 0
              THEN 2e0 * cache_read_tokens / api_call_count END AS peak
  FROM costed c, (SELECT CAST(UNNEST([{thresholds}]) AS BIGINT) AS threshold) t),
counted AS (
  SELECT *, CASE WHEN peak > threshold THEN CAST(CEIL(peak / threshold) AS BIGINT) ELSE 1 END AS k
  FROM scenarios)"""
ALL_T = "100000, 110000, 120000, 130000, 140000, 150000"
DETAIL_T = "100000, 150000"
ALPHAS = "(SELECT UNNEST([0.05e0, 0.1e0, 0.15e0, 0.2e0]) AS alpha)"

# A row per session, threshold and alpha, summed from the single pieces of the cut.
SPLITS = """
single AS (
  SELECT session_id, threshold, height * api_call_count / peak AS m, height, idx
  FROM (SELECT *, CASE WHEN idx < k - 1 THEN threshold
                       ELSE peak - (k - 1) * CAST(threshold AS DOUBLE) END AS height
        FROM (SELECT *, UNNEST(RANGE(k)) AS idx FROM counted WHERE k > 1))),
cut_sums AS (
  SELECT session_id, threshold, SUM(m * height / 2e0) AS read_pieces,
         SUM(CASE WHEN idx > 0 AND m > 1 THEN m - 1 ELSE 0e0 END) AS again
  FROM single GROUP BY session_id, threshold),
shaped AS (
  SELECT c.*, COALESCE(read_pieces, c.cache_read_tokens) AS read_after,
         COALESCE(again, 0e0) AS rereads
  FROM counted c LEFT JOIN cut_sums USING (session_id, threshold)),
parts AS (
  SELECT *, input_cost + output_cost + cache_write_cost + read_after * p_read AS base,
         alpha * threshold * ((k - 1) * p_gen) AS oh_gen,
         alpha * threshold * ((k - 1) * p_write) AS oh_write,
         alpha * threshold * (rereads * p_read) AS oh_reread
  FROM shaped, """ + ALPHAS + """),
splits AS (
  SELECT *, oh_gen + oh_write + oh_reread AS oh_total,
         base + (oh_gen + oh_write + oh_reread) AS split_cost,
         full_cost - (base + (oh_gen + oh_write + oh_reread)) AS saved
  FROM parts)"""

# Every piece as a row of its own, from which all totals of the cut are summed.
PIECES = """
pieces AS (
  SELECT *, height * api_call_count / peak AS calls
  FROM (SELECT *, CASE WHEN k = 1 THEN peak WHEN idx < k - 1 THEN threshold
                       ELSE peak - (k - 1) * CAST(threshold AS DOUBLE) END AS height
        FROM (SELECT *, UNNEST(RANGE(k)) AS idx FROM counted)))"""

GRID = PIECES + """,
cut AS (
  SELECT session_id, threshold, ANY_VALUE(full_cost) AS full_cost, COUNT(*) AS k,
         ANY_VALUE(CASE WHEN k = 1 THEN full_cost
                        ELSE input_cost + output_cost + cache_write_cost END)
           + SUM(CASE WHEN k > 1 THEN calls * height / 2 * p_read ELSE 0e0 END) AS base,
         SUM(CASE WHEN idx > 0 THEN p_gen ELSE 0e0 END) AS gen,
         SUM(CASE WHEN idx > 0 THEN p_write ELSE 0e0 END) AS wri,
         SUM(CASE WHEN idx > 0 THEN GREATEST(calls - 1, 0) * p_read ELSE 0e0 END) AS rer
  FROM pieces GROUP BY session_id, threshold),
totals AS (
  SELECT threshold, COUNT(*) AS n_sessions, SUM(full_cost) AS full_cost, SUM(base) AS base,
         CAST(SUM(k) AS BIGINT) AS pieces, COUNT(*) FILTER (k > 1) AS n_split,
         {gen} AS gen, {wri} AS wri, SUM(rer) AS rer
  FROM cut GROUP BY threshold),
parts AS (
  SELECT *, alpha * threshold * gen AS oh_gen, alpha * threshold * wri AS oh_write,
         alpha * threshold * rer AS oh_reread
  FROM totals, """ + ALPHAS + """),
grid AS (
  SELECT *, oh_gen + oh_write + oh_reread AS oh_total,
         base + (oh_gen + oh_write + oh_reread) AS split_cost,
         full_cost - (base + (oh_gen + oh_write + oh_reread)) AS saved,
         pieces / CAST(n_sessions AS DOUBLE) AS avg_chunks,
         100 * (full_cost - (base + (oh_gen + oh_write + oh_reread))) / full_cost AS saved_pct
  FROM parts)"""

# With one rate for all, the number of new pieces is summed and priced once.
ONE_RATE_GRID = ",".join([
    "WITH" + ORDER_SESSIONS, ONE_RATE, SHAPES.format(thresholds=ALL_T),
    GRID.format(gen="CAST(SUM(k - 1) AS BIGINT) * (23.75e0 / 1e6)",
                wri="CAST(SUM(k - 1) AS BIGINT) * (4.75e0 * 1.25e0 / 1e6)")])
BY_AGENT_GRID = ",".join([
    "WITH" + ORDER_SESSIONS, BY_AGENT, SHAPES.format(thresholds=ALL_T),
    GRID.format(gen="SUM(gen)", wri="SUM(wri)")])

SPLIT_GRID = """
SELECT threshold, alpha, n_sessions, ROUND(full_cost, 4) AS full_cost,
       ROUND(split_cost, 4) AS split_cost, ROUND(saved, 4) AS saved,
       ROUND(oh_total, 4) AS oh_total, {gen} AS oh_gen, {wri} AS oh_write,
       ROUND(oh_reread, 4) AS oh_reread, n_split, ROUND(avg_chunks, 4) AS avg_chunks,
       ROUND(saved_pct, 4) AS saved_pct
FROM grid"""

PIECE_COST = """
  CASE WHEN k = 1 THEN full_cost
       ELSE (input_cost + output_cost + cache_write_cost) * (calls / api_call_count)
            + calls * height / 2e0 * p_read
            + CASE WHEN idx = 0 THEN 0e0
                   ELSE 0.1e0 * threshold
                        * (p_gen + p_write + GREATEST(calls - 1e0, 0e0) * p_read) END END"""
PIECE_CHUNKS = """
chunks AS (
  SELECT session_id, threshold, idx AS chunk_idx, height, k,
         CASE WHEN k = 1 THEN CAST(api_call_count AS DOUBLE) ELSE calls END AS calls,
         """ + PIECE_COST + """ AS cost, idx = 0 AS is_first
  FROM pieces)"""
PIECE_ROWS = ",".join(["WITH" + ORDER_SESSIONS, ONE_RATE, SHAPES.format(thresholds=DETAIL_T),
                       PIECES, PIECE_CHUNKS])
SESSION_SPLIT = """
SELECT session_id, threshold, alpha, peak, k,
       FLOOR((split_cost + 3.1e-11) * 1e9 + 0.5e0) / 1e9 AS split_cost,
       FLOOR((saved + 3.1e-11) * 1e9 + 0.5e0) / 1e9 AS saved,
       FLOOR((oh_total + 3.1e-11) * 1e9 + 0.5e0) / 1e9 AS oh_total, oh_gen, oh_write,
       FLOOR((oh_reread + 3.1e-11) * 1e9 + 0.5e0) / 1e9 AS oh_reread
FROM splits"""

TURNS = """
WITH turns AS (
  SELECT conv_id, turn, role, CAST(FLOOR((length(text) + 3) / 4.0) AS BIGINT) AS tok,
         SUM(CASE WHEN role = 'user' THEN 1 ELSE 0 END)
           OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS g,
         COALESCE(SUM(CAST(FLOOR((length(text) + 3) / 4.0) AS BIGINT))
           OVER (PARTITION BY conv_id ORDER BY turn
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ctx
  FROM conversations),
heights AS (
  SELECT conv_id AS session_id, GREATEST(g, 1) - 1 AS idx, CAST(SUM(tok) AS DOUBLE) AS height
  FROM turns GROUP BY 1, 2),
s AS (
  SELECT conv_id AS session_id,
         CAST(SUM(CASE WHEN role <> 'assistant' THEN tok ELSE 0 END) AS DOUBLE) AS it,
         CAST(SUM(CASE WHEN role = 'assistant' THEN tok ELSE 0 END) AS DOUBLE) AS ot,
         CAST(SUM(tok) AS DOUBLE) AS cw,
         CAST(SUM(CASE WHEN role = 'assistant' THEN ctx ELSE 0 END) AS DOUBLE) AS cr,
         CAST(SUM(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) AS DOUBLE) AS n
  FROM turns GROUP BY conv_id),
h AS (
  SELECT session_id, idx, height, SUM(height) OVER (PARTITION BY session_id) AS total,
         ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY idx) AS place
  FROM heights),
sized AS (
  SELECT s.*, h.total, h.place, CASE WHEN n > 0 AND cr > 0 THEN 2e0 * cr / n END AS ramp,
         n > 0 AND total > 0 AND {possible} AS splits, {peak} AS peak,
         h.height * {peak} / NULLIF(h.total, 0) AS height
  FROM s LEFT JOIN h USING (session_id)),
summed AS (
  SELECT session_id, it, ot, cw, cr, n, ramp, total, splits,
         CASE WHEN splits THEN peak END AS peak,
         CASE WHEN splits THEN n / (2e0 * peak) * SUM(height * height) ELSE cr END AS read_after,
         CASE WHEN splits THEN COUNT(*) ELSE 1 END AS n_chunks,
         CASE WHEN splits THEN COALESCE(SUM(GREATEST(height * n / peak - 1, 0))
                                          FILTER (place > 1), 0e0) ELSE 0e0 END AS rereads
  FROM sized GROUP BY session_id, it, ot, cw, cr, n, ramp, total, splits, peak),
dollars AS (
  SELECT *, (it * 4.75e0 + ot * 23.75e0 + cw * 4.75e0 * 1.25e0 + cr * 4.75e0 * 0.1e0) / 1e6 AS fc,
         (it * 4.75e0 + ot * 23.75e0 + cw * 4.75e0 * 1.25e0 + read_after * 4.75e0 * 0.1e0) / 1e6
           AS base,
         40e0 * ((n_chunks - 1) * (23.75e0 + 4.75e0 * 1.25e0) + rereads * 4.75e0 * 0.1e0) / 1e6
           AS oh
  FROM summed)
SELECT session_id, n_chunks, ROUND(peak, 6) AS peak, ROUND(read_after, 6) AS cache_read_split,
       ROUND(base + oh, 12) AS split_cost, ROUND(oh, 12) AS oh_total,
       ROUND(fc - (base + oh), 12) AS saved, ABS(total - ramp) <= 1e-6 * ramp AS heights_ok
FROM dollars"""


# Every supplied piece with its own price, under ramp peaks.
SUPPLIED_PIECES = TURNS.split("sized AS")[0].rstrip().rstrip(",") + """,
joined AS (
  SELECT s.*, h.idx, h.height AS given, h.total, h.place,
         2e0 * cr / NULLIF(n, 0) AS peak, n > 0 AND cr > 0 AND total > 0 AS splits,
         (it * 4.75e0 + ot * 23.75e0 + cw * 5.9375e0) / 1e6 AS work,
         (it * 4.75e0 + ot * 23.75e0 + cw * 5.9375e0 + cr * 0.475e0) / 1e6 AS fc
  FROM s LEFT JOIN h USING (session_id)),
shares AS (
  SELECT session_id, idx, place = 1 AS is_first, given * peak / total AS height,
         given * n / total AS calls, work, n, fc, cr, peak, splits FROM joined WHERE splits
  UNION ALL
  SELECT DISTINCT session_id, 0, TRUE, CASE WHEN n > 0 AND cr > 0 THEN peak END, n, work, n, fc, cr,
         peak, FALSE FROM joined WHERE NOT COALESCE(splits, FALSE)),
owned AS (
  SELECT *, CASE WHEN splits THEN work * calls / n + calls * height / 2e0 * 0.475e0 / 1e6
                 ELSE fc END AS own FROM shares),
piece_costs AS (
  SELECT *, own + CASE WHEN is_first THEN 0e0
                       ELSE 40e0 * (23.75e0 + 5.9375e0 + GREATEST(calls - 1, 0) * 0.475e0) / 1e6
                  END AS cost FROM owned)"""


SESSIONS_FROM_CALLS = TURNS.split("heights AS")[0].rstrip().rstrip(",") + """
SELECT conv_id AS session_id, 'Claude Code' AS agent,
       CAST(SUM(CASE WHEN role <> 'assistant' THEN tok ELSE 0 END) AS BIGINT) AS input_tokens,
       CAST(SUM(CASE WHEN role = 'assistant' THEN tok ELSE 0 END) AS BIGINT) AS output_tokens,
       CAST(SUM(tok) AS BIGINT) AS cache_creation_tokens,
       CAST(SUM(CASE WHEN role = 'assistant' THEN ctx ELSE 0 END) AS BIGINT) AS cache_read_tokens,
       COUNT(*) FILTER (role = 'assistant') AS api_call_count
FROM turns GROUP BY conv_id"""

SESSION_RUNS = f"""
WITH calls AS (
  SELECT user_id AS session_id, ts, event_id,
         CASE WHEN event_id % 5 <> 0 THEN 'agent-' || event_type END AS agent,
         CAST(FLOOR(value * 100) AS BIGINT) AS tokens FROM events),
opened AS (
  SELECT *, COALESCE(epoch_us(ts) - epoch_us(LAG(ts) OVER (PARTITION BY session_id ORDER BY ts))
                     > {IDLE}::BIGINT * 1000000, TRUE) AS opens FROM calls),
numbered AS (SELECT *, COUNT(*) FILTER (opens) OVER (PARTITION BY session_id ORDER BY ts) AS run
             FROM opened)
SELECT session_id, epoch_us(MIN(ts)) AS started, epoch_us(MAX(ts)) AS ended,
       ARG_MIN(agent, ts) FILTER (agent IS NOT NULL) AS agent,
       CAST(COALESCE(SUM(tokens) FILTER (event_id % 7 <> 0), 0) AS BIGINT) AS input_tokens,
       CAST(SUM(tokens) * 2 AS BIGINT) AS output_tokens,
       CAST(SUM(tokens) AS BIGINT) AS cache_creation_tokens,
       CAST(SUM(tokens) * 9 AS BIGINT) AS cache_read_tokens, COUNT(*) AS api_call_count
FROM numbered GROUP BY session_id, run"""

TURN_REPLIES = """
WITH following AS (
  SELECT conv_id, turn, role, text,
         LEAD(role) OVER following AS next_role, LEAD(turn) OVER following AS next_turn,
         LEAD(text) OVER following AS next_text
  FROM conversations WHERE role IN ('assistant', 'user')
  WINDOW following AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, text, CASE WHEN next_role = 'user' THEN next_turn END AS reply_turn,
       CASE WHEN next_role = 'user' THEN next_text END AS reply
FROM following WHERE role = 'assistant'"""

SESSION_TIME = f"""
WITH work AS (
  SELECT user_id AS session_id, event_type IN ('click', 'view') AS human, epoch_us(ts) AS started,
         CASE WHEN event_type IN ('click', 'view') THEN epoch_us(ts)
              ELSE epoch_us(ts) + CAST(FLOOR(value * 60000000) AS BIGINT) END AS ended,
         CASE WHEN event_type IN ('click', 'view') THEN {PAUSE}::BIGINT * 1000000 ELSE 0 END AS pause
  FROM events),
opened AS (
  SELECT *, COALESCE(started - MAX(ended) OVER (
              PARTITION BY session_id, human ORDER BY started, ended
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > pause, TRUE) AS opens FROM work),
numbered AS (
  SELECT *, COUNT(*) FILTER (opens) OVER (PARTITION BY session_id, human ORDER BY started, ended
                                          ROWS UNBOUNDED PRECEDING) AS run FROM opened),
runs AS (SELECT session_id, human, run, COUNT(*) AS n, MAX(ended) - MIN(started) AS micros
         FROM numbered GROUP BY session_id, human, run),
totals AS (
  SELECT session_id,
         CAST(COALESCE(SUM(n) FILTER (human), 0) AS BIGINT) AS attention_events,
         COUNT(*) FILTER (human) AS attention_runs,
         CAST(COALESCE(SUM(n) FILTER (NOT human), 0) AS BIGINT) AS agent_events,
         COUNT(*) FILTER (NOT human) AS agent_runs,
         COALESCE(SUM(micros) FILTER (human), 0) / 6e7 AS attention_minutes,
         COALESCE(SUM(micros) FILTER (NOT human), 0) / 6e7 AS agent_minutes
  FROM runs GROUP BY session_id)
SELECT *, attention_minutes / 60e0 * {USD_PER_HOUR}e0 AS attention_usd FROM totals"""

DETECTOR = """
WITH scored AS (
  SELECT (length(text) - length(translate(text, '#*$%&|<>', ''))) / CAST(NULLIF(length(text), 0) AS DOUBLE)
           AS score, 1 - quality AS label
  FROM documents JOIN labels USING (doc_id)),
counts AS (SELECT score AS threshold, COUNT(*) FILTER (label = 1) AS positives,
                  COUNT(*) FILTER (label = 0) AS negatives
           FROM scored WHERE score IS NOT NULL AND label IN (0, 1) GROUP BY score),
summed AS (
  SELECT *, SUM(positives) OVER falling AS tp, SUM(negatives) OVER falling AS fp,
         SUM(positives) OVER () AS p, SUM(negatives) OVER () AS n
  FROM counts WINDOW falling AS (ORDER BY threshold DESC)),
curve AS (
  SELECT threshold, positives, negatives, CAST(tp AS BIGINT) AS true_positives,
         CAST(fp AS BIGINT) AS false_positives, CAST(p - tp AS BIGINT) AS false_negatives,
         CAST(n - fp AS BIGINT) AS true_negatives, CAST(tp AS DOUBLE) / (tp + fp) AS precision,
         CAST(tp AS DOUBLE) / NULLIF(p, 0) AS recall, CAST(fp AS DOUBLE) / NULLIF(n, 0) AS fall_out
  FROM summed)"""

DETECTOR_SUMMARY = DETECTOR + """,
pairs AS (
  SELECT COUNT(*) FILTER (a.label = 1 AND b.label = 0) AS n,
         COUNT(*) FILTER (a.label = 1 AND b.label = 0 AND a.score > b.score) AS ordered,
         COUNT(*) FILTER (a.label = 1 AND b.label = 0 AND a.score = b.score) AS tied
  FROM scored a, scored b),
best AS (SELECT threshold, 2e0 * true_positives / (2 * true_positives + false_positives + false_negatives) AS f1
         FROM curve ORDER BY 2 DESC, 1 DESC LIMIT 1)
SELECT CAST(SUM(positives) AS BIGINT) AS positives, CAST(SUM(negatives) AS BIGINT) AS negatives,
       ROUND((SELECT (ordered + tied / 2e0) / n FROM pairs), 9) AS area,
       ROUND(SUM(precision * positives) / SUM(positives), 9) AS average_precision,
       (SELECT threshold FROM best) AS best_threshold, ROUND((SELECT f1 FROM best), 9) AS best_f1
FROM curve"""

SKETCHED = """,
binned AS (
  SELECT threshold, cost, calls, COUNT(*) OVER (PARTITION BY threshold) AS n,
         CEIL(ln(cost) / ln(1.01e0 / 0.99e0)) AS bin FROM chunks),
bins AS (SELECT threshold, n, bin, COUNT(*) AS pieces FROM binned GROUP BY threshold, n, bin),
summed AS (SELECT *, SUM(pieces) OVER (PARTITION BY threshold ORDER BY bin) AS upto FROM bins),
found AS (
  SELECT threshold, MIN(bin) FILTER (upto > LEAST(n - 1, FLOOR(0.1e0 * n))) AS b10,
         MIN(bin) FILTER (upto > LEAST(n - 1, FLOOR(0.5e0 * n))) AS b50,
         MIN(bin) FILTER (upto > LEAST(n - 1, FLOOR(0.9e0 * n))) AS b90
  FROM summed GROUP BY threshold),
totals AS (SELECT threshold, COUNT(*) AS n_chunks, AVG(cost) AS mean_cost, MAX(cost) AS max_cost,
                  MIN(cost) AS least, AVG(calls) AS mean_calls FROM binned GROUP BY threshold)
SELECT threshold, n_chunks, ROUND(mean_cost, 4) AS mean_cost,
       ROUND(GREATEST(least, LEAST(max_cost, 2 * POW(1.01e0 / 0.99e0, b10) / (1.01e0 / 0.99e0 + 1))), 4)
         AS approx_p10,
       ROUND(GREATEST(least, LEAST(max_cost, 2 * POW(1.01e0 / 0.99e0, b50) / (1.01e0 / 0.99e0 + 1))), 4)
         AS approx_p50,
       ROUND(GREATEST(least, LEAST(max_cost, 2 * POW(1.01e0 / 0.99e0, b90) / (1.01e0 / 0.99e0 + 1))), 4)
         AS approx_p90,
       ROUND(max_cost, 4) AS max_cost, ROUND(mean_calls, 4) AS mean_calls
FROM totals JOIN found USING (threshold)"""

PIECE_RANKS = """,
placed AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY threshold ORDER BY cost, session_id, chunk_idx) - 1 AS rank,
         COUNT(*) OVER (PARTITION BY threshold) AS n_chunks
  FROM chunks)
SELECT session_id, threshold, {row}, rank, n_chunks, 100e0 * rank / n_chunks AS percentile FROM {rows}"""


def oracle_sql() -> dict[str, str]:
    partial = ",".join(["WITH" + ORDER_SESSIONS, PARTIAL_BY_AGENT])
    costed = ",".join(["WITH" + ORDER_SESSIONS, ONE_RATE])
    costed_by_agent = ",".join(["WITH" + ORDER_SESSIONS, BY_AGENT])
    session_cost = """
SELECT session_id, agent, input_tokens, output_tokens, cache_creation_tokens, cache_read_tokens,
       api_call_count, input_cost, output_cost, cache_write_cost, cache_read_cost, full_cost
FROM costed"""
    return {
        **_training_data()[1],
        "load_sessions": "WITH" + ORDER_SESSIONS + "SELECT * FROM sessions",
        "session_cost": costed + session_cost,
        "corpus_baseline": costed + """
SELECT COUNT(*) AS n_sessions, ROUND(SUM(full_cost), 4) AS full_cost,
       ROUND(SUM(full_cost) / COUNT(*), 4) AS full_per_session,
       ROUND(SUM(cache_read_cost), 4) AS cache_read_cost,
       ROUND(SUM(cache_read_cost) / COUNT(*), 4) AS cache_read_per_session,
       ROUND(100 * SUM(cache_read_cost) / SUM(full_cost), 4) AS cache_read_pct
FROM costed""",
        "session_split": ",".join(
            [costed, SHAPES.format(thresholds=ALL_T), SPLITS]) + SESSION_SPLIT,
        "rates_by_agent_session_split": ",".join(
            [partial, SHAPES.format(thresholds=ALL_T), SPLITS]) + SESSION_SPLIT,
        "rates_by_agent_chunk_prices": ",".join(
            [partial, SHAPES.format(thresholds="100000"), PIECES, PIECE_CHUNKS]) + """
SELECT session_id, threshold, chunk_idx, ROUND(height + 3.1e-11, 9) AS height, ROUND(calls + 3.1e-11, 9) AS calls,
       ROUND(cost + 3.1e-11, 9) AS cost, is_first FROM chunks""",
        "rates_by_agent_supplied": ",".join(
            [partial, SHAPES.format(thresholds="100000"), SPLITS]) + """
SELECT session_id, k AS n_chunks, ROUND(peak, 4) AS peak,
       ROUND(CAST(read_after AS DOUBLE), 4) AS cache_read_split,
       ROUND(split_cost, 4) AS split_cost, ROUND(oh_total, 4) AS oh_total,
       ROUND(oh_gen, 4) AS oh_gen, ROUND(oh_write, 4) AS oh_write,
       ROUND(oh_reread, 4) AS oh_reread, ROUND(saved, 4) AS saved, peak > 0 AS heights_ok
FROM splits WHERE alpha = 0.1e0""",
        "supplied_piece_prices": SUPPLIED_PIECES + """
SELECT session_id, 400::BIGINT AS threshold, CAST(idx AS BIGINT) AS chunk_idx,
       ROUND(height + 3.1e-11, 9) AS height,
       ROUND(calls + 3.1e-11, 9) AS calls, ROUND(cost + 3.1e-11, 9) AS cost, is_first FROM piece_costs""",
        "supplied_distribution": SUPPLIED_PIECES + """,
placed AS (SELECT *, ROW_NUMBER() OVER (ORDER BY cost) - 1 AS place, COUNT(*) OVER () AS every
           FROM piece_costs)
SELECT 400::BIGINT AS threshold, COUNT(*) AS n_chunks, ROUND(AVG(cost) + 3.1e-11, 9) AS mean_cost,
       ROUND(MAX(cost) FILTER (place = LEAST(every - 1, FLOOR(0.1e0 * every))) + 3.1e-11, 9) AS p10,
       ROUND(MAX(cost) FILTER (place = LEAST(every - 1, FLOOR(0.5e0 * every))) + 3.1e-11, 9) AS p50,
       ROUND(MAX(cost) FILTER (place = LEAST(every - 1, FLOOR(0.9e0 * every))) + 3.1e-11, 9) AS p90,
       ROUND(MAX(cost) + 3.1e-11, 9) AS max_cost, ROUND(AVG(calls) + 3.1e-11, 9) AS mean_calls
FROM placed""",
        "supplied_chunks_parts": SUPPLIED_PIECES + """,
sums AS (
  SELECT session_id, COUNT(*) FILTER (splits) AS pieces, SUM(own) AS base, ANY_VALUE(fc) AS fc,
         SUM(CASE WHEN is_first THEN 0e0 ELSE GREATEST(calls - 1, 0) END) AS again,
         ANY_VALUE(peak) AS peak, ANY_VALUE(splits) AS splits, ANY_VALUE(cr) AS cr,
         SUM(calls * height / 2e0) AS read_pieces
  FROM piece_costs GROUP BY session_id),
priced AS (
  SELECT *, GREATEST(pieces, 1) AS n_chunks, alpha * threshold * again * 0.475e0 / 1e6 AS oh_reread,
         alpha * threshold * (GREATEST(pieces, 1) - 1) * 23.75e0 / 1e6 AS oh_gen,
         alpha * threshold * (GREATEST(pieces, 1) - 1) * 5.9375e0 / 1e6 AS oh_write
  FROM sums, (SELECT UNNEST([200, 400]::BIGINT[]) AS threshold),
       (SELECT UNNEST([0.05e0, 0.1e0]) AS alpha))
SELECT session_id, threshold, alpha, n_chunks, ROUND(CASE WHEN splits THEN peak END + 3.1e-11, 9) AS peak,
       ROUND(CASE WHEN splits THEN read_pieces ELSE cr END + 3.1e-11, 9) AS cache_read_split,
       ROUND(base + oh_gen + oh_write + oh_reread + 3.1e-11, 9) AS split_cost,
       ROUND(oh_gen + oh_write + oh_reread + 3.1e-11, 9) AS oh_total, ROUND(oh_gen + 3.1e-11, 9) AS oh_gen,
       ROUND(oh_write + 3.1e-11, 9) AS oh_write, ROUND(oh_reread + 3.1e-11, 9) AS oh_reread,
       ROUND(fc - base - oh_gen - oh_write - oh_reread + 3.1e-11, 9) AS saved
FROM priced""",
        "split_grid": ONE_RATE_GRID + SPLIT_GRID.format(gen="oh_gen", wri="oh_write"),
        "savings_table": ONE_RATE_GRID + """
SELECT alpha, threshold, ROUND(saved, 4) AS saved,
       ROUND(saved / n_sessions, 4) AS saved_per_session, ROUND(saved_pct, 4) AS saved_pct,
       ROUND(oh_total, 4) AS oh_total, ROUND(avg_chunks, 4) AS avg_chunks
FROM grid WHERE threshold IN (100000, 150000) ORDER BY alpha, threshold""",
        "overhead_breakdown": ONE_RATE_GRID + """
SELECT threshold, ROUND(oh_total, 4) AS oh_total, oh_gen, oh_write,
       ROUND(oh_reread, 4) AS oh_reread
FROM grid WHERE threshold IN (100000, 150000) AND alpha = 0.1e0 ORDER BY threshold""",
        "threshold_sweep": ONE_RATE_GRID + """
SELECT threshold,
       ROUND(MAX(saved_pct) FILTER (alpha = 0.05e0), 4) AS saved_pct_a05,
       ROUND(MAX(saved_pct) FILTER (alpha = 0.1e0), 4) AS saved_pct_a10,
       ROUND(MAX(saved_pct) FILTER (alpha = 0.15e0), 4) AS saved_pct_a15,
       ROUND(MAX(saved_pct) FILTER (alpha = 0.2e0), 4) AS saved_pct_a20,
       ROUND(MAX(avg_chunks), 4) AS avg_chunks
FROM grid GROUP BY threshold ORDER BY threshold""",
        "best_threshold": ONE_RATE_GRID + """
SELECT alpha, threshold, ROUND(saved, 4) AS saved,
       ROUND(saved / n_sessions, 4) AS saved_per_session, ROUND(saved_pct, 4) AS saved_pct
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY alpha ORDER BY saved DESC, threshold) AS place
      FROM grid)
WHERE place = 1 ORDER BY alpha""",
        "chunk_prices": PIECE_ROWS + """
SELECT session_id, threshold, chunk_idx, height, calls, cost, is_first FROM chunks""",
        "chunk_prices_compact": PIECE_ROWS + """
SELECT session_id, threshold, MIN(chunk_idx) AS chunk_idx, ANY_VALUE(height) AS height,
       ANY_VALUE(calls) AS calls, ANY_VALUE(cost) AS cost, is_first, COUNT(*) AS multiplicity
FROM chunks
GROUP BY session_id, threshold, is_first, chunk_idx = k - 1""",
        "chunk_distribution": PIECE_ROWS + """,
placed AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY threshold ORDER BY cost) - 1 AS place,
         COUNT(*) OVER (PARTITION BY threshold) AS n
  FROM chunks)
SELECT threshold, COUNT(*) AS n_chunks, ROUND(AVG(cost), 4) AS mean_cost,
       MAX(cost) FILTER (place = LEAST(n - 1, FLOOR(0.1e0 * n))) AS p10,
       MAX(cost) FILTER (place = LEAST(n - 1, FLOOR(0.5e0 * n))) AS p50,
       MAX(cost) FILTER (place = LEAST(n - 1, FLOOR(0.9e0 * n))) AS p90,
       MAX(cost) AS max_cost, ROUND(AVG(calls), 4) AS mean_calls
FROM placed GROUP BY threshold""",
        "supplied_chunks_ramp": TURNS.format(possible="cr > 0", peak="(2e0 * cr / NULLIF(n, 0))"),
        "supplied_chunks_stored": TURNS.format(possible="cr > 0", peak="(2e0 * cr / NULLIF(n, 0))"),
        "sketched_distribution": PIECE_ROWS + SKETCHED,
        "supplied_chunks_heights": TURNS.format(possible="TRUE", peak="h.total"),
        "supplied_chunks_uniform": ",".join(
            [costed, SHAPES.format(thresholds="100000"), SPLITS]) + """
SELECT session_id, k AS n_chunks, ROUND(peak, 4) AS peak,
       ROUND(CAST(read_after AS DOUBLE), 4) AS cache_read_split,
       ROUND(split_cost, 4) AS split_cost, ROUND(oh_total, 4) AS oh_total,
       ROUND(saved, 4) AS saved, peak > 0 AS heights_ok
FROM splits WHERE alpha = 0.1e0""",
        "sessions_from_calls": SESSIONS_FROM_CALLS,
        "session_runs_from_calls": SESSION_RUNS,
        "turn_replies": TURN_REPLIES,
        "session_time": SESSION_TIME,
        "detector_curve": DETECTOR + "SELECT * FROM curve",
        "detector_summary": DETECTOR_SUMMARY,
        "piece_ranks": PIECE_ROWS + PIECE_RANKS.format(
            row="chunk_idx, height, calls, cost, is_first", rows="placed"),
        "piece_ranks_compact": PIECE_ROWS + PIECE_RANKS.format(
            row="chunk_idx, height, calls, cost, is_first, multiplicity", rows="""(
  SELECT session_id, threshold, MIN(chunk_idx) AS chunk_idx, ANY_VALUE(height) AS height,
         ANY_VALUE(calls) AS calls, ANY_VALUE(cost) AS cost, is_first, COUNT(*) AS multiplicity,
         MIN(rank) AS rank, ANY_VALUE(n_chunks) AS n_chunks
  FROM placed GROUP BY session_id, threshold, is_first, chunk_idx = k - 1)"""),
        "rates_by_agent_session_cost": costed_by_agent + session_cost,
        "rates_by_agent_split_grid": BY_AGENT_GRID + SPLIT_GRID.format(
            gen="ROUND(oh_gen, 4)", wri="ROUND(oh_write, 4)"),
    }
