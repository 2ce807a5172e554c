"""Price language-model sessions as they were, and as they would be in smaller pieces."""

from .defaults import DEFAULT_RATES, RateCard
from .operators import (best_threshold, chunk_distribution, chunk_prices, corpus_baseline,
                        detector_curve, detector_summary, expand_pieces, interval_runs,
                        merge_sketches, overhead_breakdown, piece_ranks, price_sketches,
                        price_supplied_chunks, savings_table, session_cost, session_split,
                        session_time, sessions_from_calls, sketch_percentiles, split_grid,
                        stored_pieces, supplied_piece_prices, threshold_sweep, turn_replies)
from .plans import Study, run_study
from .sources import load_sessions, select_sessions, staged
from .streaming import stream_distribution, stream_sessions, stream_sessions_from_calls

__all__ = ["DEFAULT_RATES", "RateCard", "Study", "best_threshold", "chunk_distribution",
           "chunk_prices", "corpus_baseline", "detector_curve", "detector_summary",
           "expand_pieces", "interval_runs", "load_sessions", "merge_sketches",
           "overhead_breakdown", "piece_ranks", "price_sketches", "price_supplied_chunks",
           "run_study", "savings_table", "select_sessions", "session_cost", "session_split",
           "session_time", "sessions_from_calls", "sketch_percentiles", "split_grid", "staged",
           "stored_pieces", "stream_distribution", "stream_sessions", "stream_sessions_from_calls",
           "supplied_piece_prices", "threshold_sweep", "turn_replies"]
