from .billing import corpus_baseline, session_cost
from .calls import CALL_SCHEMA, sessions_from_calls
from .detector import detector_curve, detector_summary
from .distribution import chunk_distribution
from .intervals import interval_runs, session_time
from .pieces import chunk_prices, expand_pieces
from .ranks import piece_ranks
from .replies import turn_replies
from .reports import best_threshold, overhead_breakdown, savings_table, threshold_sweep
from .sketches import merge_sketches, price_sketches, sketch_percentiles
from .splitting import session_split, split_grid
from .supplied import price_supplied_chunks, stored_pieces, supplied_piece_prices

__all__ = ["CALL_SCHEMA", "best_threshold", "chunk_distribution", "chunk_prices", "corpus_baseline",
           "detector_curve", "detector_summary", "expand_pieces", "interval_runs",
           "merge_sketches", "overhead_breakdown", "piece_ranks", "price_sketches",
           "price_supplied_chunks", "savings_table", "session_cost", "session_split", "session_time",
           "sessions_from_calls", "sketch_percentiles", "split_grid", "stored_pieces",
           "supplied_piece_prices", "threshold_sweep", "turn_replies"]
