"""Per-session jobs against hand-worked rows and the plain Python model."""

import math
from collections import defaultdict

import pytest

import tokentariff as tt
from tests import brute

T = 100_000
close = lambda x: pytest.approx(x, rel=1e-10, abs=1e-12)

# input, output, written, read, calls -> pieces, heights, calls per piece
HAND = [
    ((0, 0, 0, 500_000, 10), 1, [100_000], [10]),
    ((0, 0, 0, 1_000_000, 10), 2, [100_000, 100_000], [5, 5]),
    ((0, 0, 0, 750_000, 10), 2, [100_000, 50_000], [20 / 3, 10 / 3]),
    ((100, 100, 100, 0, 10), 1, [None], [10]),
    ((100, 100, 100, 500, 0), 1, [None], [0]),
    ((0, 0, 0, 400_000, 1), 8, [100_000] * 8, [0.125] * 8),
    ((0, 0, 0, 0, 0), 1, [None], [0]),
]


def test_hand_rows(make_sessions):
    frame, _ = make_sessions([row for row, *_ in HAND])
    got = defaultdict(list)
    for r in tt.chunk_prices(frame, T, 0.10).orderBy("session_id", "chunk_idx").collect():
        got[r["session_id"]].append(r)
    for i, (_, k, heights, calls) in enumerate(HAND):
        assert [r["chunk_idx"] for r in got[i]] == list(range(k))
        assert [r["height"] for r in got[i]] == (heights if heights == [None] else close(heights))
        assert [r["calls"] for r in got[i]] == close(calls)
        assert [r["is_first"] for r in got[i]] == [j == 0 for j in range(k)]


def test_hand_split(make_sessions):
    frame, _ = make_sessions([row for row, *_ in HAND])
    rows = tt.session_split(frame, [T], [0.10]).orderBy("session_id").collect()
    assert [r["k"] for r in rows] == [k for _, k, *_ in HAND]
    assert [r["peak"] for r in rows] == [100_000, 200_000, 150_000, None, None, 800_000, None]
    s = 10_000
    assert rows[0]["saved"] == 0 and rows[0]["oh_total"] == 0
    assert rows[1]["oh_gen"] == close(s * 23.75e-6)
    assert rows[1]["oh_write"] == close(s * 4.75e-6 * 1.25)
    assert rows[1]["oh_reread"] == close(4 * s * 4.75e-7)
    assert rows[1]["split_cost"] - rows[1]["oh_total"] == close(500_000 * 4.75e-7)
    assert rows[2]["split_cost"] - rows[2]["oh_total"] == close(1_250_000 / 3 * 4.75e-7)
    assert rows[5]["oh_reread"] == 0
    assert rows[6]["split_cost"] == 0


def test_null_counts_are_zero(spark):
    raw = spark.createDataFrame(
        [(1, "Claude Code", None, None, None, None, None)], tt.sources.SESSION_SCHEMA)
    sessions = tt.select_sessions(raw)
    assert tt.session_cost(sessions).first()["full_cost"] == 0
    grid = tt.split_grid(sessions, [T], [0.1]).first()
    assert (grid["n_sessions"], grid["avg_chunks"], grid["saved_pct"]) == (1, 1.0, None)


def test_split_against_python(random_sessions):
    frame, rows = random_sessions
    for r in tt.session_split(frame, [T, 150_000], [0.05, 0.2]).collect():
        s = rows[r["session_id"]]
        want = brute.split(s, r["threshold"], r["alpha"])
        assert r["k"] == want["k"]
        assert r["split_cost"] == close(want["split_cost"])
        assert (r["oh_gen"], r["oh_write"], r["oh_reread"]) == close(want["oh"])
        assert r["saved"] == pytest.approx(brute.bill(s) - want["split_cost"], abs=1e-9)


def test_pieces_against_python(random_sessions):
    frame, rows = random_sessions
    got = defaultdict(list)
    pieces = tt.chunk_prices(frame, [T, 150_000], 0.1).orderBy("chunk_idx").collect()
    for r in pieces:
        got[r["session_id"], r["threshold"]].append((r["cost"], r["calls"], r["height"]))
    assert len(got) == 2 * len(rows)
    for (session, threshold), pieces in got.items():
        want = brute.pieces(rows[session], threshold, 0.1)
        assert len(pieces) == len(want)
        for g, w in zip(pieces, want):
            assert g[:2] == close(w[:2]) and (g[2] == w[2] or g[2] == close(w[2]))


def test_grid_is_the_sum_of_sessions_and_of_pieces(random_sessions):
    frame, rows = random_sessions
    detail = defaultdict(float)
    for r in tt.session_split(frame, [T, 150_000], [0.1]).collect():
        detail[r["threshold"]] += r["split_cost"]
    pieces = defaultdict(float)
    for r in tt.chunk_prices(frame, [T, 150_000], 0.1, compact=True).collect():
        pieces[r["threshold"]] += r["cost"] * r["multiplicity"]
    for r in tt.split_grid(frame, [T, 150_000], [0.1]).collect():
        assert r["split_cost"] == close(detail[r["threshold"]])
        assert r["split_cost"] == close(pieces[r["threshold"]])
        assert r["n_sessions"] == len(rows)
        assert r["n_split"] == sum(brute.split(s, r["threshold"], 0.1)["k"] > 1 for s in rows)


def test_heights_and_calls_add_up(random_sessions):
    frame, rows = random_sessions
    total = defaultdict(lambda: [0.0, 0.0])
    for r in tt.chunk_prices(frame, T, 0.1, compact=True).collect():
        total[r["session_id"]][0] += (r["height"] or 0.0) * r["multiplicity"]
        total[r["session_id"]][1] += r["calls"] * r["multiplicity"]
    for i, s in enumerate(rows):
        assert total[i] == close([brute.peak(s) or 0.0, s["api_call_count"]])


def test_overhead_is_linear_in_alpha(random_sessions):
    grid = tt.split_grid(random_sessions[0], [T], [0.05, 0.1, 0.2]).orderBy("alpha").collect()
    assert grid[1]["oh_total"] == close(2 * grid[0]["oh_total"])
    assert grid[2]["saved"] + grid[2]["oh_total"] == close(grid[0]["saved"] + grid[0]["oh_total"])


def test_compact_form_expands(make_sessions):
    """A session of very many pieces is produced in runs, and each piece comes out once."""
    frame, rows = make_sessions([(10, 10, 10, 50_000_000, 1), (0, 0, 0, 750_000, 10)])
    compact = tt.chunk_prices(frame, T, 0.1, compact=True)
    assert compact.count() == 3 + 2
    whole = tt.expand_pieces(compact, run=64).orderBy("session_id", "chunk_idx").collect()
    assert [r["chunk_idx"] for r in whole] == [*range(1000), 0, 1]
    assert math.fsum(r["cost"] for r in whole[:1000]) == close(
        brute.split(rows[0], T, 0.1)["split_cost"])


def test_threshold_equal_to_peak_stays_whole_and_bad_thresholds_are_refused(make_sessions):
    frame, _ = make_sessions([(0, 0, 0, 500_000, 10)])
    ks = {r["threshold"]: r["k"] for r in tt.session_split(frame, [100_000, 99_999.5], [0.1]).collect()}
    assert ks == {100_000: 1, 99_999.5: 2}
    for bad in ([0], [-5], []):
        with pytest.raises(ValueError):
            tt.chunk_prices(frame, bad, 0.1)
        with pytest.raises(ValueError):
            tt.split_grid(frame, bad)
