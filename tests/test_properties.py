"""Random sessions against the plain Python model."""

from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import tokentariff as tt
from tests import brute

count = st.integers(0, 10_000_000)
rows = st.lists(st.tuples(count, count, count, st.integers(0, 50_000_000), st.integers(0, 500)),
                min_size=1, max_size=40)
threshold = st.integers(5_000, 400_000)
alpha = st.floats(0.0, 1.0)
close = lambda x: pytest.approx(x, rel=1e-9, abs=1e-9)


@settings(max_examples=12, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=rows, threshold=threshold, alpha=alpha)
def test_totals_and_pieces(make_sessions, rows, threshold, alpha):
    frame, sessions = make_sessions(rows)
    want = [brute.split(s, threshold, alpha) for s in sessions]
    cell = tt.split_grid(frame, [threshold], [alpha]).first()
    assert cell["split_cost"] == close(sum(w["split_cost"] for w in want))
    assert cell["oh_total"] == close(sum(sum(w["oh"]) for w in want))
    assert cell["avg_chunks"] == close(sum(w["k"] for w in want) / len(want))
    assert cell["full_cost"] == close(sum(map(brute.bill, sessions)))

    by_session = defaultdict(lambda: [0, 0.0])
    costs = []
    for r in tt.chunk_prices(frame, threshold, alpha, compact=True).collect():
        by_session[r["session_id"]][0] += r["multiplicity"]
        by_session[r["session_id"]][1] += r["multiplicity"] * r["cost"]
        costs += [r["cost"]] * r["multiplicity"]
    for i, w in enumerate(want):
        assert by_session[i] == close([w["k"], w["split_cost"]])

    spread = tt.chunk_distribution(tt.chunk_prices(frame, threshold, alpha, compact=True)).first()
    assert [spread["p10"], spread["p50"], spread["p90"], spread["max_cost"]] == [
        brute.at_rank(costs, 10), brute.at_rank(costs, 50), brute.at_rank(costs, 90), max(costs)]
