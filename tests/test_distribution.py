"""Exact ranks against a sort, on awkward distributions."""

import random

import pytest

import tokentariff as tt
from tests import brute
from tokentariff.operators import distribution

SCHEMA = "threshold long, cost double, calls double, multiplicity long"


def _cases():
    rng = random.Random(3)
    heavy = [0.25] * 3_000 + [rng.random() for _ in range(700)]
    return {
        "one": [1.5],
        "two": [2.0, 1.0],
        "even": [float(i) for i in range(10)],
        "ties": heavy,
        "zeros": [0.0] * 50 + [1e-9, 3.0],
        "signs": [rng.uniform(-5, 5) for _ in range(501)] + [0.0, 0.0],
        "magnitudes": [2.0 ** rng.uniform(-300, 300) for _ in range(800)],
        "neighbours": [1.0 + i * 2.0 ** -52 for i in range(300)],
    }


@pytest.mark.parametrize("bins,exact", [(distribution.RANGE_BINS, distribution.EXACT_ROWS),
                                        (4, 3), (2, 0)])
def test_ranks(spark, monkeypatch, bins, exact):
    """Also with few bins and no exact step, so that many passes are needed."""
    monkeypatch.setattr(distribution, "RANGE_BINS", bins)
    monkeypatch.setattr(distribution, "EXACT_ROWS", exact)
    names = list(_cases())
    if exact == 0:
        names = ["even", "zeros", "neighbours"]
    values = {i: _cases()[name] for i, name in enumerate(names)}
    rows = [(t, c, 2.0, 1) for t, costs in values.items() for c in costs]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = tt.chunk_distribution(frame, [0, 10, 50, 90, 100]).collect()
    assert [r["threshold"] for r in got] == list(values)
    for r in got:
        costs = values[r["threshold"]]
        for p in (0, 10, 50, 90, 100):
            assert r[f"p{p}"] == brute.at_rank(costs, p), (names[r["threshold"]], p)
        assert (r["n_chunks"], r["max_cost"], r["mean_calls"]) == (len(costs), max(costs), 2.0)
        assert r["mean_cost"] == pytest.approx(sum(costs) / len(costs))


def test_multiplicity_counts_as_repeats(spark):
    rng = random.Random(5)
    rows = [(1, rng.choice([0.1, 0.5, rng.random()]), rng.random(), rng.randrange(1, 9))
            for _ in range(500)]
    rows.append((1, 0.4321, 1.0, 4_000))
    frame = spark.createDataFrame(rows, SCHEMA)
    got = tt.chunk_distribution(frame).first()
    costs = [c for _, c, _, m in rows for _ in range(m)]
    assert [got["p10"], got["p50"], got["p90"]] == [brute.at_rank(costs, p) for p in (10, 50, 90)]
    assert got["n_chunks"] == len(costs)


def test_expanded_pieces_give_the_same(random_sessions):
    frame, _ = random_sessions
    compact = tt.chunk_distribution(tt.chunk_prices(frame, [100_000], compact=True)).first()
    whole = tt.chunk_distribution(tt.chunk_prices(frame, [100_000])).first()
    assert compact == pytest.approx(whole)


def test_no_pieces_no_rows(spark):
    assert tt.chunk_distribution(spark.createDataFrame([], SCHEMA)).collect() == []


def test_percentile_is_not_percentile_disc(spark):
    """With an even count the median is the upper of the two middle values."""
    frame = spark.createDataFrame([(1, float(i), 1.0, 1) for i in range(4)], SCHEMA)
    assert tt.chunk_distribution(frame).first()["p50"] == 2.0


@pytest.mark.parametrize("cost", ["rand(3) * rand(4)", "if(id % 50 = 0, rand(5), 0.25)"])
def test_few_passes_over_a_million_prices(spark, monkeypatch, cost):
    """Distinct prices, and mostly equal ones: the first pass, and two more at most."""
    passes = []
    narrow = distribution._next_pass
    monkeypatch.setattr(distribution, "_next_pass", lambda *a: passes.append(1) or narrow(*a))
    monkeypatch.setattr(distribution, "EXACT_ROWS", 1_000)  # as a larger table would need it
    frame = spark.range(1_000_000).selectExpr("1L AS threshold", f"{cost} AS cost", "1.0D AS calls")
    with tt.staged(frame) as prices:
        got = tt.chunk_distribution(prices).first()
        assert len(passes) <= 2
        assert got["p50"] == prices.selectExpr("sort_array(collect_list(cost))[500000]").first()[0]
