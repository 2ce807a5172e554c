"""The curve of a detector against labels, and the ranks of pieces, against plain Python."""

import random

import pytest

import tokentariff as tt

SCORED = "score double, label int"


def curve_of(rows):
    rows = [(s + 0.0, x) for s, x in rows if s is not None and s == s and x in (0, 1)]
    p, n = sum(x for _, x in rows), sum(1 - x for _, x in rows)
    out = []
    for t in sorted({s for s, _ in rows}, reverse=True):
        tp, fp = sum(x for s, x in rows if s >= t), sum(1 - x for s, x in rows if s >= t)
        out.append((t, sum(x for s, x in rows if s == t), sum(1 - x for s, x in rows if s == t), tp, fp,
                    p - tp, n - fp, tp / (tp + fp), tp / p if p else None, fp / n if n else None))
    return out


def some_scores():
    rng = random.Random(6)
    rows = [(rng.choice([round(rng.gauss(x, 1), 1), rng.gauss(x, 1)]), x)
            for x in rng.choices([0, 1], k=1_500)]
    return rows + [(None, 1), (float("nan"), 1), (0.5, None), (0.5, 7), (-0.0, 1), (0.0, 0),
                   (float("inf"), 0)] + [(0.25, i % 2) for i in range(400)]


def test_curve(spark):
    rows = some_scores()
    curve = tt.detector_curve(spark.createDataFrame(rows, SCORED).repartition(5))
    assert sorted(map(tuple, curve.collect()), reverse=True) == curve_of(rows)


def test_summary(spark):
    rows = some_scores()
    got = tt.detector_summary(tt.detector_curve(spark.createDataFrame(rows, SCORED))).first()
    good = [(s, x) for s, x in rows if s is not None and s == s and x in (0, 1)]
    ones, zeros = ([s for s, x in good if x == k] for k in (1, 0))
    pairs = sum((a > b) + (a == b) / 2 for a in ones for b in zeros)
    want = curve_of(rows)
    f1 = {r[0]: 2 * r[3] / (2 * r[3] + r[4] + r[5]) for r in want}
    best = max(f1, key=lambda t: (f1[t], t))
    assert (got.positives, got.negatives) == (len(ones), len(zeros))
    assert got.area == pytest.approx(pairs / len(ones) / len(zeros))
    assert got.average_precision == pytest.approx(sum(r[7] * r[1] for r in want) / len(ones))
    assert (got.best_threshold, got.best_f1) == (best, pytest.approx(f1[best]))


def test_one_kind_of_label_and_none(spark):
    curve = tt.detector_curve(spark.createDataFrame([(0.5, True), (0.25, True)],
                                                    "score double, label boolean"))
    assert sorted(map(tuple, curve.collect())) == curve_of([(0.5, 1), (0.25, 1)])[::-1]
    one = tt.detector_summary(curve).first()
    assert (one.positives, one.negatives, one.area) == (2, 0, None)
    nothing = tt.detector_curve(spark.createDataFrame([], SCORED))
    assert nothing.collect() == []
    assert tuple(tt.detector_summary(nothing).first()) == (0, 0, None, None, None, None)


def test_ranks_of_both_forms(spark, random_sessions):
    sessions, _ = random_sessions
    thresholds = [100_000, 150_000]
    compact = tt.piece_ranks(tt.chunk_prices(sessions, thresholds, compact=True)).collect()
    single = tt.piece_ranks(tt.chunk_prices(sessions, thresholds)).collect()
    found = {(r.threshold, r.session_id, r.chunk_idx): r.rank for r in single}
    assert len(found) == len(single)
    for r in compact:
        for i in range(r.multiplicity):
            assert found[r.threshold, r.session_id, r.chunk_idx + i] == r["rank"] + i
    for threshold in thresholds:
        mine = sorted((r for r in single if r.threshold == threshold), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(mine[0].n_chunks))
        assert [r.cost for r in mine] == sorted(r.cost for r in mine)
        assert [r.percentile for r in mine[:3]] == [100 * i / len(mine) for i in range(3)]


def test_ranks_agree_with_the_distribution(spark, random_sessions):
    """The piece at the percentile's rank has the percentile's price."""
    sessions, _ = random_sessions
    chunks = tt.chunk_prices(sessions, 100_000)
    summary = tt.chunk_distribution(chunks).first()
    by_rank = {r["rank"]: r.cost for r in tt.piece_ranks(chunks).collect()}
    n = len(by_rank)
    for p in (10, 50, 90):
        assert by_rank[min(n - 1, int(p / 100 * n))] == summary[f"p{p}"]


def test_ranks_use_no_single_partition(spark, random_sessions):
    ranked = tt.piece_ranks(tt.chunk_prices(random_sessions[0], 100_000, compact=True))
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
