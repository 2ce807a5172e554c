"""Supplied pieces against the Python recipe and against the uniform cut."""

import random

import pytest

import tokentariff as tt
from tests import brute
from tokentariff.operators import supplied

PIECES = "session_id long, chunk_idx long, height double"
close = lambda x: pytest.approx(x, rel=1e-9, abs=1e-12)


def _want(s, heights, mode, summary):
    total = sum(heights)
    top = brute.peak(s) if mode == "ramp" else total
    if s["api_call_count"] <= 0 or total <= 0 or (mode == "ramp" and top is None):
        return 1, brute.bill(s), 0.0
    scaled = [h * top / total for h in heights]
    return (len(heights), *brute.price_pieces(s, scaled, top, summary))


@pytest.mark.parametrize("mode", ["ramp", "heights"])
@pytest.mark.parametrize("block,blocks", [(supplied.BLOCK, supplied.BLOCKS), (3, 4)])
def test_against_python(spark, random_sessions, monkeypatch, mode, block, blocks):
    """Also with tiny blocks, so that every session is spread over several groups."""
    monkeypatch.setattr(supplied, "BLOCK", block)
    monkeypatch.setattr(supplied, "BLOCKS", blocks)
    frame, sessions = random_sessions
    rng = random.Random(11)
    heights = {s["session_id"]: [float(rng.choice([0, 1, 700, rng.randrange(90_000)]))
                                 for _ in range(rng.choice([1, 2, 3, 40]))]
               for s in sessions if s["session_id"] % 7}
    # Numbers need not start at zero or be dense, only ascend.
    rows = [(i, 5 + 2 * j, h) for i, hs in heights.items() for j, h in enumerate(hs)]
    chunks = spark.createDataFrame(rows, PIECES).repartition(5)
    got = tt.price_supplied_chunks(frame, chunks, 400, 0.1, peak_mode=mode).collect()
    assert sorted(r["session_id"] for r in got) == list(range(len(sessions)))
    for r in got:
        s = sessions[r["session_id"]]
        n, cost, oh = _want(s, heights.get(r["session_id"], []), mode, 40.0)
        assert (r["n_chunks"], r["split_cost"], r["oh_total"]) == (n, close(cost), close(oh))
        assert r["saved"] == pytest.approx(brute.bill(s) - cost, abs=1e-9)


def test_uniform_heights_equal_the_cut(spark, random_sessions):
    frame, _ = random_sessions
    cut = tt.chunk_prices(frame, 100_000).select("session_id", "chunk_idx", "height")
    want = {r["session_id"]: r for r in tt.session_split(frame, [100_000], [0.1]).collect()}
    for r in tt.price_supplied_chunks(frame, cut, 100_000, 0.1).collect():
        w = want[r["session_id"]]
        assert (r["n_chunks"], r["split_cost"], r["oh_total"]) == (
            w["k"], close(w["split_cost"]), close(w["oh_total"]))
        assert r["heights_ok"] is (None if w["peak"] is None else True)


def test_one_piece_is_the_bill_and_bad_heights_are_flagged(spark, make_sessions):
    frame, rows = make_sessions([(10, 20, 30, 500_000, 10)] * 3 + [(10, 20, 30, 0, 0)])
    chunks = spark.createDataFrame([(0, 0, 100_000.0), (1, 0, 40_000.0), (3, 0, 5.0)], PIECES)
    got = tt.price_supplied_chunks(frame, chunks, 400, 0.1).orderBy("session_id").collect()
    assert [r["split_cost"] for r in got] == close([brute.bill(s) for s in rows])
    assert [r["heights_ok"] for r in got] == [True, False, None, None]
    assert [r["n_chunks"] for r in got] == [1, 1, 1, 1]
    with pytest.raises(ValueError):
        tt.price_supplied_chunks(frame, chunks, 400, 0.1, peak_mode="other")


def test_no_session_vanishes(spark):
    """Null and repeated ids give a row each; repeated ones are told apart by their counts."""
    sessions = spark.createDataFrame(
        [(None, "a", 1, 2, 3, 500, 5), (None, "a", 9, 2, 3, 500, 5), (7, "a", 1, 2, 3, 400, 4),
         (7, "a", 1, 2, 3, 800, 2)], tt.sources.SESSION_SCHEMA)
    chunks = spark.createDataFrame([(7, 0, 50.0), (7, 1, 150.0), (None, 0, 1.0)], PIECES)
    got = tt.price_supplied_chunks(sessions, chunks, 400, 0.1).collect()
    assert len(got) == 4
    assert sorted(r["n_chunks"] for r in got) == [1, 1, 2, 2]
    assert len({r["split_cost"] for r in got}) == 4
    for r, calls in zip(sorted((r for r in got if r["session_id"] == 7),
                               key=lambda r: r["peak"]), (4, 2)):
        assert r["oh_reread"] == close(40.0 * brute.READ * max(calls * 150 / 200 - 1, 0))


def test_piece_without_a_number_keeps_the_bill(spark, make_sessions):
    frame, rows = make_sessions([(10, 20, 30, 500_000, 10)] * 2)
    chunks = spark.createDataFrame(
        [(0, 0, 50_000.0), (0, None, 50_000.0), (1, 0, 50_000.0), (1, 1, 50_000.0)], PIECES)
    got = tt.price_supplied_chunks(frame, chunks, 400, 0.1).orderBy("session_id").collect()
    assert [(r["n_chunks"], r["heights_ok"]) for r in got] == [(1, False), (2, True)]
    assert got[0]["split_cost"] == close(brute.bill(rows[0]))


def test_several_thresholds_and_alphas_in_one_call(spark, random_sessions):
    frame, _ = random_sessions
    cut = tt.chunk_prices(frame, 100_000).select("session_id", "chunk_idx", "height")
    got = {(r["session_id"], r["threshold"], r["alpha"]): r for r in tt.price_supplied_chunks(
        frame, cut, [200, 400], [0.05, 0.1]).collect()}
    assert len(got) == 4 * 400
    for r in tt.price_supplied_chunks(frame, cut, 400, 0.05).collect():
        same = got[r["session_id"], 400, 0.05]
        for name in ("split_cost", "oh_gen", "oh_write", "oh_reread", "saved"):
            assert same[name] == close(r[name])
        assert r["oh_total"] == close(r["oh_gen"] + r["oh_write"] + r["oh_reread"])


def test_piece_prices_add_up_and_match_the_cut(spark, random_sessions):
    frame, _ = random_sessions
    own = tt.chunk_prices(frame, 100_000, 0.1).orderBy("session_id", "chunk_idx").collect()
    cut = tt.chunk_prices(frame, 100_000).select("session_id", "chunk_idx", "height")
    priced = tt.supplied_piece_prices(frame, cut, 100_000, 0.1)
    assert priced.columns == tt.chunk_prices(frame, 100_000).columns
    for g, w in zip(priced.orderBy("session_id", "chunk_idx").collect(), own, strict=True):
        assert (g["chunk_idx"], g["is_first"]) == (w["chunk_idx"], w["is_first"])
        assert (g["calls"], g["cost"]) == (close(w["calls"]), close(w["cost"]))
    sums = {r["session_id"]: r["cost"] for r in
            priced.groupBy("session_id").sum("cost").toDF("session_id", "cost").collect()}
    for r in tt.price_supplied_chunks(frame, cut, 100_000, 0.1).collect():
        assert sums[r["session_id"]] == close(r["split_cost"])


def test_pieces_are_shuffled_once(spark, random_sessions, tmp_path):
    frame, _ = random_sessions
    path = str(tmp_path / "pieces")
    tt.chunk_prices(frame, 100_000).select("session_id", "chunk_idx", "height").write.parquet(path)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        priced = tt.price_supplied_chunks(frame, spark.read.parquet(path), 100_000, 0.1)
        priced.collect()
        plan = priced._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("FileScan parquet") == 1
    assert plan.count("ReusedExchange") >= 1
