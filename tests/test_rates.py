"""One rate card, another card, and a table of rates."""

import pytest
from pyspark.sql import functions as F

import tokentariff as tt
from tokentariff.functions import pricing

COLUMNS = ["agent", *tt.RateCard._fields]


def _rows(frame, *keys):
    return [tuple(r) for r in frame.orderBy(*keys).collect()]


def test_other_card(make_sessions):
    frame, _ = make_sessions([(1_000_000, 1_000_000, 1_000_000, 1_000_000, 10)])
    row = tt.session_cost(frame, tt.RateCard(2.0, 7.0, 1.5, 0.5)).first()
    assert [row[c] for c in ("input_cost", "output_cost", "cache_write_cost", "cache_read_cost",
                             "full_cost")] == pytest.approx([2.0, 7.0, 3.0, 1.0, 13.0])


@pytest.mark.parametrize("limit", [pricing.BROADCAST_ROWS, 0])
def test_table_of_default_rates_changes_nothing(spark, random_sessions, monkeypatch, limit):
    """Broadcast, and shuffled with salt where the table is over the limit."""
    monkeypatch.setattr(pricing, "BROADCAST_ROWS", limit)
    frame, _ = random_sessions
    rates = spark.createDataFrame([("Claude Code", *tt.DEFAULT_RATES), ("x", 1.0, 1.0, 1.0, 1.0)],
                                  COLUMNS)
    pieces = tt.chunk_prices(frame, 100_000).select("session_id", "chunk_idx", "height")
    jobs = {
        "cost": (lambda **k: tt.session_cost(frame, **k), ["session_id"]),
        "grid": (lambda **k: tt.split_grid(frame, **k), ["threshold", "alpha"]),
        "split": (lambda **k: tt.session_split(frame, [100_000], [0.1], **k), ["session_id"]),
        "pieces": (lambda **k: tt.chunk_prices(frame, 100_000, **k), ["session_id", "chunk_idx"]),
        "supplied": (lambda **k: tt.price_supplied_chunks(frame, pieces, 400, 0.1, **k),
                     ["session_id"]),
    }
    for name, (job, keys) in jobs.items():
        by_table, by_card = job(rates=rates), job()
        assert by_table.columns == by_card.columns, name
        for got, want in zip(_rows(by_table, *keys), _rows(by_card, *keys), strict=True):
            for g, w in zip(got, want):
                assert g == w or g == pytest.approx(w, rel=1e-9, abs=1e-9), name


@pytest.mark.parametrize("limit", [pricing.BROADCAST_ROWS, 0])
def test_each_row_gets_its_own_rates(spark, monkeypatch, limit):
    monkeypatch.setattr(pricing, "BROADCAST_ROWS", limit)
    rows = [(i, agent, 1_000_000, 0, 0, 0, 1) for i, agent in enumerate(["a", "b", "none", "a"])]
    frame = spark.createDataFrame(rows, tt.sources.SESSION_SCHEMA)
    rates = spark.createDataFrame([("a", 1.0, 9.0, 1.0, 1.0), ("b", 2.0, 9.0, 1.0, 1.0)], COLUMNS)
    got = tt.session_cost(frame, rates).orderBy("session_id")
    assert [r["full_cost"] for r in got.collect()] == pytest.approx([1.0, 2.0, 4.75, 1.0])


def test_any_session_column_can_be_the_key(spark, random_sessions):
    frame, rows = random_sessions
    rates = spark.createDataFrame([(3, 1.0, 2.0, 1.0, 1.0)], ["session_id", *tt.RateCard._fields])
    got = {r["session_id"]: r for r in tt.session_cost(frame, rates).collect()}
    assert got[3]["output_cost"] == pytest.approx(rows[3]["output_tokens"] * 2e-6)
    assert got[4]["output_cost"] == pytest.approx(rows[4]["output_tokens"] * 23.75e-6)
    with pytest.raises(ValueError):
        tt.session_cost(frame, rates.withColumnRenamed("session_id", "model"))


def test_null_field_takes_its_default(spark, make_sessions):
    frame, _ = make_sessions([(0, 0, 1_000_000, 0, 10)], agent="a")
    rates = spark.createDataFrame([("a", 3.0, 9.0, None, 0.5)], "agent string, " + ", ".join(
        f"{name} double" for name in tt.RateCard._fields))
    assert tt.session_cost(frame, rates).first()["cache_write_cost"] == pytest.approx(3.75)
    assert tt.RateCard(input_usd_per_mtok=3).cache_read_factor == 0.10


def test_table_by_session_ships_each_rate_once(spark, make_sessions, monkeypatch):
    monkeypatch.setattr(pricing, "BROADCAST_ROWS", 0)
    frame, _ = make_sessions([(i, 0, 0, 0, 1) for i in range(500)])
    rates = frame.select("session_id", *[F.lit(float(i + 1)).alias(name) for i, name in
                                         enumerate(tt.RateCard._fields)])
    costed = tt.session_cost(frame, rates)
    assert costed.count() == 500
    plan = costed._jdf.queryExecution().toString()
    assert "Generate" not in plan and "SortMergeJoin" in plan


def test_repeated_key_is_refused(spark, random_sessions):
    rates = spark.createDataFrame([("a", 1.0, 1.0, 1.0, 1.0)] * 2, COLUMNS)
    with pytest.raises(ValueError):
        tt.session_cost(random_sessions[0], rates)
