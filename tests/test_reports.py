"""Reports on a hand-made grid, and the whole study."""

import pytest

import tokentariff as tt
from tokentariff.operators.reports import alpha_column
from tests.conftest import DATA
from tokentariff.sources.samples import order_sessions


def _grid(spark, rows):
    full = [(t, a, 10, 1000.0, 1000.0 - s, s, 5.0, 3.0, 1.0, 1.0, 4, 2.0, s / 10)
            for t, a, s in rows]
    return spark.createDataFrame(
        full, "threshold long, alpha double, n_sessions long, full_cost double, split_cost double,"
              "saved double, oh_total double, oh_gen double, oh_write double, oh_reread double,"
              "n_split long, avg_chunks double, saved_pct double")


def test_best_threshold_takes_the_smallest_on_a_tie(spark):
    grid = _grid(spark, [(100_000, 0.1, 7.0), (110_000, 0.1, 9.0), (120_000, 0.1, 9.0),
                         (100_000, 0.2, -3.0), (110_000, 0.2, -2.0), (90_000, 0.2, 50.0)])
    got = [tuple(r) for r in tt.best_threshold(grid).collect()]
    assert got == [(0.1, 110_000, 9.0, 0.9, 0.9), (0.2, 110_000, -2.0, -0.2, -0.2)]


def test_sweep_matrix(spark):
    grid = _grid(spark, [(110_000, 0.1, 1.0), (100_000, 0.05, 2.0), (100_000, 0.1, 3.0),
                         (110_000, 0.05, 4.0), (95_000, 0.1, 5.0)])
    matrix = tt.threshold_sweep(grid, alphas=[0.05, 0.1])
    assert matrix.columns == ["threshold", "saved_pct_a05", "saved_pct_a10", "avg_chunks"]
    assert [tuple(r) for r in matrix.collect()] == [
        (100_000, 0.2, 0.3, 2.0), (110_000, 0.4, 0.1, 2.0)]


def test_alpha_column():
    names = [alpha_column(a) for a in (0.05, 0.1, 0.15, 0.125, 1.0)]
    assert names == ["saved_pct_a05", "saved_pct_a10", "saved_pct_a15", "saved_pct_a12_5",
                     "saved_pct_a100"]


def test_savings_and_overhead(spark):
    grid = _grid(spark, [(150_000, 0.1, 2.0), (100_000, 0.1, 4.0), (110_000, 0.1, 3.0),
                         (100_000, 0.05, 5.0)])
    assert [tuple(r) for r in tt.savings_table(grid).collect()] == [
        (0.05, 100_000, 5.0, 0.5, 0.5, 5.0, 2.0), (0.1, 100_000, 4.0, 0.4, 0.4, 5.0, 2.0),
        (0.1, 150_000, 2.0, 0.2, 0.2, 5.0, 2.0)]
    assert [tuple(r) for r in tt.overhead_breakdown(grid).collect()] == [
        (100_000, 5.0, 3.0, 1.0, 1.0), (150_000, 5.0, 3.0, 1.0, 1.0)]


def test_empty_corpus_gives_null_ratios(spark):
    empty = spark.createDataFrame([], tt.sources.SESSION_SCHEMA)
    row = tt.corpus_baseline(tt.session_cost(empty)).first()
    assert tuple(row) == (0, 0.0, None, 0.0, None, None)
    assert tt.split_grid(empty).count() == 0


def test_study(spark):
    sessions = tt.select_sessions(order_sessions(spark, f"{DATA}/sf0.001"))
    study = tt.run_study(sessions)
    assert study.baseline.first()["n_sessions"] == 900
    sizes = [f.count() for f in (study.grid, study.savings, study.overhead, study.sweep,
                                 study.best, study.distribution)]
    assert sizes == [24, 8, 2, 6, 4, 2]
    total = study.distribution.orderBy("threshold").first()
    cell = study.grid.where("threshold = 100000 AND alpha = 0.1").first()
    assert total["mean_cost"] * total["n_chunks"] == pytest.approx(cell["split_cost"])
    study.grid.unpersist()


def test_command_line(spark, tmp_path, capsys):
    from tokentariff.__main__ import main
    source = str(tmp_path / "sessions.parquet")
    order_sessions(spark, f"{DATA}/sf0.001").write.parquet(source)
    main([source, "--out", str(tmp_path / "out"), "--alphas", "0.05", "0.2"])
    assert spark.read.parquet(str(tmp_path / "out" / "savings")).count() == 4
    assert spark.read.parquet(str(tmp_path / "out" / "overhead")).count() == 2
    main([source, "--thresholds", "100000", "--sweep", "100000", "120000"])
    assert "saved_pct_a20" in capsys.readouterr().out
