"""Whole-corpus results at fixed scales."""

import pytest

import tokentariff as tt
from tests.conftest import DATA
from tokentariff.sources.samples import order_sessions

BASELINE = {"0.001": (900, 4869.0329, 3541.2046), "0.01": (9_000, 49475.1993, 36040.5816),
            "0.1": (90_000, 496660.9397, 362072.5090)}

# threshold, alpha: saved, saved %, overhead, generation, write, reread, split, pieces
GRID = {
    (100_000, 0.05): (19018.9756, 38.4414, 3266.8793, 2137.6188, 534.4047, 594.8559, 7252, 3.000111),
    (100_000, 0.10): (15752.0963, 31.8384, 6533.7586, 4275.2375, 1068.8094, 1189.7117, 7252, 3.000111),
    (100_000, 0.15): (12485.2170, 25.2353, 9800.6379, 6412.8562, 1603.2141, 1784.5676, 7252, 3.000111),
    (100_000, 0.20): (9218.3377, 18.6322, 13067.5172, 8550.4750, 2137.6188, 2379.4235, 7252, 3.000111),
    (110_000, 0.10): (14833.1411, 29.9810, 6398.3143, 4146.0375, 1036.5094, 1215.7675, 6927, 2.763333),
    (120_000, 0.10): (13965.7605, 28.2278, 6273.7187, 4031.6100, 1007.9025, 1234.2062, 6644, 2.571778),
    (130_000, 0.10): (13176.3727, 26.6323, 6131.1160, 3908.4662, 977.1166, 1245.5332, 6368, 2.406556),
    (140_000, 0.10): (12484.2426, 25.2333, 5966.5189, 3772.5450, 943.1363, 1250.8376, 6092, 2.260667),
    (150_000, 0.05): (14709.9045, 29.7319, 2927.0908, 1842.1688, 460.5422, 624.3799, 5892, 2.149111),
    (150_000, 0.10): (11782.8137, 23.8156, 5854.1816, 3684.3375, 921.0844, 1248.7597, 5892, 2.149111),
    (150_000, 0.15): (8855.7229, 17.8993, 8781.2724, 5526.5063, 1381.6266, 1873.1396, 5892, 2.149111),
    (150_000, 0.20): (5928.6320, 11.9830, 11708.3632, 7368.6750, 1842.1688, 2497.5195, 5892, 2.149111),
}
COLUMNS = ("saved", "saved_pct", "oh_total", "oh_gen", "oh_write", "oh_reread", "n_split",
           "avg_chunks")

# scale, threshold: pieces, mean, p10, p50, p90, max, mean calls, sum
DISTRIBUTION = {
    ("0.01", 100_000): (27_001, 1.248958, 0.402604, 0.942059, 2.299962, 34.093014, 19.9765, 33723.1030),
    ("0.01", 150_000): (19_342, 1.948733, 0.567333, 1.484817, 3.842847, 34.093014, 27.8867, 37692.3857),
    ("0.1", 100_000): (268_990, 1.258854, 0.403029, 0.949729, 2.315823, 40.596330, 20.1343, 338619.1110),
    ("0.1", 150_000): (193_231, 1.960937, 0.565977, 1.492960, 3.860772, 40.596330, 28.0283, 378913.8291),
}


def _sessions(spark, scale):
    return tt.select_sessions(order_sessions(spark, f"{DATA}/sf{scale}"))


@pytest.mark.parametrize("scale", BASELINE)
def test_baseline(spark, scale):
    row = tt.corpus_baseline(tt.session_cost(_sessions(spark, scale))).first()
    got = (row["n_sessions"], row["full_cost"], row["cache_read_cost"])
    assert got == pytest.approx(BASELINE[scale], abs=1e-4)


def test_grid(spark):
    rows = {(r["threshold"], r["alpha"]): r for r in tt.split_grid(_sessions(spark, "0.01")).collect()}
    assert len(rows) == 24
    for key, want in GRID.items():
        assert [rows[key][c] for c in COLUMNS] == pytest.approx(want, abs=1.001e-4)


@pytest.mark.parametrize("scale", ["0.01", "0.1"])
def test_distribution(spark, scale):
    with tt.staged(_sessions(spark, scale)) as sessions:
        rows = tt.chunk_distribution(
            tt.chunk_prices(sessions, [100_000, 150_000], 0.10, compact=True)).collect()
    assert len(rows) == 2
    for r in rows:
        want = DISTRIBUTION[scale, r["threshold"]]
        assert tuple(r)[1:] == pytest.approx(want[:-1], abs=1e-4)
        assert [r["p10"], r["p50"], r["p90"]] == pytest.approx(want[2:5], abs=1e-6)
        assert r["mean_cost"] * r["n_chunks"] == pytest.approx(want[-1], abs=1e-3)
