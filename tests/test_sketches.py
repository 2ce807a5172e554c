"""Mergeable sketches of prices, the distribution of a stream, and stored pieces."""

import random
import re

import pytest
from pyspark.sql import functions as F

import tokentariff as tt
from tokentariff.operators import sketches as sk

PRICES = "threshold long, day int, cost double, calls double"


def price_rows(n=4_000):
    rng = random.Random(8)
    return [(rng.choice([1, 2]), rng.randrange(5), rng.choice(
        [rng.lognormvariate(0, 3), rng.random() * 1e-6, 0.0, 2.5, -rng.random()]), 1.0)
        for _ in range(n)]


@pytest.mark.parametrize("accuracy", [0.05, 0.01, 0.001])
def test_percentiles_within_their_bound(spark, accuracy):
    rows = price_rows()
    found = tt.sketch_percentiles(tt.price_sketches(
        spark.createDataFrame(rows, PRICES), ["threshold"], accuracy), ["threshold"],
        [0, 1, 10, 50, 90, 99.9, 100], accuracy)
    for r in found.collect():
        costs = sorted(c for t, _, c, _ in rows if t == r.threshold)
        n = len(costs)
        assert (r.n_chunks, r.max_cost) == (n, costs[-1])
        assert r.mean_cost == pytest.approx(sum(costs) / n)
        for p in (0, 1, 10, 50, 90, 99.9, 100):
            want = costs[min(n - 1, int(p / 100 * n))]
            assert abs(r[f"approx_p{p:g}"] - want) <= accuracy * abs(want) * 1.000001


def test_merged_sketches_equal_one_over_all(spark, tmp_path):
    frame = spark.createDataFrame(price_rows(), PRICES)
    tt.price_sketches(frame, ["threshold", "day"]).write.parquet(str(tmp_path / "days"))
    days = spark.read.parquet(str(tmp_path / "days"))
    assert days.count() == 10
    for keys in (["threshold"], []):
        merged = tt.sketch_percentiles(tt.merge_sketches(days, keys), keys).drop("mean_cost")
        whole = tt.sketch_percentiles(tt.price_sketches(frame, keys), keys).drop("mean_cost")
        assert sorted(merged.collect()) == sorted(whole.collect())


def test_weights_count_as_rows(spark, random_sessions):
    sessions, _ = random_sessions
    forms = [tt.sketch_percentiles(tt.price_sketches(tt.chunk_prices(
        sessions, [100_000, 150_000], compact=compact), ["threshold"]), ["threshold"]).collect()
        for compact in (True, False)]
    exact = {r.threshold: r for r in tt.chunk_distribution(tt.chunk_prices(
        sessions, [100_000, 150_000], compact=True)).collect()}
    assert len(forms[0]) == 2
    for one, other in zip(*map(sorted, forms)):
        assert one[:1] + one[3:7] == other[:1] + other[3:7]
        want = exact[one.threshold]
        assert one.n_chunks == want.n_chunks and one.mean_calls == pytest.approx(want.mean_calls)
        for p in ("p10", "p50", "p90"):
            assert one[f"approx_{p}"] == pytest.approx(want[p], rel=0.0101)


def test_sketch_size_is_bounded(spark):
    many = spark.range(200_000).select(F.lit(1).alias("k"), F.lit(1.0).alias("calls"),
                                       F.exp(F.rand(3) * 20 - 10).alias("cost"))
    bins = tt.price_sketches(many, ["k"]).select(F.size("sketch.bins")).first()[0]
    assert bins <= 20 / 0.02 + 2


def test_wrong_accuracy_and_no_rows(spark):
    with pytest.raises(ValueError):
        sk.growth(0.0)
    nothing = spark.createDataFrame([], PRICES)
    assert tt.sketch_percentiles(tt.price_sketches(nothing, ["threshold"]), ["threshold"]).collect() == []
    null = spark.createDataFrame([(1, 1, None, 1.0)], PRICES)
    assert tt.price_sketches(null, ["threshold"]).collect() == []


def test_streamed_distribution_equals_the_batch(spark, random_sessions, tmp_path):
    sessions, _ = random_sessions
    folder, out = str(tmp_path / "sessions"), str(tmp_path / "out")
    for part in range(3):
        sessions.where(F.col("session_id") % 3 == part).coalesce(1).write.mode("append").parquet(folder)
    stream = tt.stream_sessions(spark, folder, maxFilesPerTrigger=1)
    query = tt.stream_distribution(stream, out, str(tmp_path / "state"))
    query.awaitTermination()
    chunks = tt.chunk_prices(sessions, [100_000, 150_000], compact=True)
    want = tt.sketch_percentiles(tt.price_sketches(chunks, ["threshold"]), ["threshold"])
    last = spark.read.parquet(f"{out}/trigger=2")

    def rows(frame):
        return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r)
                      for r in frame.collect())
    assert rows(last) == rows(want)
    first = spark.read.parquet(f"{out}/trigger=0")
    assert {r.n_chunks for r in first.collect()} < {r.n_chunks for r in first.collect()} | {
        r.n_chunks for r in last.collect()}


def test_stored_pieces_are_not_shuffled(spark, random_sessions, tmp_path):
    """Same prices as from a plain table, and no exchange above the scan of the pieces."""
    sessions, _ = random_sessions
    pieces = tt.chunk_prices(sessions, 100_000).select("session_id", "chunk_idx", "height")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored = tt.stored_pieces(pieces, "stored_pieces_test", path=str(tmp_path / "pieces"))
        priced = tt.price_supplied_chunks(sessions, stored, 100_000, 0.10)
        want = tt.price_supplied_chunks(sessions, pieces, 100_000, 0.10)
        assert sorted(map(str, priced.collect())) == sorted(map(str, want.collect()))
        plan = tt.price_supplied_chunks(sessions, stored, 100_000, 0.10)
        plan = plan._jdf.queryExecution().executedPlan().toString().splitlines()
        depth = [len(line) - len(line.lstrip(" :+-")) for line in plan]
        scans = [i for i, line in enumerate(plan) if "stored_pieces_test" in line]
        assert len(scans) >= 2
        for at in scans:
            # Up from the scan to the join or group that uses the pieces.
            place = at
            while not re.search("Join|HashAggregate", plan[place]):
                assert "Exchange" not in plan[place], plan[place]
                place = max(i for i in range(place) if depth[i] < depth[place])
        single = tt.supplied_piece_prices(sessions, stored, 100_000, 0.10)
        assert sorted(map(str, single.collect())) == sorted(map(str, tt.supplied_piece_prices(
            sessions, pieces, 100_000, 0.10).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS stored_pieces_test")
