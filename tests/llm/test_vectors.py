"""Top-k search and hard negatives against plain Python, on edge rows, copies and several cells."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokentariff.llm import hard_negatives as hn
from tokentariff.llm import pivot_index, vector_cells

SCHEMA = "vec_id long, embedding array<float>, label int"


def whole(v):
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    f32 = [float(np.float32(x)) for x in v]
    return [max(min(math.floor(256 * x), 1 << 62), -(1 << 62)) for x in f32]


def score(a, b):
    exact = sum(x * y for x, y in zip(a, b))
    return max(min(exact, (1 << 63) - 1), -((1 << 63) - 1))


def order(pair):
    value, vec_id = pair
    return (-value, vec_id is None, vec_id or 0)


def brute_top_k(rows, k=5, every=50):
    vectors = [(r[0], whole(r[1])) for r in rows if whole(r[1]) is not None]
    out = []
    for i, (query, v) in enumerate(vectors):
        if query is not None and query % every == 0:
            others = sorted(((score(v, w), x) for j, (x, w) in enumerate(vectors) if j != i), key=order)
            out += [(query, rank + 1, x, s) for rank, (s, x) in enumerate(others[:k])]
    return sorted(out, key=repr)


def brute_negatives(rows, every=100, n=5, least=80):
    usable = [(r[0], whole(r[1]), r[2]) for r in rows if whole(r[1]) is not None and r[2] is not None]
    out = []
    for i, (anchor, v, label) in enumerate(usable):
        if anchor is None or anchor % every:
            continue
        scored = [(score(v, w), x, other == label) for j, (x, w, other) in enumerate(usable) if j != i]
        positives = sorted(((s, x) for s, x, same in scored if same), key=order)[:n]
        for top, positive in positives:
            fits = sorted(((s, x) for s, x, same in scored if not same
                           and least * top <= 100 * s <= 100 * top), key=order)[:n]
            out += [(anchor, positive, rank + 1, x, top, s) for rank, (s, x) in enumerate(fits)]
    return sorted(out, key=repr)


def spread(n, dims=16, seed=3):
    """Random directions, groups of near and exact copies, labels that copies don't always share."""
    rng = random.Random(seed)
    rows, centre = [], None
    for i in range(n):
        if i % 3 or centre is None:
            v = [rng.gauss(0, 1) for _ in range(dims)]
            size = math.sqrt(sum(x * x for x in v)) / rng.choice([1, 1, 0.7])
            v = [x / size for x in v]
            centre = centre or v
        else:
            v = centre if i % 2 else [x + rng.gauss(0, 0.02) for x in centre]
        rows.append((i, v, rng.randrange(4) if i % 3 else rng.choice([1, 1, 1, 2])))
    return rows


EDGES = [
    (0, [0.5, 0.5, 0.0], 1), (0, [0.5, 0.5, 0.0], 1), (50, [0.5, 0.5, 0.0], 1), (100, [0.25], 2),
    (7, [], 1), (8, None, 1), (9, [0.5, None, 0.5], 1), (10, [float("nan"), 1.0, 1.0], 1),
    (11, [float("inf"), 0.0, 0.0], 1), (None, [0.5, 0.5, 0.0], 1), (None, None, None),
    (200, [0.4, 0.4, 0.1], None), (300, [0.4, 0.4, 0.1], 1), (-100, [-0.5, 0.1, 0.0], 1),
    (12, [0.5, 0.4, 0.0], 2), (13, [0.5, 0.4, 0.0], 2), (14, [0.45, 0.4, 0.3], 3),
    (400, [0.0, 0.0, 0.0], 2), (15, [0.0, 0.0, 0.0], 2), (16, [0.0, 0.0, 0.0], 1)]


def result(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("cell_rows", [8_192, 7])
def test_search_and_negatives(spark, monkeypatch, cell_rows):
    for module in (pivot_index, hn):
        monkeypatch.setattr(module, "CELL_ROWS", cell_rows)
    rows = spread(240)
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert result(pivot_index.exact_top_k(table, k=3, every=20)) == brute_top_k(rows, 3, 20)
    assert result(hn.hard_negatives(table, every=20)) == brute_negatives(rows, 20)


def test_edge_rows(spark):
    table = spark.createDataFrame(EDGES, SCHEMA)
    assert result(pivot_index.exact_top_k(table)) == brute_top_k(EDGES)
    assert result(hn.hard_negatives(table)) == brute_negatives(EDGES)


def test_clashing_columns(spark):
    rows = spread(60)
    table = spark.createDataFrame(rows, SCHEMA)
    extra = table.withColumns({c: F.lit("x") for c in (
        "row", "id", "v", "n2", "cell", "kind", "key", "slot", "rank", "score", "bounds", "a.b")})
    assert result(pivot_index.exact_top_k(extra)) == brute_top_k(rows)
    assert result(hn.hard_negatives(extra)) == brute_negatives(rows)


def test_few_rows_and_none(spark):
    for rows in ([], [(0, [1.0], 1), (1, [0.9], 1)]):
        table = spark.createDataFrame(rows, SCHEMA)
        assert result(pivot_index.exact_top_k(table)) == brute_top_k(rows)
        assert result(hn.hard_negatives(table)) == brute_negatives(rows)


def test_large_components(spark):
    """Beyond what doubles hold exactly, and beyond a long."""
    rows = [(100 * i, [3.0e7 + i, -2.0e7 + 3 * i, 7.0 * i], i % 2) for i in range(8)]
    rows += [(800, [1e30, 0.0, 0.0], 0), (801, [1e30, 1.0, 0.0], 1), (900, [-1e30, 0.0, 0.0], 1)]
    table = spark.createDataFrame(rows, SCHEMA)
    assert result(pivot_index.exact_top_k(table)) == brute_top_k(rows)
    assert result(hn.hard_negatives(table)) == brute_negatives(rows)


def test_annuli_skip_far_vectors(spark, tmp_path):
    """On clustered vectors most cells are never visited by most queries."""
    rng = random.Random(5)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(20)]
    rows = [(i, [x + rng.gauss(0, 0.01) for x in centres[i % 20]], 0) for i in range(2_000)]
    pairs = spark.createDataFrame(rows, SCHEMA)
    frame = vector_cells_rows(pairs, tmp_path)
    index = pivot_index.build_index(frame, str(tmp_path))
    queries = frame.where("id % 50 = 0").select("row", "v")
    pivot_index.search(index, queries, 5, str(tmp_path))
    visits = sum(spark.read.parquet(f"{tmp_path}/visits-{i}").where("cell IS NOT NULL").count()
                 for i in range(1 + len(pivot_index.PARTS)))
    every = queries.count() * int(index.directory.cells.sum())
    assert visits < every / 4


def vector_cells_rows(table, folder):
    return pivot_index.written(pivot_index.indexed_rows(table), f"{folder}/rows")


def test_inverted_cell_keeps_all_that_reach():
    """No vector at or over the threshold is dropped, and most others are."""
    rng = np.random.default_rng(1)
    v = np.floor(256 * rng.normal(size=(3_000, 32)) / 32 ** 0.5)
    v[:300] = np.floor(v[0] + 8 * rng.normal(size=(300, 32)))
    cell = type("C", (), {"v": v})()
    index = hn.InvertedCell(cell)
    for anchors in (v[:1], v[5:9], v[400:460]):
        for part in (0.9, 0.6, 0.3, -1.0):
            limits = np.array([part * (x @ x) for x in anchors]).astype(np.int64)
            places = index.reaching(anchors, limits)
            reach = np.flatnonzero((v @ anchors.T >= limits).any(axis=1))
            assert set(reach) <= set(places)
    few = index.reaching(v[:1], np.array([int(0.9 * (v[0] @ v[0]))]))
    assert len(few) < 1_500


def test_percent_is_the_least_whole_number(spark):
    frame = spark.range(500).select("id", *[
        hn._percent(F.col("id"), p).alias(f"p{p}") for p in (80, 90, 95)])
    for r in frame.collect():
        assert [r.p80, r.p90, r.p95] == [-(-r.id * p // 100) for p in (80, 90, 95)]


def test_matrix_of_short_lists():
    import pyarrow as pa
    lists = pa.array([[1, 2, 3], [4], [], [5, 6]], pa.list_(pa.int64()))
    assert vector_cells.matrix(lists, 3, True).tolist() == [[1, 2, 3], [4, 0, 0], [0, 0, 0], [5, 6, 0]]
    assert vector_cells.matrix(lists.slice(1, 2), 3, False).tolist() == [[4, 0, 0], [0, 0, 0]]
