"""Exact top-k search by inner product with a pivot-distance index.

Vectors get one more component, the root of what their squared length lacks of the largest one, M2.
Then all have the same length, and the squared distance of a query (with 0 there) to a vector is
``|q|^2 + M2 - 2 * score``: the nearest vectors are those with the highest scores, and the triangle
inequality holds.

The index keys every vector by its nearest pivot and by a ring, its distance to that pivot in steps
of a fixed width. There are at most PIVOTS * (RINGS + 1) keys at any size of the table; how
many vectors each holds, and the least and largest distance in it, is the index' directory. Keys
with more than CELL_ROWS vectors are dealt into cells, so equal vectors fill many cells.

A query's distance to all vectors of a key is at least the gap between its own distance to the
pivot and the ring's distances, and at least its distance to the plane that parts the pivot's side from
that of the query's nearest pivot. Keys sorted by that bound are the annuli to expand: first as
many as hold ``k`` other vectors, then those within parts of the k-th distance found so far, last all within
the whole of it. Beyond, no vector can be among the first k, nor tie with the last. Every vector of a
visited cell is compared, with scores in whole numbers; distances in doubles only decide
visits, with a margin for rounding.

Pivots are the centres of a bounded sample of SAMPLE rows (those with the smallest hashes); they decide
how much is skipped and never what is found. A query that has no near vectors visits all cells:
then this is a join of blocks of queries with blocks of vectors.

Vectors that are null or hold a null or non-finite component take no part. Shorter vectors end in
zeros. Rows that repeat an id, or a whole row, are rows of their own, each a candidate for the
others. A null id is no query, and comes last in ties. Scores beyond a long are the nearest long.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokentariff.llm.text import prepare_workers, work_folder, written
from tokentariff.llm.vector_cells import (CELL_ROWS, exact_in_doubles, first_of_each, matrix, norm2,
                                          products, scanned, sizes_of, usable, visits_of_cells, whole)

PIVOTS = 32
RINGS = 255
SAMPLE = 4_096
ROUNDS = 5          # of moving the centres
PARTS = (0.6, 1.0)  # of the k-th distance, by round
FOUND = "row long, other long, id long, score long"
KEYED = "row long, id long, v array<bigint>, key int, distance double"


def indexed_rows(table: DataFrame, vector: str = "embedding", id_column: str = "vec_id") -> DataFrame:
    """(row, id, v, n2) of the rows that take part; rows are numbered as they are written."""
    rows = table.where(usable(F.col(vector))).select(
        F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("id"),
        whole(F.col(vector)).alias("v"))
    return rows.withColumn("n2", norm2(F.col("v")))


def lifted(v: np.ndarray, m2: float) -> np.ndarray:
    """Vectors with the component that makes all of them as long as the longest."""
    v = v.astype(np.float64)
    return np.column_stack([v, np.sqrt(np.maximum(m2 - np.einsum("ij,ij->i", v, v), 0))])


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (np.einsum("ij,ij->i", points, points)[:, None]
               + np.einsum("ij,ij->i", pivots, pivots) - 2 * points @ pivots.T)
    return np.sqrt(np.maximum(squares, 0))


def fit_pivots(rows: DataFrame, dims: int, m2: float, pivots: int = PIVOTS) -> np.ndarray:
    """Centres of a sample of at most SAMPLE rows."""
    taken = rows.select("row", "v").orderBy(F.xxhash64("row")).limit(SAMPLE).toArrow()
    points = lifted(matrix(taken["v"], dims, True), m2)
    centres = np.unique(points[:: max(1, len(points) // pivots)][:pivots], axis=0)
    for _ in range(ROUNDS):
        nearest = distances(points, centres).argmin(axis=1)
        centres = np.array([points[nearest == i].mean(axis=0) if (nearest == i).any() else c
                            for i, c in enumerate(centres)])
    return centres


class Directory(NamedTuple):
    """The keys that hold vectors: pivot, least and largest distance, vectors, first cell, cells."""

    pivots: np.ndarray
    pivot: np.ndarray
    least: np.ndarray
    largest: np.ndarray
    rows: np.ndarray
    first: np.ndarray
    cells: np.ndarray

    def bounds(self, points: np.ndarray) -> np.ndarray:
        """Least distance that each point can have to the vectors of each key."""
        to = distances(points, self.pivots)
        nearest = to.argmin(axis=1)
        own = to[np.arange(len(to)), nearest][:, None]
        apart = distances(self.pivots, self.pivots)[nearest]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = np.where(apart > 0, (to ** 2 - own ** 2) / (2 * apart), 0)
        gap = np.maximum(self.least - to[:, self.pivot], to[:, self.pivot] - self.largest)
        bound = np.maximum(np.maximum(gap, plane[:, self.pivot]), 0)
        return bound - 1e-6 * (1 + bound)


class Index(NamedTuple):
    """``vectors`` (row, id, v, cell) of all cells, and what the planning of visits needs."""

    vectors: DataFrame
    directory: Directory
    dims: int
    m2: float
    doubles: bool


def build_index(rows: DataFrame, folder: str) -> Index:
    """The index of ``indexed_rows``, its tables written below ``folder``."""
    spark = rows.sparkSession
    prepare_workers(spark, rows=4_096)
    sizes = sizes_of(rows)
    dims, m2, doubles = sizes["dims"], sizes["n2"], exact_in_doubles(sizes)
    pivots = fit_pivots(rows, dims, m2) if sizes["rows"] else np.zeros((1, dims + 1))
    width = max(2 * m2 ** 0.5 / RINGS, 1e-300)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to = distances(lifted(matrix(batch.column("v"), dims, True), m2), pivots)
            nearest = to.argmin(axis=1)
            near = to[np.arange(len(to)), nearest]
            ring = np.minimum(near / width, RINGS).astype(np.int32)
            yield pa.record_batch(
                [batch.column("row"), batch.column("id"), batch.column("v"),
                 pa.array((nearest * (RINGS + 1) + ring).astype(np.int32)), pa.array(near)],
                names=["row", "id", "v", "key", "distance"])

    keyed = written(rows.select("row", "id", "v").mapInArrow(key, KEYED), f"{folder}/keyed")
    # At most PIVOTS * (RINGS + 1) rows.
    counted = keyed.groupBy("key").agg(
        F.count("*").alias("rows"), F.min("distance").alias("least"),
        F.max("distance").alias("largest")).withColumn(
        "cells", F.ceil(F.col("rows") / CELL_ROWS))
    found = counted.orderBy("key").toPandas()
    cells = found["cells"].to_numpy(np.int64)
    directory = Directory(pivots, found["key"].to_numpy(np.int64) // (RINGS + 1),
                          found["least"].to_numpy(float), found["largest"].to_numpy(float),
                          found["rows"].to_numpy(np.int64), np.cumsum(cells) - cells, cells)
    dealt = spark.createDataFrame(
        list(zip(found["key"].tolist(), directory.first.tolist(), cells.tolist())),
        "key int, first long, cells long")
    vectors = keyed.join(F.broadcast(dealt), "key").select(
        "row", "id", "v", (F.col("first") + F.pmod(F.xxhash64("row"), F.col("cells"))).alias("cell"))
    return Index(vectors, directory, dims, m2, doubles)


def visits(index: Index, queries: DataFrame, k: int, part: float | None) -> DataFrame:
    """(cell, row, v, bounds) of the annuli to visit next. ``queries`` (row, v, last, done) have the k-th
    best score so far, null if there is none, and the bound up to which keys were visited."""
    directory, dims, m2 = index.directory, index.dims, index.m2

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column("v"), dims, True)
            points = np.column_stack([v, np.zeros(len(v))])
            bounds = directory.bounds(points)
            if part is None:
                order = bounds.argsort(axis=1, kind="stable")
                enough = (directory.rows[order].cumsum(axis=1) >= k + 1).argmax(axis=1)
                full = directory.rows.sum() >= k + 1
                at = np.arange(len(v))
                radius = bounds[at, order[at, enough]] if full else np.full(len(v), np.inf)
                since = np.full(len(v), -np.inf)
            else:
                last = batch.column("last").to_numpy(zero_copy_only=False)
                squares = np.einsum("ij,ij->i", v, v) + m2 - 2 * last.astype(float)
                radius = np.where(np.isnan(squares), np.inf, np.sqrt(np.maximum(squares, 0)) * part)
                since = batch.column("done").to_numpy(zero_copy_only=False)
            wanted = (bounds <= radius[:, None]) & (bounds > since[:, None])
            query, key = np.nonzero(wanted)
            times = directory.cells[key]
            query, first = np.repeat(query, times), np.repeat(directory.first[key], times)
            starts = np.repeat(np.cumsum(times) - times, times)
            cell = first + np.arange(len(first)) - starts
            reached = np.maximum(radius, since)
            # Every query has a row without a cell that tells how far it has come.
            names = ["cell", "row", "v", "last", "done"]
            rows, vectors = batch.column("row"), batch.column("v")
            yield pa.record_batch(
                [pa.nulls(len(v), pa.int64()), rows, pa.nulls(len(v), vectors.type),
                 batch.column("last"), pa.array(reached)], names=names)
            for at in range(0, len(query), 4_096):
                some = pa.array(query[at:at + 4_096])
                yield pa.record_batch(
                    [pa.array(cell[at:at + 4_096].astype(np.int64)), rows.take(some),
                     vectors.take(some), batch.column("last").take(some),
                     pa.array(reached[query[at:at + 4_096]])], names=names)

    return queries.select("row", "v", "last", "done").mapInArrow(
        plan, "cell long, row long, v array<bigint>, last long, done double")


def best_of(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("row").orderBy(
        F.col("score").desc(), F.col("id").asc_nulls_last(), "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def compared(index: Index, planned: DataFrame, k: int) -> DataFrame:
    """(row, other, id, score): the first k of every cell for each query that visits it, at least as
    good as its k-th best so far."""
    dims, doubles = index.dims, index.doubles

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, batch in visits_of_cells(batches, dims, doubles):
            rows = batch.column("row").to_numpy()
            scores = products(matrix(batch.column("v"), dims, doubles), cell.v)
            last = np.array([b[0] if b is not None and b[0] is not None else np.iinfo(np.int64).min
                             for b in batch.column("bounds").to_pylist()], np.int64)
            other = rows[:, None] != cell.row
            low = np.where(other, scores, np.iinfo(np.int64).min)
            n = low.shape[1]
            floor = np.partition(low, n - k, axis=1)[:, n - k] if n > k else low.min(axis=1)
            query, place = np.nonzero(other & (low >= np.maximum(floor, last)[:, None]))
            score = scores[query, place]
            some = first_of_each(query, score, cell.id[place], k)
            query, place = query[some], place[some]
            yield pa.record_batch(
                [pa.array(rows[query]), pa.array(cell.row[place]), cell.ids(place),
                 pa.array(score[some])], names=["row", "other", "id", "score"])

    visited = planned.where(F.col("cell").isNotNull()).select(
        "cell", "row", "v", F.array("last").alias("bounds"))
    return scanned(index.vectors, visited, scan, FOUND)


def search(index: Index, queries: DataFrame, k: int, folder: str) -> DataFrame:
    """(row, other, id, score, rank) of the k best other rows of each of the ``queries`` (row, v)."""
    state = queries.select("row", "v", F.lit(None).cast("long").alias("last"),
                           F.lit(None).cast("double").alias("done"))
    best = None
    for number, part in enumerate((None, *PARTS)):
        planned = written(visits(index, state, k, part), f"{folder}/visits-{number}")
        found = compared(index, planned, k)
        if best is not None:
            found = found.unionByName(best.select("row", "other", "id", "score"))
        best = written(best_of(found, k), f"{folder}/best-{number}")
        last = best.where(F.col("rank") == k).select("row", F.col("score").alias("last"))
        done = planned.where(F.col("cell").isNull()).select("row", "done")
        state = queries.select("row", "v").join(done, "row").join(last, "row", "left")
    return best


def exact_top_k(table: DataFrame, k: int = 5, every: int = 50, vector: str = "embedding",
                id_column: str = "vec_id") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest inner products of each row whose id is
    divisible by ``every`` with all other rows; all, if there are fewer. Ties go to the smaller id."""
    folder = work_folder(table.sparkSession, "pivots")
    rows = written(indexed_rows(table, vector, id_column), f"{folder}/rows")
    index = build_index(rows, folder)
    queries = rows.where(F.col("id") % every == 0)
    names = queries.select("row", F.col("id").alias("query_id"))
    return search(index, queries.select("row", "v"), k, folder).join(names, "row").select(
        "query_id", "rank", F.col("id").alias("vec_id"), "score")
