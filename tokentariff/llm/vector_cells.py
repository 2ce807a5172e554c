"""Whole-number vectors in cells of bounded size, and queries that stream past the cells they visit.

A cell and the queries that visit it meet in one task, sorted so that the cell's vectors come first. A task
holds one cell, ``CELL_ROWS`` vectors on average, and ``CHUNK`` queries at a time, however many
visit it; no pair of a query and a vector becomes a row unless a worker returns it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokentariff.llm.text import prepare_workers

FACTOR = 256
CELL_ROWS = 8_192
CHUNK = 256
LARGEST = (1 << 63) - 1
EXACT_DOUBLE = float(1 << 53)
STREAM = ("cell", "kind", "row", "id", "label", "v", "bounds")


def usable(vector: Column) -> Column:
    """The vector is there and all its components are finite numbers."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(F.forall(vector, number), F.lit(False))


def whole(vector: Column) -> Column:
    """floor(256 * x) of each component, as long; beyond a long the nearest long."""
    return F.transform(vector, lambda x: F.floor(F.least(F.greatest(
        x.cast("double") * FACTOR, F.lit(-float(1 << 62))), F.lit(float(1 << 62)))).cast("long"))


def norm2(v: Column) -> Column:
    """Squared length, as a double."""
    return F.aggregate(v, F.lit(0.0), lambda total, x: total + x.cast("double") * x)


def sizes_of(rows: DataFrame) -> dict:
    """Number of rows, dimensions, largest component and largest squared length."""
    found = rows.agg(
        F.count("*").alias("rows"), F.max(F.size("v")).alias("dims"),
        F.max(F.array_max(F.transform("v", F.abs))).alias("largest"),
        F.max("n2").alias("n2")).first().asDict()
    return {name: value or 0 for name, value in found.items()}


def exact_in_doubles(sizes: dict) -> bool:
    return sizes["dims"] * float(sizes["largest"]) ** 2 < EXACT_DOUBLE


def matrix(vectors: pa.Array, dims: int, doubles: bool) -> np.ndarray:
    """Rows of the matrix from lists of longs; shorter lists end in zeros. Python's own integers
    where doubles would round."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    flat = flat.astype(np.float64 if doubles else object)
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    if (lengths == dims).all():
        return flat.reshape(len(lengths), dims)
    out = np.zeros((len(lengths), dims), flat.dtype)
    out[np.arange(dims) < lengths[:, None]] = flat
    return out


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products as longs; what a long can't hold is the nearest long."""
    found = queries @ vectors.T
    if found.dtype == object:
        return np.array([[min(max(x, -LARGEST), LARGEST) for x in row] for row in found],
                        np.int64).reshape(found.shape)
    return found.astype(np.int64)


class Cell:
    """The vectors of a cell."""

    def __init__(self, batches: list[pa.RecordBatch], dims: int, doubles: bool):
        table = pa.Table.from_batches(batches)
        self.row = table["row"].to_numpy()
        ids = table["id"]
        self.id = ids.fill_null(LARGEST).to_numpy()  # null ids come last in ties
        self.id_null = ids.is_null().to_numpy()
        self.label = table["label"].fill_null(0).to_numpy()
        self.v = matrix(table["v"], dims, doubles)

    def ids(self, places: np.ndarray) -> pa.Array:
        return pa.array(self.id[places], pa.int64(), mask=self.id_null[places])


def visits_of_cells(batches: Iterator[pa.RecordBatch], dims: int,
                    doubles: bool) -> Iterator[tuple[Cell, pa.RecordBatch]]:
    """(cell, at most CHUNK of its queries) from rows sorted by cell and kind."""
    current, parts, cell = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cells, kinds = batch.column("cell").to_numpy(), batch.column("kind").to_numpy()
        cuts = np.flatnonzero((np.diff(cells) != 0) | (np.diff(kinds) != 0)) + 1
        for start, end in zip([0, *cuts], [*cuts, batch.num_rows]):
            if cells[start] != current:
                current, parts, cell = cells[start], [], None
            if kinds[start] == 0:
                parts.append(batch.slice(start, end - start))
                continue
            if cell is None and parts:
                cell, parts = Cell(parts, dims, doubles), []
            if cell is not None:
                for at in range(start, end, CHUNK):
                    yield cell, batch.slice(at, min(CHUNK, end - at))


def first_of_each(group: np.ndarray, score: np.ndarray, tie: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` first of each group: highest score first, then smallest tie."""
    order = np.lexsort((tie, -score, group))
    if not len(order):
        return order
    sorted_ = group[order]
    starts = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[place < most]


def scanned(vectors: DataFrame, visits: DataFrame, worker: Callable, schema: str) -> DataFrame:
    """``worker`` over the stream of cells. ``vectors`` and ``visits`` have the columns of STREAM but
    ``kind``; those that are missing are null."""
    spark = vectors.sparkSession
    prepare_workers(spark, rows=4_096)
    empty = {"label": "long", "bounds": "array<long>", "id": "long"}

    def streamed(frame: DataFrame, kind: int) -> DataFrame:
        return frame.select(*[
            F.lit(kind).alias(c) if c == "kind" else F.col(c) if c in frame.columns
            else F.lit(None).cast(empty[c]).alias(c) for c in STREAM])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (streamed(vectors, 0).unionByName(streamed(visits, 1)).repartition(parts, "cell")
            .sortWithinPartitions("cell", "kind").mapInArrow(worker, schema))
