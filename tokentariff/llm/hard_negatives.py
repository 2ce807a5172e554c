"""Hard-negative mining by threshold joins on an inverted index, after L2AP.

Vectors are dealt into cells by a hash of their row, so that no label, group of copies or value makes a
cell large. A cell is an inverted index: for each dimension, the rows that have it and their
values. Dimensions run from the one with the least energy in the cell to the one with the most.

A threshold join looks for all vectors whose inner product with an anchor reaches a threshold:

* a vector's first dimensions are left out of the index, as far as the norm of that part, times
  the longest anchor's norm on the same dimensions, stays below the lowest threshold: no vector can
  reach it by them alone;
* lists are read from the last dimension to the first, and products added up; a vector is dropped
  once its sum and the product of the norms that remain on both sides stay below the
  anchor's threshold;
* what is left is compared in full, in whole numbers.

Positives of an anchor are its first ``n_positives`` other rows of the same label. The threshold is the
worst of the best that the anchor's own cell holds; the second join finds all that
reach it. A positive with score s opens the window of negatives from ``least`` percent of s to s. The
windows are filled from above: each join takes the open ones down to the next of LEVELS, and a window
that has its ``n_negatives`` leaves. So few vectors pass a join unless windows stay empty.

Only the first few rows of a cell for an anchor and window leave its task. Anchors are a stated part of
the rows (ids divisible by ``every``), against all rows in blocks.

Rows with a null label, a null vector or a null or non-finite component take no part. Shorter vectors end in
zeros. Rows that repeat an id are rows of their own: each is an anchor and a candidate for the
others. A null id is no anchor, and comes last in ties. An anchor without positives, a positive
with a score below 0 and an empty window give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokentariff.llm.text import work_folder, written
from tokentariff.llm.vector_cells import (CELL_ROWS, Cell, exact_in_doubles, first_of_each, matrix,
                                          norm2, products, scanned, sizes_of, usable,
                                          visits_of_cells, whole)

POSITIVES, NEGATIVES = 5, 5
LEAST, LEVELS = 80, (95, 90)  # percent of the positive's score
STEP = 8  # dimensions whose lists are read between two prunings
FOUND = "row long, slot int, other long, id long, score long"
LOWEST, HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def prefix_norms(v: np.ndarray) -> np.ndarray:
    """Norm of the first 0, 1, ... all components of each row."""
    return np.sqrt(np.pad(np.cumsum(v * v, axis=1), ((0, 0), (1, 0))))


class InvertedCell:
    """A cell with its dimensions in order of energy and the norms of all prefixes."""

    def __init__(self, cell: Cell):
        v = cell.v.astype(np.float64)
        self.order = np.argsort(np.einsum("ij,ij->j", v, v), kind="stable")
        self.v = np.ascontiguousarray(v[:, self.order])
        self.norms = prefix_norms(self.v)

    def reaching(self, anchors: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
        """Places of the vectors that may reach the threshold of one of the anchors."""
        x = anchors.astype(np.float64)[:, self.order]
        x_norms = prefix_norms(x)
        rows, dims = self.v.shape
        slack = 1e-6 * (1 + x_norms[:, -1].max() * self.norms[:, -1].max())
        limits = thresholds.astype(np.float64) - slack
        # Dimensions before ``first`` of a row are left out of the index.
        first = (self.norms[:, 1:] * x_norms[:, 1:].max(axis=0) < limits.min()).sum(axis=1)
        places = np.flatnonzero(first < dims)
        sums = np.zeros((len(x), len(places)))
        for end in range(dims, 0, -STEP):
            start = max(end - STEP, 0)
            listed = np.arange(start, end) >= first[places, None]
            sums += x[:, start:end] @ (self.v[places, start:end] * listed).T
            rest = np.maximum(start, first[places])
            alive = (sums + x_norms[:, rest] * self.norms[places, rest] >= limits[:, None]).any(axis=0)
            if not alive.all():
                places, sums = places[alive], sums[:, alive]
            if not len(places):
                break
        return places


def threshold_join(vectors: DataFrame, visits: DataFrame, sizes: dict, same_label: bool,
                   most: int) -> DataFrame:
    """(row, slot, other, id, score): of each cell that an anchor visits, the first ``most`` rows of each of
    its windows. ``bounds`` of a visit hold the lowest and highest score of each window in
    turn; a window with lowest above highest is closed."""
    dims, doubles = sizes["dims"], exact_in_doubles(sizes)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = index = None
        for cell, batch in visits_of_cells(batches, dims, doubles):
            if cell is not held:
                held, index = cell, InvertedCell(cell)
            rows, labels = batch.column("row").to_numpy(), batch.column("label").to_numpy()
            anchors = matrix(batch.column("v"), dims, doubles)
            windows = np.array(batch.column("bounds").to_pylist(), np.int64).reshape(
                len(rows), -1, 2)
            low, high = windows[:, :, 0], windows[:, :, 1]
            threshold = np.where(low <= high, low, HIGHEST).min(axis=1)
            places = index.reaching(anchors, threshold)
            if not len(places):
                continue
            scores = products(anchors, cell.v[places])
            fits = (labels[:, None] == cell.label[places]) == same_label
            fits &= (rows[:, None] != cell.row[places]) & (scores >= threshold[:, None])
            for slot in range(windows.shape[1]):
                anchor, place = np.nonzero(
                    fits & (scores >= low[:, slot, None]) & (scores <= high[:, slot, None]))
                score = scores[anchor, place]
                some = first_of_each(anchor, score, cell.id[places[place]], most)
                anchor, place = anchor[some], places[place[some]]
                yield pa.record_batch(
                    [pa.array(rows[anchor]), pa.array(np.full(len(some), slot, np.int32)),
                     pa.array(cell.row[place]), cell.ids(place), pa.array(score[some])],
                    names=["row", "slot", "other", "id", "score"])

    return scanned(vectors, visits, scan, FOUND)


def first_rows(found: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("row", "slot").orderBy(
        F.col("score").desc(), F.col("id").asc_nulls_last(), "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _everywhere(anchors: DataFrame, cells: int) -> DataFrame:
    """The anchors at all cells."""
    return anchors.withColumn("cell", F.explode(F.sequence(
        F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))))


def _bounds(*values: Column) -> Column:
    return F.array(*[value.cast("long") for value in values])


def _percent(score: Column, percent: int) -> Column:
    """Smallest whole number that is at least so many percent of a score of 0 or more."""
    hundred = F.lit(100).cast("long")
    return (F.call_function("div", score, hundred) * percent
            + F.call_function("div", score % 100 * percent + 99, hundred))


def mined_rows(table: DataFrame, vector: str, id_column: str, label: Column) -> DataFrame:
    """(row, id, label, v, n2) of the rows that take part."""
    rows = table.where(usable(F.col(vector)) & label.isNotNull()).select(
        F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("id"),
        label.cast("long").alias("label"), whole(F.col(vector)).alias("v"))
    return rows.withColumn("n2", norm2(F.col("v")))


def find_positives(vectors: DataFrame, anchors: DataFrame, sizes: dict, cells: int, most: int,
                   folder: str) -> DataFrame:
    """(row, slot, other, id, score, rank) of the first rows with the anchor's label."""
    lowest, highest = F.lit(LOWEST), F.lit(HIGHEST)
    near = first_rows(threshold_join(
        vectors, anchors.withColumn("bounds", _bounds(lowest, highest)), sizes, True, most), most)
    worst = written(near.where(F.col("rank") == most).select("row", F.col("score").alias("worst")),
                    f"{folder}/worst")
    thresholds = anchors.drop("cell").join(worst, "row", "left").select(
        "row", "label", "v", _bounds(F.coalesce("worst", lowest), highest).alias("bounds"))
    return written(first_rows(threshold_join(
        vectors, _everywhere(thresholds, cells), sizes, True, most), most), f"{folder}/positives")


def find_negatives(vectors: DataFrame, anchors: DataFrame, positives: DataFrame, sizes: dict,
                   cells: int, most: int, levels: tuple[int, ...], slots: int,
                   folder: str) -> DataFrame:
    """(row, slot, other, id, score) that fill the windows; slot is the positive's rank less one.

    ``levels`` are falling percents; the last is the end of the windows."""
    windows = positives.where(F.col("score") >= 0).select(
        "row", (F.col("rank") - 1).alias("slot"), F.col("score").alias("top"))
    found = None
    above = None
    for number, level in enumerate(levels):
        high = F.col("top") if above is None else _percent(F.col("top"), above) - 1
        edges = F.struct(F.col("slot"), _bounds(_percent(F.col("top"), level), high).alias("edges"))
        # At most one window for each of the few positives of an anchor.
        closed = F.array(F.lit(HIGHEST), F.lit(LOWEST))
        wanted = windows.groupBy("row").agg(
            F.map_from_entries(F.collect_list(edges)).alias("open")).select("row", F.flatten(F.transform(
                F.sequence(F.lit(0), F.lit(slots - 1)),
                lambda slot: F.coalesce(F.col("open")[slot], closed))).alias("bounds"))
        visits = anchors.drop("cell").join(wanted, "row")
        hits = threshold_join(vectors, _everywhere(visits, cells), sizes, False, most)
        new = written(first_rows(hits, most).drop("rank"), f"{folder}/negatives-{number}")
        found = new if found is None else found.unionByName(new)
        filled = found.groupBy("row", "slot").agg(F.count("*").alias("n")).where(F.col("n") >= most)
        windows = windows.join(filled.select("row", "slot"), ["row", "slot"], "left_anti")
        above = level
    return found


def hard_negatives(table: DataFrame, label: Column | None = None, every: int = 100,
                   n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, least: int = LEAST,
                   vector: str = "embedding", id_column: str = "vec_id") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each positive of each
    row whose id is divisible by ``every``, the first rows of another label in its window."""
    folder = work_folder(table.sparkSession, "negatives")
    label = F.col("label") if label is None else label
    rows = written(mined_rows(table, vector, id_column, label), f"{folder}/rows")
    sizes = sizes_of(rows)
    cells = max(1, -(-sizes["rows"] // CELL_ROWS))
    vectors = rows.select("row", "id", "label", "v", F.pmod(
        F.xxhash64("row"), F.lit(cells).cast("long")).alias("cell"))
    chosen = vectors.where(F.col("id") % every == 0)
    anchors = chosen.select("row", "label", "v", "cell")
    positives = find_positives(vectors, anchors, sizes, cells, n_positives, folder)
    levels = tuple(x for x in LEVELS if x > least) + (least,)
    negatives = first_rows(find_negatives(vectors, anchors, positives, sizes, cells, n_negatives, levels,
                                          n_positives, folder), n_negatives)
    named = positives.select("row", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"),
                             F.col("score").alias("positive_score"))
    return (negatives.select("row", "slot", "rank", F.col("id").alias("negative_id"),
                             F.col("score").alias("negative_score"))
            .join(named, ["row", "slot"])
            .join(chosen.select("row", F.col("id").alias("anchor_id")), "row")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score",
                    "negative_score"))
