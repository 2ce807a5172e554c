"""Line deduplication on levelled sorted runs of line hashes.

Lines are logged once as (document, row, place, hash of the line's key) and cut into batches of
falling document ids. A *run* is a table in buckets of the hash, sorted by it, that holds, for every hash of its
batch, in how many documents it was seen and the largest of their ids. A new batch is counted by hash and
merge-anti-joins the runs: hashes that the runs have settled already (seen in ``least`` documents, all
with larger ids than any of this batch) are left out; the others form the batch's own run
on level 0. When a level has ``fanout`` runs, they are compacted into one run of the next level. Batch and
runs are in the same buckets, so neither step shuffles a run.
At the end the runs say which hashes are repeated and which document keeps its lines; lines
of the log that merge with those are dropped.

A key is the line without blanks at both ends and with A-Z lower-cased. Keys shorter than
``shortest`` code points are always kept, and so not logged. Hashes are md5 (128 bits).

Null and empty texts are one empty line. Rows with the same doc_id are one document; a null
doc_id counts as an id below all others. Equal rows get equal results. The runs live in the shared
folder (spark.checkpoint.dir); nothing of them passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokentariff.llm.text import (BLANKS, ascii_lower, bucketed, packed, unpacked, work_folder,
                                  written)

SHORTEST, LEAST = 40, 5
BATCHES, FANOUT = 4, 2
NULL_ID = -(2**63)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


class LineRuns:
    """Levels of runs of (hash, n_docs, last_doc), as tables in a folder."""

    def __init__(self, spark: SparkSession, folder: str, least: int = LEAST, fanout: int = FANOUT):
        self.spark, self.folder, self.least, self.fanout = spark, folder, least, fanout
        self.levels: list[list[DataFrame]] = [[]]
        self.made = 0

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def _write(self, run: DataFrame) -> DataFrame:
        self.made += 1
        return bucketed(run, f"{self.folder}/run-{self.made}", "hash")

    def add(self, batch: DataFrame) -> None:
        """``batch``: (hash, doc) with every doc below those of earlier batches."""
        # Two steps, so that a line of very many documents is counted by many tasks.
        seen = batch.groupBy("hash", "doc").agg(F.lit(1).alias("one"))
        own = seen.groupBy("hash").agg(F.sum("one").cast("long").alias("n_docs"),
                                       F.max("doc").alias("last_doc"))
        for run in self.runs():
            own = self.unsettled(own, run)
        self.levels[0].append(self._write(own))
        self._compact()

    def unsettled(self, own: DataFrame, run: DataFrame) -> DataFrame:
        """The hashes that the run has not settled. The documents of a settled one are all larger, and
        that as a condition keeps the join above the count, where every hash is one row."""
        settled = run.where(F.col("n_docs") >= self.least).select(
            F.col("hash").alias("_hash"), F.col("last_doc").alias("_last"))
        return own.hint("merge").join(
            settled.hint("merge"), (F.col("hash") == F.col("_hash"))
            & (F.col("last_doc") < F.col("_last")), "left_anti")

    def _compact(self) -> None:
        for i, level in enumerate(self.levels):
            if len(level) < self.fanout:
                return
            if i + 1 == len(self.levels):
                self.levels.append([])
            self.levels[i + 1].append(self._write(self._merge(level)))
            self.levels[i] = []

    @staticmethod
    def _merge(runs: list[DataFrame]) -> DataFrame:
        """One run of two or more, by merge joins of their buckets."""
        merged = runs[0]
        for run in runs[1:]:
            other = run.select("hash", F.col("n_docs").alias("_n"), F.col("last_doc").alias("_last"))
            merged = merged.hint("merge").join(other.hint("merge"), "hash", "full").select(
                "hash", (F.coalesce("n_docs", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("n_docs"),
                F.greatest("last_doc", "_last").alias("last_doc"))
        return merged

    def repeated(self) -> DataFrame:
        """(hash, last_doc) of the lines found in ``least`` documents or more."""
        runs = self.runs()
        totals = runs[0] if len(runs) == 1 else self._merge(runs)
        return totals.where(F.col("n_docs") >= self.least).select("hash", "last_doc")


def _doc(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def line_log(documents: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """(doc, row, place, hash) of every line whose key is long enough; row tells texts apart."""
    lines = documents.select(_doc().alias("doc"), F.xxhash64("text").alias("row"),
                             F.posexplode(lines_of(F.col("text"))).alias("place", "line"))
    return (lines.where(F.length("line") >= shortest)
            .select("doc", "row", "place", line_key(F.col("line")).alias("key"))
            .where(F.length("key") >= shortest)
            .select("doc", "row", "place", F.unhex(F.md5("key")).alias("hash")))


def batch_bounds(log: DataFrame, batches: int) -> list[int]:
    """Document ids that divide the log into batches of about the same number of lines."""
    parts = [i / batches for i in range(1, batches)]
    if not parts:
        return []
    found = log.agg(F.percentile_approx("doc", parts, 1_000)).first()[0]
    return sorted(set(found or []))


def drop_repeated_lines(documents: DataFrame, shortest: int = SHORTEST, least: int = LEAST,
                        batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """All columns, with lines dropped from ``text``, and _n_lines and _n_dropped."""
    spark = documents.sparkSession
    folder = work_folder(spark, "lines")
    log = written(line_log(documents, shortest), f"{folder}/log")
    runs = LineRuns(spark, folder, least, fanout)
    bounds = [None, *batch_bounds(log, batches), None]
    for low, high in reversed(list(zip(bounds, bounds[1:]))):
        inside = log
        if low is not None:
            inside = inside.where(F.col("doc") > low)
        if high is not None:
            inside = inside.where(F.col("doc") <= high)
        runs.add(inside.select("hash", "doc"))
    repeated = written(runs.repeated(), f"{folder}/repeated")
    dropped = (log.join(repeated, "hash").where(F.col("doc") != F.col("last_doc"))
               .groupBy("doc", "row").agg(F.sort_array(F.collect_set("place")).alias("_places")))
    rows = packed(documents, "doc_id", "text").withColumns(
        {"_doc": _doc(), "_row": F.xxhash64("text")})
    joined = rows.join(dropped, (F.col("_doc") == dropped["doc"])
                       & (F.col("_row") == dropped["row"]), "left")
    lines = lines_of(F.col("text"))
    # The kept lines lie between the places; -1 and the number of lines close both ends.
    cut = joined.withColumn("_lines", lines).withColumn("_places", F.concat(
        F.array(F.lit(-1)), F.coalesce("_places", F.array().cast("array<int>")),
        F.array(F.size("_lines"))))
    between = F.transform(F.sequence(F.lit(1), F.size("_places") - 1), lambda k: F.slice(
        F.col("_lines"), F.element_at("_places", k) + 2,
        F.element_at("_places", k + 1) - F.element_at("_places", k) - 1))
    kept = F.when(F.size("_places") == 2, F.coalesce("text", F.lit(""))).otherwise(
        F.array_join(F.flatten(between), "\n"))
    whole = unpacked(documents.columns, ("doc_id", "text"))
    text = [kept.alias("text") if c == "text" else whole[i]
            for i, c in enumerate(documents.columns)]
    return cut.select(*text, F.size("_lines").cast("long").alias("_n_lines"),
                      (F.size("_places") - 2).cast("long").alias("_n_dropped"))
