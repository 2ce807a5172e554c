"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item is cut into *windows* of 13 words (an item of fewer words is one window). A
window counts as found where all its words follow each other in a document, so its containment
must be 1, and of its word shingles in any fixed order the first alone is a necessary prefix.
Shingles are ordered by rarity: their occurrences in the whole corpus are counted first. Documents
then join on the one prefix shingle of every window; the place of the shingle in its window gives
the only start that is possible (positional bound), the window has to lie within the document
(length bound), and the words of the window are compared (exact verification).

The benchmark side is broadcast in blocks of at most ``block_windows`` windows; a benchmark of
more windows takes more passes over the documents, never a larger broadcast. The blocks' spans
meet per document in a shuffle that only then exists. Documents are not shuffled otherwise.

Null, empty and word-less texts have no words, no hits and aren't contaminated; such items have no
windows. Items with the same id count once. Repeated documents are judged row by row.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokentariff.llm.shingles import ALPHANUMERIC, WordHashes, windows, words_of
from tokentariff.llm.text import packed, prepare_workers, unpacked, work_folder, written

WINDOW = 13
SHINGLE = 5
BLOCK_WINDOWS = 200_000
SPANS = "array<struct<start:int,end:int>>"


class Items:
    """The windows of a block of items, by the rarest shingle of each."""

    def __init__(self, items: list[tuple[int, str]], window: int, shingle: int):
        by_window: dict[tuple[bytes, ...], set[int]] = defaultdict(set)
        for item_id, text in items:
            words = words_of(text, ALPHANUMERIC)
            size = min(window, len(words))
            for i in range(len(words) - size + 1 if size else 0):
                by_window[tuple(words[i:i + size])].add(item_id)
        self.windows = list(by_window)
        self.ids = [sorted(ids, key=lambda x: (x is None, x)) for ids in by_window.values()]
        hashes = WordHashes()
        self.shingles = [(min(shingle, len(w)), windows(hashes.of(w), min(shingle, len(w))))
                         for w in self.windows]
        self.rarest: dict[int, np.ndarray] = {}
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def all_shingles(self) -> dict[int, np.ndarray]:
        """Sorted shingles by their number of words."""
        found = defaultdict(list)
        for size, values in self.shingles:
            found[size].append(values)
        return {size: np.unique(np.concatenate(v)) for size, v in found.items()}

    def order(self, counts: dict[int, int]) -> None:
        """Choose the rarest shingle of every window; ties go to the smaller hash."""
        chosen = defaultdict(set)
        for i, (size, values) in enumerate(self.shingles):
            place = min(range(len(values)), key=lambda k: (counts.get(int(values[k]), 0), values[k]))
            key = int(values[place])
            chosen[size].add(key)
            self.places[key].append((i, place))
        self.rarest = {size: np.array(sorted(keys), dtype=np.uint64)
                       for size, keys in chosen.items()}
        self.shingles = []


def _known(values: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    """Positions of the values that are among the keys."""
    at = np.searchsorted(sorted_keys, values)
    at[at == len(sorted_keys)] = 0
    return np.flatnonzero(sorted_keys[at] == values)


def _occurrences(documents: DataFrame, wanted) -> dict[int, int]:
    """How often each wanted shingle occurs in the whole corpus."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, counts = WordHashes(), Counter()
        for batch in batches:
            for text in batch["text"]:
                found = hashes.of(words_of(text, ALPHANUMERIC))
                for size, keys in wanted.value.items():
                    values = windows(found, size)
                    if len(values):
                        counts.update(values[_known(values, keys)].tolist())
        yield pd.DataFrame({"key": np.array(list(counts), dtype=np.uint64).view(np.int64),
                            "n": np.array(list(counts.values()), dtype=np.int64)})

    rows = (documents.select("text").mapInPandas(count, "key long, n long")
            .groupBy("key").agg(F.sum("n").alias("n")).collect())
    return {row.key % 2**64: row.n for row in rows}


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _block_hits(documents: DataFrame, items) -> DataFrame:
    """The packed documents, with n_words, spans (hit words) and items of this block."""

    @F.pandas_udf(f"n_words long, spans {SPANS}, items array<long>")
    def hits(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hashes, block = WordHashes(), items.value
        for batch in texts:
            rows = []
            for text in batch:
                words = words_of(text, ALPHANUMERIC)
                found, spans, ids = hashes.of(words), [], set()
                for size, keys in block.rarest.items():
                    values = windows(found, size)
                    if not len(values):
                        continue
                    for at in _known(values, keys).tolist():
                        for i, place in block.places[int(values[at])]:
                            window, start = block.windows[i], at - place
                            end = start + len(window)
                            if 0 <= start and end <= len(words) \
                                    and tuple(words[start:end]) == window:
                                spans.append((start, end))
                                ids.update(block.ids[i])
                ids = sorted(ids - {None}) + [None] * (None in ids)
                rows.append((len(words), merged(spans), ids))
            yield pd.DataFrame(rows, columns=["n_words", "spans", "items"])

    return documents.withColumn("_hits", hits("text")).select(
        *[F.col(f"`{c}`") for c in documents.columns], "_hits.*")


def item_blocks(benchmark: DataFrame, window: int, block_windows: int) -> int:
    """Blocks that the benchmark needs, counted before anything of it reaches the driver."""
    words = F.size(F.split("text", "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"))
    bound = F.greatest(words - window + 3, F.lit(1))
    total = benchmark.agg(F.sum(F.when(F.col("text").isNotNull(), bound))).first()[0] or 0
    return max(1, -(-total // block_windows))


def benchmark_hits(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                   shingle: int = SHINGLE, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Every row of ``documents`` with n_words, spans of hit words and the items found.

    Columns of these names are replaced; all others are kept whatever their names.
    """
    spark = documents.sparkSession
    prepare_workers(spark)
    columns = documents.columns
    documents = packed(documents, "text")
    items = benchmark.select("item_id", "text")
    n = item_blocks(items, window, block_windows)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    folder = work_folder(spark, "decontamination") if n > 1 else None
    result = unpacked(columns, ("text",), n_words=F.col("n_words"), spans=F.col("spans"),
                      items=F.col("items"))
    text_id = F.md5(F.coalesce("text", F.lit(""))).alias("_text")
    found = None
    for i in range(n):
        # One block is on the driver and the workers at a time.
        block = Items([(r.item_id, r.text) for r in items.where(part == i).collect()], window, shingle)
        wanted = spark.sparkContext.broadcast(block.all_shingles())
        block.order(_occurrences(documents, wanted))
        wanted.destroy()
        shared = spark.sparkContext.broadcast(block)
        if n == 1:
            return _block_hits(documents, shared).select(*result)
        # Hits depend on the text alone, so they are kept by its digest.
        hits = written(_block_hits(documents.select("text"), shared).where(F.size("items") > 0)
                       .select(text_id, "spans", "items").dropDuplicates(["_text"]),
                       f"{folder}/hits-{i}")
        shared.destroy()
        found = hits if found is None else found.unionByName(hits)
    keyed = found.groupBy("_text").agg(
        F.flatten(F.collect_set("spans")).alias("_spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("_items"))
    words = F.regexp_count(F.col("text"), F.lit("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"))
    return (documents.withColumn("_text", text_id).join(keyed, "_text", "left")
            .withColumns({"n_words": F.coalesce(words, F.lit(0)).cast("long"),
                          "spans": F.coalesce("_spans", F.array().cast(f"{SPANS}")),
                          "items": F.coalesce("_items", F.array().cast("array<long>"))})
            .select(*result))


def judged(hits: DataFrame, one_in: int = 20) -> DataFrame:
    """Add n_hit, and contaminated: one word in ``one_in`` is hit, or more."""
    covered = F.aggregate(
        F.array_sort("spans"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(s["end"] - F.greatest(s["start"], acc["end"]), F.lit(0)))
            .alias("n"), F.greatest(acc["end"], s["end"]).alias("end")),
        lambda acc: acc["n"].cast("long"))
    return hits.withColumn("n_hit", covered).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * one_in >= F.col("n_words")))
