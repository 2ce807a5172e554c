"""Token counts by a map-side lookup in two tiers; no pre-token is ever shuffled.

A SentencePiece model without pieces that run on past a space divides at every run of spaces and
at every line feed, so a text's count is the sum over its *pre-tokens*. A first pass finds the
pre-tokens that are frequent in the corpus: every task keeps a bounded summary (its counts are
cut whenever it is full) and only entries above a share of the task's pre-tokens leave it. Their
lengths in tokens form a compact hash table of at most ``table_size`` entries, which is broadcast.
The second pass looks every pre-token up there; misses are encoded, through a bounded cache of
the worker. The table decides speed only: counts are the library's for every text.

Null and empty texts have 0 bytes and 0 tokens. Repeated rows are counted row by row; other
columns are left out of the result unless named in ``keep``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokentariff.llm.text import prepare_workers

TABLE_SIZE = 16_384
SUMMARY_SIZE = 65_536
SHARE = 1 / 16_384
CACHE_SIZE = 500_000
LONG_PRE_TOKEN = 48
PRE_TOKEN = re.compile("(?: +|\\n|^)[^ \\n]*")


def pre_tokens(text: str) -> list[str]:
    return PRE_TOKEN.findall(text.replace("▁", " "))


def load_encoder(model: str):
    """``model`` is a path, or the name of a file of the ``public_tokenizers`` package."""
    import os

    import sentencepiece

    if not os.path.isabs(model):
        import public_tokenizers
        model = public_tokenizers.path(model)
    return sentencepiece.SentencePieceProcessor(model_file=model)


def divides_at_spaces(encoder) -> bool:
    """No piece goes on after a space or holds a line feed among others."""
    pieces = map(encoder.id_to_piece, range(encoder.get_piece_size()))
    return not any(re.search("[^▁]▁|\\n", piece) for piece in pieces)


def encoded_lengths(encoder, pre_tokens: list[str]) -> list[int]:
    """Tokens of every pre-token inside a text. The library puts a space before what it is given;
    it stands for the first space, and before a line feed it is a token of its own to take off."""
    spaced = [p.startswith(" ") for p in pre_tokens]
    found = encoder.encode([p[1:] if s else p for p, s in zip(pre_tokens, spaced)], num_threads=1)
    return [max(len(ids), p == " ") if s else len(ids) - 1
            for p, s, ids in zip(pre_tokens, spaced, found)]


class Lengths:
    """The broadcast table, and behind it a bounded cache of what the table lacks."""

    def __init__(self, table: dict[str, int], encoder):
        self.table, self.encoder = table, encoder
        self.misses: dict[str, int] = {}

    def length(self, pre_token: str) -> int:
        length = self.table.get(pre_token)
        return self.misses[pre_token] if length is None else length

    def counts(self, texts) -> list[int]:
        """Tokens of every text; what neither tier knows is encoded together."""
        # The space that the library puts before a text joins the run of spaces it begins with.
        found = [pre_tokens(" " + text) if text else [] for text in texts]
        new = list(set().union(*found).difference(self.table, self.misses))
        if len(self.misses) + len(new) > CACHE_SIZE:
            self.misses.clear()
            new = list(set().union(*found).difference(self.table))
        self.misses.update(zip(new, encoded_lengths(self.encoder, new)))
        totals = [sum(map(self.length, pieces)) for pieces in found]
        for pre_token in new:
            if len(pre_token) > LONG_PRE_TOKEN:
                del self.misses[pre_token]
        return totals


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: Counter = Counter()
    total = cut = 0
    for batch in batches:
        for text in batch["text"]:
            if text:
                found = pre_tokens(" " + text)
                total += len(found)
                counts.update(found)
                if len(counts) > SUMMARY_SIZE:
                    middle = sorted(counts.values())[len(counts) // 2]
                    cut += middle
                    counts = Counter({k: n - middle for k, n in counts.items() if n > middle})
    least = total * SHARE - cut
    often = [(k, n) for k, n in counts.items() if n > least and 0 < len(k) <= LONG_PRE_TOKEN]
    yield pd.DataFrame(often, columns=["pre_token", "n"])


def frequent_lengths(documents: DataFrame, model: str, table_size: int = TABLE_SIZE) -> dict:
    """At most ``table_size`` pre-tokens of the whole corpus with their lengths in tokens."""
    often = (documents.select("text").mapInPandas(_summaries, "pre_token string, n long")
             .groupBy("pre_token").agg(F.sum("n").alias("n"))
             .orderBy(F.desc("n"), "pre_token").limit(table_size).collect())
    names = [row.pre_token for row in often]
    return dict(zip(names, encoded_lengths(load_encoder(model), names)))


def token_counts(documents: DataFrame, model: str, limit: int = 4096,
                 keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_bytes, n_tokens and over_limit of every row's whole ``text``."""
    spark = documents.sparkSession
    prepare_workers(spark)
    if not divides_at_spaces(load_encoder(model)):
        raise ValueError(f"{model} has pieces that run past a space; it can't be counted in parts")
    table = spark.sparkContext.broadcast(frequent_lengths(documents, model))

    @F.pandas_udf("long")
    def tokens(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lengths = Lengths(table.value, load_encoder(model))
        for batch in texts:
            yield pd.Series(lengths.counts(batch), dtype="int64")

    text = F.coalesce("text", F.lit(""))
    counted = documents.select(*keep, F.octet_length(text).cast("long").alias("n_bytes"),
                               tokens(text).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
