"""The corpus pipeline: five filters over ``documents``, each written as Parquet before the next.

Toxic documents go, repeated lines go, one document of each group of near duplicates stays,
contaminated documents go, and what is left is mixed to the sources' target weights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokentariff.llm import decontamination, line_runs, mixing, ngram_join, toxicity
from tokentariff.llm.text import packed, unpacked, work_folder, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on the labelled ones among them, lets pass."""
    model = toxicity.fit(docs.select("doc_id", "text"),
                         spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score_texts(packed(docs, "text"), model)
    return scored.where(F.col("predicted") == 0).select(*unpacked(docs.columns, ("text",)))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that repeat across them; n_chars follows the text."""
    kept = line_runs.drop_repeated_lines(packed(docs, "doc_id", "text"))
    whole = unpacked(docs.columns, ("doc_id", "text"))
    return kept.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else whole[i]
                         for i, c in enumerate(docs.columns)])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group; rows without an id stay."""
    groups = ngram_join.ngram_components(docs.select("doc_id", "text"))
    others = groups.where(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(
        *[F.col(f"`{c}`") for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lies in benchmark passages."""
    hits = decontamination.benchmark_hits(packed(docs, "text"),
                                          spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return decontamination.judged(hits).where(~F.col("contaminated")).select(
        *unpacked(docs.columns, ("text",)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix with size, target and ``taken``, the words that it takes of each,
    repeats counted; these replace columns of their names."""
    made = ("size", "target", "taken")
    mixed = mixing.mix(docs, keep=tuple(docs.columns)).where(F.col("taken") > 0)
    return mixed.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in made
                          and c.lower() != "source_size"], *made)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines),
          ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated),
          ("mixing", mix_sources)]

# The first stage is a trained model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = work_folder(spark, "pipeline")
    for place, (name, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"{folder}/{place}-{name}")
    return docs
