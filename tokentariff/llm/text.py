"""Native text expressions that several operators share."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokentariff.sources.staging import shared_folder

BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value evaluated once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def without(text: Column, characters: str) -> Column:
    """The text without these characters; a search for each is cheaper than a lookup of all."""
    for character in characters:
        text = F.replace(text, F.lit(character), F.lit(""))
    return text


def packed(frame: DataFrame, *needed: str) -> DataFrame:
    """The needed columns, and all others in one struct ``_given``, where no name can clash."""
    rest = [F.col(f"`{c}`") for c in frame.columns if c not in needed]
    given = F.struct(*rest) if rest else F.struct(F.lit(None).cast("int").alias("none"))
    return frame.select(*[F.col(f"`{c}`") for c in needed], given.alias("_given"))


def unpacked(columns: list[str], needed: tuple[str, ...], **made: Column) -> list[Column]:
    """The columns of a frame before ``packed``, in order, and those made. A made column takes the
    place of one with its name."""
    names = {name.lower() for name in made}
    before = [F.col(f"`{c}`") if c in needed else F.col(f"_given.`{c}`") for c in columns
              if c.lower() not in names]
    return [*before, *[column.alias(name) for name, column in made.items()]]


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for a table of this run, below the cluster's shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(frame: DataFrame, path: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: its lineage ends there."""
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def bucketed(frame: DataFrame, path: str, key: str) -> DataFrame:
    """The frame as a table in the shared folder, in sorted buckets of the key: joins and groups on
    the key read it without an exchange. There are as many buckets as shuffle partitions."""
    spark = frame.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"buckets_{uuid.uuid4().hex}"
    frame.write.bucketBy(parts, key).sortBy(key).option("path", path).saveAsTable(name)
    return spark.table(name)


def prepare_workers(spark: SparkSession, rows: int = 256) -> None:
    """Let Python workers import this package from where the driver has it (a cluster that
    ships it with --py-files needs no more), and give them few whole texts at a time."""
    home = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if home not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([home, *filter(None, paths)])
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))
