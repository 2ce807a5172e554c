"""Deterministic sharded WARC writer, and the reader that takes the archives apart again.

Records are sorted by range of page id into shards. The bounds of the ranges follow from exact sums of
payload bytes per range of ids, refined a few times, and not from a sample, so a rerun cuts at
the same ids. A shard is a series of files, and a new file begins
when the compressed size of the last has reached ``roll_bytes``; every record is a gzip member of
its own. Headers are made anew from the row: record ids are UUIDs of page id and payload digest, the
date is a parameter, digests are SHA-256 of block and payload. So an archive's bytes depend on its
rows only, and a task that runs twice writes the same files. Ids reach Python as strings, since pandas
would round large ones beside a null.

Of records with the same payload of ``least_bytes`` or more, the one with the smallest page id is the
response and the others are revisits that refer to it. Payloads cross the network once: references
of revisits are sorted into the shards beside the rows, each ahead of its row.

A file is written under a temporary name with the attempt's number and then renamed. Tasks return
a line for each file they finished; these lines are written as a Parquet table, the manifest,
whose commit is the archive's: a reader opens what the manifest names, so files of lost attempts
are never read. Paths are any that pyarrow's filesystems reach (file, hdfs, s3, gs).

Null HTML is an empty payload. A null page id is a record without that header, sorted first; rows
that repeat a page id are records of their own, of which equal ones refer to that id. A null URL
is an empty target; characters that can't stand in a header are percent-encoded.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokentariff.llm.text import prepare_workers

LEAST_BYTES = 100
ROLL_BYTES = 16_000_000
DATE = "2024-01-01T00:00:00Z"
SHARD_BYTES = 32_000_000
RANGES, REFINEMENTS = 65_536, 3  # ranges of ids whose bytes are summed at once, and how often
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # namespace of URLs, RFC 4122
MANIFEST = ("shard int, file string, records long, bytes long, sha256 string, "
            "first_page long, last_page long")
RECORD = ("page_id long, url string, record_type string, refers_to long, payload_bytes long, "
          "payload_digest string, payload binary")


def filesystem(path: str):
    """A pyarrow filesystem and the path in it, of a URI or a plain path."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id}/{digest}')}>"


def record_bytes(page_id, url: str | None, payload: bytes, refers_to, date: str,
                 revisit: bool) -> bytes:
    """One record, uncompressed: a response with its payload, or a revisit without."""
    digest = hashlib.sha256(payload).hexdigest()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" \
           b"Content-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    headers = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page_id, digest),
        "WARC-Date": date,
        "WARC-Target-URI": quote(url or "", safe="!#$%&'()*+,/:;=?@[]~"),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
        "X-Payload-Length": str(len(payload)),
    }
    if page_id is not None:
        headers["X-Page-ID"] = str(page_id)
    if revisit:
        headers["WARC-Profile"] = PROFILE
        headers["WARC-Refers-To"] = record_id(refers_to, digest)
        headers["X-Refers-To-Page"] = str(refers_to)
    head = "".join(f"{name}: {value}\r\n" for name, value in headers.items())
    return f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def references(pages: DataFrame, least_bytes: int) -> DataFrame:
    """(page_id, digest, refers_to) of the groups of equal payloads, from digests alone."""
    sized = pages.select("page_id", F.octet_length("html").alias("size"),
                         F.unhex(F.sha2("html", 256)).alias("digest")).where(
        (F.col("size") >= least_bytes) & F.col("page_id").isNotNull())
    groups = sized.groupBy("digest").agg(F.min("page_id").alias("refers_to"),
                                         F.count("*").alias("n")).where("n > 1")
    return sized.join(groups, "digest").select("page_id", "digest", "refers_to").distinct()


def byte_sums(sizes: DataFrame, edges: np.ndarray) -> np.ndarray:
    """Bytes of the rows (id, size) in each range; range i ends before edge i, the last has no end."""
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(edges) + 1)
        for batch in batches:
            at = np.searchsorted(edges, batch.column(0).to_numpy(), side="right")
            total += np.bincount(at, batch.column(1).to_numpy(), len(total))
        found = np.flatnonzero(total)
        yield pa.record_batch([pa.array(found), pa.array(total[found])], names=["at", "bytes"])

    rows = sizes.mapInArrow(summed, "at long, bytes double").groupBy("at").agg(
        F.sum("bytes").alias("bytes")).toPandas()
    out = np.zeros(len(edges) + 1)
    out[rows["at"].to_numpy(np.int64)] = rows["bytes"].to_numpy()
    return out


def _cut(edges: np.ndarray, sums: np.ndarray, parts: int, low: int, high: int) -> np.ndarray:
    """Ids that part the bytes into ``parts`` about equal parts, as if even inside a range."""
    bounds = [low, *edges.tolist(), high]
    upto = np.concatenate([[0.0], np.cumsum(sums)])
    wanted = upto[-1] * np.arange(1, parts) / parts
    at = np.clip(np.searchsorted(upto, wanted, side="right") - 1, 0, len(sums) - 1)
    share = (wanted - upto[at]) / np.where(sums[at] > 0, sums[at], 1)
    cuts = {bounds[i] + int((bounds[i + 1] - bounds[i]) * f) for i, f in zip(at, share)}
    return np.array(sorted(c for c in cuts if low < c <= high), np.int64)


def shard_bounds(sizes: DataFrame, shards: int | None) -> np.ndarray:
    """First ids of all shards but the first, from the rows (id, size)."""
    span = sizes.agg(F.min("id"), F.max("id"), F.sum("size")).first()
    low, high, total = span[0] or 0, span[1] or 0, span[2] or 0
    shards = shards or max(1, -(-int(total) // SHARD_BYTES))
    if shards == 1 or low == high or not total:
        return np.zeros(0, np.int64)
    step = max(1, (high - low) // RANGES)
    edges = np.array(range(low + step, high, step)[:RANGES], np.int64)
    for turn in range(REFINEMENTS + 1):
        sums = byte_sums(sizes, edges)
        if turn == REFINEMENTS or sums.max() * 8 <= total / shards:
            break
        edges = _cut(edges, sums, RANGES, low, high)
    return _cut(edges, sums, shards, low, high)


def shard_of(bounds: np.ndarray, page_id: Column) -> Column:
    """Number of the shard that an id (null: the first) belongs to."""
    @F.pandas_udf("int")
    def numbered(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(), side="right").astype(np.int32))

    return numbered(F.coalesce(page_id, F.lit(LOWEST)))


class Shard:
    """Writes the files of a shard, one at a time, each under a temporary name until finished."""

    def __init__(self, folder: str, shard: int, attempt: int, roll_bytes: int):
        self.fs, self.path = filesystem(folder)
        self.shard, self.attempt, self.roll_bytes = shard, attempt, roll_bytes
        self.files = 0
        self.out = None

    def add(self, page_id, record: bytes) -> Iterator[tuple]:
        if self.out is None:
            self.name = f"shard-{self.shard:06d}-{self.files:05d}.warc.gz"
            self.temporary = f"{self.path}/.{self.name}.{self.attempt}.tmp"
            self.out = self.fs.open_output_stream(self.temporary, compression=None)
            self.size, self.records, self.first = 0, 0, page_id
            self.sha = hashlib.sha256()
        member = io.BytesIO()
        with gzip.GzipFile(fileobj=member, mode="wb", compresslevel=6, mtime=0, filename="") as z:
            z.write(record)
        member = member.getvalue()
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)
        self.records += 1
        self.last = page_id
        if self.size >= self.roll_bytes:
            yield self.finish()

    def finish(self) -> tuple:
        self.out.close()
        self.out = None
        self.files += 1
        self.fs.move(self.temporary, f"{self.path}/{self.name}")
        return (self.shard, self.name, self.records, self.size, self.sha.hexdigest(), self.first,
                self.last)


def write_archive(pages: DataFrame, folder: str, shards: int | None = None,
                  roll_bytes: int = ROLL_BYTES, least_bytes: int = LEAST_BYTES,
                  date: str = DATE) -> DataFrame:
    """Write ``pages`` (page_id, url, html) below ``folder``; return the manifest that was written."""
    spark = pages.sparkSession
    prepare_workers(spark)
    fs, path = filesystem(folder)
    fs.create_dir(f"{path}/data", recursive=True)
    html = F.coalesce(F.col("html"), F.lit(""))
    page = F.col("page_id").cast("long").alias("page_id")
    rows = pages.select(page, F.col("url").cast("string").alias("url"), html.alias("html"))
    bounds = shard_bounds(rows.select(
        F.coalesce("page_id", F.lit(LOWEST)).alias("id"),
        F.octet_length("html").cast("double").alias("size")), shards)
    empty = F.lit(None)
    both = rows.select("page_id", F.lit(1).alias("kind"), "url", "html", F.xxhash64("html", "url")
                       .alias("tie"), empty.cast("binary").alias("digest"),
                       empty.cast("string").alias("refers_to")).unionByName(
        references(rows, least_bytes).select(
            "page_id", F.lit(0).alias("kind"), empty.cast("string").alias("url"),
            empty.cast("string").alias("html"), empty.cast("long").alias("tie"), "digest",
            F.col("refers_to").cast("string").alias("refers_to")))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        attempt = TaskContext.get().taskAttemptId()
        shard = None
        refers: dict[bytes, int] = {}
        current, done, answered = object(), [], set()
        for batch in batches:
            for number, page_id, kind, url, html, digest, target in zip(
                    batch["shard"], batch["page"], batch["kind"], batch["url"], batch["html"],
                    batch["digest"], batch["refers_to"]):
                page_id = None if pd.isna(page_id) else int(page_id)
                if shard is None or shard.shard != number:
                    if shard is not None and shard.out is not None:
                        done.append(shard.finish())
                    shard = Shard(f"{folder}/data", int(number), attempt, roll_bytes)
                if page_id != current:
                    current, refers, answered = page_id, {}, set()
                if kind == 0:
                    refers[bytes(digest)] = int(target)
                    continue
                payload = html.encode("utf-8", "surrogatepass")
                key = hashlib.sha256(payload).digest()
                target = refers.get(key)
                revisit = target is not None and (target != page_id or key in answered)
                answered.add(key)
                record = record_bytes(page_id, None if pd.isna(url) else url, payload, target, date,
                                      revisit)
                done += shard.add(page_id, record)
            if done:
                yield manifest_rows(done)
                done = []
        if shard is not None and shard.out is not None:
            done.append(shard.finish())
        if done:
            yield manifest_rows(done)

    # A partition for each shard, in order of the ids.
    sorted_ = (both.withColumn("shard", shard_of(bounds, F.col("page_id")))
               .repartitionById(len(bounds) + 1, "shard")
               .sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "kind", "tie")
               .select("shard", F.col("page_id").cast("string").alias("page"), "kind", "url", "html",
                       "digest", "refers_to"))
    sorted_.mapInPandas(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


MANIFEST_COLUMNS = [part.split()[0] for part in MANIFEST.split(", ")]


def manifest_rows(done: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(done, columns=MANIFEST_COLUMNS)
    for name in ("first_page", "last_page"):
        out[name] = whole_numbers(out[name])
    return out


def whole_numbers(values) -> pd.Series:
    """Numbers and None as nullable integers, without a detour through doubles."""
    return pd.Series(pd.array(list(values), "Int64"))


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def parse_records(stream) -> Iterator[tuple]:
    """Rows of RECORD from an uncompressed stream; digests and lengths are checked."""
    while line := stream.readline():
        if line.strip() == b"":
            continue
        if line.strip() != b"WARC/1.1":
            raise ValueError(f"no WARC record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline().rstrip(b"\r\n")) != b"":
            name, _, value = line.decode().partition(": ")
            headers[name] = value
        block = stream.read(int(headers["Content-Length"]))
        if f"sha256:{hashlib.sha256(block).hexdigest()}" != headers["WARC-Block-Digest"]:
            raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
        payload = block.partition(b"\r\n\r\n")[2]
        digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
        if headers["WARC-Type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"damaged payload {headers['WARC-Record-ID']}")
        number = {k: int(v) if (v := headers.get(k)) is not None else None
                  for k in ("X-Page-ID", "X-Refers-To-Page", "X-Payload-Length")}
        yield (number["X-Page-ID"], headers["WARC-Target-URI"], headers["WARC-Type"],
               number["X-Refers-To-Page"], number["X-Payload-Length"], digest,
               payload if headers["WARC-Type"] == "response" else None)


def read_archive(spark: SparkSession, folder: str, payloads: bool = True,
                 batch_rows: int = 200) -> DataFrame:
    """The records of the files that the manifest names; one task reads a few files at most."""
    prepare_workers(spark)
    manifest = read_manifest(spark, folder).select("file", "records")
    files = max(1, manifest.count())
    columns = [part.split()[0] for part in RECORD.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, path = filesystem(folder)

        def frame(rows):
            out = pd.DataFrame({name: pd.Series(values, dtype=object) for name, values in zip(
                columns, zip(*rows) if rows else [()] * len(columns))})
            for name in ("page_id", "refers_to", "payload_bytes"):
                out[name] = whole_numbers(out[name])
            return out

        for batch in batches:
            for name, records in zip(batch["file"], batch["records"]):
                rows, n = [], 0
                with fs.open_input_stream(f"{path}/data/{name}", compression=None) as raw:
                    for row in parse_records(io.BufferedReader(gzip.GzipFile(fileobj=raw))):
                        rows.append(row if payloads else (*row[:-1], None))
                        n += 1
                        if len(rows) == batch_rows:
                            yield frame(rows)
                            rows = []
                if n != records:
                    raise ValueError(f"{name} has {n} records, the manifest says {records}")
                yield frame(rows)

    return manifest.repartition(min(files, 10_000), "file").mapInPandas(read, RECORD)
