"""Append-only tables of content-addressed blobs: rows are seen once their version is published, and never of a write that was aborted.

Under the journal's folder, blobs/ holds files named by the SHA-256 of their bytes and log/<table>/ one small file for each version, which lists the blobs that it adds. Tasks
write blobs only: the same lines give the same name, so a task that runs again, or a write that is repeated after a failure, adds nothing. The driver publishes a
version when all tasks are done, and a version whose blobs are those of an earlier one is not published twice. What an aborted write leaves is
named by no version; `vacuum` removes it. Each table has one writer at a time.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from evirank.sources.tables import canonical_lines

NAME = "evirank_journal"


class _Folder:
    """A folder of any file system that pyarrow knows."""

    def __init__(self, path: str):
        self.fs, self.root = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)

    def names(self, below: str) -> list[str]:
        found = self.fs.get_file_info(pafs.FileSelector(f"{self.root}/{below}", allow_not_found=True, recursive=True))
        return sorted(f.path.rsplit("/", 1)[-1] for f in found if f.type == pafs.FileType.File)

    def read(self, name: str) -> bytes:
        with self.fs.open_input_stream(f"{self.root}/{name}") as f:
            return f.read()

    def put(self, name: str, data: bytes) -> None:
        """All of it or nothing: written beside and moved."""
        self.fs.create_dir(f"{self.root}/{name}".rsplit("/", 1)[0])
        beside = f"{self.root}/tmp-{uuid.uuid4().hex}"
        with self.fs.open_output_stream(beside) as f:
            f.write(data)
        self.fs.move(beside, f"{self.root}/{name}")

    def versions(self, table: str) -> dict[int, dict]:
        return {int(n.split(".")[0]): json.loads(self.read(f"log/{table}/{n}")) for n in self.names(f"log/{table}")}


def blob_path(digest: str) -> str:
    return f"blobs/{digest[:2]}/{digest}"


@dataclass
class Written(WriterCommitMessage):
    blobs: list


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.table = options["path"], options["table"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """One blob of lines for each bucket; rows come sorted by bucket and line, and equal lines count once. Contents are blobs of their own, named in their line's digest by who made it."""
        folder, there, done = _Folder(self.path), set(), []
        at, lines = None, []

        def put(data: bytes) -> str:
            digest = hashlib.sha256(data).hexdigest()
            if digest not in there and folder.fs.get_file_info(f"{folder.root}/{blob_path(digest)}").type == pafs.FileType.NotFound:
                folder.put(blob_path(digest), data)
            there.add(digest)
            return digest

        def close() -> None:
            if lines:
                done.append([put("".join(f"{x}\n" for x in lines).encode()), len(lines)])
                lines.clear()

        for batch in iterator:
            bucket, value, content = (batch.column(c) for c in ("bucket", "value", "content"))
            for x in content.drop_null().to_pylist():
                put(x)
            bucket, value = bucket.to_numpy(), value.to_pylist()
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            for first, last in zip([0, *cuts.tolist()], [*cuts.tolist(), len(value)], strict=True):
                if first == last:
                    continue
                if bucket[first] != at:
                    close()
                    at = bucket[first]
                own = dict.fromkeys(value[first:last])  # equal lines stand together
                if lines:
                    own.pop(lines[-1], None)
                lines += own
        close()
        return Written(done)

    def commit(self, messages: list) -> None:
        folder = _Folder(self.path)
        blobs = sorted(b for m in messages if m is not None for b in m.blobs)
        known = folder.versions(self.table)
        if blobs and not any(v["blobs"] == blobs for v in known.values()):
            digest = hashlib.sha256("\n".join(b[0] for b in blobs).encode()).hexdigest()
            folder.put(f"log/{self.table}/{max(known, default=0) + 1:012d}.json", json.dumps({"blobs": blobs, "digest": digest, "rows": sum(b[1] for b in blobs)}).encode())

    def abort(self, messages: list) -> None:
        """Nothing was published, so there is nothing to take back."""


#: Rows from which on blobs that follow each other are no longer read by one task.
TASK_ROWS = 200_000


@dataclass
class Blobs(InputPartition):
    version: int
    digests: list


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.table = options["path"], options["table"]

    def partitions(self) -> list[Blobs]:
        out = []
        for version, said in sorted(_Folder(self.path).versions(self.table).items()):
            rows = TASK_ROWS
            for digest, n in said["blobs"]:
                if rows >= TASK_ROWS:
                    out.append(Blobs(version, []))
                    rows = 0
                out[-1].digests.append(digest)
                rows += n
        return out

    def read(self, partition: Blobs) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        folder = _Folder(self.path)
        for digest in partition.digests:
            data = folder.read(blob_path(digest))
            if hashlib.sha256(data).hexdigest() != digest:
                raise ValueError(f"blob was altered: {digest}")
            lines = data.decode().split("\n")[:-1]  # other separators may stand inside a line
            yield pa.RecordBatch.from_arrays([pa.array([partition.version] * len(lines), pa.int64()), pa.array([digest] * len(lines)), pa.array(lines, pa.string())], ["version", "blob", "value"])


class Journal(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "version bigint, blob string, value string"

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("a journal is only appended to")
        return Writer(self.options)


def append(df: DataFrame, path: str, table: str, content: str | None = None, rows_per_blob: int = 50_000) -> None:
    """Append df to a table as canonical JSON lines; a binary column named `content` goes to blobs and leaves its digest in the line.

    Lines are dealt to blobs by their hash and sorted there, so the same rows make the same blobs in whatever order they come. Rows that are equal as lines of one
    write are one row.
    """
    spark = df.sparkSession
    spark.dataSource.register(Journal)
    told = df.withColumn(content, F.sha2(content, 256)) if content else df
    lines = canonical_lines(told)
    if content:
        whole = df.select(F.sha2(content, 256).alias("digest"), F.col(content).alias("content")).where("digest is not null")
        keyed = lines.withColumn("digest", F.get_json_object("value", f"$.{content}"))
        first = whole.groupBy("digest").agg(F.first("content").alias("content"))
        lines = keyed.dropDuplicates(["value"]).join(first, "digest", "left").select("value", "content")
    else:
        lines = lines.withColumn("content", F.lit(None).cast("binary"))
    buckets = max(1, df.count() // rows_per_blob)
    dealt = lines.withColumn("bucket", F.pmod(F.xxhash64("value"), F.lit(buckets)).cast("bigint")).repartition("bucket").sortWithinPartitions("bucket", "value")
    dealt.select("bucket", "value", "content").write.format(NAME).option("path", path).option("table", table).mode("append").save()


def lines_of(spark: SparkSession, path: str, table: str) -> DataFrame:
    """(version, blob, value) of all published rows; a blob whose bytes changed fails the job."""
    spark.dataSource.register(Journal)
    return spark.read.format(NAME).option("path", path).option("table", table).load()


def rows_of(spark: SparkSession, path: str, table: str, schema: str) -> DataFrame:
    """The published rows of a table, typed, with their version."""
    return lines_of(spark, path, table).select("version", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("version", "r.*")


def digests_of(path: str, table: str) -> list[tuple[int, int, str]]:
    """(version, rows, digest) of what was published, in order."""
    return [(v, said["rows"], said["digest"]) for v, said in sorted(_Folder(path).versions(table).items())]


def blob(path: str, digest: str) -> bytes:
    return _Folder(path).read(blob_path(digest))


def vacuum(spark: SparkSession, path: str, contents: dict[str, str] | None = None) -> int:
    """Remove blobs that no version of any table names, and return how many. contents: the column of digests of each table that has contents. No write may be under way."""
    folder = _Folder(path)
    tables = {f.path.rsplit("/", 1)[-1] for f in folder.fs.get_file_info(pafs.FileSelector(f"{folder.root}/log", allow_not_found=True))}
    named = {b[0] for t in tables for v in folder.versions(t).values() for b in v["blobs"]}
    for table, column in (contents or {}).items():
        named |= {r[0] for r in lines_of(spark, path, table).select(F.get_json_object("value", f"$.{column}")).distinct().toLocalIterator()}
    gone = [n for n in folder.names("blobs") if n not in named]
    for n in gone:
        folder.fs.delete_file(f"{folder.root}/{blob_path(n)}")
    return len(gone)
