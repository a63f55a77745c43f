"""Delimited, JSON-lines and reference-sequence readers, and the writers for exports."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def mentions_tsv(spark: SparkSession, path: str, route: str) -> DataFrame:
    """A mention table: comment lines begin with ##, the first other line names the columns, empty cells are null."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("ordinal")).where(~F.startswith("value", F.lit("##")))
    head = lines.orderBy("ordinal").first()
    if head is None:
        raise ValueError(f"{path} has no header")
    names = head["value"].rstrip("\r\n").split("\t")
    cells = F.split(F.col("value"), "\t", -1)
    body = lines.where((F.col("ordinal") > head["ordinal"]) & (F.trim("value") != ""))
    out = body.select("ordinal", *(F.nullif(F.trim(F.get(cells, F.lit(i))), F.lit("")).alias(n) for i, n in enumerate(names)))
    for n in ("mention_id", "raw_text", "route", "assembly", "chrom", "pos", "ref", "alt", "roles", "resolution_method", "resolution_status", "resolution_note", "source_refs"):
        if n not in names:
            out = out.withColumn(n, F.lit(None).cast("string"))

    def listed(name: str, sep: str) -> Column:
        return F.filter(F.transform(F.split(F.coalesce(F.col(name), F.lit("")), sep), lambda x: F.trim(x)), lambda x: x != "")

    return out.withColumn("pos", F.col("pos").cast("bigint")).withColumn("roles", listed("roles", ",")).withColumn("source_refs", listed("source_refs", ";")).withColumn("route", F.coalesce("route", F.lit(route)))


def _unknown(schema: T.StructType, document: Column, path: str = "") -> list[Column]:
    keys = F.json_object_keys(document)
    tests = [F.when(F.size(F.array_except(keys, F.array(*(F.lit(f.name) for f in schema)))) > 0, F.concat(F.lit(f"unknown field at {path or '/'}: "), F.to_json(F.array_except(keys, F.array(*(F.lit(f.name) for f in schema))))))]
    for f in schema:
        if isinstance(f.dataType, T.StructType):
            tests += _unknown(f.dataType, F.get_json_object(document, f"$.{f.name}"), f"{path}/{f.name}")
    return tests


def strict_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Typed JSON lines; blank lines are skipped and a field that the schema lacks fails the job."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    problem = F.coalesce(*_unknown(schema, F.col("value")))
    checked = lines.where(F.when(problem.isNotNull(), F.raise_error(problem).cast("boolean")).otherwise(True))
    return checked.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def fasta(spark: SparkSession, path: str, manifest: dict) -> DataFrame:
    """(chrom, accession, offset, sequence) of a reference bundle whose checksum is verified.

    manifest: {"sha256": ..., "contigs": {name: accession or {"accession": ..., "start": ...}}}.
    """
    body = spark.read.format("binaryFile").load(path).select("content", F.sha2("content", 256).alias("digest"))
    ok = F.when(F.col("digest") != manifest["sha256"], F.raise_error(F.lit("reference checksum differs")).cast("boolean")).otherwise(True)
    records = body.where(ok).select(F.explode(F.split(F.concat(F.lit("\n"), F.decode("content", "UTF-8")), "\n>")).alias("r")).where(F.trim("r") != "")
    named = records.select(F.regexp_extract("r", r"^(\S+)", 1).alias("chrom"), F.upper(F.regexp_replace(F.regexp_replace("r", r"^[^\n]*\n?", ""), r"\s+", "")).alias("sequence"))
    rows = [(k, v, 1) if isinstance(v, str) else (k, v["accession"], int(v["start"])) for k, v in manifest["contigs"].items()]
    declared = spark.createDataFrame(rows, "chrom string, accession string, offset bigint")
    joined = declared.join(named, "chrom", "left")
    return joined.where(F.when(F.col("sequence").isNull(), F.raise_error(F.concat(F.lit("declared contig is absent: "), F.col("chrom"))).cast("boolean")).otherwise(True))


def snapshots(spark: SparkSession, folder: str, index: DataFrame) -> DataFrame:
    """Blobs of an index (file, snapshot_id, digest), hashed again; one that is missing or altered fails the job."""
    blobs = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content", F.sha2("content", 256).alias("found"))
    j = index.join(blobs, "file", "left")
    bad = F.when(F.col("found").isNull(), F.concat(F.lit("snapshot is missing: "), F.col("file"))).when(F.col("found") != F.col("digest"), F.concat(F.lit("snapshot was altered: "), F.col("file")))
    return j.where(F.when(bad.isNotNull(), F.raise_error(bad).cast("boolean")).otherwise(True)).withColumn("text", F.decode("content", "UTF-8")).drop("content", "found")


def merge_index(old: DataFrame, new: DataFrame, present: DataFrame) -> DataFrame:
    """Old rows win, new ones are added, rows without a file go."""
    added = new.dropDuplicates(["snapshot_id"]).join(old.select("snapshot_id"), "snapshot_id", "left_anti")
    return old.unionByName(added).join(present.select("file").distinct(), "file", "left_semi")


def canonical_lines(df: DataFrame) -> DataFrame:
    """One canonical JSON line for each row: keys in order, no spaces, nulls kept. For structs the field order is sorted too."""

    def ordered(kind: T.DataType, c: Column) -> Column:
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*(ordered(f.dataType, c[f.name]).alias(f.name) for f in sorted(kind, key=lambda f: f.name))))
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            return F.transform(c, lambda x: ordered(kind.elementType, x))
        return c

    whole = F.struct(*(ordered(f.dataType, F.col(f.name)).alias(f.name) for f in sorted(df.schema, key=lambda f: f.name)))
    return df.select(F.to_json(whole, {"ignoreNullFields": "false"}).alias("value"))


def write_jsonl(df: DataFrame, path: str, order: list[str]) -> str:
    """Write canonical lines in order to one file of the driver and return its digest; rows stream, so memory stays bounded."""
    h = hashlib.sha256()
    with Path(path).open("wb") as out:
        for row in canonical_lines(df.orderBy(*order)).toLocalIterator():
            line = row["value"].encode() + b"\n"
            h.update(line)
            out.write(line)
    return h.hexdigest()


def write_json(value, path: str) -> str:
    data = (json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False) + "\n").encode()
    Path(path).write_bytes(data)
    return hashlib.sha256(data).hexdigest()


def write_tsv(df: DataFrame, path: str, order: list[str]) -> str:
    """Write a mention table: a header, tab-separated cells with null as empty, lists joined by commas; returns the digest. Rows stream to the driver."""
    text = [F.array_join(c, ",") if t.startswith("array") else F.col(c).cast("string") for c, t in df.dtypes]
    lines = df.orderBy(*order).select(F.concat_ws("\t", *(F.regexp_replace(F.coalesce(c, F.lit("")), "[\t\r\n]", " ") for c in text)).alias("line"))
    h = hashlib.sha256()
    with Path(path).open("wb") as out:
        for line in ("\t".join(df.columns), *(r["line"] for r in lines.toLocalIterator())):
            data = line.encode() + b"\n"
            h.update(data)
            out.write(data)
    return h.hexdigest()
