"""Saved replies of remote sources as a Spark data source, and the cache that decides what still has to be asked."""

from __future__ import annotations

import ast
import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from evirank.canonical import canonical

RETRIED, TRIES = frozenset((429, 500, 502, 503, 504)), 3


def request_key(source: str, version: str, meta: dict) -> str:
    """Name of a request: a digest over what was asked, of whom, and in which version."""
    return hashlib.sha256(canonical({"source": source, "version": version, "request": meta}).encode()).hexdigest()


def wait_seconds(attempt: int, retry_after: str | None = None) -> float:
    """How long to wait before another try: as told, else twice as long each time, 30 s at most."""
    if retry_after and retry_after.isdigit():
        return min(30.0, float(retry_after))
    return min(30.0, 2.0**attempt)


@dataclass
class Budget:
    """Requests are reserved before they are sent, so that parallel workers cannot overrun."""

    requests: int
    tokens: int
    used_requests: int = 0
    used_tokens: int = 0

    def reserve(self) -> bool:
        if self.used_requests >= self.requests or self.used_tokens >= self.tokens:
            return False
        self.used_requests += 1
        return True

    def spend(self, tokens: int) -> None:
        self.used_tokens += tokens


class _Part(InputPartition):
    pass


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [_Part(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, encoding="utf-8") as f:
            for line in f:
                if line.strip():
                    r = json.loads(line)
                    body = r["body"] if isinstance(r["body"], str) else canonical(r["body"])
                    yield r["request_key"], int(r.get("status", 200)), r.get("retrieved_at"), body, hashlib.sha256(body.encode()).hexdigest()


class SavedReplies(DataSource):
    """spark.read.format("saved_replies").option("paths", "a.jsonl,b.jsonl"): one partition for each file, on storage all executors see."""

    @classmethod
    def name(cls) -> str:
        return "saved_replies"

    def schema(self) -> str:
        return "request_key string, status int, retrieved_at string, body string, digest string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader([p for p in self.options["paths"].split(",") if p])


def lookup(requests: DataFrame, replies: DataFrame, now: Column, ttl_days: float | None) -> tuple[DataFrame, DataFrame]:
    """(answered, to ask). A reply counts if it is no older than ttl_days (infinity: for ever, None: never) and its body still has its digest."""
    if ttl_days is None:
        return requests.limit(0), requests
    age = (F.unix_timestamp(now) - F.unix_timestamp(F.to_timestamp("retrieved_at"))) / F.lit(86_400.0)
    fresh = replies.where((F.col("status") == 200) & (F.sha2("body", 256) == F.col("digest")))
    if ttl_days != float("inf"):
        fresh = fresh.where(age <= ttl_days)
    last = fresh.groupBy("request_key").agg(F.max_by("body", "retrieved_at").alias("body"))
    return requests.join(last, "request_key"), requests.join(last, "request_key", "left_anti")


def python_literals(lines: DataFrame, column: str, fields: str) -> DataFrame:
    """Rows from text lines that each hold one literal dictionary in Python's notation; damaged lines are null rows."""

    @F.arrow_udf("string")
    def as_json(values: pa.Array) -> pa.Array:
        def one(x: str | None) -> str | None:
            try:
                return json.dumps(ast.literal_eval(x or ""))
            except (ValueError, SyntaxError):
                return None

        return pa.array([one(x) for x in values.to_pylist()], pa.string())

    return lines.select(F.from_json(as_json(F.col(column)), fields).alias("r")).select("r.*")
