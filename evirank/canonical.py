"""Canonical JSON and content digests as column expressions.

Keys are written in order, without spaces, and nulls are kept, so that a SHA-256 over the text names the content.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical(value) -> str:
    """The driver-side form, for small objects."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def digest(value) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def quoted(c: Column) -> Column:
    """A JSON string of a text column; null is written as null."""
    wrapped = F.to_json(F.struct(c.cast("string").alias("v")), {"ignoreNullFields": "false"})
    return F.substring(wrapped, 6, F.length(wrapped) - 6)


def canonical_row(fields: dict[str, Column], numbers: tuple[str, ...] = ()) -> Column:
    """Canonical JSON of a flat object. Fields named in numbers are integers; the others are text."""
    parts: list[Column] = []
    for i, name in enumerate(sorted(fields)):
        value = F.coalesce(fields[name].cast("string"), F.lit("null")) if name in numbers else quoted(fields[name])
        parts += [F.lit(("{" if i == 0 else ",") + json.dumps(name) + ":"), value]
    return F.concat(*parts, F.lit("}"))


def content_id(prefix: str, text: Column, length: int | None = None) -> Column:
    hashed = F.sha2(text, 256)
    return F.concat(F.lit(prefix), hashed if length is None else F.substring(hashed, 1, length))


def variant_id(assembly: Column, accession: Column, pos: Column, ref: Column, alt: Column, version: str = "1") -> Column:
    """The name of an allele: a digest over its six identity fields."""
    fields = {"identity_version": F.lit(version), "assembly": assembly, "reference_accession": accession, "pos_1based": pos, "ref": ref, "alt": alt}
    return content_id("var_", canonical_row(fields, ("pos_1based",)))


def combined_digest(df: DataFrame, name: str, value: str) -> DataFrame:
    """One digest over sorted (name, digest) rows, combined as a JSON array of pairs."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(name).cast("string").alias("n"), F.col(value).alias("d"))))
    text = F.concat(F.lit("["), F.concat_ws(",", F.transform(pairs, lambda p: F.concat(F.lit("["), quoted(p["n"]), F.lit(","), quoted(p["d"]), F.lit("]")))), F.lit("]"))
    return df.agg(F.sha2(text, 256).alias("combined_digest"))
