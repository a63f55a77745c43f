"""Archives as addressable text units."""

from __future__ import annotations

import csv
import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from functools import partial
from html import unescape
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CELL = re.compile(r"([A-Z]+)[0-9]+")
_SCHEMA = "id string, file string, where string, text string, error string"


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _sheets(data: bytes) -> Iterator[tuple[str, str]]:
    book = zipfile.ZipFile(io.BytesIO(data))
    shared: list[str] = []
    if "xl/sharedStrings.xml" in book.namelist():
        for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")):
            shared.append("".join(t.text or "" for t in item.iter() if _local(t.tag) == "t"))
    titles = _titles(book)
    for name in sorted(n for n in book.namelist() if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)):
        sheet = titles.get(name, name.rpartition("/")[2][:-4])
        for number, row in enumerate((e for e in ElementTree.fromstring(book.read(name)).iter() if _local(e.tag) == "row"), 1):
            cells = []
            for c in row:
                value = "".join(t.text or "" for t in c.iter() if _local(t.tag) in ("v", "t"))
                cells.append(shared[int(value)] if c.get("t") == "s" and value else value)
            if any(cells):
                yield f"sheet={sheet};row={row.get('r') or number}", " | ".join(c for c in cells if c)


def _titles(book: zipfile.ZipFile) -> dict[str, str]:
    """Sheet names by the file that holds each sheet."""
    if not {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= set(book.namelist()):
        return {}
    files = {e.get("Id"): e.get("Target", "").removeprefix("/xl/") for e in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    found = {}
    for e in ElementTree.fromstring(book.read("xl/workbook.xml")).iter():
        if _local(e.tag) == "sheet":
            link = next((v for k, v in e.attrib.items() if _local(k) == "id"), None)
            found["xl/" + files.get(link, "")] = e.get("name", "")
    return found


def _paragraphs(data: bytes) -> Iterator[tuple[str, str]]:
    """Paragraphs and table rows in order; a row is one unit, and its paragraphs are not units of their own."""
    root, number = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")), 0
    todo = [root]
    while todo:
        e = todo.pop()
        if _local(e.tag) not in ("p", "tr"):
            todo += reversed(list(e))
            continue
        number += 1
        parts = [p for p in e.iter() if _local(p.tag) == "p"] or [e]
        text = " ".join(" ".join("".join(t.text or "" for t in p.iter() if _local(t.tag) == "t").split()) for p in parts).strip()
        if text:
            yield f"block={number}", text


def _delimited(data: bytes, tabbed: bool = False) -> Iterator[tuple[str, str]]:
    text = data.decode("utf-8", "replace")
    mark = "\t" if tabbed or text.count("\t") > text.count(",") else ","
    for i, row in enumerate(csv.reader(io.StringIO(text), delimiter=mark), 1):
        if any(c.strip() for c in row):
            yield f"row={i}", " | ".join(row)


def _pages(data: bytes) -> Iterator[tuple[str, str]]:
    from pypdf import PdfReader  # optional

    for i, page in enumerate(PdfReader(io.BytesIO(data)).pages):
        if text := (page.extract_text() or "").strip():
            yield f"page={i + 1}", text


READERS = {"xlsx": _sheets, "xlsm": _sheets, "csv": _delimited, "tsv": partial(_delimited, tabbed=True), "txt": _delimited, "docx": _paragraphs, "pdf": _pages}


def units(archive: bytes) -> Iterator[tuple[str, str, str, str | None]]:
    """(file, where, text, error) of each unit; a member that cannot be read is one unit with its error."""
    try:
        members = zipfile.ZipFile(io.BytesIO(archive))
        names = members.namelist()
    except zipfile.BadZipFile as e:
        yield "", "", "", str(e)
        return
    for name in names:
        reader = READERS.get(name.rpartition(".")[2].lower())
        if reader is None or name.endswith("/"):
            continue
        try:
            for where, text in reader(members.read(name)):
                yield name, where, unescape(text), None
        except Exception as e:  # noqa: BLE001  any damage of a member is that member's error
            yield name, "", "", f"{type(e).__name__}: {e}"


def archive_units(df: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """Units of each archive of a binary column."""

    def run(frames):
        for frame in frames:
            rows = [(i, *u) for i, data in zip(frame["id"], frame["content"], strict=True) for u in units(bytes(data or b""))]
            yield pd.DataFrame(rows, columns=["id", "file", "where", "text", "error"])

    return df.select(F.col(id_col).cast("string").alias("id"), F.col(content_col).alias("content")).mapInPandas(run, _SCHEMA)


def archive_state(content: bytes | None) -> str:
    """ok, corrupt_member or truncated_archive."""
    try:
        return "ok" if zipfile.ZipFile(io.BytesIO(content or b"")).testzip() is None else "corrupt_member"
    except (zipfile.BadZipFile, zlib.error, EOFError):
        return "truncated_archive"


def intact_archives(df: DataFrame, key: str, attempt: str, content: str, most: int = 3) -> DataFrame:
    """(key, content, state): of several tries to get each archive the first that is whole, among the first `most`; without one, the state of the last."""
    state = F.udf(archive_state, "string")
    tried = df.where(F.col(attempt) <= most).select(F.col(key), F.col(attempt).alias("__n"), F.col(content).alias("content")).withColumn("state", state("content"))
    whole = F.when(F.col("state") == "ok", F.col("__n"))
    return tried.groupBy(key).agg(F.min_by("content", whole).alias("content"), F.when(F.min(whole).isNotNull(), "ok").otherwise(F.max_by("state", "__n")).alias("state"))
