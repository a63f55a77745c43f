"""ISO base-media columns: write samples into a container, walk its boxes, decode the sample tables.

A payload is kept losslessly as unsigned 8-bit PCM in one track. Reading never decodes samples: the walker
follows box headers, decodes stts, stsc, stsz, stco or co64 and stss of each track by itself, and the runs of its fragments, and derives codec, duration
and the byte range of each key sample; stored bytes are only sliced out by the chunks' ranges. All samples of a track without a table of key samples are keys.

Defined results: null text counts as empty; an empty payload is one block of 64 zero bytes; equal texts give equal
rows; a null or damaged container gives a row whose error says why and whose other columns are null; extra columns
of the input are dropped, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE, CHUNK, BLOCK = 8000, 4096, 64
CONTAINERS = frozenset((b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"))


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def mux(payload: bytes, chunk: int = CHUNK, rate: int = RATE) -> bytes:
    """One audio track of 8-bit samples; each chunk of `chunk` samples begins with a sync sample."""
    n = len(payload)
    whole, rest = divmod(n, chunk)
    n_chunks = whole + bool(rest)
    wide = n + 64 * n_chunks + 4096 >= 1 << 32
    entries = ([(1, chunk)] if whole else []) + ([(whole + 1, rest)] if rest else [])
    stsc = struct.pack(">I", len(entries)) + b"".join(struct.pack(">III", first, per, 1) for first, per in entries)
    stss = struct.pack(f">I{n_chunks}I", n_chunks, *range(1, n + 1, chunk))
    entry = struct.pack(">6xH8xHH4xI", 1, 1, 8, rate << 16)
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomqt  ")

    def moov(base: int) -> bytes:
        places = [base + i * chunk for i in range(n_chunks)]
        table = struct.pack(f">I{n_chunks}{'Q' if wide else 'I'}", n_chunks, *places)
        stbl = box(
            b"stbl", full(b"stsd", struct.pack(">I", 1), box(b"raw ", entry)), full(b"stts", struct.pack(">III", 1, n, 1)), full(b"stss", stss),
            full(b"stsc", stsc), full(b"stsz", struct.pack(">II", 1, n)), full(b"co64" if wide else b"stco", table),
        )
        minf = box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl)
        mdia = box(b"mdia", full(b"mdhd", struct.pack(">QQIQI", 0, 0, rate, n, 0x55C40000), version=1), full(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"samples\0"), minf)
        tkhd = full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, n), struct.pack(">8xHHH2x", 0, 0, 0x100), _MATRIX, bytes(8), version=1, flags=7)
        mvhd = full(b"mvhd", struct.pack(">QQIQ", 0, 0, rate, n), struct.pack(">IH10x", 0x10000, 0x100), _MATRIX, bytes(24), struct.pack(">I", 2), version=1)
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    head = len(ftyp) + len(moov(0)) + (8 if n + 8 < 1 << 32 else 16)
    return ftyp + moov(head) + box(b"mdat", payload)


def walk(data: bytes, start: int = 0, end: int | None = None, path: str = "") -> Iterator[tuple[str, int, int]]:
    """(path, body start, body end) of each box, depth first; sizes 0 (to the end) and 1 (64 bits) included."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            (size,), head = struct.unpack_from(">Q", data, start + 8), 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError(f"box {kind!r} at {start} has size {size}")
        here = f"{path}/{kind.decode('latin-1')}"
        yield here, start + head, start + size
        if kind in CONTAINERS:
            yield from walk(data, start + head, start + size, here)
        start += size
    if start != end:
        raise ValueError(f"{end - start} stray bytes at {start}")


def _tracks(data: bytes) -> tuple[list[dict], list[dict], dict]:
    """Boxes of each trak and of each traf by name, and the places of trex defaults by track."""
    tracks: list[dict] = []
    parts: list[dict] = []
    defaults: dict[int, tuple[int, int]] = {}
    moof = 0
    for path, a, b in walk(data):
        kind = path.rpartition("/")[2]
        if kind == "moof":
            moof = a - 8 if struct.unpack_from(">I", data, a - 8)[0] != 1 else a - 16
        elif kind == "trak":
            tracks.append({})
        elif kind == "traf":
            parts.append({"moof": moof, "runs": []})
        elif kind == "trex":
            track, _, duration, size, flags = struct.unpack_from(">5I", data, a + 4)
            defaults[track] = (duration, size, flags)
        elif "/traf/" in path:
            if kind == "trun":
                parts[-1]["runs"].append((a, b))
            else:
                parts[-1].setdefault(kind, (a, b))
        elif "/trak/" in path:
            tracks[-1].setdefault(kind, (a, b))
    return tracks, parts, defaults


def _fragments(data: bytes, parts: list[dict], defaults: dict, track: int) -> tuple[list[tuple], list[tuple], int]:
    """Chunks (offset, samples, bytes), key samples (offset, bytes) and ticks of a track's fragments."""
    chunks, keys, ticks = [], [], 0
    for part in parts:
        a, _ = part["tfhd"]
        flags, own = struct.unpack_from(">II", data, a)
        flags &= 0xFFFFFF
        if own != track:
            continue
        at = a + 8
        base = part["moof"]
        if flags & 1:
            (base,) = struct.unpack_from(">Q", data, at)
            at += 8
        at += 4 if flags & 2 else 0
        found = list(defaults.get(track, (0, 0, 0)))
        for i, bit in enumerate((8, 16, 32)):
            if flags & bit:
                (found[i],) = struct.unpack_from(">I", data, at)
                at += 4
        place = base
        for a, b in part["runs"]:
            flags, n = struct.unpack_from(">II", data, a)
            flags &= 0xFFFFFF
            at, first = a + 8, None
            if flags & 1:
                place = base + struct.unpack_from(">i", data, at)[0]
                at += 4
            if flags & 4:
                (first,) = struct.unpack_from(">I", data, at)
                at += 4
            fields = [bit for bit in (0x100, 0x200, 0x400, 0x800) if flags & bit]
            if at + 4 * n * len(fields) > b:
                raise ValueError("trun is cut short")
            start = place
            for i in range(n):
                row = dict(zip(fields, struct.unpack_from(f">{len(fields)}I", data, at), strict=True))
                at += 4 * len(fields)
                size = row.get(0x200, found[1])
                ticks += row.get(0x100, found[0])
                said = row.get(0x400, first if i == 0 and first is not None else found[2])
                if not said & 0x10000:  # not a difference sample
                    keys.append((place, size))
                place += size
            if place > len(data):
                raise ValueError("a run lies outside the file")
            chunks.append((start, n, place - start))
    return chunks, keys, ticks


def probe_track(data: bytes, found: dict, parts: list[dict] = (), defaults: dict | None = None) -> dict:
    """Codec, duration and sample layout of one track."""
    missing = [k for k in ("mdhd", "stsd", "stts", "stsc", "stsz") if k not in found]
    if missing:
        raise ValueError("no " + ", ".join(missing))

    def words(kind: str, skip: int, each: int, code: str = "I") -> list[tuple]:
        a, b = found[kind]
        (n,) = struct.unpack_from(">I", data, a + skip)
        if n * struct.calcsize(f">{each}{code}") > b - a - skip - 4:
            raise ValueError(f"{kind} is cut short")
        flat = struct.unpack_from(f">{n * each}{code}", data, a + skip + 4)
        return [flat[i : i + each] for i in range(0, len(flat), each)]

    a, _ = found["mdhd"]
    timescale, length = struct.unpack_from(">IQ", data, a + 20) if data[a] == 1 else struct.unpack_from(">II", data, a + 12)
    a, _ = found["stsd"]
    codec = data[a + 12 : a + 16].decode("latin-1")
    runs = words("stts", 4, 2)
    a, _ = found["stsz"]
    each, n = struct.unpack_from(">II", data, a + 4)
    sizes = None if each else [x for (x,) in words("stsz", 8, 1)]
    places = [x for (x,) in (words("co64", 4, 1, "Q") if "co64" in found else words("stco", 4, 1) if "stco" in found else [])]
    per = words("stsc", 4, 3)
    key = {x - 1 for (x,) in words("stss", 4, 1)} if "stss" in found else None
    ordered = sorted(key or ())
    chunks, keys, sample = [], [], 0  # (offset, first sample, samples, bytes), (offset, bytes)
    for i, (first, count, _) in enumerate(per):
        last = per[i + 1][0] if i + 1 < len(per) else len(places) + 1
        for c in range(first, last):
            own = range(sample, sample + count)
            size = count * each if each else sum(sizes[sample : sample + count])
            if places[c - 1] + size > len(data):
                raise ValueError(f"chunk {c} lies outside the file")
            chunks.append((places[c - 1], sample, count, size))
            if key is None and each:
                keys += [(places[c - 1] + each * k, each) for k in range(count)]
            elif each:
                low, high = bisect_left(ordered, sample), bisect_left(ordered, sample + count)
                keys += [(places[c - 1] + each * (k - sample), each) for k in ordered[low:high]]
            else:
                at = places[c - 1]
                for k in own:
                    if key is None or k in key:
                        keys.append((at, sizes[k]))
                    at += sizes[k]
            sample += count
    if sample != n or sum(k for k, _ in runs) != n:
        raise ValueError("the sample tables disagree")
    ticks = sum(k * d for k, d in runs)
    if parts and "tkhd" in found:
        a, _ = found["tkhd"]
        track = struct.unpack_from(">I", data, a + (20 if data[a] == 1 else 12))[0]
        more, more_keys, more_ticks = _fragments(data, parts, defaults or {}, track)
        for place, count, size in more:
            chunks.append((place, sample, count, size))
            sample += count
        keys, ticks = keys + more_keys, ticks + more_ticks
        length = length or ticks
    return {"codec": codec, "timescale": timescale, "duration": length, "ticks": ticks, "samples": sample, "chunks": chunks, "keys": keys}


def probe_all(data: bytes) -> list[dict]:
    """Every track by itself, in the order of the file."""
    tracks, parts, defaults = _tracks(data)
    return [probe_track(data, t, parts, defaults) for t in tracks]


def probe(data: bytes) -> dict:
    """The first track with a sample description."""
    tracks, parts, defaults = _tracks(data)
    described = [t for t in tracks if "stsd" in t] or tracks
    if not described:
        raise ValueError("no track")
    return probe_track(data, described[0], parts, defaults)


def stored(data: bytes, found: dict) -> bytes:
    return b"".join(data[at : at + size] for at, _, _, size in found["chunks"])


def padded(raw: bytes, block: int = BLOCK) -> bytes:
    return raw + bytes(max(block, -(-len(raw) // block) * block) - len(raw))


_PROBED = "id bigint, codec string, seconds double, samples bigint, keyframes array<struct<offset: bigint, bytes: bigint>>, error string"


def probe_column(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row for each row of df: codec, duration and key-sample byte ranges of a binary container column."""

    def run(batches):
        for batch in batches:
            rows = []
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    if data is None:
                        raise ValueError("null")
                    x = probe(data)
                    seconds = x["duration"] / x["timescale"] if x["timescale"] else None
                    rows.append({"id": key, "codec": x["codec"], "seconds": seconds, "samples": x["samples"], "keyframes": [{"offset": o, "bytes": n} for o, n in x["keys"]], "error": None})
                except (ValueError, struct.error, IndexError) as e:
                    rows.append({"id": key, "codec": None, "seconds": None, "samples": None, "keyframes": None, "error": str(e)})
            kind = pa.schema([("id", pa.int64()), ("codec", pa.string()), ("seconds", pa.float64()), ("samples", pa.int64()), ("keyframes", pa.list_(pa.struct([("offset", pa.int64()), ("bytes", pa.int64())]))), ("error", pa.string())])
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(media_col).alias("media")).mapInArrow(run, _PROBED)


def mux_column(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n_bytes, media): the UTF-8 text, padded and stored as samples in a container."""

    def run(batches):
        for batch in batches:
            raw = [x or b"" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([mux(padded(x)) for x in raw], pa.large_binary()).cast(pa.binary())], ["id", "n_bytes", "media"])

    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("binary").alias("raw")).mapInArrow(run, "id bigint, n_bytes bigint, media binary")


_DIGEST = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text as samples, read it back through the sample tables, return digests and features.

    Muxing and reading happen in one pass, so that no container is ever sent between processes.
    """

    def run(batches):
        for batch in batches:
            columns = [[] for _ in range(7)]
            for raw in batch.column(1).to_pylist():
                raw = raw or b""
                media = mux(padded(raw))
                x = probe(media)
                back = stored(media, x)
                ranges = ",".join(f"{o}+{n}" for o, n in x["keys"])
                feature = f"codec={x['codec'].strip()};rate={x['timescale']};duration={x['duration']};samples={x['samples']};chunks={len(x['chunks'])};keys={ranges}"
                values = (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature)
                for c, v in zip(columns, values, strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = [x.split()[0] for x in _DIGEST.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("raw")).mapInArrow(run, _DIGEST)
