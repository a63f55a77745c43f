"""Byte-pair encoding and decoding with a contiguous rank array.

Each short word is a row of parts and of the ranks of adjacent pairs. The least rank is looked for again and again, its
right boundary is deleted, and the two neighbouring ranks are refreshed. All unknown words of a batch are rows of one
matrix, so a scan is one argmin over that matrix. Words over LONG bytes use a heap over a linked list with the same order
(least rank, then leftmost). Merged words and whole space-delimited pieces are remembered up to a bound.

Defined results: null text counts as empty and has no ids; the strings of special tokens in a text become their ids;
ids that the vocabulary lacks make decoding fail; equal texts give equal rows; input columns other than the two that
are named are dropped, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from functools import lru_cache
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evirank.llm.common import gathered

LONG, REMEMBER, NONE = 64, 400_000, np.int64(1) << 40
#: Where a piece may not begin at a space: inside or at the end of a longer run of white space.
_UNSAFE = re.compile(r"\s \s| \Z")
#: The byte-level split of the vocabulary's format. Fixed values.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Ranks:
    """A vocabulary's merges as sorted keys, and what has been merged so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        self.base = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]
        self.by_key = {int(k): (int(r), int(m)) for k, r, m in zip(self.keys, self.rank, self.made, strict=True)}
        back = {c: b for b, c in letters.items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of = {str(i): bytes(back[c] for c in token) for token, i in vocab.items()} | {str(i): token.encode() for token, i in self.special.items()}
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.split = regex.compile(_SPLIT)
        self.said = [str(i) for i in range(len(vocab) + len(self.special))]
        self.words: dict[str, str] = {}
        self.pieces: dict[str, str] = {}
        self.older: dict[str, str] = {}  # the pieces known before the last overflow

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE where the pair does not merge) and the merged id of pairs; a negative right side never merges."""
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        hit = (self.keys[at] == key) & (right >= 0)
        return np.where(hit, self.rank[at], NONE), self.made[at]

    def merge_rows(self, rows: list[bytes], width: int) -> list[list[int]]:
        """Merge words of at most `width` bytes, one row each."""
        n = len(rows)
        flat = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in rows), np.uint8).reshape(n, width)
        size = np.fromiter(map(len, rows), np.int64, n)
        column = np.arange(width)
        ids = np.where(column < size[:, None], self.base[flat], -1)
        ids = np.concatenate([ids, np.full((n, 1), -1, np.int64)], axis=1)
        rank, made = (x.reshape(n, width) for x in self.look(ids[:, :-1].ravel(), ids[:, 1:].ravel()))
        rank, made = rank.copy(), made.copy()
        final = np.empty((n, width), np.int64)
        place = np.arange(n)
        while len(place):
            at = rank.argmin(axis=1)
            row = np.arange(len(place))
            live = rank[row, at] < NONE
            if not live.all():
                final[place[~live]] = ids[~live, :-1]
                place, ids, rank, made, at = place[live], ids[live], rank[live], made[live], at[live]
                row = np.arange(len(place))
                if not len(place):
                    break
            ids[row, at] = made[row, at]
            gone = column > at[:, None]  # what follows moves one place to the left
            ids[:, :-1] = np.where(gone, ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            rank[:, :-1] = np.where(gone[:, :-1], rank[:, 1:], rank[:, :-1])
            made[:, :-1] = np.where(gone[:, :-1], made[:, 1:], made[:, :-1])
            rank[:, -1] = NONE
            rank[row, at], made[row, at] = self.look(ids[row, at], ids[row, at + 1])
            some = at > 0
            r, a = row[some], at[some] - 1
            rank[r, a], made[r, a] = self.look(ids[r, a], ids[r, a + 1])
        left = final >= 0
        flat, ends = final[left].tolist(), np.cumsum(left.sum(axis=1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def merge_long(self, word: bytes) -> list[int]:
        """The same merges for one long word: a heap of (rank, place) over linked parts."""
        ids = [int(self.base[b]) for b in word]
        n = len(ids)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(x[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (x := self.by_key.get(ids[i] << 32 | ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = self.by_key[a << 32 | b][1], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q >= 0 and (x := self.by_key.get(ids[p] << 32 | ids[q])):
                    heapq.heappush(heap, (x[0], p, ids[p], ids[q]))
        return [x for x in ids if x >= 0]

    def learn(self, pieces: set[str]) -> None:
        """Remember the ids of new pieces, as comma-joined text."""
        again = {p for p in pieces if p in self.older}
        self.pieces.update((p, self.older[p]) for p in again)
        pieces -= again
        split = {p: [p] if p[1:].isalpha() and (p[0] == " " or p[0].isalpha()) else [p[:-1], p[-1]] if p[-1] in ".,;:" and p[1:-1].isalpha() and p[0] == " " else self.split.findall(p) for p in pieces}
        new = list({w for ws in split.values() for w in ws if w not in self.words})
        raw = [w.encode() for w in new]
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        low, said = 0, self.said.__getitem__
        for width in (8, 12, 16, 24, LONG):
            picked = np.flatnonzero((length > low) & (length <= width))
            low = width
            for k in range(0, len(picked), 20_000):
                part = picked[k : k + 20_000]
                for i, ids in zip(part, self.merge_rows([raw[i] for i in part], width), strict=True):
                    self.words[new[i]] = ",".join(map(said, ids))
        for i in np.flatnonzero(length > LONG):
            self.words[new[i]] = ",".join(map(str, self.merge_long(raw[i])))
        for p, ws in split.items():
            self.pieces[p] = self.words[ws[0]] if len(ws) == 1 else ",".join([self.words[w] for w in ws])

    def cut_pieces(self, text: str) -> list[str]:
        """Pieces that are merged on their own: at single spaces where that is safe, else the words themselves."""
        if _UNSAFE.search(text):
            return self.split.findall(text)
        first, *rest = text.split(" ")
        rest = [" " + x for x in rest]
        return [first, *rest] if first else rest

    def encode_batch(self, texts: list[str]) -> list[str]:
        """The ids of each text, comma-joined."""
        cut = []
        for text in texts:
            if self.cut and self.cut.search(text):
                parts, at = [], 0
                for m in self.cut.finditer(text):
                    parts += [self.cut_pieces(text[at : m.start()]) if m.start() > at else [], self.special[m[0]]]
                    at = m.end()
                cut.append([*parts, self.cut_pieces(text[at:]) if at < len(text) else []])
            else:
                cut.append([self.cut_pieces(text)] if text else [])
        out, k = [], 0
        while k < len(cut):
            if len(self.pieces) > REMEMBER:
                self.older, self.pieces, self.words = self.pieces, {}, {}
            new: set[str] = set()
            known, start = self.pieces.__contains__, k
            while k < len(cut) and len(new) < REMEMBER // 4:
                for part in cut[k]:
                    if isinstance(part, list):
                        new.update(filterfalse(known, part))
                k += 1
            self.learn(new)
            get = self.pieces.__getitem__
            for parts in cut[start:k]:
                said = [str(p) if isinstance(p, int) else ",".join(map(get, p)) for p in parts]
                out.append(said[0] if len(said) == 1 else ",".join(x for x in said if x))
        return out

    def decode(self, ids: str) -> str:
        """Text of comma-joined ids; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids.split(","))).decode("utf-8", "replace") if ids else ""


@lru_cache(maxsize=4)
def ranks(path: str) -> Ranks:
    return Ranks(path)


def _slices(texts: list[str], most: int = 4_000_000):
    """Runs of texts of about `most` characters, so that the pieces of few texts are held at a time."""
    start = size = 0
    for i, x in enumerate(texts):
        size += len(x)
        if size >= most:
            yield texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield texts[start:]


def _by_id(df: DataFrame, id_col: str, col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(col).alias("x"))


def encode_column(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the token ids of each whole text."""

    def run(batches):
        r = ranks(path)
        for batch in batches:
            ids = [[int(x) for x in s.split(",")] if s else [] for part in _slices([x or "" for x in batch.column(1).to_pylist()]) for s in r.encode_batch(part)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    return _by_id(df, id_col, text_col).mapInArrow(run, "id bigint, ids array<int>")


def decode_column(df: DataFrame, path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, text): null ids decode to the empty text."""

    def run(batches):
        r = ranks(path)
        for batch in batches:
            text = [r.decode(",".join(map(str, x or ()))) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], ["id", "text"])

    return _by_id(df, id_col, ids_col).mapInArrow(run, "id bigint, text string")


_DIGEST = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each whole text, decode the ids again, and return digests of both."""

    def run(batches):
        r = ranks(path)
        for batch in gathered(batches):
            count, ids_sha, text_sha = [], [], []
            for part in _slices([x or "" for x in batch.column(1).to_pylist()]):
                for ids in r.encode_batch(part):
                    count.append(ids.count(",") + 1 if ids else 0)
                    ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                    text_sha.append(hashlib.sha256(r.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], [x.split()[0] for x in _DIGEST.split(", ")])

    return _by_id(df, id_col, text_col).mapInArrow(run, _DIGEST)
