"""Best-fit packing with certified repacking.

Texts become token pieces; pieces are dealt to partitions of about PER_PART rows, each packed by best-fit decreasing. A
dual-feasible function bounds from below how many sequences a partition needs. Where the packing uses more, the partition
has a gap: its least filled sequences are opened and their pieces go to the next round, mixed with those of other
partitions, and are packed anew. A partition whose count equals the bound only gives up its least filled sequence, since
rounding up once for each partition is what is left to gain. Rounds end when one partition holds all that is still open, or
at MAX_ROUNDS. Every piece is in exactly one sequence at all times.

Defined results: null text counts as empty and is one piece that holds the end id alone; repeated rows are packed as
often as they occur; equal inputs give equal sequences, whatever the partitioning of the input; an empty table gives no
rows; extra columns are dropped.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from functools import lru_cache, partial
from itertools import chain, count, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evirank.llm.common import gathered, giving_back, written

CAPACITY, END_ID, PER_PART, MAX_ROUNDS, REMEMBER, AT_ONCE = 4096, 1, 20_000, 8, 600_000, 4_000_000
#: Characters that str.split() takes as white space though the tokenizer does not.
_SEPARATORS = re.compile("[\x1c-\x1f]")
#: Where lower-casing a text first or parting its marks could change the ids: capital sigma, dotted I, combining marks.
_CASED = re.compile("[\u03a3\u0130\u0300-\u036f]")
_MARK = re.compile(r"(?<=[^\W\d_])([.,;:!?])(?=\s|\Z)")
_BLANKS = re.compile(r"[ \n\r\t]+")


class Words:
    """Ids of white-space-delimited words, remembered by number in flat arrays; the tokenizer never joins across white space."""

    def __init__(self, path: str, remember: int = REMEMBER):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.remember = Tokenizer.from_file(path), remember
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)  # ids that end a run of letters or signs
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = defaultdict(count().__next__)  # no reference to itself: it goes as soon as nothing needs it
        self.ids = np.empty(0, "<u4")
        self.start, self.size = np.empty(0, np.int64), np.empty(0, np.int64)

    def tokens(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word). Letters, and letters with one mark, are encoded as one text and cut at word ends."""
        parts = np.fromiter((1 if w.isalpha() else 2 if w[-1] in ".,;:!?" and w[:-1].isalpha() else 0 for w in words), np.int64, len(words))
        easy = np.flatnonzero(parts)
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join([words[i] for i in easy])], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != parts.sum():  # a letter whose lower case is more than letters: take every word by itself
            parts[:] = 0
            easy, ids, ends = easy[:0], ids[:0], ends[:0]
        size = np.zeros(len(words), np.int64)
        size[easy] = np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(parts[easy])])])
        hard = np.flatnonzero(parts == 0)
        other = [e.ids for k in range(0, len(hard), 20_000) for e in self.tokenizer.encode_batch_fast([words[i] for i in hard[k : k + 20_000]], add_special_tokens=False)]
        size[hard] = [len(x) for x in other]
        out, from_easy = np.empty(int(size.sum()), "<u4"), np.repeat(parts > 0, size)
        out[from_easy] = ids
        out[~from_easy] = [i for x in other for i in x]
        return out, size

    def cut(self, text: str) -> list[str]:
        """Words of a text, a lone mark after letters by itself; in lower case, as the tokenizer takes them, where that is safe."""
        if _SEPARATORS.search(text):
            return [w for w in _BLANKS.split(text) if w]
        if not text.isascii() and _CASED.search(text):
            return text.split()
        return _MARK.sub(r" \1", text.lower()).split()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.number) > self.remember:
            self.forget()
        cut = [self.cut(x) for x in texts]
        before = len(self.number)
        get = self.number.__getitem__
        each = np.fromiter(map(len, cut), np.int64, len(cut))
        word = np.fromiter(map(get, chain.from_iterable(cut)), np.int64, int(each.sum()))
        if len(self.number) > before:
            ids, size = self.tokens(list(islice(self.number, before, None)))
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
            self.size, self.ids = np.concatenate([self.size, size]), np.concatenate([self.ids, ids])
        size = self.size[word]
        total = np.cumsum(size)
        flat = self.ids[np.arange(int(total[-1]) if len(total) else 0) + np.repeat(self.start[word] - total + size, size)]
        bounds = np.concatenate([[0], total])[np.concatenate([[0], np.cumsum(each)])].tolist()
        return [flat[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


@lru_cache(maxsize=2)
def words_of(path: str, remember: int) -> Words:
    return Words(path, remember)


_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(df: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", remember: int = REMEMBER, at_once: int = AT_ONCE, stay: bool = True) -> DataFrame:
    """Token pieces of each whole text followed by end_id; only what is longer than capacity is cut. at_once: about so many characters of short texts
    are encoded together. stay: a Python worker keeps the tokenizer and its words for later tasks, against its memory."""
    end, step = np.array([end_id], "<u4").tobytes(), 4 * capacity
    names = [x.split()[0] for x in _PIECES.split(", ")]

    def run(batches):
        words = words_of(path, remember) if stay else Words(path, remember)
        for batch in gathered(batches):
            ids, texts = batch.column(0).to_pylist(), [x or "" for x in batch.column(1).to_pylist()]
            k = 0
            while k < len(ids):
                size, first = 0, k
                while k < len(ids) and size < at_once:
                    size += len(texts[k])
                    k += 1
                rows = [[], [], [], [], []]
                for doc, raw in zip(ids[first:k], words.encode(texts[first:k]), strict=True):
                    raw = raw.tobytes() + end
                    for i, at in enumerate(range(0, len(raw), step)):
                        part = raw[at : at + step]
                        for c, v in zip(rows, (doc, i, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(rows)], names)

    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run if stay else giving_back(run), _PIECES)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Sequences that any packing needs.

    For each t up to half the capacity the function that lifts lengths over capacity - t to a whole capacity, drops lengths
    under t and keeps the rest is dual feasible; the bound is the largest of the rounded-up sums.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)
    total = np.concatenate([[0], np.cumsum(count * np.arange(capacity + 1))])
    number = np.concatenate([[0], np.cumsum(count)])
    t = np.arange(0, capacity // 2 + 1)
    lifted = (number[-1] - number[capacity - t + 1]) * capacity + total[capacity - t + 1] - total[t]
    return int(-(-lifted.max() // capacity))


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing of lengths that are sorted downwards: bin and offset of each, fill of each bin."""
    bins, offsets, fill = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    open_by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set while a bin with room r is open
    for i, n in enumerate(lengths.tolist()):
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            own = open_by_room[room]
            b = own.pop()
            if not own:
                rooms ^= 1 << room
        else:
            b, room = len(fill), capacity
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        room -= n
        if room:
            open_by_room[room].append(b)
            rooms |= 1 << room
    return bins, offsets, np.array(fill, np.int64)


def pack_part(part: pd.DataFrame, capacity: int, last: bool) -> pd.DataFrame:
    """Pack one partition; rows of sequences given up for another round have sequence -1."""
    part = part.sort_values(["length", "doc_id", "piece", "start", "ids_crc32"], ascending=[False, True, True, True, True], ignore_index=True)
    bins, offsets, fill = best_fit(part["length"].to_numpy(), capacity)
    if not last and len(fill):
        gap = len(fill) - lower_bound(part["length"].to_numpy(), capacity)
        emptiest = np.argsort(fill, kind="stable")
        give = emptiest[: 1 if gap <= 0 else max(1 + gap, len(fill) // 10)]
        give = give[fill[give] < capacity]
        bins = np.where(np.isin(bins, give), -1, bins)
    return part.assign(bin=bins, offset=offsets)


def _pack_group(capacity: int, last: bool, key: tuple, part: pd.DataFrame) -> pd.DataFrame:
    return pack_part(part, capacity, last)


def pack(table: DataFrame, capacity: int = CAPACITY, per_part: int = PER_PART, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """table: rows as pieces() makes them, already in storage. Adds sequence_id and offset."""
    schema = f"{_PIECES}, part int, bin bigint, offset bigint"
    left, done = table, None
    for turn in range(max_rounds):
        parts = max(1, -(-left.count() // per_part))
        last = parts == 1 or turn == max_rounds - 1
        dealt = left.withColumn("part", F.pmod(F.xxhash64(F.lit(turn), "doc_id", "piece"), F.lit(parts)).cast("int"))
        out = dealt.groupBy("part").applyInPandas(partial(_pack_group, capacity, last), schema)
        if not last:
            out = written(out, "packed")
        closed = out.where("bin >= 0").withColumn("sequence_id", F.lit(turn).cast("bigint") * F.lit(1 << 56) + F.col("part").cast("bigint") * F.lit(1 << 24) + F.col("bin"))
        done = closed if done is None else done.unionAll(closed)
        if last:
            break
        left = out.where("bin < 0").drop("part", "bin", "offset")
    return done.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def pack_documents(df: DataFrame, path: str, remember: int = REMEMBER, at_once: int = AT_ONCE, stay: bool = True, **options) -> DataFrame:
    """Tokenise once into shared storage, then pack. remember: words that a Python worker keeps, against its memory; at_once, stay: see pieces."""
    return pack(written(pieces(df, path, remember=remember, at_once=at_once, stay=stay), "pieces"), **options)
