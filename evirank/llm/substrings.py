"""Exact removal of repeated long substrings with a run-length suffix index.

Every LENGTH-byte string that starts at two places is to go. Each distinct text is worked on once: where several rows hold the same
text, all of it goes. All strings of the length hold an anchor: the least hash among their K-byte grams, so equal strings hold the same
anchor at the same offset, and one byte in about eighty begins an anchor. Anchors
are counted over the corpus. Where all occurrences of an anchor have the same context (all strings of the length that hold it),
the context is repeated as a whole. Where contexts differ, one of each kind goes to an index task: it builds the Burrows-Wheeler transform of
the contexts, aligned at the anchor, and keeps nothing but its runs, with a common prefix sampled where each run begins. All others
follow from the samples, one more with each step to the left, so a single stream over the runs gives the matching statistics of all
contexts; what matches LENGTH bytes or more is marked.

Nothing but anchors is shuffled for all texts. Counts are combined before the shuffle, and anchors or contexts that occur very often are sent
to the rows instead of gathering them. All strings of a context hold its anchor, so they overlap and what goes of a context is one run. The contexts of an anchor that has more
than BLOCK_CONTEXTS of them are not gathered: names of their strings are counted, first of STEP neighbouring strings by the bytes they have in common,
then of single ones where these are shared, so the work grows with the contexts whatever they share.

Defined results: null text counts as empty; texts under LENGTH bytes stay whole; matches never cross texts; overlapping
occurrences count; strings are judged on the input; repeated rows repeat each other; rows are told apart by their texts, so null and repeated ids do not
matter; an empty table gives no rows; extra columns are dropped by digests() and kept, whatever their names, by deduplicated().
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evirank.llm.common import distinct_texts, few, fresh, giving_back, joined, key_of, repeated_texts, written

LENGTH, K, SEGMENT, CHUNK, BLOCK_CONTEXTS = 200, 32, 1 << 22, 10_000, 10_000
_BASE = 0x9E3779B97F4A7C15
_M64 = (1 << 64) - 1


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all k-byte strings, built by doubling."""
    powers = {1: _BASE}
    have, h, left, out = 1, data.astype(np.uint64) + np.uint64(1), k, None
    taken = 0
    while left:
        if left & have:
            if out is None:
                out, taken = h, have
            else:
                n = len(data) - taken - have + 1
                out = out[:n] * np.uint64(powers[have]) + h[taken : taken + n]
                taken += have
            left -= have
        if left:
            n = len(data) - 2 * have + 1
            h = h[:n] * np.uint64(powers[have]) + h[have : have + n]
            powers[2 * have] = powers[have] * powers[have] & _M64
            have *= 2
    h = out
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` consecutive values."""
    n = len(values)
    rows = -(-n // width)
    padded = np.full(rows * width, np.uint64(_M64))
    padded[:n] = values
    grid = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(raw: bytes, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of each anchor: the least gram of some string of the length; ties go to the first."""
    hashes, places = [], []
    for at in range(0, max(1, len(raw) - length + 1), SEGMENT):
        part = np.frombuffer(raw, np.uint8)[at : at + SEGMENT + length - 1]
        if len(part) < length:
            continue
        h = gram_hashes(part, k)
        mixed = (h & np.uint64(_M64 ^ 0x7FFFFF)) | np.arange(len(h), dtype=np.uint64)  # 41 bits of hash, then the place
        place = np.unique(sliding_least(mixed, length - k + 1) & np.uint64(0x7FFFFF)).astype(np.int64)
        hashes.append(h[place])
        places.append(place + at)
    if not places:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    place, first = np.unique(np.concatenate(places), return_index=True)
    return np.concatenate(hashes)[first], place


def context(size: int, place: int, length: int, k: int) -> tuple[int, int]:
    return max(0, place - (length - k)), min(size, place + length)


_OCCURRENCES = "anchor bigint, context bigint, text_key bigint, place bigint"


def occurrences(texts: DataFrame, length: int, k: int) -> DataFrame:
    """Every anchor of each text (text_key, text), with a hash of its context."""

    def run(batches):
        for batch in batches:
            keys, heads, sides, places = [], [], [], []
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(raw) < length:
                    continue
                h, place = anchors(raw, length, k)
                view, reach, digest = memoryview(raw), length - k, xxhash.xxh3_64_intdigest
                heads.append(h.view(np.int64))
                places.append(place)
                keys.append(np.full(len(place), key, np.int64))
                sides.append(np.fromiter((digest(view[p - reach if p > reach else 0 : p + length], min(p, reach)) for p in place.tolist()), np.uint64, len(place)).view(np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (heads, sides, keys, places)], ["anchor", "context", "text_key", "place"])

    return texts.select("text_key", F.col("text").cast("binary").alias("raw")).mapInArrow(giving_back(run), _OCCURRENCES)


GAP = 256  # what stands beyond a text's ends; it equals nothing
_SYMBOLS = GAP + 1


def _moved(begin: np.ndarray, head: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The step to the next column's order: runs sorted by head and moved as blocks. Sorted runs, where they begin then, and each row's old place."""
    runs = np.argsort(head, kind="stable")
    size = np.diff(np.append(begin, n))[runs]
    at = np.cumsum(size) - size
    return runs, at, np.repeat(begin[runs] - at, size) + np.arange(n)


class RunLengthIndex:
    """The transform of aligned contexts as runs, with samples where they begin.

    Contexts are rows aligned at their anchor, so equal strings at different rows are equal columns. Going from the last
    column to the first, the transform of a column is its symbols in the order of the column after it, and a stable sort of it by (group, symbol) gives
    the order of the column. The index keeps, for each column, where the runs of the transform begin, their heads, and for each run
    the common prefix of its first row with the row that comes before it in the column's own order. Rows that follow each other inside a run still do
    after the step, so their common prefix grows by one and need not be kept.
    """

    def __init__(self, rows: np.ndarray, group: np.ndarray):
        self.n, self.width = rows.shape
        self.first = np.argsort(group, kind="stable").astype(np.int32)
        self.columns: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # beginnings, heads, samples; last column first
        order, number = self.first, np.unique(group, return_inverse=True)[1]
        for column in range(self.width - 1, -1, -1):
            key = number[order] * _SYMBOLS + rows[order, column]
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if self.n else np.empty(0, np.int64)
            head = key[begin]
            runs, at, place = _moved(begin, head, self.n)
            order = order[place]
            met = np.flatnonzero((head[runs][1:] == head[runs][:-1]) & (head[runs][1:] % _SYMBOLS != GAP)) + 1
            sample = np.zeros(len(runs), np.int32)
            if len(met):
                sample[met] = 1 + _common(rows, order[at[met] - 1], order[at[met]], column + 1)
            self.columns.append((begin.astype(np.int32), head, sample))

    @property
    def runs(self) -> int:
        return sum(len(begin) for begin, _, _ in self.columns)

    def stream(self, length: int) -> np.ndarray:
        """For each row and column whether `length` symbols from there on also stand at that column of another row of the group.

        Reads the runs and samples only; the greater of a row's two common prefixes is its matching statistic.
        """
        out = np.zeros((self.n, self.width), bool)
        order, common = self.first, np.zeros(self.n, np.int32)  # common prefix of each row in the order with the one before it
        for column, (begin, head, sample) in zip(range(self.width - 1, -1, -1), self.columns, strict=True):
            runs, at, place = _moved(begin, head, self.n)
            order, common = order[place], common[place] + 1
            gap = head[runs] % _SYMBOLS == GAP
            if gap.any():
                common[np.repeat(gap, np.diff(np.append(at, self.n)))] = 0
            common[at] = sample
            if column + length <= self.width:
                out[order, column] = np.maximum(common, np.append(common[1:], 0)) >= length
        return out


def _common(rows: np.ndarray, a: np.ndarray, b: np.ndarray, column: int, step: int = 16) -> np.ndarray:
    """Common prefixes of pairs of rows from a column on."""
    found, live = np.zeros(len(a), np.int32), np.arange(len(a))
    while len(live) and column < rows.shape[1]:
        p, q = rows[a[live], column : column + step], rows[b[live], column : column + step]
        same = (p == q) & (p != GAP)
        run = np.where(same.all(axis=1), same.shape[1], same.argmin(axis=1))
        found[live] += run.astype(np.int32)
        live = live[run == same.shape[1]]
        column += step
    return found


def repeated_in(contexts: list[tuple[int, int, bytes]], length: int, k: int) -> list[tuple[int, int] | None]:
    """For each (group, bytes before the anchor, context) the run of bytes in strings that other contexts of the group hold too, or None.

    It is one run: all strings of a context hold the anchor, so any two of them overlap.
    """
    reach = length - k
    rows = np.full((len(contexts), 2 * reach + k), GAP, np.uint16)
    for i, (_, before, c) in enumerate(contexts):
        rows[i, reach - before : reach - before + len(c)] = np.frombuffer(c, np.uint8)
    index = RunLengthIndex(rows, np.array([a for a, _, _ in contexts], np.int64))
    del rows
    found = index.stream(length)
    first, last = found.argmax(axis=1).tolist(), (found.shape[1] - 1 - found[:, ::-1].argmax(axis=1)).tolist()
    shift = [reach - before for _, before, _ in contexts]
    return [(a - x, b - x + length) if own else None for own, a, b, x in zip(found.any(axis=1).tolist(), first, last, shift, strict=True)]


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Touching and overlapping runs as one, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


_FOUND = "anchor bigint, context bigint, low bigint, high bigint"
_CONTEXTS = "anchor bigint, context bigint, before bigint, bytes binary"


def _cut_contexts(texts: DataFrame, kinds: DataFrame, length: int, k: int) -> DataFrame:
    """(anchor, context, before, bytes): one example of each kind of context, cut from its text."""

    def cut(batches):
        for batch in batches:
            rows = [[], [], [], []]
            for raw, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w in wanted:
                    low, high = context(len(raw), w["place"], length, k)
                    if high > len(raw) or high - low < length:
                        continue  # another text of the same 64-bit name
                    for c, v in zip(rows, (w["anchor"], w["context"], w["place"] - low, raw[low:high]), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.binary())], [x.split()[0] for x in _CONTEXTS.split(", ")])

    by_text = written(kinds.groupBy("text_key").agg(F.collect_list(F.struct("anchor", "context", "place")).alias("wanted")), "substrings-by-text")
    some = texts.select("text_key", F.col("text").cast("binary").alias("raw")).join(few(by_text.select("text_key")), "text_key", "left_semi")
    return some.join(by_text.hint("merge"), "text_key").select("raw", "wanted").mapInArrow(giving_back(cut), _CONTEXTS)


_CELLS = "anchor bigint, context bigint, start int, cell bigint"
STEP = 8


def _cells(contexts: DataFrame, step: int, length: int, k: int) -> DataFrame:
    """(anchor, context, start, cell) for each of a context's starts: a name of the bytes that two contexts both hold if they share a string
    of the length with start to start + step - 1 bytes before the anchor. contexts: its columns and starts."""
    reach, digest = length - k, xxhash.xxh3_64_intdigest

    def run(batches):
        for batch in batches:
            rows = [[], [], [], []]
            for a, c, before, raw, starts in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                view, after = memoryview(raw), len(raw) - before - k
                for start in starts:
                    right = max(0, reach - start - step + 1)
                    if start <= before and right <= after:
                        for column, v in zip(rows, (a, c, start, digest(view[before - start : before + k + right], start) - (1 << 63)), strict=True):
                            column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], [x.split()[0] for x in _CELLS.split(", ")])

    return contexts.select("anchor", "context", "before", "bytes", "starts").mapInArrow(giving_back(run), _CELLS)


def _shared_cells(cells: DataFrame) -> DataFrame:
    """The rows of cells that several contexts hold."""
    cells = written(cells, "substrings-cells")
    return joined(cells, written(cells.groupBy("cell").agg(F.count("*").alias("m")).where("m > 1"), "substrings-sizes"), ["cell"], "m", "left_semi")


def _by_cells(contexts: DataFrame, length: int, k: int) -> DataFrame:
    """The run of each context, whatever the contexts of an anchor: each is looked up by names of its strings and meets no other one.

    First STEP neighbouring strings are looked up at once by what they have in common, then only the strings of those that some other context shares.
    """
    reach = length - k
    wide = _shared_cells(_cells(contexts.withColumn("starts", F.sequence(F.lit(0), F.lit(reach), F.lit(STEP))), STEP, length, k))
    wide = wide.groupBy("anchor", "context").agg(F.collect_list("start").alias("wide"))  # reach / STEP at most
    each = F.flatten(F.transform("wide", lambda w: F.sequence(w, F.least(w + F.lit(STEP - 1), F.lit(reach)))))
    found = _shared_cells(_cells(contexts.join(wide, ["anchor", "context"]).withColumn("starts", each), 1, length, k))
    run = found.groupBy("anchor", "context").agg(F.min("start").alias("least"), F.max("start").alias("most"))
    at = lambda c: c.cast("bigint")
    return run.join(contexts.select("anchor", "context", "before"), ["anchor", "context"]).select("anchor", "context", at(F.col("before") - F.col("most")).alias("low"), at(F.col("before") + length - F.col("least")).alias("high"))


def _indexed(contexts: DataFrame, length: int, k: int) -> DataFrame:
    """The run of bytes of each kind of context that is repeated; of an anchor with more than BLOCK_CONTEXTS they come from cells."""

    def run(frames):
        held: list[tuple[int, int, bytes, int, int]] = []
        last = None

        def flush():
            # each group keeps its own number, so that nothing matches across groups
            found = repeated_in([(g, before, b) for g, before, b, _, _ in held], length, k)
            out = [(a, c, *run) for (_, _, _, a, c), run in zip(held, found, strict=True) if run]
            return pd.DataFrame(out, columns=["anchor", "context", "low", "high"], dtype="int64")

        number = 0
        for frame in frames:
            for a, c, before, b in zip(frame["anchor"], frame["context"], frame["before"], frame["bytes"], strict=True):
                if a != last:
                    if len(held) > CHUNK:
                        yield flush()
                        held.clear()
                    last, number = a, number + 1
                held.append((number, before, b, a, c))
        if held:
            yield flush()

    sizes = written(contexts.groupBy("anchor").agg(F.count("*").alias("m")).where("m > 1"), "substrings-sizes")
    sized = joined(contexts, sizes, ["anchor"], "m")
    few_each = sized.where(F.col("m") <= BLOCK_CONTEXTS).select("anchor", "context", "before", "bytes")
    out = few_each.repartition("anchor").sortWithinPartitions("anchor", "context").mapInPandas(giving_back(run), _FOUND)
    if sizes.where(F.col("m") > BLOCK_CONTEXTS).isEmpty():
        return out
    return out.unionAll(_by_cells(written(sized.where(F.col("m") > BLOCK_CONTEXTS).select("anchor", "context", "before", "bytes"), "substrings-large"), length, k))


def removals(documents: DataFrame, text_col: str = "text", length: int = LENGTH, k: int = K) -> tuple[DataFrame, DataFrame]:
    """(text_key, runs) of the texts that stand once and hold repeated strings: byte runs [low, high) to remove, unmerged; and the keys of texts
    of several rows, of which all goes. Both are in storage."""
    repeated = repeated_texts(documents, text_col)
    texts = distinct_texts(documents, repeated, text_col)
    every = written(occurrences(texts, length, k), "substrings-anchors")
    of_anchor = every.groupBy("anchor").agg(F.count("*").alias("n"), F.min("context").alias("lo"), F.max("context").alias("hi")).where("n > 1")
    of_anchor = written(of_anchor.select("anchor", "n", (F.col("lo") != F.col("hi")).alias("mixed")), "substrings-counts")
    shared = written(joined(every, of_anchor, ["anchor"], "n").select("anchor", "context", "text_key", "place", "mixed"), "substrings-shared")
    mixed = shared.where("mixed").drop("mixed")
    kinds = written(mixed.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(F.struct("text_key", "place")).alias("first")).select("anchor", "context", "n", "first.text_key", "first.place"), "substrings-kinds")
    contexts = written(_cut_contexts(texts, kinds, length, k), "substrings-contexts")
    found = written(_indexed(contexts, length, k), "substrings-found")

    reach = length - k
    again = joined(mixed, kinds.where("n > 1").select("anchor", "context", "n"), ["anchor", "context"], "n", "left_semi")
    whole = shared.where("not mixed").select("text_key", "place").unionAll(again.select("text_key", "place")).select("text_key", F.greatest(F.lit(0), F.col("place") - reach).alias("low"), (F.col("place") + length).alias("high"))
    # a context that stands alone has its one place beside it, so occurrences are not joined again
    start = F.greatest(F.lit(0), F.col("place") - reach)
    part = kinds.where("n = 1").join(found, ["anchor", "context"]).select("text_key", (start + F.col("low")).alias("low"), (start + F.col("high")).alias("high"))
    runs = whole.unionAll(part).join(few(repeated.select("text_key")), "text_key", "left_anti").groupBy("text_key").agg(F.collect_list(F.struct("low", "high")).alias("runs"))
    return written(runs, "substrings-runs"), repeated


def _cleaned(raw: bytes, runs: list[dict]) -> tuple[bytes, list[tuple[int, int]]]:
    gone = merged([(r["low"], min(r["high"], len(raw))) for r in runs if r["low"] < len(raw)])
    kept, at = [], 0
    for a, b in gone:
        kept.append(raw[at:a])
        at = b
    kept.append(raw[at:])
    return b"".join(kept), gone


_DIGEST = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _dealt(documents: DataFrame, text_col: str, key: str, runs: DataFrame, repeated: DataFrame, length: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of documents in three parts: texts that go as a whole, texts with runs to remove, and texts that stay; key is added."""
    rows = documents.withColumn(key, key_of(F.col(text_col)))
    copied, touched = few(repeated.select(F.col("text_key").alias(key)).distinct()), few(runs.select(F.col("text_key").alias(key)))
    long = F.length(F.col(text_col).cast("binary")) >= length
    alone = rows.join(copied, key, "left_anti")
    copies = rows.join(copied, key, "left_semi")
    return copies.where(long), alone.join(touched, key, "left_semi"), alone.join(touched, key, "left_anti").unionAll(copies.where(~F.coalesce(long, F.lit(False))))


def digests(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Counts and the digest of what is kept, for each row."""
    runs, repeated = removals(documents, text_col, **options)
    rows = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    gone, touched, rest = _dealt(rows, "text", "text_key", runs, repeated, options.get("length", LENGTH))

    def clean(batches):
        for batch in batches:
            rows = [[], [], [], [], []]
            for doc, raw, own in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                kept, spans = _cleaned(raw, own)
                for c, v in zip(rows, (doc, len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in rows[:4]), pa.array(rows[4], pa.string())], [x.split()[0] for x in _DIGEST.split(", ")])

    changed = touched.select("doc_id", F.col("text").cast("binary").alias("raw"), "text_key").join(runs.hint("merge"), "text_key").select("doc_id", "raw", "runs").mapInArrow(clean, _DIGEST)
    number = lambda v: F.lit(v).cast("bigint")
    size = F.length(F.col("text").cast("binary")).cast("bigint")
    whole = rest.select("doc_id", size.alias("n_bytes"), number(0).alias("n_removed"), number(0).alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
    empty = gone.select("doc_id", size.alias("n_bytes"), size.alias("n_removed"), number(1).alias("n_spans"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"))
    return changed.unionAll(whole).unionAll(empty)


def deduplicated(documents: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """documents with what is repeated cut out of their texts; bytes left of a cut character are dropped."""
    runs, repeated = removals(documents, text_col, **options)
    key, own = fresh(documents, "text_key"), fresh(documents, "runs")
    gone, touched, rest = _dealt(documents, text_col, key, runs, repeated, options.get("length", LENGTH))

    @F.arrow_udf("string")
    def clean(text: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([_cleaned(t.encode(), r)[0].decode("utf-8", "ignore") for t, r in zip(text.to_pylist(), spans.to_pylist(), strict=True)], pa.string())

    changed = touched.join(runs.select(F.col("text_key").alias(key), F.col("runs").alias(own)).hint("merge"), key).withColumn(text_col, clean(F.col(text_col), F.col(own)))
    return changed.select(*documents.columns).unionAll(gone.withColumn(text_col, F.lit("")).select(*documents.columns)).unionAll(rest.select(*documents.columns))
