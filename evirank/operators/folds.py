"""Folds over sorted groups of any size: rows stream through their task in order, chunk by chunk, and only a small state is carried on."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def folded(df: DataFrame, by: list[str], order: list[str], size: str, start: tuple, step: Callable, name: str, kind: str) -> DataFrame:
    """(by, order, size, name): step(state, sizes) is called with the sizes of consecutive rows of one group and returns the next state and one result for each.

    Groups are dealt to tasks and sorted there by Spark, which spills; a chunk is what of an Arrow batch belongs to one group. So a group may be larger than
    memory, and a task holds one batch and one state. Rows that are equal by `order` come in any order; a null size counts as 0; groups and orders may be null.
    """
    rows = df.select(*by, *order, F.coalesce(F.col(size).cast("bigint"), F.lit(0).cast("bigint")).alias(size), F.xxhash64(*by, *(F.col(c).isNull() for c in by)).alias("__group"))
    dealt = rows.repartition(*by).sortWithinPartitions(*by, *order)
    result = {"bigint": pa.int64(), "boolean": pa.bool_()}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, start
        for batch in batches:
            if not batch.num_rows:
                continue
            group, sizes = batch.column("__group").to_numpy(), batch.column(size).to_numpy()
            named = [batch.column(c) for c in by]
            cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1), batch.num_rows]
            out = []
            for low, high in zip(cuts, cuts[1:], strict=False):
                here = tuple(c[int(low)].as_py() for c in named)
                if here != key:
                    key, state = here, start
                state, made = step(state, sizes[low:high])
                out.append(made)
            columns = [batch.column(c) for c in [*by, *order, size]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(out), result)], names=[*by, *order, size, name])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__group"), f"`{name}` {kind}"])
    return dealt.mapInArrow(run, schema)


def next_fit(capacity: int) -> Callable:
    """Step of next-fit: state (bin, used); a row that would overfill a bin that is in use begins the next one."""

    def step(state: tuple, sizes: np.ndarray) -> tuple:
        number, used = state
        ends = np.concatenate([[0], np.cumsum(sizes)])
        bins, at = np.empty(len(sizes), np.int64), 0
        while at < len(sizes):
            # rows that still fit behind what is used; sizes are not negative, so their sums ascend
            fit = int(np.searchsorted(ends, ends[at] + capacity - used, "right")) - 1
            if used == 0:
                fit = max(fit, at + 1)
                while fit < len(sizes) and ends[fit] == ends[at]:  # empty rows leave a bin unused
                    fit += 1
            fit = max(fit, at)
            bins[at:fit] = number
            used += int(ends[fit] - ends[at])
            at = fit
            if at < len(sizes):
                if used == 0:
                    continue
                number, used = number + 1, 0
        return (number, used), bins

    return step


def capped(max_units: int, max_size: int) -> Callable:
    """Step of greedy choice: state (units, used); what does not fit is skipped and later rows may still fit."""

    def step(state: tuple, sizes: np.ndarray) -> tuple:
        n, used = state
        kept = np.zeros(len(sizes), bool)
        for i in np.flatnonzero(sizes <= max_size - used) if n < max_units else ():
            if n < max_units and used + int(sizes[i]) <= max_size:
                kept[i], n, used = True, n + 1, used + int(sizes[i])
        return (n, used), kept

    return step
