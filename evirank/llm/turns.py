"""Conversations as ordered turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evirank.llm.common import written
from evirank.llm.radix import ranked, sortable


def said(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def placed(conversations: DataFrame, more: dict[str, Column], keep: DataFrame | None = None) -> DataFrame:
    """(conv_id, pos, ...): the turns of each conversation from 1 in ascending order of turn, a null turn first.

    Rows of a conversation with equal turns are ordered by a SHA-256 of role and text, and equal rows in any order. Rows without a conv_id take no part. Columns
    of `more` are computed before rows are written, so that texts go only where they are wanted.
    """
    tie = F.sha2(F.concat(F.octet_length(said("role")).cast("string"), F.lit(":"), said("role"), said("text")).cast("binary"), 256)
    order = F.coalesce(F.concat(F.lit("1"), sortable(F.col("turn"))), F.lit("0"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.concat(order, F.lit(":"), tie).alias("__order"), F.monotonically_increasing_id().alias("__uid"), *(c.alias(n) for n, c in more.items()))
    rows = written(rows, "turns")
    out = ranked(rows, ["conv_id"], F.concat("__order", F.lit(":"), sortable(F.col("__uid"))), "__pos")
    return out.select("conv_id", (F.col("__pos") + 1).alias("pos"), *more)
