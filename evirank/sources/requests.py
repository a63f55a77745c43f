"""Requests planned in batches over saved replies: every input goes out once, and every reply record is matched back by the input that it echoes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evirank.operators.scan import scanned
from evirank.storage import stored

#: Alleles of one annotation request.
ANNOTATED = 200


def allele_input(chrom: str = "chrom", pos: str = "pos", ref: str = "ref", alt: str = "alt") -> Column:
    """An allele as the annotation service takes it, and echoes it."""
    dot = F.lit(".")
    return F.concat_ws(" ", F.col(chrom), F.col(pos).cast("string"), dot, F.col(ref), F.col(alt), dot, dot, dot)


def planned(inputs: DataFrame, columns: list[str], text: Column, size: int = ANNOTATED) -> DataFrame:
    """(batch, place, input, columns): distinct rows of `columns` without nulls, in their order, `size` to a batch; in storage.

    Places come from ranges of the order, so nothing is sorted in one task, and the same alleles make the same batches whatever rows they come from.
    """
    known = inputs.select(*columns).dropna().distinct()
    placed = scanned(known, [], [F.col(c).asc() for c in columns], {"__n": F.lit(1).cast("bigint")})
    return stored(placed.select(F.floor(F.col("__n") / size).cast("bigint").alias("batch"), (F.col("__n") % size).alias("place"), text.alias("input"), *columns), "planned")


def requests(plan: DataFrame, source: str, version: str = "live") -> DataFrame:
    """(batch, request_key, body) with one row for each request; the key is a digest of what is asked, of whom and in which version."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "input"))), lambda x: x["input"])  # at most `size` of a batch
    bodies = plan.groupBy("batch").agg(F.to_json(F.struct(listed.alias("variants"))).alias("body"))
    key = F.sha2(F.concat_ws("\n", F.lit(source), F.lit(version), F.col("body")).cast("binary"), 256)
    return bodies.select("batch", key.alias("request_key"), "body")


def matched_back(plan: DataFrame, asked: DataFrame, replies: DataFrame, record: str, strict: bool = True) -> DataFrame:
    """plan with status and record (a struct of the type `record`, which has a field input).

    replies: (request_key, body), the saved body of each request, a JSON array of records. A record belongs to the input that it echoes, in its own batch only. An input without
    a record is `missing`; one that several records echo is `doubled`, with the smallest of them; a batch without a reply is `unanswered`, and a record that echoes no input of its batch is
    foreign. If strict, a doubled or foreign echo fails the job; missing ones stay missing.
    """
    met = asked.select("batch", "request_key").join(replies.select("request_key", F.col("body").alias("reply")), "request_key")
    parsed = met.select("batch", F.from_json("reply", f"array<{record}>", {"mode": "FAILFAST"}).alias("records"))
    records = parsed.select("batch", F.explode("records").alias("record")).withColumn("input", F.col("record.input"))
    echoed = records.groupBy("batch", "input").agg(F.count("*").alias("n"), F.min("record").alias("record"))
    answered = met.select("batch").distinct().withColumn("answered", F.lit(True))
    j = plan.join(echoed, ["batch", "input"], "full").join(answered, "batch", "left")
    status = F.when(F.col("place").isNull(), "foreign").when(F.col("n") > 1, "doubled").when(F.col("n") == 1, "matched").when(F.col("answered"), "missing").otherwise("unanswered")
    j = j.withColumn("status", status)
    if strict:
        j = j.where(F.when(F.col("status").isin("foreign", "doubled"), F.raise_error(F.concat(F.lit("a reply echoes "), F.col("status"), F.lit(" input: "), F.coalesce("input", F.lit("null")))).cast("boolean")).otherwise(True))
    return j.select(*plan.columns, "status", "record")
