"""Effective states kept up to date from a stream of decisions (an extension: the batch operator is the definition)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evirank.operators.evidence import effective_state


def maintain(decisions: DataFrame, log_path: str, state_path: str, checkpoint: str, by: list[str]) -> StreamingQuery:
    """Append each micro-batch to the log, partitioned by batch so that a repeated batch replaces itself, and write the states of the links it touches."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{log_path}/batch={number}")
        touched = batch.select(*by).distinct()
        log = spark.read.parquet(log_path).where(F.col("batch") <= number).join(touched, by, "left_semi")
        effective_state(log, by).withColumn("version", F.lit(number)).write.mode("overwrite").parquet(f"{state_path}/batch={number}")

    return decisions.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(states: DataFrame, by: list[str]) -> DataFrame:
    """The latest state of each link."""
    return states.groupBy(*by).agg(F.max_by("state", "version").alias("state"))
