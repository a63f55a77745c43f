"""Effective states as a running aggregate of a stream: the state store keeps what each link's decisions have come to, so that the log is never read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evirank.operators.evidence import effective_state


def states(decisions: DataFrame, by: list[str]) -> DataFrame:
    """(by, state) of a stream of decisions (by, sequence, reviewer_type, human_review, effective_state), each time that a batch holds decisions of a link.

    The rules are those of the batch operator; decisions may arrive in any order, since the last one is told by its sequence, and one without a state is never the last. What decides
    a link's state is one row of the state store, whatever the length of its log, and comes back from the checkpoint after a failure.
    """
    told = F.when(F.col("effective_state").isNotNull(), F.col("sequence").cast("bigint"))
    return effective_state(decisions.withColumn("sequence", told), by)


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def latest(decisions: DataFrame, by: list[str], path: str, checkpoint: str) -> DataFrame:
    """Run the stream over what is there, keep the states of the links of every batch under path, and return each link's last state and, as its version,
    how often it has changed."""
    spark = decisions.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)  # state need not fit into the executors' memory
    try:
        def add(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/batch={number}")  # a repeated batch replaces itself

        states(decisions, by).writeStream.foreachBatch(add).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    earlier = F.lag("state").over(Window.partitionBy(*by).orderBy("batch"))
    seen = spark.read.parquet(path).withColumn("changed", F.when(F.col("state") == earlier, 0).otherwise(1))
    return seen.groupBy(*by).agg(F.max_by("state", "batch").alias("state"), F.sum("changed").alias("version"))
