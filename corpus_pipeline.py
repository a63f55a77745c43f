"""Corpus pipeline: quality, near duplicates, repeated substrings, personal data, packing.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. All but
the last return the columns of documents, with n_chars brought up to date where texts change.

Defined results: null texts are scored, compared and packed as empty ones; texts without words are no one's near duplicates; of linked or repeated
rows the one with the smallest id stays (ties: by a hash of the text; of equal rows any one), also where ids are null (null comes first) or repeat with other
texts; an empty table gives no rows; extra columns, whatever their names, are carried through all but the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evirank.llm import jaccard, packing, pii, quality, substrings
from evirank.llm.common import few, fresh, key_of, table, written


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("bigint"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier accepts."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near duplicates."""
    found = written(jaccard.link_table(docs), "near-duplicates")
    groups = found.where("component is not null").groupBy("component").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "text_key")).alias("stays")).where("n > 1")
    groups = written(groups.select("component", F.col("stays.doc_id").alias("stays_id"), F.col("stays.text_key").alias("stays_key")), "near-duplicate-groups")
    texts = found.select("component", "text_key").distinct().join(few(groups.select("component")), "component", "left_semi")
    key, stays = fresh(docs, "text_key"), fresh(docs, "stays_id")
    grouped = few(written(texts.select(F.col("text_key").alias(key)), "near-duplicate-texts"))
    staying = few(written(groups.select(F.col("stays_key").alias(key), F.col("stays_id").alias(stays)), "near-duplicate-stays"))
    keyed = docs.withColumn(key, key_of(F.col("text")))
    alone = keyed.join(grouped, key, "left_anti")
    kept = keyed.join(staying, key).where(F.col("doc_id").cast("bigint").eqNullSafe(F.col(stays))).dropDuplicates([key])
    return alone.select(*docs.columns).unionAll(kept.select(*docs.columns))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the long substrings that also stand elsewhere."""
    return _measured(substrings.deduplicated(docs)).select(*docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with protected values and the terms that disclose them replaced or removed."""
    return _measured(pii.sanitised(docs)).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all texts with their sequences and places."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), remember=150_000, at_once=1_000_000, stay=False)  # the executors also hold what earlier stages left


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", one_of_each_group),
    ("repeated_substrings", without_repeats),
    ("personal_data", without_personal_data),
    ("packing", packed),
]

#: The classifier, the disclosure counts and the tokenizer are beyond SQL; tests hold the stages' operators against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
