"""What the corpus operators share: table reading, shared-storage tables, distinct texts, joins with hot keys, components."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that may be sent to all tasks, and rows of one key from which on it counts as hot.
SMALL_IDS, HOT = 300_000, 1_000
BATCH_ROWS, BATCH_BYTES = 500, 2 << 20


def ship(spark: SparkSession) -> None:
    """Give this package to the executors once for each application, through Spark's own file server.

    Arrow batches of the session are held to BATCH_ROWS rows and BATCH_BYTES bytes, whatever it had set before, so that long texts stay
    within a Python worker's memory.
    """
    context = spark.sparkContext
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        said = spark.conf.get(name)
        if not (said.isdigit() and 0 < int(said) <= most):
            spark.conf.set(name, str(most))
    if getattr(context, "_evirank_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="evirank-code-")) / "evirank_package.zip"  # the driver serves it from here
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(str(path))
    context._evirank_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a session within one process may leave it unset and gets a temporary one."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="evirank-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def written(df: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    """Cut the lineage: write df once as Parquet in the shared folder and read it back.

    The files go when the application ends. A lost executor costs nothing that was written.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    jvm.System.gc()  # lets Spark drop the shuffle files of what is now written
    return spark.read.schema(df.schema).parquet(path)


def gathered(batches: Iterator[pa.RecordBatch], most: int = 6_000_000) -> Iterator[pa.RecordBatch]:
    """Runs of small batches as one of about `most` bytes, for work that is done once for each batch."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held and (rest := pa.Table.from_batches(held).combine_chunks().to_batches()):
        yield rest[0]


def give_back() -> None:
    """Return what this process's allocators hold unused to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a function of mapInArrow or mapInPandas, that ends with give_back: Spark keeps Python workers for later tasks, and what one task has
    freed else counts against the executor through all of them."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def crc_of_id(column: str = "doc_id"):
    """crc32 of the id written as decimal text, as a BIGINT expression; a null id is the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name like this one that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def key_of(text: Column) -> Column:
    """A 64-bit name of a text; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def few(keys: DataFrame) -> DataFrame:
    """keys, to be sent to all tasks if there are at most SMALL_IDS; it must be in storage and narrow."""
    return F.broadcast(keys) if keys.count() <= SMALL_IDS else keys


def repeated_texts(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """(text_key, text_check, copies) of the texts that several rows hold, told apart by 128 bits of hashes; in storage."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = documents.select(F.xxhash64(text).alias("text_key"), F.xxhash64(F.lit(29), text).alias("text_check"))
    return written(named.groupBy("text_key", "text_check").agg(F.count("*").alias("copies")).where("copies > 1"), "copies")


def distinct_texts(documents: DataFrame, repeated: DataFrame, text_col: str = "text") -> DataFrame:
    """(text_key, text, copies): each distinct text once. Only texts with copies are shuffled, as long as their keys are few."""
    keys = ["text_key", "text_check"]
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = documents.select(text.alias("text")).select(F.xxhash64("text").alias("text_key"), F.xxhash64(F.lit(29), "text").alias("text_check"), "text")
    sent = few(repeated)
    single = named.join(sent.select(*keys), keys, "left_anti").select("text_key", "text", F.lit(1).cast("bigint").alias("copies"))
    several = named.join(sent, keys).groupBy(*keys).agg(F.first("text").alias("text"), F.first("copies").alias("copies")).select("text_key", "text", "copies")
    return single.unionAll(several)


def texts_of(documents: DataFrame, keys: DataFrame, text_col: str = "text") -> DataFrame:
    """(text_key, text): one row for each of the keys, a table in storage with distinct text_key."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = documents.select(text.alias("text")).withColumn("text_key", F.xxhash64("text")).join(few(keys.select("text_key")), "text_key", "left_semi")
    return found.groupBy("text_key").agg(F.first("text").alias("text"))


def joined(left: DataFrame, right: DataFrame, on: list[str], n: str, how: str = "inner") -> DataFrame:
    """left joined (inner or left_semi) with right, a table in storage with one row for each key and the number n of left rows it meets.

    Keys that meet very many rows never gather these in one task: they are sent to all tasks, and there are at most SMALL_IDS of
    them, since their numbers add up to the rows of left.
    """
    total, most = right.agg(F.coalesce(F.sum(n), F.lit(0)), F.coalesce(F.max(n), F.lit(0))).first()
    least = max(HOT, total // SMALL_IDS + 1)
    if most <= least:
        return left.join(right, on, how)
    hot = right.where(F.col(n) > least)
    rest = left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(right.where(F.col(n) <= least), on, how)
    return left.join(F.broadcast(hot), on, how).unionByName(rest)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of undirected (a, b) edges over BIGINT ids: one row (id, component) per id met.

    component is the smallest id reachable. Large-star and small-star steps alternate until nothing
    changes; each step is a grouped shuffle whose result is written to shared storage. A vertex with very many
    neighbours never becomes one row: neighbours stay rows, and only a minimum is aggregated for each vertex. The job fails if
    `rounds` rounds do not settle them; the number of rounds grows with the logarithm of the longest path.
    """
    spark = edges.sparkSession
    schema = "a bigint, b bigint"
    current = written(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = current.unionAll(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: every larger neighbour is tied to the least of the neighbourhood
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        # small star: smaller neighbours and the vertex itself are tied to the least of them
        small = large.join(down, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        current = written(small, "edges")
        state = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    stars = current.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("id"), "component")
    roots = stars.select(F.col("component").alias("id"), "component").distinct()
    return stars.unionAll(roots) if before else spark.createDataFrame([], schema).select(F.col("a").alias("id"), F.col("b").alias("component"))


def extended(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels, (id, component) of some ids, after more links (a, b): only the components that these join are worked on."""
    own = labels.select(F.col("id"), F.col("component"))
    ends = links.join(own.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a", "left").join(own.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b", "left")
    moved = written(components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))), "moved")
    old = own.join(moved.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    return old.unionAll(moved.join(own, "id", "left_anti").select("id", "component"))
