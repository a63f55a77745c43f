"""Reference sequences read in splits: FASTA lines of any number of files become chunks of contigs, and places are looked up by chunk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evirank.operators.scan import looked_up
from evirank.storage import stored

#: Bases of a chunk.
CHUNK = 1 << 14


def sequence_ranges(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """(chrom, chunk, sequence) of FASTA files, in storage: upper-case bases chunk * `chunk` to the next, from 0.

    Spark splits the files and a line belongs to the split that it begins in. Lines are numbered within their split, headers and bases are summed for each split,
    and the sums of earlier splits of the file say which contig a split begins in and how many of its bases lie before. So no task holds more than a split, and a contig
    may span any number of them. A contig named twice, a header without a name and bases before the first header fail the job; lines are not split, so a
    sequence should be wrapped.
    """
    read = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"), "value")
    head = F.startswith("value", F.lit(">"))
    bases = F.when(head, "").otherwise(F.upper(F.regexp_replace("value", r"\s+", "")))
    lines = stored(read.select("file", "split", "line", head.alias("head"), F.when(head, F.regexp_extract("value", r"^>\s*(\S*)", 1)).alias("name"), bases.alias("bases")), "fasta-lines")
    upto = Window.partitionBy("file", "split").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("part", F.sum(F.col("head").cast("bigint")).over(upto)).withColumn("size", F.length("bases").cast("bigint"))
    earlier = Window.partitionBy("file", "split", "part").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    lines = stored(lines.withColumn("within", F.coalesce(F.sum("size").over(earlier), F.lit(0))).drop("head"), "fasta-parts")

    parts = stored(lines.groupBy("file", "split", "part").agg(F.sum("size").alias("size"), F.max("name").alias("name")), "fasta-splits")  # one row for each split and each contig
    splits = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.groupBy("file", "split").agg(F.max("part").alias("heads")).select("file", "split", F.coalesce(F.sum("heads").over(splits), F.lit(0)).alias("heads_before"))
    numbered = parts.join(before, ["file", "split"]).withColumn("contig", F.col("heads_before") + F.col("part"))
    own = Window.partitionBy("file", "contig")
    start = F.coalesce(F.sum("size").over(own.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = numbered.withColumn("start", start).withColumn("chrom", F.max("name").over(own))
    problem = F.when((F.coalesce("chrom", F.lit("")) == "") & (F.col("size") + F.col("contig") > 0), F.concat(F.lit("bases without a named header in "), F.col("file")))
    numbered = numbered.where(F.when(problem.isNotNull(), F.raise_error(problem).cast("boolean")).otherwise(True))
    starts = stored(numbered.select("file", "split", "part", "contig", "start", "chrom"), "fasta-starts")
    twice = starts.where("chrom is not null").groupBy("chrom").agg(F.count_distinct("file", "contig").alias("n")).where("n > 1").first()
    if twice is not None:
        raise ValueError(f"contig {twice['chrom']} is there twice")
    placed = lines.where("size > 0").join(starts, ["file", "split", "part"]).withColumn("at", F.col("start") + F.col("within"))
    first, last = F.floor(F.col("at") / chunk), F.floor((F.col("at") + F.col("size") - 1) / chunk)
    pieces = placed.select("chrom", "at", "size", "bases", F.explode(F.sequence(first, last)).alias("chunk"))
    low = F.greatest(F.col("at"), F.col("chunk") * chunk)
    high = F.least(F.col("at") + F.col("size"), (F.col("chunk") + 1) * chunk)
    piece = F.substring("bases", (low - F.col("at") + 1).cast("int"), (high - low).cast("int"))
    whole = pieces.select("chrom", "chunk", low.alias("at"), piece.alias("piece")).groupBy("chrom", "chunk").agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("pieces"))
    return stored(whole.select("chrom", "chunk", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("sequence")), "sequence-ranges")


def bases_between(rows: DataFrame, ranges: DataFrame, start: Column, end: Column, name: str, chunk: int = CHUNK) -> DataFrame:
    """rows (chrom, ...) with the bases of the places start to end, from 0 and half-open; fewer where the contig ends, null where none is there.

    Distinct places are looked up, so a place that very many rows share is read once; one that spans chunks is put together from them.
    """
    locus = ["__chrom", "__from", "__to"]
    known = F.col("chrom").isNotNull() & (end > start) & (end > 0)
    named = rows.withColumns({"__chrom": F.when(known, F.col("chrom")), "__from": F.when(known, F.greatest(F.lit(0), start).cast("bigint")), "__to": F.when(known, end.cast("bigint"))})
    loci = stored(named.groupBy(*locus).agg(F.count("*").alias("__n")), "places")
    asked = loci.where("__from is not null").select(*locus, F.explode(F.sequence(F.floor(F.col("__from") / chunk), F.floor((F.col("__to") - 1) / chunk))).alias("chunk"))
    low = F.greatest(F.col("__from") - F.col("chunk") * chunk, F.lit(0))
    piece = F.substring("sequence", (low + 1).cast("int"), (F.least(F.col("__to") - F.col("chunk") * chunk, F.lit(chunk)) - low).cast("int"))
    met = asked.join(ranges.withColumnRenamed("chrom", "__chrom"), ["__chrom", "chunk"]).select(*locus, "chunk", piece.alias("piece"))
    found = met.groupBy(*locus).agg(F.array_sort(F.collect_list(F.struct("chunk", "piece"))).alias("pieces"))
    text = F.nullif(F.array_join(F.transform("pieces", lambda p: p["piece"]), ""), F.lit(""))
    found = found.select(*locus, text.alias(name))
    held = loci.alias("l").join(found.alias("r"), [F.col(f"l.{c}") == F.col(f"r.{c}") for c in locus], "left").select("l.*", f"r.{name}")
    return looked_up(named, stored(held, "bases"), locus, "__n", [name]).drop(*locus)


def declared(spark: SparkSession, manifest: dict) -> DataFrame:
    """(chrom, accession, offset) of a bundle's manifest; offset is the place, from 1, of a contig's first base."""
    rows = [(k, v, 1) if isinstance(v, str) else (k, v["accession"], int(v["start"])) for k, v in manifest["contigs"].items()]
    return spark.createDataFrame(rows, "chrom string, accession string, offset bigint")


def windows_of(mentions: DataFrame, ranges: DataFrame, contigs: DataFrame, flank: int, chunk: int = CHUNK) -> DataFrame:
    """mentions (chrom, pos, ref, ...) with accession, offset and sequence: the bases from `flank` before the mention to its end, instead of whole contigs."""
    there = contigs.select(F.col("chrom").alias("__name"), "accession", F.col("offset").alias("__first"))
    j = mentions.join(F.broadcast(there), F.col("chrom") == F.col("__name"), "left")  # one row for each declared contig of a bundle
    at = F.col("pos") - F.col("__first")
    low = F.greatest(F.lit(0), at - flank)
    seen = bases_between(j, ranges, F.when(at >= 0, low), F.when(at >= 0, at + F.length("ref")), "sequence", chunk)
    return seen.withColumn("offset", F.col("__first") + low).drop("__name", "__first")
