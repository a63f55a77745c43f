"""Alleles carried from one assembly to another along chains of aligned blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evirank.operators.scan import looked_up
from evirank.storage import stored

#: Bases of a bin. A block has one row for each bin that it touches, at most the length of the assembly / BIN more than there are blocks.
BIN = 1 << 14


def read_chains(spark: SparkSession, path: str) -> DataFrame:
    """(chain_id, score, t_name, t_start, t_end, q_name, q_size, q_strand, q_start) of the ungapped blocks of chain files, 0-based and half-open.

    Chains are separated by blank lines, so the reader splits files between them; # begins a comment line. q_start is counted along q_strand. A chain that is
    malformed, whose blocks do not add up to what its header says, or whose source strand is not + fails the job.
    """
    records = spark.read.text(path, lineSep="\n\n").select(F.filter(F.split("value", "\r?\n"), lambda x: (F.trim(x) != "") & ~F.startswith(x, F.lit("#"))).alias("lines")).where("size(lines) > 0")
    head = F.split(F.trim(F.col("lines")[0]), r"\s+")
    cells = F.transform(F.slice("lines", 2, 1 << 30), lambda x: F.transform(F.split(F.trim(x), r"\s+"), lambda c: c.try_cast("bigint")))
    names = ("score", "t_name", "t_size", "t_strand", "t_from", "t_to", "q_name", "q_size", "q_strand", "q_from", "q_to", "chain_id")
    text = ("t_name", "t_strand", "q_name", "q_strand")
    whole = records.select("lines", cells.alias("cells"), F.get(head, F.lit(0)).alias("kind"), *(F.get(head, F.lit(i + 1)) .try_cast("string" if n in text else "bigint").alias(n) for i, n in enumerate(names)))
    size = lambda gap: F.aggregate("cells", F.lit(0).cast("bigint"), lambda a, c: a + F.get(c, F.lit(0)) + F.coalesce(F.get(c, F.lit(gap)), F.lit(0)))
    said = F.element_at("lines", 1)
    problem = (
        F.when((F.col("kind") != "chain") | F.col("t_to").isNull() | F.col("q_to").isNull() | F.col("score").isNull() | (F.size("cells") == 0), F.concat(F.lit("no chain: "), said))
        .when(~F.col("q_strand").isin("+", "-") | (F.col("t_strand") != "+"), F.concat(F.lit("unknown strand: "), said))
        .when(F.coalesce(size(1) != F.col("t_to") - F.col("t_from"), F.lit(True)) | F.coalesce(size(2) != F.col("q_to") - F.col("q_from"), F.lit(True)), F.concat(F.lit("blocks do not add up: "), said))
    )
    sound = whole.where(F.when(problem.isNotNull(), F.raise_error(problem).cast("boolean")).otherwise(True))
    sound = sound.withColumn("chain_id", F.coalesce("chain_id", F.xxhash64(said)))
    rows = sound.select(*(n for n in names if n != "t_size"), said.alias("said"), F.posexplode("cells").alias("i", "cell"))
    before = Window.partitionBy("said").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda gap: F.coalesce(F.sum(F.get("cell", F.lit(0)) + F.coalesce(F.get("cell", F.lit(gap)), F.lit(0))).over(before), F.lit(0))
    placed = rows.select("chain_id", "score", "t_name", (F.col("t_from") + upto(1)).alias("t_start"), F.get("cell", F.lit(0)).alias("size"), "q_name", "q_size", "q_strand", (F.col("q_from") + upto(2)).alias("q_start"))
    return placed.select("chain_id", "score", "t_name", "t_start", (F.col("t_start") + F.col("size")).alias("t_end"), "q_name", "q_size", "q_strand", "q_start")


def reverse_complement(sequence: Column) -> Column:
    return F.reverse(F.translate(sequence, "ACGTacgt", "TGCAtgca"))


def carried(alleles: DataFrame, blocks: DataFrame) -> DataFrame:
    """alleles (chrom, pos, ref, alt, ...; pos from 1) with map_status, to_chrom, to_pos, to_ref, to_alt, chain_id and to_normalise.

    A reference allele within one block is `resolved`, and where chains overlap the best score decides; equal scores are `ambiguous`. If only a part of it is in a block,
    or it lies in several of them, it is `split`; if neither end is in a block it is `unmapped`, and without a place or bases `insufficient`. Along the - strand bases are complemented, and
    to_normalise says that an allele with an anchor base must be aligned anew, since the anchor now stands at its end.

    Distinct loci are joined with blocks by bin: a bin has at most BIN places, so no key is hot, however many alleles share a locus.
    """
    first, size = F.col("pos").cast("bigint") - 1, F.length("ref").cast("bigint")
    known = F.col("chrom").isNotNull() & (first >= 0) & (size > 0) & F.col("alt").isNotNull()
    named = alleles.withColumns({"__chrom": F.when(known, F.col("chrom")), "__a": F.when(known, first), "__b": F.when(known, first + size)})
    locus = ["__chrom", "__a", "__b"]
    loci = stored(named.groupBy(*locus).agg(F.count("*").alias("__n")), "loci")
    ends = F.array_distinct(F.array(F.floor(F.col("__a") / BIN), F.floor((F.col("__b") - 1) / BIN)))
    asked = loci.where("__a is not null").select(*locus, F.explode(ends).alias("__bin"))
    covering = blocks.where("t_end > t_start").withColumn("__bin", F.explode(F.sequence(F.floor(F.col("t_start") / BIN), F.floor((F.col("t_end") - 1) / BIN)))).withColumnRenamed("t_name", "__chrom")
    inside = lambda p: (F.col("t_start") <= p) & (p < F.col("t_end"))
    met = asked.join(covering, ["__chrom", "__bin"]).where(inside(F.col("__a")) | inside(F.col("__b") - 1))
    whole = inside(F.col("__a")) & inside(F.col("__b") - 1)
    hit = lambda sign: F.max(F.when(whole, F.struct("score", (sign * F.col("chain_id")).alias("c"), (sign * F.col("t_start")).alias("t"), "t_start", "chain_id", "q_name", "q_size", "q_strand", "q_start")))
    best = met.groupBy(*locus).agg(hit(1).alias("best"), hit(-1).alias("other"))
    b = F.col("best")
    along = b["q_start"] + F.col("__a") - b["t_start"]
    start = F.when(b["q_strand"] == "+", along).otherwise(b["q_size"] - along - (F.col("__b") - F.col("__a")))
    tied = (F.col("other.chain_id") != b["chain_id"]) | (F.col("other.t_start") != b["t_start"])
    status = F.when(b.isNull(), "split").when(tied, "ambiguous").otherwise("resolved")
    placed = best.select(*locus, status.alias("map_status"), b["q_name"].alias("q_name"), (start + 1).alias("q_pos"), b["q_strand"].alias("q_strand"), b["chain_id"].alias("chain_id"))
    found = loci.alias("l").join(placed.alias("r"), [F.col(f"l.{c}") == F.col(f"r.{c}") for c in locus], "left").select("l.*", "r.map_status", "r.q_name", "r.q_pos", "r.q_strand", "r.chain_id")
    status = F.when(F.col("__a").isNull(), "insufficient").otherwise(F.coalesce("map_status", F.lit("unmapped")))
    found = stored(found.withColumn("map_status", status), "mapped-loci")
    out = looked_up(named, found, locus, "__n", ["map_status", "q_name", "q_pos", "q_strand", "chain_id"])
    resolved = F.col("map_status") == "resolved"
    turned = lambda c: F.when(resolved, F.when(F.col("q_strand") == "-", reverse_complement(F.col(c))).otherwise(F.col(c)))
    keep = lambda c: F.when(resolved, F.col(c))
    return out.select(
        *(F.col(c) for c in alleles.columns), "map_status", keep("q_name").alias("to_chrom"), keep("q_pos").alias("to_pos"), turned("ref").alias("to_ref"), turned("alt").alias("to_alt"), keep("chain_id").alias("map_chain"),
        F.coalesce(resolved & (F.col("q_strand") == "-") & (F.length("ref") != F.length("alt")), F.lit(False)).alias("to_normalise"),
    )
