"""Readers of sequence files, over whatever store Spark can read.

All are read in splits: SAM and FASTQ by lines, FASTA by records, BAM by compressed blocks (``bam``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dna import cleaned, gapped
from .bam import read_bam

#: Fixed value: flags of reads that are unmapped, secondary, of failed quality or duplicates.
DROPPED_FLAGS = 0x704


def numbered(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """(value, file, start, nth): lines, the split they are in, and their place in it from 0."""
    lines = spark.read.options(**options).text(path)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    return lines.select("value", "file", "start", (F.col("row") - F.min("row").over(Window.partitionBy("file", "start"))).alias("nth"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(id, seq, ord): records, upper case; ``ord`` rises with the place in the file (S3)."""
    # a split has fewer records than bytes, so start + place rises through the file
    rec = numbered(spark, path, lineSep="\n>").withColumn("ord", F.col("start") + F.col("nth"))
    # the first record brings its own ">"; what stands before it is none
    rec = rec.where((F.col("ord") > 0) | F.col("value").startswith(">"))
    r = F.when(F.col("ord") == 0, F.substr("value", F.lit(2))).otherwise(F.col("value"))
    body = F.regexp_replace(F.regexp_replace(r, "^[^\n]*", ""), r"\s", "")
    return rec.select(F.regexp_extract(r, r"^(\S*)", 1).alias("id"), F.upper(body).alias("seq"), "ord")


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(id, tag, seq, qual, ord): four-line records, ``ord`` their number in the file."""
    lines = numbered(spark, path)
    # line numbers in two steps: lines of a split, splits of a file (one row each)
    splits = lines.groupBy("file", "start").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "start", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    at = F.col("before") + F.col("nth")
    part = lambda k: F.max(F.when(at % 4 == k, F.col("value")))
    rec = lines.join(splits, ["file", "start"]).groupBy("file", F.floor(at / 4).alias("ord")).agg(part(0).alias("head"), part(1).alias("seq"), part(3).alias("qual"))
    rec = rec.where(F.col("head").startswith("@") & F.col("qual").isNotNull())
    return rec.select(F.regexp_extract("head", r"^@(\S+)", 1).alias("id"), F.regexp_extract("head", r"^@\S+\s+(.*)", 1).alias("tag"), "seq", "qual", "ord")


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of SAM text, ``file_ord`` rising with the place in the file."""
    lines = numbered(spark, path).where(~F.col("value").startswith("@") & (F.col("value") != ""))
    c = lambda i: F.get(F.split("value", "\t"), F.lit(i))
    return lines.select(
        (F.col("start") + F.col("nth")).alias("file_ord"),
        c(0).alias("qname"), c(1).try_cast("int").alias("flag"), c(2).alias("chrom"), (c(3).try_cast("int") - 1).alias("pos0"), c(5).alias("cigar"), c(9).alias("seq"),
    )


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    """SAM or BAM by the name's ending; CRAM is refused."""
    if path.lower().endswith(".cram"):
        raise ValueError("CRAM files are not supported; convert to BAM or SAM")
    return read_bam(spark, path) if path.lower().endswith(".bam") else read_sam(spark, path)


def aligned_reads(alignments: DataFrame, dropped_flags: int = DROPPED_FLAGS, mask_indels: bool = False) -> DataFrame:
    """Reads on reference columns: (chrom, qname, pos0, gapped, is_rev, file_ord, size) (P3, Q5); size: bases of the read, clipped and inserted ones too."""
    a = alignments.where((F.col("flag").bitwiseAND(dropped_flags) == 0) & (F.col("cigar") != "*"))
    return a.select("chrom", "qname", "pos0", gapped(cleaned(F.col("seq")), F.col("cigar"), mask_indels).alias("gapped"), (F.col("flag").bitwiseAND(16) != 0).alias("is_rev"), "file_ord", F.when(F.col("seq") == "*", F.lit(1)).otherwise(F.length("seq")).alias("size"))


def in_region(reads: DataFrame, chrom: str, begin: int, end: int) -> DataFrame:
    """Reads that overlap [begin, end), 0-based."""
    return reads.where((F.col("chrom") == chrom) & (F.col("pos0") < end) & (F.col("pos0") + F.length("gapped") > begin))
