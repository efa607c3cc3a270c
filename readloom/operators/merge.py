"""Corrected reads: window haplotypes put together along each read.

Corrected: (chrom, beg, qname, hap, posterior), the haplotype of a read in a window; aligned:
(chrom, qname, pos0, gapped, file_ord).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dna import bases
from .pileup import joined_bases


def last_alignment(reads: DataFrame) -> DataFrame:
    """One alignment of each name, the last in the file (S5, Q8), with the order of the first."""
    last = F.max_by(F.struct("pos0", "gapped"), "file_ord")
    return reads.groupBy("chrom", "qname").agg(last.alias("r"), F.min("file_ord").alias("file_ord")).select("chrom", "qname", "r.pos0", "r.gapped", "file_ord")


def merge_corrected(aligned: DataFrame, corrected: DataFrame, min_posterior: float = 0.9, vote: bool = False) -> DataFrame:
    """(chrom, qname, pos0, file_ord, seq): each read with the bases of its windows.

    A base comes from the first window, by start, whose posterior is above the limit and that covers
    the position; X where there is none. ``vote``: the most frequent base of all such windows, of
    equal ones the first of the alphabet (A18).
    """
    c = corrected.where(F.col("posterior") > min_posterior).select("chrom", "qname", "beg", "hap")
    j = aligned.join(c, ["chrom", "qname"]).select("chrom", "qname", "pos0", F.length("gapped").alias("size"), "beg", F.posexplode(bases(F.col("hap"))).alias("k", "base"))
    j = j.withColumn("i", F.col("beg") - 1 + F.col("k") - F.col("pos0")).where((F.col("i") >= 0) & (F.col("i") < F.col("size")))
    if vote:
        votes = j.groupBy("chrom", "qname", "i", "base").agg(F.count("*").alias("n"))
        best = votes.groupBy("chrom", "qname", "i").agg(F.min_by("base", F.struct(-F.col("n"), "base")).alias("base"))
    else:
        best = j.groupBy("chrom", "qname", "i").agg(F.min_by("base", "beg").alias("base"))
    out = aligned.join(joined_bases(best, ("chrom", "qname"), "i", 0, "X"), ["chrom", "qname"], "left")
    seq = F.rpad(F.coalesce("seq", F.lit("")), F.length("gapped"), F.lit("X"))
    return out.select("chrom", "qname", "pos0", "file_ord", seq.alias("seq"))


def clean_corrected(merged: DataFrame, most_x: int = 10) -> DataFrame:
    """Merged reads fit for output (P13, K6), with ``inner_x``, the X that are not at their ends.

    Leading - and X go, and move the start; X within go too; reads of - and X alone, or with more
    than ``most_x`` X inside, are left out.
    """
    ends = F.lit("-X")
    m = merged.withColumn("left", F.ltrim("seq", ends))
    m = m.withColumn("body", F.rtrim("left", ends))
    m = m.withColumn("inner_x", F.length("body") - F.length(F.replace(F.col("body"), F.lit("X"), F.lit(""))))
    m = m.where((F.col("body") != "") & (F.col("inner_x") <= most_x))
    lead = F.length("seq") - F.length("left")
    return m.select("chrom", "qname", (F.col("pos0") + lead).alias("pos0"), "file_ord", F.replace(F.col("left"), F.lit("X"), F.lit("")).alias("seq"), "inner_x")


def x_histogram(merged: DataFrame, most_x: int = 1 << 30) -> DataFrame:
    """(inner_x, n): how many merged reads have how many X inside."""
    return clean_corrected(merged, most_x).groupBy("inner_x").agg(F.count("*").alias("n"))


def wrapped(seq, width: int = 80):
    """A sequence broken into lines (K6)."""
    return F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")
