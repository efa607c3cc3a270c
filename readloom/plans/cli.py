"""Command line: shotgun, amplicon or snv over alignment files and a FASTA reference."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import haplotypes, windows
from ..sources import files, indexed, readers, sinks
from . import analysis


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="readloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("-b", "--bam", required=True, help="sorted SAM or BAM")
    common.add_argument("-f", "--fasta", required=True, help="reference")
    common.add_argument("-o", "--out", default="out", help="folder for results")
    common.add_argument("-a", "--alpha", type=float, default=0.1)
    common.add_argument("-r", "--region", default="")
    common.add_argument("-R", "--seed", type=int, default=42)
    common.add_argument("-x", "--maxcov", type=int, default=10_000)
    common.add_argument("-S", "--sigma", type=float, default=0.01)
    common.add_argument("-I", "--ignore_indels", action="store_true")
    common.add_argument("-p", "--threshold", type=float, default=0.9)
    common.add_argument("-of", "--out_format", nargs="+", choices=("csv", "vcf"), default=["csv", "vcf"])
    common.add_argument("--index", default="", help="folder of the reads sorted by place: made if it isn't there; with a region only its reads are read")
    common.add_argument("-t", "--threads", type=int, default=0, help="tasks at a time in a local session; a cluster decides itself")
    sampled = argparse.ArgumentParser(add_help=False)
    sampled.add_argument("--epochs", default="", help="folder of the sampler's states: a run that was stopped goes on from there")
    sampled.add_argument("--control", default="", help="Parquet table of orders (alpha, sweeps), read before each epoch")
    s = sub.add_parser("shotgun", parents=[common, sampled])
    s.add_argument("-c", "--win_coverage", type=int, default=0)
    s.add_argument("-w", "--windowsize", type=int, default=201)
    s.add_argument("-s", "--winshifts", type=int, default=3)
    m = sub.add_parser("amplicon", parents=[common, sampled])
    m.add_argument("-c", "--win_coverage", type=int, default=0)
    m.add_argument("-d", "--diversity", action="store_true")
    m.add_argument("-m", "--min_overlap", type=float, default=0.95)
    v = sub.add_parser("snv", parents=[common])
    v.add_argument("-i", "--increment", type=int, default=1)
    v.add_argument("--haplotypes", required=True, help="Parquet table of haplotypes, or the folder of their files")
    v.add_argument("--windows", required=True, help="Parquet table of windows, or their coverage file (.txt)")
    return p


def region_reads(spark: SparkSession, a: argparse.Namespace, reference: DataFrame) -> DataFrame:
    """The aligned reads; with a region, those that reach into it or the windows around it."""
    reads = readers.aligned_reads(readers.read_alignments(spark, a.bam), mask_indels=a.ignore_indels)
    if not a.region:
        return analysis.kept(reads)
    lengths = {r["chrom"]: r["n"] for r in reference.select("chrom", F.length("seq").alias("n")).collect()}  # names and lengths of the reference
    # windows of an amplicon lie in the region; those of shotgun reach three shifts beyond it
    shift = getattr(a, "windowsize", 201) // getattr(a, "winshifts", 3) if a.command == "shotgun" else 0
    (chrom, (begin, end)), = windows.region_bounds(lengths, shift, a.region).items()
    if not a.index:
        return analysis.kept(readers.in_region(reads, chrom, begin, end + 1))
    return indexed.read_region(spark, a.index, indexed.indexed(reads, a.index), chrom, begin, end + 1)


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    builder = SparkSession.builder
    spark = (builder.master(f"local[{a.threads}]") if a.threads else builder).getOrCreate()
    o = analysis.Options(
        alpha=a.alpha, region=a.region, seed=a.seed, max_coverage=a.maxcov, sigma=a.sigma, ignore_indels=a.ignore_indels, threshold=a.threshold,
        win_coverage=getattr(a, "win_coverage", 0), width=getattr(a, "windowsize", 201), shifts=getattr(a, "winshifts", 3), min_overlap=getattr(a, "min_overlap", 0.95), diversity=getattr(a, "diversity", False),
        epochs=getattr(a, "epochs", ""), control=getattr(a, "control", ""),
    )
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(message)s")
    logging.info("%s of %s", a.command, a.bam)
    reference = readers.read_fasta(spark, a.fasta).select(F.col("id").alias("chrom"), "seq", "ord")
    reads = region_reads(spark, a, reference)
    single = a.command == "amplicon" or a.command == "snv" and a.increment == 1
    if a.command == "snv":
        text = a.windows.endswith(".txt")
        cov = files.read_coverage(spark, a.windows) if text else spark.read.parquet(a.windows)
        haps = files.read_support(spark, a.haplotypes) if text else spark.read.parquet(a.haplotypes)
        raw, snvs, calls = analysis.call_snvs(haps, reads, reference.select("chrom", "seq"), cov, a.increment, o, single)
        lengths = {r["chrom"]: r["n"] for r in reference.select("chrom", F.length("seq").alias("n")).collect()}
    else:
        result = (analysis.shotgun if a.command == "shotgun" else analysis.amplicon)(spark, reads, reference, o)
        result.windows.write.mode("overwrite").parquet(f"{a.out}/windows")
        result.haplotypes.write.mode("overwrite").parquet(f"{a.out}/haplotypes")
        files.write_coverage(result.windows, f"{a.out}/coverage.txt")
        files.write_support(result.haplotypes, f"{a.out}/support")
        files.write_window_corrected(result.corrected, result.windows, f"{a.out}/corrected_windows")
        files.write_trace(result.trace, f"{a.out}/trace")
        files.write_clusters(result.classes, f"{a.out}/clusters")
        files.write_frequencies(result.frequencies, f"{a.out}/frequencies")
        files.write_proposed(haplotypes.proposed_rate(result.stats), f"{a.out}/proposed")
        if result.convergence is not None:
            for r in result.convergence.where("low_untouched or few_new_clusters").collect():  # one window
                logging.warning("window %s: %.1f %% of reads untouched, %d clusters proposed", r["beg"], r["untouched_pct"], r["made"])
        if result.entropy is not None:
            files.write_entropy(sinks.entropy_rows(*result.entropy), f"{a.out}/entropy_csv")
        begin = windows.region_bounds(result.lengths, o.width // o.shifts, o.region) if o.region else {}
        sinks.write_corrected(analysis.corrected_reads(reads, result), f"{a.out}/corrected", min((b for b, _ in begin.values()), default=0))
        raw, snvs, calls, lengths = result.raw, result.snvs, result.calls, result.lengths
    files.write_snvs(raw, f"{a.out}/raw_snv", single)
    files.write_snvs(snvs, f"{a.out}/SNV", single)
    files.write_snvs(calls, f"{a.out}/SNVs_{o.sigma:f}", single)
    if "csv" in a.out_format:
        sinks.write_csv(calls, f"{a.out}/snvs_csv", single)
    if "vcf" in a.out_format:
        sinks.write_vcf(calls, lengths, f"{a.out}/snvs_vcf", single=single, reference=a.fasta)


if __name__ == "__main__":
    main()
