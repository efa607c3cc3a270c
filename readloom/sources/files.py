"""Text files between the steps of an analysis: window coverage, haplotypes and corrected reads of
windows, variant tables, proposal rates, entropy.

The files of windows are named by them (``w-<sequence>-<begin>-<end>``); writing gives a folder of that
name for each window, reading takes such folders as well as single files, plain or gzipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .sinks import separated, write_calls, write_lines

WINDOW = r"w-(.+)-(\d+)-(\d+)(?:[./]|$)"


def _windows(df: DataFrame) -> DataFrame:
    """``df`` (path, value) with chrom, beg and end of the window that the path names."""
    name = F.regexp_extract("path", r"([^/]*w-[^/]+-\d+-\d+)(?:[./][^/]*)*$", 1)
    part = lambda k: F.regexp_extract(F.concat(name, F.lit("/")), WINDOW, k)
    return df.select(part(1).alias("chrom"), part(2).cast("int").alias("beg"), part(3).cast("int").alias("end"), "value")


def _records(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, beg, end, ord, head, seq): FASTA records of the files of windows, one small file a window."""
    t = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), "value")
    rec = _windows(t).select("chrom", "beg", "end", F.posexplode(F.split("value", "(?:^|\n)>")).alias("ord", "r")).where("ord > 0")
    return rec.select("chrom", "beg", "end", "ord", F.regexp_extract("r", r"^([^\r\n]*)", 1).alias("head"), F.upper(F.regexp_replace(F.regexp_replace("r", r"^[^\n]*", ""), r"\s", "")).alias("seq"))


def _write_windows(df: DataFrame, path: str) -> None:
    """One text for each row (chrom, beg, end, value)."""
    name = F.concat_ws("-", F.lit("w"), "chrom", "beg", "end")
    df.select(name.alias("window"), "value").write.mode("overwrite").partitionBy("window").text(path)


def write_coverage(windows: DataFrame, path: str) -> None:
    """Windows and their reads, without header (K3)."""
    name = F.concat(F.lit("w-"), "chrom", F.lit("-"), "beg", F.lit("-"), "end", F.lit(".reads.fas"))
    write_lines(windows.select("chrom", "beg", separated([name, "chrom", "beg", "end", "cov"], "\t").alias("value")), ["chrom", "beg"], path)


def read_coverage(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, beg, end, cov)."""
    return spark.read.option("sep", "\t").schema("file string, chrom string, beg int, end int, cov long").csv(path).drop("file")


def write_support(haps: DataFrame, path: str) -> None:
    """Haplotypes of each window by support, with posterior and mean reads (K4)."""
    nth = F.row_number().over(Window.partitionBy("chrom", "beg").orderBy(F.desc("posterior"), "hap")) - 1
    record = F.concat(F.lit(">hap_"), "nth", F.lit("|posterior="), "posterior", F.lit(" ave_reads="), "ave_reads", F.lit("\n"), "hap")
    g = haps.withColumn("nth", nth).groupBy("chrom", "beg", "end").agg(F.sort_array(F.collect_list(F.struct("nth", record.alias("r")))).alias("r"))
    _write_windows(g.select("chrom", "beg", "end", F.array_join(F.col("r.r"), "\n").alias("value")), path)


def read_support(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, beg, end, hap, posterior, ave_reads)."""
    value = lambda name: F.regexp_extract("head", rf"{name}=\s*([-+.eE0-9]+)", 1).cast("double").alias(name)
    return _records(spark, path).select("chrom", "beg", "end", F.col("seq").alias("hap"), value("posterior"), value("ave_reads"))


def write_window_corrected(corrected: DataFrame, ends: DataFrame, path: str) -> None:
    """The corrected reads of each window with their posteriors (K4); ends: (chrom, beg, end)."""
    record = F.concat(F.lit(">"), "qname", F.lit("|posterior="), "posterior", F.lit("\n"), "hap")
    g = corrected.join(ends.select("chrom", "beg", "end"), ["chrom", "beg"]).groupBy("chrom", "beg", "end").agg(F.array_join(F.sort_array(F.collect_list(record)), "\n").alias("value"))
    _write_windows(g, path)


def read_window_corrected(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, beg, qname, hap, posterior)."""
    r = _records(spark, path)
    return r.select("chrom", "beg", F.regexp_extract("head", r"^(.*)\|posterior=", 1).alias("qname"), F.col("seq").alias("hap"), F.regexp_extract("head", r"posterior=\s*([-+.eE0-9]+)", 1).cast("double").alias("posterior"))


def write_snvs(snvs: DataFrame, path: str, single: bool = False) -> None:
    """Variants as a tab-separated table with header (K8); counts and p, where there, follow without one (K9)."""
    tested = "fvar" in snvs.columns
    write_calls(snvs.drop("qval"), path, "\t", single, not tested, "\n")


def read_snvs(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, key_pos, key_var, pos, ref, var, frq1..3, pst1..3, state1..3) of a variant table."""
    # the header stands in one of the parts
    t = spark.read.option("sep", "\t").csv(path)
    names = t.where("_c0 = 'Chromosome'").first()
    if names is None:
        raise ValueError(f"no header in {path}")
    t = t.where("_c0 <> 'Chromosome'").toDF(*names)
    if "Freq" in t.columns:
        t = t.withColumnsRenamed({"Freq": "Frq3", "Post": "Pst3"}).withColumns({f"{c}{k}": F.lit("*") for c in ("Frq", "Pst") for k in (1, 2)})
    gap = F.length("Ref") > 1
    size = F.length("Ref") - 1
    state = lambda k: F.when(F.col(f"Frq{k}") == "*", "none").when(F.col(f"Frq{k}") == "-", "absent").otherwise("called")
    pos = F.col("Pos").cast("int")
    return t.select(
        F.col("Chromosome").alias("chrom"), F.when(gap, pos + 1).otherwise(pos).alias("key_pos"), F.when(gap, F.repeat(F.lit("-"), size)).otherwise(F.col("Var")).alias("key_var"), pos.alias("pos"), F.col("Ref").alias("ref"), F.col("Var").alias("var"),
        *(F.col(f"{c}{k}").try_cast("double").alias(f"{c.lower()}{k}") for c in ("Frq", "Pst") for k in (1, 2, 3)), *(state(k).alias(f"state{k}") for k in (1, 2, 3)),
    )


def write_proposed(rates: DataFrame, path: str) -> None:
    """Clusters proposed in a sweep, by window (K7)."""
    lines = rates.select("chrom", "beg", separated(["beg", F.format_string("%f", "proposed_per_step")], "\t").alias("value"))
    write_lines(lines, ["chrom", "beg"], path, ["#base\tproposed_per_step"])


def write_entropy(rows: DataFrame, path: str) -> None:
    """Entropy by column with NA where no mean is."""
    columns = ["pos", "entropy", F.coalesce(F.col("mean_entropy").cast("string"), F.lit("NA")), "high_entropy_window"]
    write_lines(rows.select("chrom", "pos", separated(columns, ",").alias("value")), ["chrom", "pos"], path, ["pos,entropy,mean_entropy,high_entropy_window"])


def write_trace(trace: DataFrame, path: str) -> None:
    """One line for each sweep of each window: classes, untouched reads, theta and gamma (K5)."""
    columns = ["chrom", "beg", "step", "classes", F.col("untouched").cast("long"), "theta", "gamma"]
    write_lines(trace.select("chrom", "beg", "step", separated(columns, "\t").alias("value")), ["chrom", "beg", "step"], path, ["#chrom\tbase\tsweep\tclasses\tuntouched\ttheta\tgamma"])


def write_clusters(classes: DataFrame, path: str) -> None:
    """The classes at the end of each window: number, reads, unique reads, haplotype (K5)."""
    columns = ["chrom", "beg", "classes", F.col("ave_reads").cast("long"), "q", "hap"]
    write_lines(classes.select("chrom", "beg", "classes", separated(columns, "\t").alias("value")), ["chrom", "beg", "classes"], path, ["#chrom\tbase\tclass\treads\tunique\thaplotype"])


def write_frequencies(freq: DataFrame, path: str) -> None:
    """Reads of each haplotype at each recorded sweep (K4)."""
    columns = ["chrom", "beg", "hap", F.array_join(F.transform("reads", lambda n: n.cast("string")), ",")]
    write_lines(freq.select("chrom", "beg", "hap", separated(columns, "\t").alias("value")), ["chrom", "beg", "hap"], path, ["#chrom\tbase\thaplotype\treads"])
