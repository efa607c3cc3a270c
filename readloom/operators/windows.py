"""Sliding windows over aligned reads: tiling, caps, overlap, coverage.

Reads: (chrom, pos0, gapped, file_ord, ...), pos0 the 0-based first column, gapped the read on
reference columns. Windows are found by arithmetic on each read's interval, so reads and windows
need no join; the rows of one window meet only where they are counted or clustered.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import arrays

REGION = re.compile(r"^(?P<chrom>.*):(?P<start>\d+)-(?P<stop>\d+)$")


def parse_region(region: str, lengths: dict[str, int]) -> tuple[str, int, int]:
    """(chrom, first, last) of ``name:start-stop`` or of a name; 0-based first, ``last`` inclusive."""
    m = REGION.match(region)
    if m and m["chrom"] in lengths:
        return m["chrom"], int(m["start"]) - 1, int(m["stop"]) - 1
    if region in lengths:
        return region, 0, lengths[region] - 1
    raise ValueError(f"unknown sequence in region {region!r}")


def region_bounds(lengths: dict[str, int], shift: int, region: str = "") -> dict[str, tuple[int, int]]:
    """Interval in which windows lie, by sequence (P2): a region padded by three shifts and clamped, else [0, length]."""
    if not region:
        return {c: (0, n) for c, n in lengths.items()}
    chrom, b, e = parse_region(region, lengths)
    top = lengths[chrom] - 1
    return {chrom: (min(max(b - 3 * shift, 0), top), min(max(e + 3 * shift, 0), top))}


def bounds_table(spark, bounds: dict[str, tuple[int, int]]) -> DataFrame:
    return spark.createDataFrame([(c, b, e) for c, (b, e) in bounds.items()], "chrom string, roi_b int, roi_e int")


def tile(reads: DataFrame, bounds: DataFrame, width: int, shift: int) -> DataFrame:
    """One row for each read and window that it overlaps (J1): ``win_b``, 0-based, and ``columns``, the read's length.

    ``bounds`` (chrom, roi_b, roi_e) has one row for each sequence. shift 0: one window.
    """
    # the length is taken once a read, not once a window
    r = reads.withColumn("columns", F.length("gapped")).join(bounds, "chrom")
    s, e, b = F.col("pos0"), F.col("pos0") + F.col("columns"), F.col("roi_b")
    if shift == 0:
        hit = (s < b + width) & (e > b) & (b + width - 1 <= F.col("roi_e"))
        return r.where(hit).withColumn("win_b", b).drop("roi_b", "roi_e")
    last = F.floor((F.col("roi_e") - b - width + 1) / shift)
    kmin = F.greatest(F.lit(0), F.floor((s - width + 1 - b - 1) / shift) + 1)
    kmax = F.least(last, F.ceil((e - b) / shift) - 1)
    r = r.withColumn("kmin", kmin.cast("int")).withColumn("kmax", kmax.cast("int")).where("kmin <= kmax")
    return r.withColumn("win_b", F.explode(F.transform(F.sequence("kmin", "kmax"), lambda k: b + k * shift))).drop("kmin", "kmax", "roi_b", "roi_e")


#: Up to so many rows of a start Spark itself cuts before its shuffle; beyond, parts are cut first.
PRE_CUT, PARTS = 1000, 32


def cap_starts(tiled: DataFrame, most: int) -> DataFrame:
    """At most ``most`` - 1 reads of each start in a window, in file order."""
    key = ("chrom", "win_b", "pos0")
    if most > PRE_CUT:  # one start may hold all reads of an amplicon
        tiled = tiled.withColumn("part", F.pmod(F.hash("file_ord"), F.lit(PARTS)))
        inside = F.row_number().over(Window.partitionBy(*key, "part").orderBy("file_ord"))
        tiled = tiled.withColumn("nth", inside).where(F.col("nth") < most).drop("part")
    return tiled.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy("file_ord"))).where(F.col("nth") < most).drop("nth")


def overlap(width: int):
    """Columns that a read shares with its window, counted with an exclusive read end (P5, Q2)."""
    end = F.col("pos0") + F.col("columns")
    return F.least(end, F.col("win_b") + width - 1) - F.greatest(F.col("pos0"), F.col("win_b")) + 1


def read_ranges(reads: DataFrame, bounds: DataFrame, width: int, shift: int, min_overlap: int, most: int, every: bool = False) -> DataFrame:
    """``reads`` with ``roi_b`` and the windows ``ka`` to ``kb``, by number, that they are in (P4, P5): those of ``tile`` that share ``min_overlap``
    columns with them and keep them under ``cap_starts``. No row is made for a window. ``every``: also reads that are in none (``ka`` > ``kb``)."""
    columns = F.length("gapped")
    # one row for each sequence
    r = reads.where(F.length("gapped") > 0).join(F.broadcast(bounds), "chrom", "left" if every else "inner").withColumn("pos0", F.col("pos0").cast("int"))
    s, b = F.col("pos0"), F.col("roi_b")
    e = s + columns
    if shift == 0:
        hit = (s < b + width) & (e > b) & (b + width - 1 <= F.col("roi_e"))
        kmin, kmax = F.lit(0), F.when(hit, 0).otherwise(-1)
    else:
        last = F.floor((F.col("roi_e") - b - width + 1) / shift)
        kmin = F.greatest(F.lit(0), F.floor((s - width + 1 - b - 1) / shift) + 1).cast("int")
        kmax = F.least(last, F.ceil((e - b) / shift) - 1).cast("int")
    r = r.withColumns({"kmin": F.coalesce(kmin, F.lit(0)), "kmax": F.coalesce(kmax, F.lit(-1)), "roi_b": F.coalesce("roi_b", F.lit(0))}).drop("roi_e")
    if not every:
        r = r.where("kmin <= kmax")
    if most > PRE_CUT and not every:  # one start may hold all reads of an amplicon
        r = arrays.cut_starts(r.withColumn("part", F.pmod(F.hash("file_ord"), F.lit(PARTS))), most, "part").where("kmin <= kmax").drop("part")
    r = arrays.cut_starts(r, most)
    ka, kb = arrays.long_enough(columns, width, shift, min_overlap)
    return r.withColumns({"ka": ka, "kb": kb}).drop("kmin", "kmax")


def window_reads(reads: DataFrame, bounds: DataFrame, width: int, shift: int, min_overlap: int, most: int) -> DataFrame:
    """(chrom, beg, end, file_ord, qname, pos0, seq): the reads of each window, 1-based ends."""
    return arrays.window_rows(read_ranges(reads.select("chrom", "pos0", "gapped", "file_ord", "qname"), bounds, width, shift, min_overlap, most), width, shift)


def coverage(rows: DataFrame, above: int = 0) -> DataFrame:
    """(chrom, beg, end, cov) of windows with more reads than ``above``."""
    return rows.groupBy("chrom", "beg", "end").agg(F.count("*").alias("cov")).where(F.col("cov") > above)


def range_coverage(ranges: DataFrame, width: int, shift: int, above: int = 0) -> DataFrame:
    """``coverage`` of ``window_reads``, from the windows ``ka`` to ``kb`` of each read (``read_ranges``): no read is cut."""
    w = ranges.where("ka <= kb").select("chrom", "roi_b", F.explode(F.sequence("ka", "kb")).alias("k")).groupBy("chrom", "roi_b", "k").agg(F.count("*").alias("cov"))
    beg = F.col("roi_b") + F.col("k") * shift
    return w.where(F.col("cov") > above).select("chrom", (beg + 1).alias("beg"), (beg + width).alias("end"), "cov")


def covered_windows(rows: DataFrame, above: int) -> DataFrame:
    """The rows of windows with more reads than ``above``, without a join: the count is a window function."""
    n = F.count("*").over(Window.partitionBy("chrom", "beg"))
    return rows.withColumn("cov", n).where(F.col("cov") > above)


def collapse(rows: DataFrame) -> DataFrame:
    """Equal reads of a window as one row with its weight, first read and number of N."""
    g = rows.groupBy("chrom", "beg", "seq").agg(F.count("*").alias("weight"), F.min("file_ord").alias("first_ord"))
    return g.withColumn("missing", F.length("seq") - F.length(F.replace(F.col("seq"), F.lit("N"), F.lit(""))))


def iteration_budget(windows: DataFrame, times: int = 15, most: int = 300_000, history: float = 0.2) -> DataFrame:
    """Sweeps of the sampler and how many of them are recorded."""
    it = F.least(F.lit(most), F.col("cov") * times).cast("long")
    return windows.withColumn("iterations", it).withColumn("history", F.floor(it * history).cast("long"))
