"""Window coverage of reads that arrive over time, as a structured stream.

The tiling is the arithmetic of the batch operators, so a stream of aligned reads gives the counts of
the same windows; state is one count for each window and event-time interval.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_coverage(reads: DataFrame, width: int, shift: int, delay: str = "10 minutes", every: str = "1 hour") -> DataFrame:
    """(chrom, beg, arrived, cov) of a stream of reads (ts, chrom, pos0, gapped); late rows go after ``delay``."""
    s, e = F.col("pos0"), F.col("pos0") + F.length("gapped")
    first = F.greatest(F.lit(0), F.floor((s - width) / shift) + 1)
    last = F.ceil(e / shift) - 1
    r = reads.withWatermark("ts", delay).where(first <= last)
    r = r.withColumn("beg", F.explode(F.transform(F.sequence(first, last), lambda k: (k * shift + 1).cast("int"))))
    return r.groupBy("chrom", "beg", F.window("ts", every).alias("arrived")).agg(F.count("*").alias("cov"))
