"""Reads kept sorted by place, so that a region is read without the rest.

The index is a Parquet table, a folder for each sequence: reads are dealt to tasks by ranges of
(chrom, pos0) and sorted there, and each row group knows the least and greatest begin and end of its
reads. A region then is a filter: the folder of its sequence, and the row groups whose reads can
overlap it; nothing else leaves the store. Many reads that begin at one column (amplicons) are dealt
by their place in the file too. A table that was not written to its end does not count as an index.

Reads without sequence name or place are not aligned and are left out. An empty table gives an index
without rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a row group.
GROUP = 8 << 20


def write_index(reads: DataFrame, path: str, files: int = 0, group: int = GROUP) -> None:
    """Writes reads (chrom, pos0, gapped, file_ord, ...) as an index; ``files``: tasks, by default those of a shuffle."""
    kept = reads.where(F.col("chrom").isNotNull() & F.col("pos0").isNotNull()).withColumn("stop", F.col("pos0") + F.length("gapped"))
    keys = ("chrom", "pos0", "file_ord")
    dealt = kept.repartitionByRange(files, *keys) if files else kept.repartitionByRange(*keys)
    dealt.sortWithinPartitions(*keys).write.mode("overwrite").option("parquet.block.size", group).partitionBy("chrom").parquet(path)


def is_index(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_index(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All reads of an index; ``schema``: the columns of the reads (names of sequences stay text)."""
    return spark.read.schema(f"{schema}, stop int").parquet(path)


def read_region(spark: SparkSession, path: str, schema: str, chrom: str, begin: int, end: int) -> DataFrame:
    """The reads of an index that overlap [begin, end), 0-based."""
    return read_index(spark, path, schema).where((F.col("chrom") == chrom) & (F.col("pos0") < end) & (F.col("stop") > begin)).drop("stop")


def indexed(reads: DataFrame, path: str) -> str:
    """Makes the index where there is none; returns the schema to read it with."""
    spark = reads.sparkSession
    if not is_index(spark, path):
        write_index(reads, path)
    return ", ".join(f"`{n}` {t}" for n, t in reads.dtypes)
