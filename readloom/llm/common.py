"""Helpers that several operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows of an Arrow batch: texts may be long, and a worker holds a batch of them as Python objects.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where a local session names none (tests on one machine) a temporary folder is taken; a
    cluster without the setting is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("readloom.local.shared", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="spark-readloom-")
        spark.conf.set("readloom.local.shared", where)
    return where


#: The shuffle files of a query go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage and survives lost executors.

    The shuffle files of the query that writes it are freed at its end.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/readloom-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def free(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing will read again."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread(spark: SparkSession, least: int = 8) -> int:
    """Partitions for a shuffle whose rows are then worked on in Python."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))
