"""Corpus pipeline: documents to packed training sequences, in five stages.

quality: documents that the compression classifier scores below its threshold go.
near_duplicates: of each group of texts that links of similarity 0.8 on five-word shingles hold
    together, the document with the smallest doc_id stays.
secrets: found secrets are replaced in the texts.
mixing: sources are mixed to their target weights; a row is a stretch of a document that is taken.
packing: token sequences of at most 1024 ids; a row is a piece of a document.

Every stage works on all rows of the stage before and writes its result as Parquet. Null texts count
as empty: quality scores them, near_duplicates leaves them alone, mixing takes no word of them. Rows
without doc_id pass near_duplicates, as they cannot be told apart. Rows that share a doc_id but not a
text stay or go together; rows with equal id and text are one there. Columns besides those of documents stay, under
whatever name, up to packing. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm import mixing, ngram_join, packing, quality, secret_scan
from readloom.llm.common import table, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return quality.score(docs, model, "__score").where(F.col("__score") >= quality.THRESHOLD).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = ngram_join.jaccard_components(docs.select("doc_id", "text"), size=5, percent=80)
    groups = written(groups, "near-groups")
    out = groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id")
    again = groups.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    # rows that surely stay need no shuffle; ids that go or come again are looked up
    doubtful = ngram_join.among(out.union(again).select(F.col("doc_id").alias("id")))(F.col("doc_id").cast("long"))
    sure = docs.where(F.col("doc_id").isNull() | ~doubtful)
    kept = groups.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    rest = docs.where(F.col("doc_id").isNotNull() & doubtful).join(kept, "doc_id", "left_semi")
    # of rows with equal id and text, the one whose other columns come first
    other = [c for c in docs.columns if c not in ("doc_id", "text")]
    one = rest.groupBy("doc_id", "text").agg(F.min(F.struct(F.lit(0).alias("__any"), *other)).alias("__other"))
    return sure.select(*docs.columns).union(one.select(*(F.col(c) if c in ("doc_id", "text") else F.col("__other")[c].alias(c) for c in docs.columns)))


def replace_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secret_scan.redact(docs, secret_scan.fit(docs.select("doc_id", "text")))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_texts(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each_group),
    ("secrets", replace_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: SQL expresses neither the classifier nor the packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
