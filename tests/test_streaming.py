import collections

from pyspark.sql import functions as F

from readloom.streaming.coverage import stream_coverage


def test_stream_agrees_with_counting(spark, tmp_path):
    rows = [("2024-01-01 00:%02d:00" % i, "c", 7 * i, "A" * (10 + i)) for i in range(20)]
    df = spark.createDataFrame(rows, "ts string, chrom string, pos0 int, gapped string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = stream_coverage(stream, 20, 5).writeStream.format("memory").queryName("cov").outputMode("complete").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    want = collections.Counter()
    for _, _, s, seq in rows:
        for b in range(0, 400, 5):
            if s < b + 20 and s + len(seq) > b:
                want[b + 1] += 1
    assert {r.beg: r["cov"] for r in spark.table("cov").collect()} == dict(want)
