"""Mixing sources to target weights (operator 2).

1. Targets: sources by code point (null last) weigh 5, 2, 1 and so on and share all words; a target
   stops at three times its source's words, and the excess is shared anew by weight. Filling up is
   done at once: sources sorted by (cap / weight) are capped as long as the common level exceeds it.
2. The words of a source, its documents in a pseudorandom order, are packed into blocks of
   ``BLOCK`` words; a document's place is a prefix sum in two steps (bins within a source, documents
   within a bin), so a source with a third of all rows is no single task's work.
3. The mix is a row of output shards of equal slots. For each shard of the first half, counts of
   slots by source are drawn from the multinomial distribution of the targets. The other half is
   scaled: it holds what each source still lacks, in equal parts. A source that was drawn
   more often than its target asks keeps that, up to three passes over its blocks.
4. The k-th slot of a source takes the block at place k of a pseudorandom permutation of the
   source's blocks (a Feistel network with cycle walking, another one for each pass over the
   source), so no document comes more than three times; slots and blocks are joined by index. The
   slots of a shard are permuted alike, so its sources are mixed.

Draws are made again from the seed wherever they are needed, by groups of shards, and not stored.
All draws hang on ``seed``, source and index alone: reruns agree. The targets come to the driver,
one row for each source (``MAX_SOURCES`` at most, else an error); nothing else does.

``op2`` also tells in how many shards a document is, and in which first.

Nulls: a null text has size 0 and takes no part, with taken 0; a null source is a source. Rows with
the same doc_id are placed each on its own. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written
from .hashing import Words, mix

WEIGHTS = (5, 2, 1)
LIMIT = 3
BLOCK = 128
SLOTS_PER_SHARD = 256
DOCS_PER_BIN = 512
MAX_SOURCES = 100_000
SEED = 42
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> list[float]:
    """Target of each source in order: shares of all words by weight, none above limit * size."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    left, weight = float(sum(sizes)), float(sum(w))
    out = [0.0] * len(sizes)
    # the source that reaches its cap first comes first; once one is below its cap, all others are
    for i in sorted(range(len(sizes)), key=lambda i: sizes[i] / w[i]):
        out[i] = min(float(limit * sizes[i]), left * w[i] / weight)
        left -= out[i]
        weight -= w[i]
    return out


def permuted(k: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Place k of a pseudorandom permutation of range(n) under a key, elementwise."""
    k, n, key = k.astype(np.uint64), n.astype(np.uint64), key.astype(np.int64).view(np.uint64)
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2).astype(np.float64))).astype(np.int64) + 1) // 2).astype(np.uint64)
    low = (np.uint64(1) << half) - np.uint64(1)
    out = k.copy()
    todo = np.ones(len(k), dtype=bool)
    while todo.any():
        x, h, m, s = out[todo], half[todo], low[todo], key[todo]
        a, b = x >> h, x & m
        for r in range(4):
            a, b = b, a ^ (mix(b + s * np.uint64(2 * r + 1) + np.uint64(r)) & m)
        out[todo] = a << h | b
        todo[todo] = out[todo] >= n[todo]
    return out.astype(np.int64)


def placed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, source, row, size, source_size, at): each row's first word within its source.

    ``row`` is the hash of all columns, by which a row is found again.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.xxhash64(*docs.columns).alias("row"), n_words(F.col("text")).alias("size"))
    n_rows = d.count()
    bins = max(1, -(-n_rows // DOCS_PER_BIN))
    d = d.withColumn("bin", F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(bins)).cast("int"))
    sums = d.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    own = Window.partitionBy("source")
    upto = own.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("bin_size").over(upto), F.lit(0))).withColumn("source_size", F.sum("bin_size").over(own)).drop("bin_size")
    sums = sums.withColumnsRenamed({"source": "of_source", "bin": "of_bin"})
    joined = d.join(sums, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("bin") == F.col("of_bin")))
    within = Window.partitionBy("source", "bin").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    return joined.select("doc_id", "source", "row", "size", "source_size", (F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0))).alias("at"))


def slots(spark: SparkSession, sources: pd.DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """(no, pass, block, words, shard, slot): the blocks that the mix takes, one row for each slot.

    ``sources``: no, size, target. ``words``: how many of the block's words are taken; only the slot
    at a source's target may take fewer than the block has.
    """
    schema = "no int, pass int, block long, words long, shard long, slot long"
    use = sources[(sources["target"] >= 0.5) & (sources["size"] > 0)].reset_index(drop=True)
    if use.empty:
        return spark.createDataFrame([], schema)
    no = use["no"].to_numpy()
    size, want = use["size"].to_numpy().astype(np.int64), np.rint(use["target"].to_numpy()).astype(np.int64)
    blocks = -(-size // block)
    passes, rest = want // size, want % size
    quota = passes * blocks + -(-rest // block)
    share = quota / quota.sum()
    shards = -(-int(quota.sum()) // SLOTS_PER_SHARD)
    closing = -(-shards // 2)
    drawn_shards = shards - closing
    per_group = max(1, min(1024, (1 << 20) // len(use)))
    groups = -(-shards // per_group)

    def counts(first: int, stop: int, lacking: np.ndarray | None = None) -> np.ndarray:
        """Slots by shard and source; of the scaled shards only if ``lacking`` is given."""
        out = np.zeros((stop - first, len(use)), dtype=np.int64)
        for shard in range(first, stop):
            if shard < drawn_shards:
                out[shard - first] = np.random.default_rng((seed, shard)).multinomial(SLOTS_PER_SHARD, share)
            elif lacking is not None:
                j = shard - drawn_shards
                out[shard - first] = lacking * (j + 1) // closing - lacking * j // closing
        return out

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for g in batch["id"]:
                n = counts(g * per_group, min(shards, (g + 1) * per_group)).sum(0)
                yield pd.DataFrame({"g": np.full(len(n), g), "s": np.arange(len(n), dtype=np.int32), "n": n})

    sums = written(spark.range(groups).mapInPandas(draw, "g long, s int, n long"), "mix-draws")
    drawn = np.zeros(len(use), dtype=np.int64)
    for r in sums.groupBy("s").agg(F.sum("n").alias("n")).collect():
        drawn[r["s"]] = r["n"]
    lacking = np.maximum(0, quota - drawn)
    # scaled shards follow the drawn ones of the same source
    before = Window.partitionBy("s").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("from", F.coalesce(F.sum("n").over(before), F.lit(0))).select("g", "s", "from")

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        g = int(group["g"].iloc[0])
        first, stop = g * per_group, min(shards, (g + 1) * per_group)
        n = counts(first, stop, lacking)
        begin = np.zeros(len(use), dtype=np.int64)
        begin[group["s"].to_numpy()] = group["from"].to_numpy()
        # scaled shards of earlier groups
        scaled = max(0, min(first, shards) - drawn_shards)
        begin += lacking * scaled // closing
        at, whole = np.cumsum(n, 1) - n, n.sum(1)
        out = []
        for s in np.flatnonzero(n.sum(0)):
            times = n[:, s]
            row = np.repeat(np.arange(stop - first), times)
            k = begin[s] + np.arange(len(row))
            place = at[row, s] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            ok = k < LIMIT * blocks[s]
            k, row, place = k[ok], row[ok], place[ok]
            turn = k // blocks[s]
            key = mix((turn * 1_000_003 + int(no[s]) * 7919 + seed).astype(np.uint64)).view(np.int64)
            index = permuted(k % blocks[s], np.full(len(k), blocks[s]), key)
            taken = np.minimum(block, size[s] - index * block)
            # the slot at the target takes the words that are still lacking
            taken = np.where((k == quota[s] - 1) & (rest[s] > 0), np.minimum(taken, rest[s] - (k % blocks[s]) * block), taken)
            slot = permuted(place, whole[row], mix((row + first).astype(np.uint64) + np.uint64(seed)).view(np.int64))
            out.append(pd.DataFrame({"no": np.full(len(k), no[s], dtype=np.int32), "pass": turn.astype(np.int32), "block": index, "words": taken, "shard": row + first, "slot": slot}))
        return pd.concat(out) if out else pd.DataFrame([], columns=["no", "pass", "block", "words", "shard", "slot"])

    return sums.groupBy("g").applyInPandas(fill, schema)


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces) of the mix.

    documents: (doc_id, source, row, no, at, size, source_size, target), one row for each row of
    ``docs``; pieces: (row, no, at, size, pass, begin, end, shard, slot), the words of a document that
    one slot takes.
    """
    spark = docs.sparkSession
    d = written(placed(docs, seed), "mix-places")
    found = d.groupBy("source").agg(F.first("source_size").alias("size")).orderBy(F.col("source").asc_nulls_last()).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sizes = [r["size"] for r in found]
    table_ = pd.DataFrame({"no": range(len(sizes)), "size": sizes, "target": targets(sizes, weights)})
    names = spark.createDataFrame([(r["source"], i, t) for i, (r, t) in enumerate(zip(found, table_["target"], strict=True))], "of_source string, no int, target double")
    d = d.join(F.broadcast(names), F.col("source").eqNullSafe(F.col("of_source"))).select("doc_id", "source", "row", "no", "at", "size", "source_size", "target")  # MAX_SOURCES rows at most
    parts = d.where(F.col("size") > 0).select("row", "no", "at", "size", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))).alias("block"))
    parts = parts.withColumn("begin", F.greatest(F.lit(0), F.col("at") - F.col("block") * block)).withColumn("end", F.least(F.lit(block), F.col("at") + F.col("size") - F.col("block") * block))
    taken = slots(spark, table_, block, seed)
    # slots are as many as blocks, whatever Spark makes of the small table they come from: no broadcast
    pieces = parts.join(taken.hint("merge"), ["no", "block"]).where(F.col("words") > F.col("begin"))
    offset = F.col("block") * block - F.col("at")
    return d, pieces.select("row", "no", "at", "size", "pass", (F.col("begin") + offset).alias("begin"), (F.least("end", "words") + offset).alias("end"), "shard", "slot")


def mixed_texts(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows of ``docs``: one row for each stretch of a document that a pass takes.

    ``text`` is that stretch (the whole text if all of it is taken) and ``n_chars``, where ``docs``
    has it, its length; other columns stay. Documents that the mix doesn't take are not there.
    """
    _, pieces = mixed(docs, **options)
    run = Window.partitionBy("no", "at", "pass").orderBy("begin")
    start = (F.col("begin") != F.coalesce(F.lag("end").over(run), F.lit(-1))).cast("int")
    runs = pieces.withColumn("start", start).withColumn("run", F.sum("start").over(run)).groupBy("row", "no", "at", "pass", "run").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.first("size").alias("size"))

    @F.pandas_udf("string")
    def stretch(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        words = Words()
        for texts, begin, end, size in batches:
            out = []
            for t, b, e, n in zip(texts, begin, end, size, strict=True):
                if e - b < n:
                    data = t.encode("utf-8", "surrogatepass")
                    starts, ends = words.spans(np.frombuffer(data, dtype=np.uint8))
                    t = data[starts[b] : ends[e - 1]].decode("utf-8", "surrogatepass")
                out.append(t)
            yield pd.Series(out, dtype=object)

    # names of their own, as docs may have columns of any name
    runs = runs.select(*(F.col(c).alias(f"__mix_{c}") for c in ("row", "no", "at", "pass", "run", "begin", "end", "size")))
    texts = docs.withColumn("__mix_row", F.xxhash64(*docs.columns))
    # rows are told apart by their hash; equal rows meet each other's runs, so of those each run stays once
    equal = written(texts.groupBy("__mix_row").agg(F.count("*").alias("rows")).where("rows > 1").select("__mix_row"), "mix-equal")
    once = texts.join(runs.join(equal, "__mix_row", "left_anti").hint("merge"), "__mix_row")
    more = texts.join(runs.join(equal, "__mix_row"), "__mix_row").dropDuplicates(["__mix_no", "__mix_at", "__mix_pass", "__mix_run"])
    out = once.unionByName(more).withColumn("text", stretch("text", "__mix_begin", "__mix_end", "__mix_size"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, pieces = mixed(table(spark, sf_dir, "documents"))
    # (no, at) names a row with words: places do not overlap
    taken = pieces.groupBy("no", "at").agg(F.sum(F.col("end") - F.col("begin")).alias("taken"), F.count_distinct("shard").alias("n_shards"), F.min("shard").alias("first_shard"))
    taken = taken.withColumnsRenamed({"no": "of_no", "at": "of_at"})
    own = d.join(taken, (F.col("no") == F.col("of_no")) & (F.col("at") == F.col("of_at")) & (F.col("size") > 0), "left")
    return own.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("n_shards", F.lit(0)).cast("long").alias("n_shards"), "first_shard")
