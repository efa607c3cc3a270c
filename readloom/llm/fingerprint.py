"""Document fingerprints by consistent weighted sampling (operator 5).

A text is its words (A-Z lower-cased) weighted by how often they occur. Each of ``SAMPLES`` samples
draws, for every weighted term, from gamma variables that hang on the term and the sample alone,
and keeps the term with the smallest draw together with its quantised weight. Two texts keep the
same pair with a probability that equals their generalised Jaccard similarity, the sum of the
smaller weights over the sum of the larger ones. The gamma variables come from a hash of the word's
64-bit hash and the sample, so distinct words have draws of their own whatever the vocabulary; those
of the last words stand in a table of fixed size.

Nulls: a null text is empty; texts without words share the fingerprint of the empty bag, and their
likeness to each other is 1. Rows without doc_id stand after all others (before none, in descending
order). Rows with the same doc_id are ordered by their text; repeated rows are each other's next.
One row alone is its own next document. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import spread, table, written
from .hashing import U64, Words, mix

SAMPLES = 64
#: Words whose draws are at hand, and words drawn at once.
CACHED, CHUNK = 1 << 15, 2048
SEED = 20


class Sampler:
    """Weighted samples of texts: 16 bits for each sample."""

    def __init__(self, samples: int = SAMPLES, seed: int = SEED) -> None:
        self.streams = mix(np.arange(1, 2 * samples + 1, dtype=np.uint64) + U64(seed << 32)).reshape(2, samples)
        self.samples = samples
        self.words = Words()
        self.held = np.arange(1, CACHED + 1, dtype=np.uint64)  # a word that belongs to another place
        self.table = np.zeros((CACHED, 3, samples), dtype=np.float32)

    def _drawn(self, words: np.ndarray) -> np.ndarray:
        """r, beta and lead of words: lead is ln(c) less r, what the draw needs besides t."""
        x, y = (mix(words[:, None] + stream) for stream in self.streams)

        def unit(bits: np.ndarray) -> np.ndarray:
            return (bits.astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-23)

        low = U64((1 << 23) - 1)
        gamma = [-np.log(unit(z >> U64(41)) * unit((z >> U64(18)) & low)) for z in (x, y)]
        beta = unit(((x & U64((1 << 18) - 1)) << U64(5)) | (y & U64(31)))
        return np.stack((gamma[0], beta, np.log(gamma[1]) - gamma[0]), axis=1)

    def _at_hand(self, words: np.ndarray) -> np.ndarray:
        place = (words & U64(CACHED - 1)).astype(np.int64)
        out = self.table[place]
        new = np.flatnonzero(self.held[place] != words)
        if len(new):
            out[new] = self._drawn(words[new])
            # of words with one place, one is held
            place, one = np.unique(place[new], return_index=True)
            self.held[place] = words[new[one]]
            self.table[place] = out[new[one]]
        return out

    def __call__(self, text: str | None) -> str:
        words, weights = np.unique(self.words(text), return_counts=True)
        if not len(words):
            return "ffff" * self.samples
        log_w = np.log(weights).astype(np.float32)[:, None]
        best = np.full(self.samples, np.inf, dtype=np.float32)
        term = np.zeros(self.samples, dtype=np.uint64)
        level = np.zeros(self.samples, dtype=np.int64)
        for at in range(0, len(words), CHUNK):
            part = words[at : at + CHUNK]
            r, beta, lead = self._at_hand(part).transpose(1, 0, 2)
            t = np.floor(log_w[at : at + CHUNK] / r + beta)
            draw = lead - r * (t - beta)
            low = draw.argmin(0)
            value = draw[low, np.arange(self.samples)]
            better = value < best
            best[better] = value[better]
            term[better] = part[low][better]
            level[better] = t[low, np.arange(self.samples)][better]
        code = mix(term + mix(level.view(np.uint64)))
        return (code % U64(0xFFFF)).astype(">u2").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Share of equal samples of two fingerprints."""
    x, y = (np.frombuffer(bytes.fromhex(s), dtype=">u2") for s in (a, b))
    return float((x == y).mean())


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by the start of ``following``."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


FINISHED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprint of each row of ``docs`` (doc_id, text), of its edited text and their likenesses.

    The next document (in descending doc_id) of a row is the row before it in ascending order, so
    one pass over range-partitioned, sorted rows has both texts at hand. Only the first and the
    last row of each partition are kept with their texts, to be matched across partitions.
    """
    parts = spread(docs.sparkSession)

    def result(sampler: Sampler, doc, text: str, fp: str, other: str, other_fp: str) -> tuple:
        new = edited(text, other)
        new_fp = sampler(new)
        sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
        return (doc, len(text), sha, fp, new_fp, likeness(fp, new_fp), likeness(fp, other_fp))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sampler = Sampler(samples)
        before = None
        nothing = (None,) * 6
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"].astype("Int64"), batch["text"], strict=True):
                doc, text = (None if doc is pd.NA else int(doc)), text or ""
                fp = sampler(text)
                if before is None:
                    rows.append(("head", text, doc, len(text), None, fp, None, None, None))
                else:
                    rows.append((None, None, *result(sampler, doc, text, fp, before[1], before[2])))
                before = (doc, text, fp)
            yield frame(rows)
        if before is not None:
            yield frame([("tail", before[1], before[0], len(before[1]), None, before[2], None, None, None)])

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["edge", "text", "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
        out["doc_id"] = out["doc_id"].astype("Int64")
        out[["near_edited", "near_next"]] = out[["near_edited", "near_next"]].astype("float64")
        return out

    # nulls come last in descending order, so first here
    order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(parts, *order[:1]).sortWithinPartitions(*order)
    done = written(ranged.mapInPandas(run, f"edge string, text string, {FINISHED}").withColumn("part", F.spark_partition_id()), "fingerprints")
    # two rows for each partition: a head is matched with the tail of the last partition that has rows
    edges = done.where(F.col("edge").isNotNull()).select("part", "edge", "doc_id", "text", "fingerprint")
    tails = edges.where(F.col("edge") == "tail").select(F.col("part").alias("from_part"), F.col("text").alias("other"), F.col("fingerprint").alias("other_fp"))
    used = edges.where(F.col("edge") == "tail").select("part")
    first = Window.orderBy("part")
    follow = used.select("part", F.lag("part").over(first).alias("from_part"), F.max("part").over(first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("last"))
    follow = follow.select("part", F.coalesce("from_part", "last").alias("from_part"))
    heads = edges.where(F.col("edge") == "head").join(follow, "part").join(tails, "from_part")

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sampler = Sampler(samples)
        for batch in batches:
            ids = batch["doc_id"].astype("Int64")
            rows = [(None, None, *result(sampler, None if d is pd.NA else int(d), t, f, o, of)) for d, t, f, o, of in zip(ids, batch["text"], batch["fingerprint"], batch["other"], batch["other_fp"], strict=True)]
            yield frame(rows).drop(columns=["edge", "text"])

    matched = heads.select("doc_id", "text", "fingerprint", "other", "other_fp").mapInPandas(match, FINISHED)
    return done.where(F.col("edge").isNull()).select(*matched.columns).union(matched)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
