"""Quality classifier by compression (operator 6).

Two zstandard dictionaries hold labelled text, one good and one bad, of the same size. A text is
compressed with either, in blocks so short that what counts is the dictionary and not what the text
repeats of itself; the difference of the two sizes, divided by the text's own size, says which of the
two it resembles. It is calibrated on other labelled rows than those of the dictionaries: the score is
a function of this difference alone that never falls, half an isotonic regression, which
follows the sample, and half a logistic curve, which tells all differences apart.

Training reads at most ``TRAIN_ROWS`` labelled rows (those with the smallest hashes of doc_id), and
like scoring it compresses whole texts, in tasks that give only numbers back. Labels, lang, source and doc_id
are no inputs of a score. The dictionaries take ``PIECE_BYTES`` of each text of their half of the sample, ``DICT_BYTES`` at most. If training rows lack one of the classes, every score is the share of
good labels (0.5 without labels).

Nulls: null and empty texts have difference 0 and get the curve's value there. Null doc_ids are
scored, and are not held out; labels with a null id or quality teach nothing. Repeated rows are
scored alike; of several labels of a document each counts. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

TRAIN_ROWS = 4000
DICT_BYTES = 1 << 16
PIECE_BYTES = 200
BLOCK_BYTES = 128
LEVEL = 6
THRESHOLD = 0.3


class Compressor:
    """The normalised difference of a text's sizes under two dictionaries; above 0: more like the good one."""

    def __init__(self, good: bytes, bad: bytes, level: int = LEVEL) -> None:
        raw = lambda b: zstandard.ZstdCompressionDict(b, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.coders = []
        for content in (good, bad):
            d = raw(content)
            d.precompute_compress(level=level)
            self.coders.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        self.empty = [len(c.compress(b"")) for c in self.coders]

    def __call__(self, text: str | None) -> float:
        data = (text or "").encode("utf-8", "surrogatepass")
        sizes = [0, 0]
        for at in range(0, len(data), BLOCK_BYTES):
            block = data[at : at + BLOCK_BYTES]
            for i, c in enumerate(self.coders):
                sizes[i] += len(c.compress(block)) - self.empty[i]
        return (sizes[1] - sizes[0]) / max(1, len(data))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, rounds: int = 60) -> tuple[float, float]:
    """(slope, offset) of a logistic curve by Newton's method."""
    centre, width = x.mean(), max(x.std(), 1e-9)
    a = np.column_stack([(x - centre) / width, np.ones(len(x))])
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hess = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2)
        step = np.linalg.solve(hess, a.T @ (p - y) + ridge * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / width), float(w[1] - w[0] * centre / width)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[list[float], list[float]]:
    """Points of a function that never falls: means of neighbouring rows, pooled where they fall."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # sum of y, rows, sum of x
    for a, b in zip(x[order], y[order], strict=True):
        pools.append([b, 1.0, a])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [u + v for u, v in zip(pools[-1], last, strict=True)]
    return [p[2] / p[1] for p in pools], [p[0] / p[1] for p in pools]


def fold(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS) -> dict:
    """The model: two dictionaries and a curve, from a bounded sample of the labelled rows."""
    use = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (fold(F.col("doc_id")) != 0))
    # as many of the bad as of the good, as far as there are
    use = use.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), F.xxhash64("doc_id").alias("h"))
    half = [use.where(F.col("quality") == q).orderBy("h", "doc_id").limit(max_rows // 2) for q in (1, 0)]
    pick = half[0].unionByName(half[1])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(pick), "doc_id")  # at most max_rows rows

    @F.pandas_udf("binary")
    def pieces(texts: pd.Series) -> pd.Series:
        return texts.map(piece).astype(object)

    # a repeated id is many rows: what comes to the driver is bounded here, too
    order = ("h", "doc_id", "quality", "piece")
    rows = texts.select("h", "doc_id", "quality", pieces("text").alias("piece")).orderBy(*order).limit(2 * max_rows).collect()
    share = use.agg(F.avg("quality")).first()[0]
    y = np.array([r["quality"] for r in rows], dtype=float)
    if len(set(y.tolist())) < 2:
        return {"good": b"", "bad": b"", "curve": (0.0, logit(0.5 if share is None else share)), "at": [0.0], "value": [0.5 if share is None else float(share)]}
    content = {}
    for q in (1, 0):
        own = [r["piece"] for r in rows if r["quality"] == q]
        content[q] = b"".join(map(bytes, own[: max(1, len(own) // 2)]))[:DICT_BYTES]
    size = min(len(content[1]), len(content[0]))
    good, bad = content[1][-size:], content[0][-size:]

    @F.pandas_udf("double")
    def difference(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = Compressor(good, bad)
        for texts in batches:
            yield pd.Series([coder(t) for t in texts], dtype="float64")

    # the other half of each class: whole texts stay in the tasks
    rated = texts.select("h", "doc_id", "quality", pieces("text").alias("piece"), difference("text").alias("x")).orderBy(*order).limit(2 * max_rows).collect()
    x, y = [], []
    for q in (1, 0):
        own = [r["x"] for r in rated if r["quality"] == q]
        other = own[len(own) // 2 :]
        x, y = x + other, y + [float(q)] * len(other)
    y = np.array(y)
    slope, offset = logistic(np.array(x), y)
    # the sample may hold more bad rows than their share; both curves move to the share of all labels
    move = logit(share) - logit(y.mean())
    at, value = isotonic(np.array(x), y)
    return {"good": good, "bad": bad, "curve": (slope, offset + move), "at": at, "value": [sigmoid(logit(v) + move) for v in value]}


def sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def logit(p: float) -> float:
    p = min(max(p, 1e-3), 1 - 1e-3)
    return math.log(p / (1 - p))


def piece(text: str | None) -> bytes:
    """PIECE_BYTES from the middle of a text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    at = max(0, (len(data) - PIECE_BYTES) // 2)
    return data[at : at + PIECE_BYTES]


def score(docs: DataFrame, model: dict, name: str = "score") -> DataFrame:
    """``docs`` with a column ``name`` (which it replaces, if there): the probability of a good label, from the whole text."""
    slope, offset = model["curve"]

    def rated(x: float) -> float:
        return (float(np.interp(x, model["at"], model["value"])) + sigmoid(slope * x + offset)) / 2

    @F.pandas_udf("double")
    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = Compressor(model["good"], model["bad"])
        for texts in batches:
            yield pd.Series([rated(coder(t)) for t in texts], dtype="float64")

    return docs.withColumn(name, rate("text"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
