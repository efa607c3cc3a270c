"""Exact top-k inner-product search by pivot-table elimination (operator 9).

Every vector keeps its distances to a set of pivots. By the triangle inequality
``max_p |d(q,p) - d(x,p)|`` is a lower bound of ``d(q,x)``, and with the norms it gives an upper
bound of the inner product. Candidates are evaluated in the order of that bound, until no bound
reaches the k-th best score found so far, so the answer is exact.

Rows are dealt into blocks of rows and blocks of queries, each of bounded size; one task meets one
pair of blocks. Each pair of blocks gives k rows for each query at most, and a window keeps the best.

Nulls: a row without id, or whose vector is null or holds a null or non-finite component, takes no
part. Vectors of another length than the query's are not compared. Repeated ids stay separate
candidates; equal query rows are one query, different vectors of one id are queries of their own. An
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

SCALE = 256
PIVOTS = 24
ROWS_PER_BLOCK = 4096
QUERIES_PER_BLOCK = 1024
OUT = "query_id long, query_key long, vec_id long, score long"


def as_integers(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v): usable rows with components floor(scale * x)."""
    x = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return (
        vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & finite)
        .select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))
    )


def block_search(cand_id: np.ndarray, cand: np.ndarray, query_id: np.ndarray, query: np.ndarray, k: int, pivots: int) -> list[tuple[int, int, int]]:
    """(i, id, score): the k best rows of ``cand`` for each row i of ``query``, exact, ties to the smaller id."""
    order = np.argsort(cand_id, kind="stable")
    cand_id, cand = cand_id[order], cand[order]
    cf, qf = cand.astype(np.float64), query.astype(np.float64)
    pick = np.linspace(0, len(cf) - 1, min(pivots, len(cf))).astype(int)
    table_ = np.stack([np.sqrt(((cf - cf[p]) ** 2).sum(1)) for p in pick], 1)
    q_to_p = np.stack([np.sqrt(((qf - cf[p]) ** 2).sum(1)) for p in pick], 1)
    norms, q_norms = (cf**2).sum(1), (qf**2).sum(1)
    out = []
    for i in range(len(qf)):
        low = np.zeros(len(cf))
        for p in range(len(pick)):
            np.maximum(low, np.abs(table_[:, p] - q_to_p[i, p]), out=low)
        high = (norms + q_norms[i] - low**2) / 2
        high += 1e-6 * (1 + norms + q_norms[i])  # rounding of the distances
        own = cand_id == query_id[i]
        high[own] = -np.inf
        if own.all():
            continue
        # the rows with the highest bounds first; everything whose bound reaches the k-th best score follows
        first = np.argpartition(-high, min(4 * k, len(high) - 1))[: 4 * k] if len(high) > 4 * k else np.arange(len(high))
        first = first[~own[first]]
        score = cand[first] @ query[i]
        kth = np.sort(score)[-k] if len(score) >= k else None
        rest = np.flatnonzero(~own if kth is None else (high >= kth) & ~own)
        rest = rest[np.argsort(-high[rest], kind="stable")]
        best: list[tuple[int, int]] = []
        for at in range(0, len(rest), 256):
            if len(best) == k and high[rest[at]] < -best[-1][0]:
                break
            part = rest[at : at + 256]
            best = sorted([*best, *zip((-(cand[part] @ query[i])).tolist(), cand_id[part].tolist(), strict=True)])[:k]
        out += [(i, vec, -neg) for neg, vec in best]
    return out


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score) of each row of ``queries`` against all ``rows``; both are (vec_id, v)."""
    n_rows, n_queries = rows.count(), queries.count()
    row_blocks, query_blocks = max(1, -(-n_rows // ROWS_PER_BLOCK)), max(1, -(-n_queries // QUERIES_PER_BLOCK))
    dims = F.size("v").alias("dims")
    key = F.xxhash64("vec_id", "v")
    queries = queries.dropDuplicates(["vec_id", "v"])
    left = rows.select("vec_id", "v", dims, F.pmod(key, F.lit(row_blocks)).cast("int").alias("rb"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"))
    right = queries.select("vec_id", "v", dims, key.alias("query_key"), F.pmod(key, F.lit(query_blocks)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("rb"))

    def search(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        found: list = []
        if len(c) and len(q) and int(c["dims"].iloc[0]):
            found = block_search(c["vec_id"].to_numpy(), np.stack(c["v"].to_list()), q["vec_id"].to_numpy(), np.stack(q["v"].to_list()), k, pivots)
        elif len(c) and len(q):  # vectors without components: every score is 0
            ids = np.sort(c["vec_id"].to_numpy())
            found = [(i, v, 0) for i, x in enumerate(q["vec_id"]) for v in ids[ids != x][:k]]
        i, vec, score = np.array(found, dtype=np.int64).reshape(-1, 3).T
        return pd.DataFrame({"query_id": q["vec_id"].to_numpy()[i], "query_key": q["query_key"].to_numpy()[i], "vec_id": vec, "score": score}).astype("int64")

    near = left.groupBy("rb", "qb", "dims").cogroup(right.groupBy("rb", "qb", "dims")).applyInPandas(search, OUT)
    best = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = as_integers(table(spark, sf_dir, "embeddings"))
    return top_k(rows, rows.where(F.col("vec_id") % 50 == 0))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
