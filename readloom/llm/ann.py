"""Approximate nearest neighbours by a hierarchical k-means tree (operator 13).

The tree is fitted on a bounded sample (``SAMPLE`` rows, chosen by a hash of the row); every row is
then put into the leaf that a descent to the nearest centres leads to. A query goes through the tree
best bin first: a priority queue holds the nodes seen so far by the distance of their centres, the
nearest is opened, and leaves come out in the order of their visit. How many leaves are visited is
calibrated: ``CALIBRATION`` rows are searched exactly among all rows, and the visits widen until the
wanted share of their true neighbours lies in visited leaves. Neighbours of the visited leaves are
ranked by their exact distances.

Rows of a leaf are dealt into blocks of bounded size, so a leaf that holds a third of all rows is
many blocks; a query meets the blocks of the leaves it visits, and each gives k rows at most.

Nulls: a row without id, or whose vector is null, zero or holds a null or non-finite component, takes
no part. Vectors of another length than the commonest (of equally common ones the shortest) take no
part. Repeated ids stay separate candidates; equal query rows are one query, different vectors of one
id are queries of their own; a row with the query's id is never its candidate. A query that has fewer
than k rows in its visited leaves visits further ones. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Rows of the sample and of the calibration, share of true neighbours wanted, rows a leaf should hold, children of a node.
SAMPLE, CALIBRATION, RECALL, LEAF_ROWS, BRANCH = 20_000, 128, 0.95, 1024, 8
ROWS_PER_BLOCK, QUERIES_PER_BLOCK = 4096, 1024
OUT = "query_id long, query_key long, vec_id long, score double"


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v, key): usable rows with components as doubles."""
    v = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    kept = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & finite).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    lengths = kept.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), "dims").limit(1).collect()
    kept = kept.where(F.size("v") == (lengths[0]["dims"] if lengths else 0))
    return kept.withColumn("key", F.xxhash64("vec_id", "v"))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` and ``b``, for finding the way: rounded."""
    return (a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * (a @ b.T)


def exact(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.sqrt(((rows - q) ** 2).sum(1))


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Centres of at most k clusters, started far from each other."""
    centres = x[[rng.integers(len(x))]]
    least = distances(x, centres)[:, 0].clip(0)
    while len(centres) < k and least.max() > 0:
        centres = np.vstack([centres, x[rng.choice(len(x), p=least / least.sum())]])
        least = np.minimum(least, distances(x, centres[-1:])[:, 0].clip(0))
    for _ in range(rounds):
        near = distances(x, centres).argmin(1)
        used, size = np.unique(near, return_counts=True)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres = total[used] / size[:, None]
    return centres


class Tree:
    """Nodes as arrays: centre, first child and number of children (0: a leaf), number of the leaf."""

    def __init__(self, sample: np.ndarray, rows: int, leaf_rows: int = LEAF_ROWS, branch: int = BRANCH, seed: int = 13) -> None:
        rng = np.random.default_rng(seed)
        centres, first, n_children = [sample.mean(0)], [0], [0]
        todo = [(0, np.arange(len(sample)))]
        while todo:
            node, members = todo.pop()
            # as many sample rows as stand for leaf_rows rows are a leaf; so are those that can't be told apart
            if len(members) * rows <= leaf_rows * len(sample) or len(members) < 2 * branch:
                continue
            found = k_means(sample[members], branch, rng)
            near = distances(sample[members], found).argmin(1)
            if len(np.unique(near)) < 2:
                continue
            first[node], n_children[node] = len(centres), len(found)
            for c in range(len(found)):
                todo.append((len(centres), members[near == c]))
                centres.append(found[c])
                first.append(0)
                n_children.append(0)
        self.centres, self.first, self.n_children = np.array(centres), np.array(first), np.array(n_children)
        self.leaf = np.cumsum(self.n_children == 0) - 1
        self.leaves = int((self.n_children == 0).sum())

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        at, todo = np.zeros(len(x), dtype=np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            a, n = self.first[node], self.n_children[node]
            if not n or not len(rows):
                at[rows] = self.leaf[node]
                continue
            near = distances(x[rows], self.centres[a : a + n]).argmin(1)
            todo += [(a + c, rows[near == c]) for c in range(n)]
        return at

    def visits(self, q: np.ndarray) -> Iterator[int]:
        """All leaves, best bin first."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            a, n = self.first[node], self.n_children[node]
            if not n:
                yield int(self.leaf[node])
                continue
            for c, d in enumerate(((self.centres[a : a + n] - q) ** 2).sum(1)):
                heapq.heappush(queue, (float(d), int(a + c)))


def nearest_in(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(i, places, distances): the k nearest rows of each query i, exact, ties to the smaller id.

    A product of matrices narrows the rows, with room for its rounding; the distances that rank them are exact.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        far = distances(queries, rows)
        room = 1e-9 * ((rows**2).sum(1).max(initial=0) + (queries**2).sum(1).max(initial=0))
        for i in range(len(queries)):
            other = np.flatnonzero(ids != query_ids[i])
            if len(other) > k and np.isfinite(far[i]).all() and np.isfinite(room):
                d = far[i, other]
                other = other[d <= np.partition(d, k - 1)[k - 1] + room]
            d = exact(queries[i], rows[other])
            best = np.lexsort((ids[other], d))[:k]
            yield i, other[best], d[best]


def matrix(batch: pa.RecordBatch, column: str = "v") -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)


def true_leaves(rows: DataFrame, probes: pd.DataFrame, k: int) -> pd.DataFrame:
    """(i, leaf): the leaves of the k true neighbours of each probe, from all rows (vec_id, v, leaf)."""
    ids, x = probes["vec_id"].to_numpy(), np.stack(probes["v"].to_list())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[float, int, int]]] = [[] for _ in ids]
        for b in batches:
            own, leaf = b.column("vec_id").to_numpy(), b.column("leaf").to_numpy()
            for i, at, d in nearest_in(own, matrix(b), ids, x, k):
                best[i] = sorted([*best[i], *zip(d.tolist(), own[at].tolist(), leaf[at].tolist(), strict=True)])[:k]
        out = [(i, *r) for i, found in enumerate(best) for r in found]
        kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, kinds, strict=True)], names=["i", "d", "vec_id", "leaf"])

    found = rows.select("vec_id", "v", "leaf").mapInArrow(run, "i long, d double, vec_id long, leaf long")
    order = Window.partitionBy("i").orderBy("d", "vec_id")
    return found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k).select("i", "leaf").toPandas()  # probes x k rows


def calibrated(tree: Tree, probes: pd.DataFrame, truth: pd.DataFrame, recall: float) -> int:
    """Leaves to visit so that the wanted share of the probes' true neighbours lies in visited leaves."""
    nth = []
    for i, found in truth.groupby("i"):
        order = {leaf: n for n, leaf in enumerate(tree.visits(probes["v"].iloc[i]))}
        nth += [order[leaf] for leaf in found["leaf"]]
    nth, visits = np.array(nth), 1
    while len(nth) and (nth < visits).mean() < recall:
        visits += 1
    return visits


def search(rows: DataFrame, queries: DataFrame, k: int = 10, recall: float = RECALL, sample: int = SAMPLE, leaf_rows: int = LEAF_ROWS, calibration: int = CALIBRATION) -> DataFrame:
    """(query_id, rank, vec_id, score) of each row of ``queries`` among ``rows``; both are (vec_id, v, key) of ``usable``."""
    n_rows = rows.count()
    # a share of the hashes, so no task gathers more than its share of the sample
    draw = F.pmod(F.xxhash64("key"), F.lit(1 << 30))
    some = rows.where(draw < int((1 << 30) * min(1.0, sample / max(1, n_rows)))).limit(2 * sample).select("v").toPandas()
    if n_rows == 0 or some.empty:
        some = rows.limit(1).select("v").toPandas()
    if some.empty:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    tree = Tree(np.stack(some["v"].to_list()), n_rows, leaf_rows)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tree.place(matrix(b)))], names=[*b.schema.names, "leaf"])

    indexed = written(rows.select("vec_id", "v", "key").mapInArrow(place, "vec_id long, v array<double>, key long, leaf long"), "leaves")
    sizes = {r["leaf"]: r["count"] for r in indexed.groupBy("leaf").count().collect()}  # at most as many as leaves
    other = F.pmod(F.xxhash64(F.lit(1), "key"), F.lit(1 << 30))
    probes = indexed.where(other < int((1 << 30) * min(1.0, 4 * calibration / n_rows))).select("vec_id", "v").orderBy("vec_id").limit(calibration).toPandas()
    if probes.empty:
        probes = indexed.select("vec_id", "v").limit(calibration).toPandas()
    visits = calibrated(tree, probes, true_leaves(indexed, probes, k), recall)
    blocks = np.array([-(-sizes.get(leaf, 0) // ROWS_PER_BLOCK) for leaf in range(tree.leaves)])
    n_queries = queries.count()
    query_blocks = max(1, -(-n_queries * visits // tree.leaves // QUERIES_PER_BLOCK))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, leaf, block = [], [], []
            for i, q in enumerate(matrix(b) if len(b) else ()):
                seen = rows_seen = 0
                for bin_ in tree.visits(q):
                    if seen >= visits and rows_seen > k:
                        break
                    seen, rows_seen = seen + 1, rows_seen + sizes.get(bin_, 0)
                    for n in range(blocks[bin_]):
                        at.append(i)
                        leaf.append(bin_)
                        block.append(n)
            if at:
                picked = b.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(leaf, pa.int64()), pa.array(block, pa.int64())], names=[*b.schema.names, "leaf", "block"])

    # which block a row is in: one of its leaf's, by hash
    n_blocks = F.element_at(F.array(*(F.lit(int(max(1, n))) for n in blocks)), (F.col("leaf") + 1).cast("int"))
    left = indexed.select("vec_id", "v", "leaf", F.pmod(F.xxhash64(F.lit(2), "key"), n_blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("part"))
    asked = queries.select("vec_id", "v", "key").dropDuplicates(["vec_id", "v"])
    right = asked.mapInArrow(visit, "vec_id long, v array<double>, key long, leaf long, block long").withColumn("part", F.pmod(F.xxhash64(F.lit(3), "key"), F.lit(query_blocks)).cast("int"))

    def meet(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(c) and len(q):
            ids = c["vec_id"].to_numpy()
            for i, at, d in nearest_in(ids, np.stack(c["v"].to_list()), q["vec_id"].to_numpy(), np.stack(q["v"].to_list()), k):
                out.append(pd.DataFrame({"query_id": q["vec_id"].iloc[i], "query_key": q["key"].iloc[i], "vec_id": ids[at], "score": d}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"query_id": [], "query_key": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "query_key": "int64", "vec_id": "int64"})

    by = ("leaf", "block", "part")
    near = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(meet, OUT)
    best = Window.partitionBy("query_id", "query_key").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(table(spark, sf_dir, "embeddings"))
    return search(rows, rows.where(F.col("vec_id") % 100 == 0))
