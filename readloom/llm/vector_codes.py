"""Vector code compression by cover-tree Lloyd rounds (operator 11).

A vector's components become integers ``floor(scale * x)`` and are cut into equal consecutive
parts; every part has a codebook of its own, trained by Lloyd rounds. Each task builds, once, cover
trees over the parts of its blocks of rows and writes them as a table in the shared folder. In a
round a whole subtree goes to an entry when the triangle inequality shows that no other entry can be
nearer to any of its points; its share of the entry's sum then comes from cumulative sums along the
tree's order of points. Only nodes for which several entries remain are descended, and only the
points of such leaves are compared exactly, in integers. So the result is that of plain rounds.

A round moves a number of rows bounded by parts, entries and components of each task; the codebooks
are its only broadcast. Nothing but rows' codes leaves the last pass.

Nulls: a vector that is null or holds a null or non-finite component is dropped. Rows without id or
label stay (ids last in the order that starts the codebooks). Vectors of another length than the
commonest (of equally common ones the shortest), and empty ones, are dropped. Where the length is no
multiple of the number of parts, part i has the components from floor(i * n / parts) to the next
part's. Integers beyond +-2^24 count as +-2^24. Ties go to the lower entry; rows that share an id
start the codebooks in the order of their vectors; repeated rows stay. With fewer rows than entries
the codebook has an entry a row. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, written

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Rows of a block (the points of a tree), points of a leaf, largest integer component.
BLOCK, LEAF, LARGEST = 2048, 8, 1 << 24


def bounds(dims: int, parts: int) -> list[int]:
    return [i * dims // parts for i in range(parts + 1)]


def usable(vectors: DataFrame, vec_col: str) -> DataFrame:
    """Rows with vectors of the commonest length and finite components only."""
    v = F.col(vec_col)
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    kept = vectors.where(v.isNotNull() & (F.size(v) > 0) & finite)
    lengths = kept.groupBy(F.size(v).alias("dims")).count().orderBy(F.desc("count"), "dims").limit(1).collect()
    return kept.where(F.size(v) == (lengths[0]["dims"] if lengths else 0))


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    return np.clip(np.floor(x.astype(np.float64) * scale), -LARGEST, LARGEST).astype(np.int64)


class CoverTree:
    """Points in the order of the tree, so that every node is a range of them; nodes level by level.

    A node's centre is one of its points and its first child has the same centre; the children of a
    node lie more than half its scale apart, and all its points within its radius. ``place`` gives
    the place of each row's point; equal rows are one point with a weight.
    """

    NODES = ("centre", "start", "end", "radius", "first", "last")

    def __init__(self, points: np.ndarray, weight: np.ndarray, place: np.ndarray, levels: list[tuple]) -> None:
        self.points, self.weight, self.place, self.levels = points, weight, place, levels
        self.sums = np.zeros((len(points) + 1, points.shape[1]), dtype=np.int64)
        np.cumsum(points * weight[:, None], axis=0, out=self.sums[1:])
        self.counts = np.r_[0, np.cumsum(weight)]

    @classmethod
    def build(cls, rows: np.ndarray) -> CoverTree:
        points, place, weight = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        x, m = points.astype(np.float64), len(points)
        order, levels = np.arange(m), []
        start, end, centre = np.array([0]), np.array([m]), np.array([0])  # centres are names of points, not places
        scale = None
        while len(start):
            owner = np.repeat(np.arange(len(start)), end - start)
            at = np.concatenate([np.arange(a, b) for a, b in zip(start, end, strict=True)]) if len(start) > 1 else np.arange(start[0], end[0])
            far = np.sqrt(((x[order[at]] - x[centre[owner]]) ** 2).sum(1))
            radius = np.maximum.reduceat(far, np.r_[0, np.cumsum(end - start)[:-1]])
            scale = (radius.max() if scale is None else scale) / 2
            split = (end - start > LEAF) & (radius > 0)
            first = last = np.zeros(len(start), dtype=np.int64)
            nodes = [centre, start, end, radius, first, last]
            levels.append(nodes)
            if not split.any():
                break
            open_ = split[owner]
            at, owner, far = at[open_], owner[open_], far[open_]
            child, new_centre = np.full(len(at), -1), np.full(len(at), -1)
            left, now = np.arange(len(at)), centre
            turn = 0
            while len(left):
                if turn:  # the first point that is left becomes the next centre of its node
                    own, where = np.unique(owner[left], return_index=True)
                    now = now.copy()
                    now[own] = order[at[left[where]]]
                    far = np.sqrt(((x[order[at[left]]] - x[now[owner[left]]]) ** 2).sum(1))
                near = far <= scale
                child[left[near]] = turn
                new_centre[left[near]] = now[owner[left[near]]]
                left, far = left[~near], far[~near]
                turn += 1
            by = np.lexsort((child, owner))
            order[at] = order[at[by]]
            owner, child, new_centre = owner[by], child[by], new_centre[by]
            new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (child[1:] != child[:-1])])
            parent = owner[new]
            nodes[4], nodes[5] = np.searchsorted(parent, np.arange(len(start))), np.searchsorted(parent, np.arange(len(start)), side="right")
            # the places of a node are consecutive
            start, end, centre = at[new], at[np.r_[new[1:], len(at)] - 1] + 1, new_centre[new]
        places = np.empty(m, dtype=np.int64)
        places[order] = np.arange(m)
        levels = [(places[n[0]], *n[1:]) for n in levels]
        return cls(points[order], weight[order], places[place.reshape(-1)], levels)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        short = np.int16 if len(self.points) == 0 or np.abs(self.points).max() < 1 << 15 else np.int32
        ints = np.concatenate([np.stack([n[i] for i in (0, 1, 2, 4, 5)], 1) for n in self.levels]).astype(np.int32)
        for a in (self.points.astype(short), self.weight.astype(np.int32), self.place.astype(np.int32), ints, np.concatenate([n[3] for n in self.levels]), np.array([len(n[0]) for n in self.levels], dtype=np.int32)):
            np.save(out, a, allow_pickle=False)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> CoverTree:
        src = io.BytesIO(data)
        points, weight, place, ints, radius, sizes = (np.load(src, allow_pickle=False) for _ in range(6))
        levels, at = [], 0
        for n in sizes:
            c, r = ints[at : at + n].astype(np.int64), radius[at : at + n]
            levels.append((c[:, 0], c[:, 1], c[:, 2], r, c[:, 3], c[:, 4]))
            at += n
        return cls(points.astype(np.int64), weight.astype(np.int64), place.astype(np.int64), levels)

    def assign(self, book: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], int]:
        """Ranges of points and the nearest entry of each: (starts, ends, entries) by level; and the points compared exactly."""
        found, exact = [], 0
        entries = book.astype(np.float64)
        node, may = np.array([0]), np.ones((1, len(book)), dtype=bool)
        for centre, start, end, radius, first, last in self.levels:
            # an entry stays only if it may be nearest, or as near as the nearest, for some point of the node
            far = np.sqrt(((self.points[centre[node]].astype(np.float64)[:, None, :] - entries[None]) ** 2).sum(2))
            far[~may] = np.inf
            least = far.min(1)
            may = far <= (least + 2 * radius[node] + 1e-6 * (1 + least))[:, None]
            alone = may.sum(1) == 1
            found.append((start[node[alone]], end[node[alone]], may[alone].argmax(1)))
            node, may = node[~alone], may[~alone]
            leaf = last[node] == first[node]
            if leaf.any():
                size = (end - start)[node[leaf]]
                at = np.repeat(start[node[leaf]] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
                near = nearest(self.points[at], book, np.repeat(may[leaf], size, axis=0))
                found.append((at, at + 1, near))
                exact += len(at)
            node, may = node[~leaf], may[~leaf]
            if not len(node):
                break
            n = last[node] - first[node]
            may = np.repeat(may, n, axis=0)
            node = np.repeat(first[node] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        return found, exact

    def labels(self, book: np.ndarray) -> np.ndarray:
        """The nearest entry of each point."""
        out = np.full(len(self.points), -1, dtype=np.int64)
        for start, end, entry in self.assign(book)[0]:
            size = end - start
            out[np.repeat(start - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())] = np.repeat(entry, size)
        return out


def nearest(points: np.ndarray, book: np.ndarray, may: np.ndarray) -> np.ndarray:
    """The nearest of the entries that are left for each point, by integer distances; ties to the lower."""
    d = np.zeros((len(points), len(book)), dtype=np.int64)
    for j in range(points.shape[1]):
        d += (points[:, j, None] - book[None, :, j]) ** 2
    d[~may] = np.iinfo(np.int64).max
    return d.argmin(1)


def trees(rows: DataFrame, parts: int, scale: int, block: int = BLOCK) -> DataFrame:
    """(ids, labels, trees) of each block of at most ``block`` rows; rows are (id, label, v)."""
    kinds = {f.name: f.dataType for f in rows.schema}
    out = T.StructType([T.StructField("ids", T.ArrayType(kinds["id"])), T.StructField("labels", T.ArrayType(kinds["label"])), T.StructField("trees", T.ArrayType(T.BinaryType()))])

    def block_row(part: pa.RecordBatch) -> pa.RecordBatch:
        v = part.column("v")
        x = integers(v.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1), scale)
        cut = bounds(x.shape[1], parts)
        packed = [CoverTree.build(np.ascontiguousarray(x[:, a:b])).to_bytes() if a < b else b"" for a, b in zip(cut, cut[1:], strict=False)]
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, len(part)], part.column(c)) for c in ("id", "label")] + [pa.array([packed], pa.list_(pa.binary()))], names=["ids", "labels", "trees"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            while len(b):
                take = min(len(b), block - sum(map(len, held)))
                held.append(b.slice(0, take))
                b = b.slice(take)
                if sum(map(len, held)) == block:
                    yield block_row(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    held = []
        if held:
            yield block_row(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return rows.mapInArrow(build, out)


def totals(blocks: DataFrame, books: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(sums, counts) of each part's entries over all rows: summed in each task, then by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(b.shape, dtype=np.int64) for b in books]
        counts = [np.zeros(len(b), dtype=np.int64) for b in books]
        for batch in batches:
            for packed in batch.column("trees"):
                for p, data in enumerate(packed):
                    if books[p].shape[1]:
                        tree = CoverTree.from_bytes(data.as_py())
                        for start, end, entry in tree.assign(books[p])[0]:
                            np.add.at(sums[p], entry, tree.sums[end] - tree.sums[start])
                            np.add.at(counts[p], entry, tree.counts[end] - tree.counts[start])
        rows = [(p, e, j, int(counts[p][e]), int(sums[p][e, j])) for p in range(len(books)) for e in np.flatnonzero(counts[p]).tolist() for j in range(books[p].shape[1])]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 5)], names=["part", "entry", "at", "n", "total"])

    out = [(np.zeros(b.shape, dtype=np.int64), np.zeros(len(b), dtype=np.int64)) for b in books]
    by = blocks.select("trees").mapInArrow(run, "part long, entry long, at long, n long, total long").groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    for r in by.collect():  # at most entries x components
        out[r["part"]][0][r["entry"], r["at"]] = r["total"]
        out[r["part"]][1][r["entry"]] = r["n"]
    return out


def codes(blocks: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(id, label, code, error) of every row."""
    kinds = {f.name: f.dataType.elementType for f in blocks.schema}
    out = T.StructType([T.StructField("id", kinds["ids"]), T.StructField("label", kinds["labels"]), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                ids, labels = (batch.column(c).slice(i, 1).flatten() for c in ("ids", "labels"))
                code, error = np.zeros((len(ids), len(books)), dtype=np.uint8), np.zeros(len(ids), dtype=np.int64)
                for p, data in enumerate(batch.column("trees")[i]):
                    if books[p].shape[1]:
                        tree = CoverTree.from_bytes(data.as_py())
                        near = tree.labels(books[p])
                        off = ((tree.points - books[p][near]) ** 2).sum(1)
                        code[:, p], error = near[tree.place], error + off[tree.place]
                text, n = code.tobytes().hex(), 2 * len(books)
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array([text[k : k + n] for k in range(0, len(text), n)], pa.string()), pa.array(error)], names=["id", "label", "code", "error"])

    return blocks.mapInArrow(run, out)


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", block: int = BLOCK) -> tuple[DataFrame, list[np.ndarray]]:
    """((id, label, code, error) of every usable row, the codebook of each part); the codes are a written table."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hexadecimal digits a part: 1 to 256 entries")
    kept = usable(vectors, vec_col).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("v"))
    start = kept.select("id", "v").orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    x = integers(np.array([r["v"] for r in start], dtype=np.float64).reshape(len(start), len(start[0]["v"]) if start else 0), scale)
    cut = bounds(x.shape[1], parts)
    books = [x[:, a:b] for a, b in zip(cut, cut[1:], strict=False)]
    blocks = written(trees(kept, parts, scale, block), "cover-trees")
    for _ in range(rounds if start else 0):
        books = [np.where(n[:, None] > 0, s // np.maximum(n, 1)[:, None], b) for b, (s, n) in zip(books, totals(blocks, books), strict=True)]
    return written(codes(blocks, books), "vector-codes"), books


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


_NEAR = "SELECT {cols}min(list_sum(list_transform(range(1, 1 + len(p.v)), lambda i: (p.v[i] - b.v[i]) * (p.v[i] - b.v[i])))::BIGINT * 64 + b.entry) AS m FROM p JOIN {book} b USING (part) GROUP BY {by}"
_ROUND = (
    "SELECT part, entry, coalesce(n.v, b.v) AS v FROM {book} b LEFT JOIN ("
    "SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM ("
    "SELECT p.part, m % 64 AS entry, i, sum(p.v[i])::BIGINT AS s, count(*) AS n FROM (" + _NEAR + ") JOIN p USING (rid, part), range(1, 1 + len(p.v)) r(i) GROUP BY ALL"
    ") GROUP BY ALL) n USING (part, entry)"
)
#: For vectors whose length is a multiple of 16.
SQL = f"""
WITH e AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid, vec_id, label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT rid, part, v[part * (len(v) // 16) + 1 : (part + 1) * (len(v) // 16)] AS v FROM e, range(16) t(part)),
b0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, v FROM p WHERE rid <= 64),
b1 AS MATERIALIZED ({_ROUND.format(book="b0", cols="rid, part, ", by="rid, part")}),
b2 AS MATERIALIZED ({_ROUND.format(book="b1", cols="rid, part, ", by="rid, part")}),
f AS ({_NEAR.format(book="b2", cols="rid, part, ", by="rid, part")}),
c AS (SELECT rid, string_agg(printf('%02x', m % 64), '' ORDER BY part) AS code, sum(m // 64)::BIGINT AS error FROM f GROUP BY rid)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM b2) AS codebooks_sha256
FROM c JOIN e USING (rid)
"""
