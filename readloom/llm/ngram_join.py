"""N-gram Jaccard self-join with parity sketches (operator 3).

1. Every whole text becomes its set of word shingles (64-bit hashes). Equal sets are collapsed into
   a class with one representative.
2. A representative has one or two parity sketches: its set is dealt into K chunks, and in each
   chunk every shingle flips one of 64 bits (and its hash is XORed into the chunk's join key). A
   shingle in only one of two sets flips one bit, so the Hamming distance of two sketches is at most
   the size of the symmetric difference, and a chunk without such a shingle is equal. For each band
   of set sizes, K is more than the largest symmetric difference that the threshold allows, so
   linked texts agree in at least one chunk.
3. Chunk keys are counted where they arise (a hot key is one row for each task), and only rows of
   keys that two texts have go on. They meet the smallest id of their chunk (a star, so a large
   group of copies gives a row for each copy and not for each pair).
4. Pairs whose sketches differ in more bits than allowed go: first folded to 512 bits (which keeps
   the lower bound), then, for sets too large for that, to two bits for each element. Each text is verified
   with the nearest star that is left, on the shingle sets of the whole texts.
5. Chunks whose texts do not yet all hang together are joined with themselves across components.
   The join's condition compares the folded sketches, so only pairs that may be linked come out;
   they are narrowed and verified alike. No link that could join two components is missed.
6. Components by repeated minimum over the links with pointer jumping.

Nulls: null and empty texts have no shingles and are linked with nothing. Rows with the same doc_id
are one document each with its own text; their classes meet in the smallest doc_id. A null doc_id
takes no part in links: its component is null. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free, table, written
from .hashing import Words, mix, shingles

U64 = np.uint64
BAND_RATIO = 1.4


def bands(percent: int, up_to: int = 1 << 40) -> list[int]:
    """First set size of each band.

    Linked sets lie in one band or in two that follow each other: b elements need at least
    ``percent`` of them in the smaller set, so bands are wider where ``percent`` is low.
    """
    if not 1 <= percent <= 100:
        raise ValueError("percent lies between 1 and 100")
    out = [1]
    while out[-1] < up_to:
        # a smaller set of the band has out[-1] - 1 elements at most in the one before
        out.append(max(out[-1] + 1, int(out[-1] * BAND_RATIO), 100 * out[-1] // percent))
    return out


def most_apart(larger: int, percent: int) -> int:
    """Largest symmetric difference of linked sets of which the larger one has so many elements.

    From J >= p/100 follows |A and B| >= p (a + b) / (100 + p), and a <= b bounds the rest.
    """
    return 2 * larger * (100 - percent) // (100 + percent)


def chunks_of(first: list[int], band: int, percent: int) -> tuple[int, int]:
    """(K, z) of a band: chunks of its sketches, and the empty chunks that a sketch may have.

    K = t + 1 + z for the largest symmetric difference t, so linked sketches agree in z + 1 chunks.
    A sketch with at most z zero chunks thus agrees in one that isn't zero, and only sketches with
    more zeros have to meet at zero chunks; z is chosen so that they are rare.
    """
    t = most_apart(first[band + 1] - 1, percent)
    empty = float(np.exp(-max(1, percent * first[band] // 100) / (t + 1)))
    z = int(np.ceil(2 * empty * (t + 1) + 3 * np.sqrt(empty * (t + 1)))) if t and empty > 5e-4 else 0
    return t + 1 + z, z


KEY_BITS = 48


def sketch(sets: np.ndarray, chunks: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(bits, keys) of one set, by chunk: parity words of 64 bits, and XOR-hashes of KEY_BITS bits.

    An element's hash chooses its chunk. Both are unchanged by elements in other chunks; the bits
    give distances, the keys tell different chunks apart for the join. An empty chunk has key 0.
    """
    h = mix(sets ^ U64(salt))
    chunk = ((h >> U64(32)) * U64(chunks)) >> U64(32)
    order = np.argsort(chunk, kind="stable")
    chunk, h = chunk[order].astype(np.int64), h[order]
    first = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]])
    bits, keys = np.zeros(chunks, dtype=np.uint64), np.zeros(chunks, dtype=np.uint64)
    bits[chunk[first]] = np.bitwise_xor.reduceat(U64(1) << (h & U64(63)), first)
    keys[chunk[first]] = np.bitwise_xor.reduceat(mix(h) >> U64(64 - KEY_BITS) | U64(1), first)
    return bits, keys


FOLDED = 8


def fold(words: np.ndarray, size: int = FOLDED) -> np.ndarray:
    """A parity sketch of ``size`` words: chunks that fall together flip the same bits twice."""
    out = np.zeros(-(-len(words) // size) * size, dtype=np.uint64)
    out[: len(words)] = words
    return np.bitwise_xor.reduce(out.reshape(-1, size), axis=0)


def wide(words: np.ndarray, first: int) -> np.ndarray | None:
    """The sketch of a band that begins at ``first``, folded to two bits an element; None if FOLDED words do."""
    size = 1 << max(0, (first - 1).bit_length() - 5)
    return fold(words, size).view(np.int64) if size > FOLDED else None


def fingerprint_of(sets: np.ndarray) -> tuple[int, int]:
    """Two numbers that stand for a set of hashes."""
    with np.errstate(over="ignore"):
        one, two = (int(mix(sets + U64(k)).sum().astype(np.int64)) for k in (1, 2))
    return one, two


def set_fingerprints(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n, fp1, fp2) of every row of ``docs``: the size and fingerprint of its shingle set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for batch in batches:
            rows = [(len(s), *fingerprint_of(s)) for s in (shingles(words(t), size) for t in batch["text"])]
            out = pd.DataFrame(rows, columns=["n", "fp1", "fp2"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
            yield out.astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, n long, fp1 long, fp2 long")


def sketches(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, n, fp1, fp2, band, own, own_zeros, own_fold, own_wide, up, ...) of every row of ``docs``.

    ``own`` has the chunk keys for partners of the same band or smaller, ``up`` those with which the
    set takes part in the next larger band (null if no partner of that band can be linked);
    ``*_fold`` and ``*_wide`` are the folded parity sketches; ``*_zeros`` tells that the set also has
    to meet others at its empty chunks.
    """
    first = bands(percent)
    edges = np.array(first)
    level_of_none = (None, False, None, None)

    def level_of(s: np.ndarray, level: int) -> tuple:
        k, z = chunks_of(first, level, percent)
        bits, keys = sketch(s, k, level)
        return keys.view(np.int64), int((keys == 0).sum()) > z, fold(bits).view(np.int64), wide(bits, first[level])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for batch in batches:
            rows = []
            for text in batch["text"]:
                s = shingles(words(text), size)
                n = len(s)
                if not n:
                    rows.append((0, 0, 0, -1, *level_of_none, *level_of_none))
                    continue
                band = int(np.searchsorted(edges, n, side="right")) - 1
                up = level_of(s, band + 1) if 100 * n >= percent * first[band + 1] else level_of_none
                rows.append((n, *fingerprint_of(s), band, *level_of(s, band), *up))
            out = pd.DataFrame(rows, columns=["n", "fp1", "fp2", "band", *(f"{l}_{c}" for l in ("own", "up") for c in ("keys", "zeros", "fold", "wide"))])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
            yield out.astype({"doc_id": "Int64"})

    level = "{0}_keys array<long>, {0}_zeros boolean, {0}_fold array<long>, {0}_wide array<long>"
    schema = f"doc_id long, n long, fp1 long, fp2 long, band int, {level.format('own')}, {level.format('up')}"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, schema)


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) of all ids in ``links`` (a, b): the smallest id reachable; ends when nothing changes."""
    both = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-links")
    label = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("c")).select(F.col("a").alias("id"), "c"), f"{name}-0")
    for i in itertools.count(1):
        # the smallest label among the neighbours ...
        near = both.join(label.select(F.col("id").alias("b"), "c"), "b").groupBy("a").agg(F.min("c").alias("m"))
        step = label.join(near.withColumnRenamed("a", "id"), "id").select("id", F.least("c", "m").alias("c"), F.col("c").alias("was"))
        # ... and then the label's own label
        jump = label.select(F.col("id").alias("c"), F.col("c").alias("cc"))
        new = written(step.join(jump, "c", "left").select("id", F.least("c", F.coalesce("cc", "c")).alias("c"), "was"), f"{name}-{i}")
        free(label)
        label = new.select("id", "c")
        if new.where(F.col("c") < F.col("was")).isEmpty():
            free(both)
            return label.select("id", F.col("c").alias("component"))


def distance(other: str):
    """Hamming distance of the folded sketches f0, f1, ... and those with names ending in ``other``."""
    return sum((F.bit_count(F.col(f"f{i}").bitwiseXOR(F.col(f"f{i}{other}"))) for i in range(1, FOLDED)), F.bit_count(F.col("f0").bitwiseXOR(F.col(f"f0{other}"))))


def allowed(percent: int, other: str, apart=None):
    """May two rows with n and the same name ending in ``other`` be linked, if so many elements are apart at least?"""
    apart = distance(other) if apart is None else apart
    n = F.col(f"n{other}")
    return (100 * F.least("n", n) >= percent * F.greatest("n", n)) & (apart * (100 + percent) <= (100 - percent) * (F.col("n") + n))


def narrowed(pairs: DataFrame, shown: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, step_a, b, step_b, ...) whose wide sketches, if they have some, still allow a link.

    Long sets leave no information in FOLDED words; only pairs of such sets are looked up.
    """
    w = shown.select("id", "n", F.lit(0).alias("step"), F.col("own_wide").alias("w")).union(shown.select("id", "n", F.lit(1), "up_wide")).where(F.col("w").isNotNull())
    left = w.withColumnsRenamed({"id": "a", "step": "step_a", "n": "n_a", "w": "w_a"})
    right = w.withColumnsRenamed({"id": "b", "step": "step_b", "w": "w_b"})
    apart = F.aggregate(F.zip_with("w_a", "w_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    both = pairs.join(left, ["a", "step_a"], "left").join(right, ["b", "step_b"], "left")
    return both.where(F.col("w_a").isNull() | F.col("w_b").isNull() | allowed(percent, "_a", apart)).select(*pairs.columns)


ID_SLOTS = 1 << 20


def among(ids: DataFrame):
    """A condition that a column of ids holds for all of ``ids`` (id), and for few others while they are few.

    It is a bitmap of fixed size; at most ID_SLOTS numbers come to the driver. What it lets through
    wrongly has to be sorted out by a join.
    """
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(ID_SLOTS)).cast("int")
    hit = np.zeros(ID_SLOTS, dtype=bool)
    hit[ids.select(slot(F.col("id")).alias("slot")).distinct().toPandas()["slot"].to_numpy(dtype="int64")] = True
    packed = np.packbits(hit)

    @F.pandas_udf("boolean")
    def test(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bits = np.unpackbits(packed).astype(bool)
        for slots in batches:
            yield pd.Series(bits[slots.to_numpy()])

    return lambda c: test(slot(c))


def texts_of(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, text) of the documents in ``pairs``; the bitmap keeps most others out of the shuffle."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    d = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where(F.col("doc_id").isNotNull())
    return d.where(among(ids)(F.col("id"))).join(ids, "id", "left_semi").dropDuplicates(["id", "text"])


def verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose whole texts reach the similarity."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        last, kept = None, None
        for batch in batches:
            keep = []
            for a, ta, tb in zip(batch["a"], batch["ta"], batch["tb"], strict=True):
                if a != last:
                    last, kept = a, shingles(words(ta), size)
                other = shingles(words(tb), size)
                both = len(np.intersect1d(kept, other, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(kept) + len(other) - both))
            yield batch.loc[keep, ["a", "b"]]

    t = written(texts_of(pairs, docs), "texts")
    with_b = pairs.join(t.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    both = with_b.join(t.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    found = written(both.select("a", "b", "ta", "tb").mapInPandas(run, "a long, b long").distinct(), "links")
    free(t)
    return found


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every row of ``docs`` (doc_id, text).

    Two texts link when 100 * intersection >= percent * union of their sets of ``size``-word
    shingles. ``n_links`` counts the verified links of the document's class: those that were needed
    to tell which texts hang together, not all pairs within a group.
    """
    sk = written(set_fingerprints(docs, size), "rows")
    have = sk.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    distinct = written(have.groupBy("doc_id", "fp1", "fp2", "n").agg(F.count("*").alias("times")), "distinct")
    # the row that stands for each class of equal sets of several documents
    reps = written(distinct.groupBy("fp1", "fp2", "n").agg(F.min("doc_id").alias("id"), F.count("*").alias("docs")).where("docs > 1").drop("docs"), "copies")
    # a join of two tables and nothing else: Spark splits it where one class has very many rows
    members = written(distinct.join(reps, ["fp1", "fp2", "n"], "left").select("doc_id", "fp1", "fp2", "n", F.coalesce("id", "doc_id").alias("id"), "times"), "classes")
    free(distinct, reps)
    stand = members.where(F.col("doc_id") == F.col("id")).select("id", "fp1", "fp2", "n")
    # rows that cannot be copies get their sketches without a shuffle; the others are looked up
    doubtful = among(members.where((F.col("doc_id") != F.col("id")) | (F.col("times") > 1)).select(F.col("doc_id").alias("id")))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull())
    sure = sketches(d.where(~doubtful(F.col("doc_id"))), size, percent)
    looked_up = sketches(d.where(doubtful(F.col("doc_id"))), size, percent).join(stand.withColumnRenamed("id", "doc_id"), ["doc_id", "fp1", "fp2", "n"], "left_semi").dropDuplicates(["doc_id", "fp1", "fp2", "n"])
    shown = sure.unionByName(looked_up).where(F.col("n") > 0).withColumnRenamed("doc_id", "id").drop("fp1", "fp2")
    shown = written(shown, "stand")

    def keys(name: str, step: int) -> DataFrame:
        at = shown.where(F.col(f"{name}_keys").isNotNull()).select("id", (F.col("band") + step).alias("level"), F.posexplode(f"{name}_keys").alias("pos", "word"), F.col(f"{name}_zeros").alias("zeros"))
        return at.where((F.col("word") != 0) | F.col("zeros")).select(F.xxhash64("level", "pos", "word").alias("key"), "id", F.lit(step).alias("step"))

    # keys of two texts or more, counted where they arise; then only their rows go on
    rows = keys("own", 0).union(keys("up", 1))
    again = written(rows.groupBy("key").agg(F.count("*").alias("texts")).where("texts > 1").select("key"), "keys")
    shared = written(rows.join(again.hint("merge"), "key"), "shared")
    stars = shared.groupBy("key").agg(F.min(F.struct("id", "step")).alias("s")).select("key", F.col("s.id").alias("star"), F.col("s.step").alias("star_step"))
    stars = written(stars, "stars")
    hits = written(shared.join(stars.hint("merge"), "key").where(F.col("id") != F.col("star")), "hits")
    free(again, shared, stars)
    folds = shown.select("id", "n", F.lit(0).alias("step"), F.col("own_fold").alias("f")).union(shown.where(F.col("up_fold").isNotNull()).select("id", "n", F.lit(1), "up_fold"))
    folds = folds.select("id", "n", "step", *(F.col("f")[i].alias(f"f{i}") for i in range(FOLDED)))
    # a pair that meets at two levels is looked at in one
    first = hits.groupBy(F.col("star").alias("a"), F.col("id").alias("b")).agg(F.min(F.struct("star_step", "step")).alias("s")).select("a", "b", F.col("s.star_step").alias("step_a"), F.col("s.step").alias("step_b"))
    first = written(first, "pairs")
    left = folds.withColumnsRenamed({"id": "a", "step": "step_a"})
    other_folds = [F.col(c).alias(f"{c}_b") for c in ("n", *(f"f{i}" for i in range(FOLDED)))]
    right = folds.select(F.col("id").alias("b"), F.col("step").alias("step_b"), *other_folds)
    near = first.join(left, ["a", "step_a"]).join(right, ["b", "step_b"]).where(allowed(percent, "_b"))
    near = written(near.select("a", "step_a", "b", "step_b", (distance("_b") / (F.col("n") + F.col("n_b"))).alias("apart")), "near")
    # each text is first verified with the nearest of its stars
    best = written(narrowed(near, shown, percent).groupBy("b").agg(F.min(F.struct("apart", "a")).alias("s")).select(F.col("s.a").alias("a"), "b"), "best")
    links = verified(best, docs, size, percent)
    free(first, near)
    # texts with one doc_id but different sets belong together as one document
    same = members.where(F.col("doc_id") != F.col("id")).select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
    label = components(links, "star")
    # chunks that still hold more than one component
    star = label.select(F.col("id").alias("star"), F.col("component").alias("star_c"))
    known = hits.join(label, "id", "left").join(star, "star", "left").select("key", "id", "step", "star", "star_step", F.coalesce("component", "id").alias("c"), F.coalesce("star_c", "star").alias("star_c"))
    known = written(known, "known")
    open_keys = known.where(F.col("c") != F.col("star_c")).groupBy("key").agg(F.min("star").alias("star"), F.min("star_step").alias("star_step"), F.min("star_c").alias("star_c"))
    open_keys = written(open_keys, "open-keys")
    rest = known.join(open_keys.select("key"), "key", "left_semi").select("key", "id", "step", "c").union(open_keys.select("key", "star", "star_step", "star_c"))
    rest = written(rest.join(folds, ["id", "step"]), "open")
    free(hits, label, known, open_keys)
    other = rest.select("key", *(F.col(x).alias(f"{x}_b") for x in rest.columns if x != "key"))
    may = (rest["key"] == other["key"]) & (F.col("c") < F.col("c_b")) & allowed(percent, "_b")
    # one row for each pair: of the levels at which it meets, the first
    a_first = F.col("id") < F.col("id_b")
    cross = rest.join(other, may).select(F.least("id", "id_b").alias("a"), F.greatest("id", "id_b").alias("b"), F.when(a_first, F.struct("step", F.col("step_b").alias("other"))).otherwise(F.struct(F.col("step_b").alias("step"), F.col("step").alias("other"))).alias("s"))
    cross = written(cross.groupBy("a", "b").agg(F.min("s").alias("s")).select("a", "b", F.col("s.step").alias("step_a"), F.col("s.other").alias("step_b")), "cross")
    tried = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    narrow = written(narrowed(cross, shown, percent).select("a", "b").join(tried, ["a", "b"], "left_anti"), "narrow")
    free(rest, cross, best)
    links = links.union(verified(narrow, docs, size, percent))
    free(narrow, shown)
    label = components(links.union(same), "final")
    degree = links.select(F.col("a").alias("id")).union(links.select("b")).groupBy("id").agg(F.count("*").alias("n_links"))
    figures = written(label.join(degree, "id", "left"), "figures")
    free(label)
    found = members.join(figures, "id", "left").select("doc_id", "fp1", "fp2", "n", F.coalesce("component", "id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = sk.select("doc_id", "n", "fp1", "fp2").join(found, ["doc_id", "fp1", "fp2", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), size=3, percent=90).select("doc_id", "n_shingles", "component_id")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON b.shingle = a.shingle AND b.doc_id > a.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 90 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id WHERE r.c < e.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.c AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) c ON c.doc_id = d.doc_id
"""
