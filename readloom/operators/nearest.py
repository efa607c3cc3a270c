"""The nearest haplotype of each read, exactly, without comparing all pairs.

Columns are cut into more bands than differences are allowed. A read and a haplotype that differ in at most ``most`` columns agree in all columns of one band at least, if the read knows
as many bands wholly as there are differences and one more; so they meet by equal bands (an equi-join
on window, band and its letters), each pair once, at its first equal band. Any bands of that number do, so a
read takes those that the fewest haplotypes share. A read that knows fewer bands meets all haplotypes of its window. Pairs that met are verified by bit planes; the least
distance is kept by partial aggregation. Equal reads of a window are compared once.

Reads without a haplotype within ``most`` give no row; of equally near haplotypes the first in the
order of letters counts. As in windows, a read takes part if it knows a share of the columns
(``least_known``, the windows' least overlap). Null sequences take no part; strings of different
lengths never meet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dna import WORD, packed_distance, unpacked
from .arrays import CODE

KEYS = ("chrom", "beg")
#: A band that so many haplotypes of a window share is hot.
HOT = 8


def banded(rows: DataFrame, numbers: tuple[int, ...], least_known: float = 0.0, most: int = -1) -> DataFrame:
    """``rows`` (chrom, beg, seq, ...) with ``columns``, ``bands`` and ``bits``; those that know less than a share of their columns are left out.

    bands: a hash of each of ``number`` parts of the string, null where it has an N; ``number`` is the first of
    ``numbers`` with which more than ``most`` bands are known, 0 if there is none. bits: as ``dna.packed``. Strings of one length are worked on together, as arrays.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seqs = b.column("seq").cast(pa.binary()).to_pylist()
            size = np.array([len(s) for s in seqs], dtype=np.int64)
            for n in np.unique(size).tolist():
                of = np.flatnonzero(size == n)
                code = CODE[np.frombuffer(b"".join([seqs[i] for i in of]), dtype=np.uint8)].reshape(len(of), n)
                unknown = code == 5
                kept = n - unknown.sum(1) >= least_known * n
                of, code, unknown = of[kept], code[kept], unknown[kept]
                if not len(of):
                    continue
                weights = np.random.default_rng(n).integers(1, 1 << 63, n, dtype=np.int64) | 1
                # sums of products, modulo 2^64; equal hashes of different letters only make a pair meet in vain
                upto = np.zeros((len(of), n + 1), dtype=np.int64)
                np.cumsum((code.astype(np.int64) + 1) * weights, axis=1, out=upto[:, 1:])
                missing = np.zeros((len(of), n + 1), dtype=np.int32)
                np.cumsum(unknown, axis=1, out=missing[:, 1:])
                planes = []
                for k in range(3):
                    bit = (code >> k & 1).astype(np.int64)
                    planes.append(np.stack([bit[:, i : i + WORD] @ (1 << np.arange(min(WORD, n - i) - 1, -1, -1, dtype=np.int64)) for i in range(0, n, WORD)] or [np.zeros(len(of), dtype=np.int64)], axis=1))
                words = planes[0].shape[1] if n else 0
                left = np.ones(len(of), dtype=bool)
                for number in (*numbers, 0):
                    parts = number or numbers[0]
                    edge = np.arange(parts + 1) * n // parts
                    null = missing[:, edge[1:]] > missing[:, edge[:-1]]
                    row = np.flatnonzero(left & ((~null).sum(1) > most) if number else left)
                    left[row] = False
                    if not len(row):
                        continue
                    bands = pa.array((upto[row][:, edge[1:]] - upto[row][:, edge[:-1]]).ravel(), mask=null[row].ravel())
                    flat = pa.StructArray.from_arrays([pa.array(p[row, :words].ravel()) for p in planes], names=["p0", "p1", "p2"])
                    lists = [pa.ListArray.from_arrays(np.arange(len(row) + 1, dtype=np.int32) * each, values) for each, values in ((parts, bands), (words, flat))]
                    own = [c.take(pa.array(of[row])) for c in b.columns]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(np.full(len(row), number, dtype=np.int32)), pa.array(np.full(len(row), n, dtype=np.int32)), *lists], names=[*b.schema.names, "number", "columns", "bands", "bits"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{types}, number int, columns int, bands array<bigint>, bits array<struct<p0:bigint,p1:bigint,p2:bigint>>")


def rarest(r: DataFrame, h: DataFrame, enough: int) -> DataFrame:
    """``r`` with ``enough`` of each read's bands, those that the fewest haplotypes have; its others are null.

    Of ``enough`` bands one agrees whichever they are, so a text that very many sequences begin with makes
    no pairs. A read learns of its hot bands alone; only they are joined.
    """
    r = r.withColumn("rid", F.xxhash64("r_bits", "columns"))
    hot = h.select(*KEYS, "number", F.posexplode("h_bands").alias("at", "band")).where(F.col("band").isNotNull()).groupBy(*KEYS, "number", "at", "band").agg(F.count("*").alias("n")).where(F.col("n") >= HOT)
    hits = r.select(*KEYS, "rid", "number", F.posexplode("r_bands").alias("at", "band")).where(F.col("band").isNotNull()).join(hot, [*KEYS, "number", "at", "band"])
    # reads of one rid share what they learn; a read may take any of its bands, so that is no error
    cost = hits.groupBy(*KEYS, "rid", "at").agg(F.max("n").alias("n")).groupBy(*KEYS, "rid").agg(F.map_from_entries(F.collect_list(F.struct("at", "n"))).alias("cost"))
    j = r.join(cost, [*KEYS, "rid"], "left")
    of = lambda b, i: F.when(b.isNotNull(), F.struct(F.coalesce(F.try_element_at("cost", i), F.lit(0).cast("long")).alias("n"), i.alias("at")))
    order = F.sort_array(F.filter(F.transform("r_bands", of), lambda x: x.isNotNull()))
    # an exploded array of one element is worked out once; a plain column would be, again, for each band
    j = j.withColumn("picked", F.explode(F.array(F.transform(F.slice(order, 1, enough), lambda x: x["at"]))))
    return j.withColumn("r_bands", F.transform("r_bands", lambda b, i: F.when(F.array_contains("picked", i), b))).drop("picked", "cost", "rid")


def nearest_haplotypes(reads: DataFrame, haps: DataFrame, most: int, least_known: float = 0.85) -> DataFrame:
    """(chrom, beg, seq, weight, hap, distance) of each different read of a window; reads: (chrom, beg, seq), haps: (chrom, beg, hap)."""
    # a read whose unknown columns lie at its ends still knows one band more than there may be differences; with more of them
    # spread out the bands must be finer, and with one more than differences and unknown columns together they always do
    number = math.ceil((most + 3) / max(least_known, 0.5))
    numbers = (number, number * 3 // 2, number * 5 // 2)
    r = reads.where(F.col("seq").isNotNull()).groupBy(*KEYS, "seq").agg(F.count("*").alias("weight"))
    # a read's bits say its letters; they are what is sent once for each band
    r = banded(r, numbers, least_known, most).select(*KEYS, "weight", "number", "columns", F.col("bands").alias("r_bands"), F.col("bits").alias("r_bits"))
    h = haps.where(F.col("hap").isNotNull()).select(*KEYS, F.col("hap").alias("seq")).distinct()
    h = reduce(DataFrame.unionByName, [banded(h, (n,)) for n in numbers])
    h = h.select(*KEYS, "number", F.col("seq").alias("hap"), F.col("columns").alias("h_columns"), F.col("bands").alias("h_bands"), F.col("bits").alias("h_bits"))
    by_band = rarest(r.where("number > 0"), h, most + 1).select("*", F.posexplode("r_bands").alias("at", "band")).where(F.col("band").isNotNull())
    of_haps = h.select("*", F.posexplode("h_bands").alias("at", "band")).where(F.col("band").isNotNull())
    same = F.zip_with("r_bands", "h_bands", lambda x, y: F.coalesce(x == y, F.lit(False)))
    # a pair meets at its first equal band
    met = by_band.join(of_haps, [*KEYS, "number", "at", "band"]).where(F.array_position(same, True) == F.col("at") + 1)
    met = met.unionByName(r.where("number = 0").drop("number").join(h.where(F.col("number") == number).drop("number"), [*KEYS]), allowMissingColumns=True)
    near = met.where(F.col("columns") == F.col("h_columns")).withColumn("distance", packed_distance(F.col("h_bits"), F.col("r_bits"))).where(F.col("distance") <= most)
    best = near.groupBy(*KEYS, "columns", "r_bits").agg(F.first("weight").alias("weight"), F.min(F.struct("distance", "hap")).alias("best"))
    return best.select(*KEYS, unpacked(F.col("r_bits"), F.col("columns")).alias("seq"), "weight", "best.hap", "best.distance")
