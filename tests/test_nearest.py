"""Bit planes and the nearest-haplotype join against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from readloom.functions import dna
from readloom.operators import nearest


def test_packed_distances_agree_with_plain_counts(spark):
    rng = random.Random(1)
    pairs = [tuple("".join(rng.choices("ACGT-N", k=n)) for _ in range(2)) for n in (0, 1, 59, 60, 61, 120, 201) for _ in range(8)]
    df = spark.createDataFrame(pairs, "a string, b string")
    a, b = F.col("a"), F.col("b")
    assert all(r.a == r.back for r in df.select("a", dna.unpacked(dna.packed(a), F.length("a")).alias("back")).collect())
    for r in df.select("a", "b", dna.hamming_reads(a, b).alias("f1"), dna.haplotype_distance(a, b).alias("f2"), dna.haplotype_matches(a, b).alias("same"), dna.known_distance(a, b).alias("f3")).collect():
        both = list(zip(r.a, r.b, strict=True))
        assert r.f1 == sum(x != y for x, y in both)
        assert r.f2 == sum(x != y and y != "N" for x, y in both)
        assert r.same == sum(x == y and y != "N" for x, y in both)
        assert r.f3 == sum(x != y and "N" not in (x, y) for x, y in both)


@pytest.mark.parametrize(("most", "least"), [(0, 0.0), (2, 0.85), (6, 0.0), (6, 0.6)])
def test_nearest_haplotypes_agree_with_all_pairs(spark, most, least):
    """Reads with many and few unknown columns, copies, ties, a hot window, and windows without haplotypes."""
    rng = random.Random(most)
    base = "".join(rng.choices("ACGT", k=60))

    def near(s, n, unknown=0):
        s = list(s)
        for i in rng.sample(range(60), n):
            s[i] = rng.choice("ACGT-")
        for i in rng.sample(range(60), unknown):
            s[i] = "N"
        return "".join(s)

    haps = [("c", b, near(base, 5)) for b in (1, 1, 1, 1, 2, 3)] + [("c", 1, base), ("c", 1, base), ("d", 1, base[:30]), ("c", 1, None)]
    reads = [("c", 1, near(base, rng.randrange(9), rng.choice([0, 1, 3, 20, 60]))) for _ in range(120)] + [("c", b, near(base, 3)) for b in (2, 3, 4)]
    reads += [reads[0]] * 50 + [("d", 1, base[:30]), ("d", 1, base), ("c", 1, None), ("c", 1, "")]
    got = nearest.nearest_haplotypes(spark.createDataFrame([(*r, "x", 1) for r in reads], "chrom string, beg int, seq string, band string, at int"), spark.createDataFrame(haps, "chrom string, beg int, hap string"), most, least)
    want = {}
    for c, b, s in reads:
        found = [(sum(x != y and y != "N" for x, y in zip(h, s, strict=True)), h) for hc, hb, h in haps if (hc, hb) == (c, b) and h and s and len(h) == len(s)]
        if found and min(found)[0] <= most and len(s) - s.count("N") >= least * len(s):
            want[c, b, s] = (reads.count((c, b, s)), min(found)[1], min(found)[0])
    rows = got.collect()
    assert {(r.chrom, r.beg, r.seq): (r.weight, r.hap, r.distance) for r in rows} == want and len(rows) == len(want)


def test_bits_and_bands_from_arrays(spark):
    rng = random.Random(4)
    seqs = ["".join(rng.choices("ACGT-N", weights=[5, 5, 5, 5, 1, 1], k=n)) for n in (0, 1, 59, 60, 61, 120, 201, 201) for _ in range(6)]
    df = nearest.banded(spark.createDataFrame([("c", 1, s) for s in seqs], "chrom string, beg int, seq string"), (7,))
    # bits came from digits of base 2, letter by letter, in each row
    assert "conv(" not in df._jdf.queryExecution().toString()
    rows = df.select("seq", "columns", "bits", "bands", dna.packed(F.col("seq")).alias("want")).collect()
    parts = lambda s: [s[i * len(s) // 7 : (i + 1) * len(s) // 7] for i in range(7)]
    assert len(rows) == len(seqs) and all(r.bits == r.want and r.columns == len(r.seq) for r in rows)
    assert all((h is None) == ("N" in p) for r in rows for h, p in zip(r.bands, parts(r.seq), strict=True))
    long = [r for r in rows if len(r.seq) == 201]
    for a in long:
        for b in long:
            assert all((x == y) == (p == q) for x, y, p, q in zip(a.bands, b.bands, parts(a.seq), parts(b.seq), strict=True) if x is not None and y is not None)


def test_a_beginning_that_all_sequences_share_makes_no_pairs(spark):
    """Exact all the same; before, every read met every haplotype by the bands of the common beginning."""
    rng = random.Random(9)
    seqs = ["A" * 60 + "".join(rng.choices("ACGT", k=141)) for _ in range(300)]
    df = spark.createDataFrame([("c", 1, s) for s in seqs], "chrom string, beg int, seq string")
    r = nearest.banded(df, (16,)).select("chrom", "beg", F.lit(1).alias("weight"), "number", "columns", F.col("bands").alias("r_bands"), F.col("bits").alias("r_bits"))
    h = nearest.banded(df, (16,)).select("chrom", "beg", "number", F.col("bands").alias("h_bands"))
    got = nearest.rarest(r, h, 11).collect()
    # the common beginning holds bands 0 to 3
    assert len(got) == 300 and all(x.r_bands[:4] == [None] * 4 and sum(b is not None for b in x.r_bands) == 11 for x in got)
    haps = [("c", 1, s[:200] + "ACGT"["ACGT".index(s[200]) - 1]) for s in seqs[::3]]
    found = nearest.nearest_haplotypes(df, spark.createDataFrame(haps, "chrom string, beg int, hap string"), 10).collect()
    assert {(x.seq, x.hap, x.distance) for x in found} == {(s, h[2], 1) for s, h in zip(seqs[::3], haps, strict=True)}


def test_unknown_columns_spread_out_take_finer_bands(spark):
    """Such reads met all haplotypes of their window before."""
    rng = random.Random(3)
    s = ["".join("N" if i % 20 == 3 + k % 9 or i % 40 == k % 9 else rng.choice("ACGT") for i in range(201)) for k in range(40)]
    got = nearest.banded(spark.createDataFrame([("c", 1, x) for x in s], "chrom string, beg int, seq string"), (16, 24, 40), 0.85, 10).collect()
    assert len(got) == 40 and all(x.number in (24, 40) and len(x.bands) == x.number and sum(b is not None for b in x.bands) > 10 for x in got)
