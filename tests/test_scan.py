"""Computations along a sequence against plain loops, over many bin borders."""

import random

import pytest
from pyspark.sql import functions as F

from readloom.operators import pileup, scan, windows


def islands(seed, bins):
    """Positions of some sequences: long runs, gaps on, before and behind borders, single columns."""
    rng = random.Random(seed)
    out = {"one": [5 * bins], "empty start": list(range(bins, 3 * bins))}
    for name in "abc":
        pos, at = [], rng.randrange(1, 50)
        while at < 9 * bins:
            run = rng.choice([1, 3, bins - 1, bins, bins + 1, 2 * bins])
            pos += range(at, at + run)
            at += run + rng.choice([1, 2, bins, rng.randrange(1, 99)])
        out[name] = pos
    return out


def frame(spark, by, entropy):
    rows = [(c, p, entropy[c, p]) for c, ps in by.items() for p in ps]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "chrom string, pos int, entropy double").repartition(3)


@pytest.mark.parametrize("width", [1, 7, 100, 130])
def test_moving_means_and_ranks_over_borders(spark, monkeypatch, width):
    monkeypatch.setattr(scan, "BIN", 100)
    by = islands(2, 100)
    rng = random.Random(3)
    e = {(c, p): rng.random() for c, ps in by.items() for p in ps}
    got = {(r.chrom, r.start): r.mean_entropy for r in pileup.moving_entropy(frame(spark, by, e), width).collect()}
    want = {(c, ps[i]): sum(e[c, p] for p in ps[i : i + width]) / width for c, ps in by.items() for i in range(len(ps) - width + 1)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    ranks = {(r.chrom, r.pos): r["rank"] for r in scan.ranked(frame(spark, by, e), "chrom", "pos", size=100).collect()}
    assert ranks == {(c, p): i + 1 for c, ps in by.items() for i, p in enumerate(ps)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_region_ends_at_the_first_gap_behind_its_start(spark, monkeypatch, seed):
    monkeypatch.setattr(scan, "BIN", 50)
    by = islands(seed, 50)
    rng = random.Random(seed)
    e = {(c, p): 0.0 if i < rng.randrange(400) else rng.random() for c, ps in by.items() for i, p in enumerate(ps)}
    want = {}
    for c, ps in by.items():
        some = [p for p in ps if e[c, p] > 0]
        if some:
            stop = some[0]
            while stop + 1 in set(ps):
                stop += 1
            want[c] = (some[0], stop)
    got = {r.chrom: (r.start, r.stop) for r in pileup.covered_region(frame(spark, by, e)).collect()}
    assert got == want
    none = spark.createDataFrame([], "chrom string, pos int, entropy double")
    assert pileup.covered_region(none).count() == 0 and pileup.moving_entropy(none, 5).count() == 0


def test_cap_of_a_hot_start_is_that_of_file_order(spark):
    rows = spark.range(9000).select(F.lit("c").alias("chrom"), F.lit(0).alias("win_b"), (F.col("id") % 3 % 2).alias("pos0"), F.pmod(F.hash("id"), F.lit(1 << 30)).alias("file_ord"), "id")
    plain = {}
    for r in rows.collect():
        plain.setdefault(r.pos0, []).append(r.file_ord)
    got = {}
    for r in windows.cap_starts(rows, 2000).collect():
        got.setdefault(r.pos0, []).append(r.file_ord)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v)[:1999] for k, v in plain.items()}
