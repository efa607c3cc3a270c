"""Regions of an index: the same reads as a filter of all, and how much of the table is read for them."""

import random

from readloom.plans import cli
from readloom.sources import indexed, readers

SCHEMA = "qname string, pos0 int, gapped string, is_rev boolean, file_ord long, chrom string"


def reads_of(spark, n=6000):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        # a third of all reads begin at one column; some are long
        at = 20_000 if i % 3 == 0 else rng.randrange(100_000)
        rows.append((f"r{i}", at, "".join(rng.choices("ACGT", k=rng.choice([40, 60, 900 if i % 50 == 0 else 50]))), i % 2 == 0, i, rng.choice(["c1", "7", "c3"])))
    rows += [("lost", None, "ACGT", False, n, "c1"), ("nowhere", 5, "ACGT", False, n + 1, None)]
    return spark.createDataFrame(rows, SCHEMA)


def scanned(df):
    """(rows, files) that the scan gave, from the plan's own figures."""
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return tuple(leaf.metrics().apply(k).value() for k in ("numOutputRows", "numFiles"))


def test_region_reads_are_those_of_a_filter_and_the_rest_is_not_read(spark, tmp_path):
    reads = reads_of(spark)
    path = str(tmp_path / "index")
    assert not indexed.is_index(spark, path)
    indexed.write_index(reads, path, files=6, group=1 << 14)
    schema = indexed.indexed(reads, path)
    assert indexed.read_index(spark, path, schema).count() == 6000
    for chrom, begin, end in (("c1", 0, 10), ("7", 19_990, 20_010), ("c3", 50_000, 50_400), ("c1", 99_900, 200_000), ("c3", 21_000, 21_001), ("none", 0, 9)):
        want = readers.in_region(reads, chrom, begin, end)
        got = indexed.read_region(spark, path, schema, chrom, begin, end)
        assert sorted(map(str, got.select(*reads.columns).collect())) == sorted(map(str, want.collect()))
    some = indexed.read_region(spark, path, schema, "c3", 70_000, 70_400)
    rows, files = scanned(some)
    assert 0 < len(some.collect()) <= rows < 600 and files <= 4
    # the hot column is in the files of its place alone
    _, files_all = scanned(indexed.read_index(spark, path, schema))
    assert files_all > files


def test_an_index_that_was_cut_off_is_made_again(spark, tmp_path):
    reads = reads_of(spark, 50)
    path = tmp_path / "index"
    path.mkdir()
    (path / "junk").write_text("x")
    indexed.indexed(reads, str(path))
    assert indexed.is_index(spark, str(path)) and not (path / "junk").exists()
    empty = reads.limit(0)
    indexed.write_index(empty, str(tmp_path / "none"))
    assert indexed.read_region(spark, str(tmp_path / "none"), indexed.indexed(empty, str(tmp_path / "none")), "c1", 0, 9).count() == 0


def test_analysis_of_a_region_with_and_without_index(spark, tmp_path):
    rng = random.Random(5)
    genome = "".join(rng.choices("ACGT", k=600))
    (tmp_path / "g.fasta").write_text(f">g one\n{genome}\n>h\n{genome[::-1]}\n")
    other = "ACGT"[("ACGT".index(genome[299]) + 1) % 4]
    lines = ["@SQ\tSN:g\tLN:600"]
    for i in range(160):
        at = 60 + 4 * (i % 60)
        seq = list(genome[at : at + 180])
        if i // 2 % 2 and 0 <= 299 - at < 180:
            seq[299 - at] = other
        lines.append("\t".join([f"q{i}", "16" if i % 2 else "0", "g", str(at + 1), "60", "180M", "*", "0", "0", "".join(seq), "*"]))
    (tmp_path / "x.sam").write_text("\n".join(lines) + "\n")
    plain = ["shotgun", "-b", str(tmp_path / "x.sam"), "-f", str(tmp_path / "g.fasta"), "-r", "g:200-400", "-w", "90", "-x", "9000", "-of", "csv"]
    out = {}
    for name, more in (("plain", []), ("index", ["--index", str(tmp_path / "index"), "--epochs", str(tmp_path / "epochs")])):
        cli.main([*plain, "-o", str(tmp_path / f"out-{name}"), *more])
        out[name] = "".join(p.read_text() for p in sorted((tmp_path / f"out-{name}" / "snvs_csv").glob("part-*")))
    assert out["plain"] == out["index"] and f"g,300,{genome[299]},{other}" in out["plain"]
    assert (tmp_path / "out-index" / "trace" / "_SUCCESS").exists() and (tmp_path / "out-index" / "clusters" / "_SUCCESS").exists()
