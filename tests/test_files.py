"""Files between analyses: what is written reads back, and the formats' fixed rows are understood."""

import random

from pyspark.sql import functions as F

from readloom.functions.stats import strand_p_value
from readloom.operators import sampler, snv, strand
from readloom.operators.sampler import Params, gibbs
from readloom.sources import bam, files, readers, sinks

import numpy as np
import pytest


def test_support_coverage_and_corrected_reads_read_back(spark, tmp_path):
    haps = spark.createDataFrame([("g-1", 1, 6, "ACGTAC", 0.5, 2.0), ("g-1", 1, 6, "AC-TAC", 1.0, 7.5), ("h", 3, 8, "AAAAAA", 1.0, 4.0)], "chrom string, beg int, end int, hap string, posterior double, ave_reads double")
    files.write_support(haps, str(tmp_path / "support"))
    got = files.read_support(spark, str(tmp_path / "support"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in haps.collect()}
    windows = spark.createDataFrame([("g-1", 1, 6, 9), ("h", 3, 8, 4)], "chrom string, beg int, end int, cov long")
    files.write_coverage(windows, str(tmp_path / "coverage.txt"))
    assert {tuple(r) for r in files.read_coverage(spark, str(tmp_path / "coverage.txt")).collect()} == {tuple(r) for r in windows.collect()}
    cor = spark.createDataFrame([("g-1", 1, "r|1", "ACGTAC", 0.75), ("h", 3, "r2", "AAAAAA", 1.0)], "chrom string, beg int, qname string, hap string, posterior double")
    files.write_window_corrected(cor, windows, str(tmp_path / "cor"))
    assert {tuple(r) for r in files.read_window_corrected(spark, str(tmp_path / "cor")).collect()} == {tuple(r) for r in cor.collect()}


def test_support_of_plain_and_gzipped_files(spark, tmp_path):
    import gzip

    (tmp_path / "w-a.b-10-15.reads-support.fas").write_text(">hap_0|posterior=0.98 ave_reads=12.5\nacgtac\n>hap_1|posterior=0.4 ave_reads=1\nACGT--\n")
    (tmp_path / "w-a.b-20-25.reads-support.fas.gz").write_bytes(gzip.compress(b">hap_0|posterior=1 ave_reads=3\nAAAAAA\n"))
    got = {tuple(r) for r in files.read_support(spark, str(tmp_path)).collect()}
    assert got == {("a.b", 10, 15, "ACGTAC", 0.98, 12.5), ("a.b", 10, 15, "ACGT--", 0.4, 1.0), ("a.b", 20, 25, "AAAAAA", 1.0, 3.0)}


def test_variant_table_reads_back(spark, tmp_path):
    rows = [("g", 5, "A", 5, "C", "A", 0.25, None, 0.5, 1.0, None, 0.75, "called", "none", "called"), ("g", 8, "--", 7, "TAC", "T", None, 0.5, 0.5, None, 1.0, 1.0, "absent", "called", "called")]
    kinds = ", ".join(["chrom string", "key_pos int", "key_var string", "pos int", "ref string", "var string", *(f"{c}{k} double" for c in ("frq", "pst") for k in (1, 2, 3)), *(f"state{k} string" for k in (1, 2, 3))])
    files.write_snvs(spark.createDataFrame(rows, kinds), str(tmp_path / "SNV"))
    got = files.read_snvs(spark, str(tmp_path / "SNV"))
    assert {tuple(r) for r in got.collect()} == set(rows)


def test_parts_are_written_in_parallel_in_order_with_one_header(spark, tmp_path):
    kinds = ", ".join(["chrom string", "key_pos int", "key_var string", "pos int", "ref string", "var string", *(f"{c}{k} double" for c in ("frq", "pst") for k in (1, 2, 3)), *(f"state{k} string" for k in (1, 2, 3)), "fvar int, rvar int, ftot int, rtot int, pval double, qval double"])
    rows = [(c, p, "A", p, "C", "A", 0.25, 0.25, 0.25, 1.0, 1.0, 1.0, "called", "called", "called", 1, 2, 3, 4, 0.5, 1.0) for p in (9, 10, 2, 100, 33, 7, 1000) for c in ("b", "a", "c")]
    calls = spark.createDataFrame(rows, kinds).repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_csv(calls, str(tmp_path / "csv"))
        sinks.write_vcf(calls, {"a": 2000}, str(tmp_path / "vcf"))
        files.write_snvs(calls.drop("fvar"), str(tmp_path / "SNV"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = sorted((r[0], r[1]) for r in rows)
    parts = sorted((tmp_path / "csv").glob("part-*"))
    assert len(parts) > 1
    lines = b"".join(p.read_bytes() for p in parts).decode().split("\r\n")
    assert lines[0].startswith("Chromosome,Pos,Ref,Var,Frq1") and lines[-1] == ""
    assert [(x.split(",")[0], int(x.split(",")[1])) for x in lines[1:-1]] == want
    vcf = "".join(p.read_text() for p in sorted((tmp_path / "vcf").glob("part-*"))).splitlines()
    n = sum(x.startswith("#") for x in vcf)
    assert vcf[0] == "##fileformat=VCFv4.2" and vcf[n - 1].startswith("#CHROM") and all(x.startswith("#") for x in vcf[:n])
    assert [(x.split("\t")[0], int(x.split("\t")[1])) for x in vcf[n:]] == want
    assert sorted((r.chrom, r.pos) for r in files.read_snvs(spark, str(tmp_path / "SNV")).collect()) == want
    with pytest.raises(ValueError, match="no header"):
        files.read_snvs(spark, str(tmp_path / "vcf"))


def test_trace_clusters_and_frequencies_as_files(spark, tmp_path):
    trace = spark.createDataFrame([("c", 1, s, 3, 5.0, 0.99, 0.9) for s in (2, 0, 10, 1)], "chrom string, beg int, step int, classes int, untouched double, theta double, gamma double")
    files.write_trace(trace, str(tmp_path / "t"))
    lines = "".join(p.read_text() for p in sorted((tmp_path / "t").glob("part-*"))).splitlines()
    assert lines[0].startswith("#chrom") and [x.split("\t")[2] for x in lines[1:]] == ["0", "1", "2", "10"] and lines[1] == "c\t1\t0\t3\t5\t0.99\t0.9"
    files.write_clusters(spark.createDataFrame([("c", 1, 0, 7.0, 2, "AC")], "chrom string, beg int, classes int, ave_reads double, q int, hap string"), str(tmp_path / "k"))
    files.write_frequencies(spark.createDataFrame([("c", 1, "AC", [3, 0, 2])], "chrom string, beg int, hap string, reads array<int>"), str(tmp_path / "f"))
    text = ["".join(p.read_text() for p in sorted((tmp_path / n).glob("part-*"))).splitlines()[1] for n in "kf"]
    assert text == ["c\t1\t0\t7\t2\tAC", "c\t1\tAC\t3,0,2"]


def test_sizes_of_reads_count_clipped_and_inserted_bases(spark):
    a = spark.createDataFrame([(1, "r", 0, "c", 0, "2S3M1I2M1S", "ACGTACGTA"), (2, "s", 0, "c", 0, "2M5D2M3H", "ACGT"), (3, "t", 0, "c", 0, "4M", "*")], "file_ord long, qname string, flag int, chrom string, pos0 int, cigar string, seq string")
    assert [(r.qname, r.size) for r in readers.aligned_reads(a).orderBy("file_ord").collect()] == [("r", 9), ("s", 4), ("t", 1)]


def test_vcf_leaves_out_slots_without_a_window(spark):
    rows = [("g", 5, "A", 5, "C", "A", 0.25, None, None, 1.0, None, None, "called", "none", "absent", 1, 2, 3, 4, 0.5, 1.0)]
    kinds = ", ".join(["chrom string", "key_pos int", "key_var string", "pos int", "ref string", "var string", *(f"{c}{k} double" for c in ("frq", "pst") for k in (1, 2, 3)), *(f"state{k} string" for k in (1, 2, 3)), "fvar int, rvar int, ftot int, rtot int, pval double, qval double"])
    body, header = sinks.vcf_lines(spark.createDataFrame(rows, kinds), {"g": 9}, reference="g.fasta")
    lines = [r.value for r in body.collect()]
    assert "##reference=g.fasta" in header
    assert any(x.endswith("Freq1=0.2500;Freq3=0.0000;Post1=1.0000;Post3=0.0000;Fvar=1;Rvar=2;Ftot=3;Rtot=4;Pval=0.5;Qval=1.0") for x in lines)


def test_columns_unknown_to_a_class_come_from_all_reads():
    """Reads of 40 and 30; the second kind has N in two columns that the first covers."""
    a = "ACGTACGTAC" * 3
    b = a[:5] + "NN" + a[7:12] + "T" + a[13:]
    seen = {}
    steps = 0
    for _, kept, z, hap, *_ in gibbs([a, b], np.array([40, 30]), Params(), np.random.default_rng(1)):
        if kept:
            steps += 1
            for k in set(z.tolist()):
                text = "".join("ACGT-"[x] for x in hap[k])
                seen[text] = seen.get(text, 0) + 1
    assert seen[a] >= 0.99 * steps and seen[a[:12] + "T" + a[13:]] >= 0.99 * steps


def test_planted_haplotypes_get_their_posterior(spark):
    rng = random.Random(4)
    one = "".join(rng.choice("ACGT") for _ in range(60))
    two = "".join({"A": "C", "C": "A", "G": "T", "T": "G"}[b] if i in (10, 30, 50) else b for i, b in enumerate(one))
    rows = [("g", 1, one, 60, 0), ("g", 1, two, 40, 1)]
    found = sampler.sample_windows(spark.createDataFrame(rows, "chrom string, beg int, seq string, weight long, first_ord long"), Params(most=300))
    haps = {r.hap: r for r in found.where("kind = 'hap'").collect()}
    assert haps[one].posterior > 0.95 and haps[two].posterior > 0.95
    assert abs(haps[one].ave_reads - 60) < 2 and abs(haps[two].ave_reads - 40) < 2


def test_most_variants_of_a_haplotype(spark):
    ref = spark.createDataFrame([("g", "ACGTACGTAC")], "chrom string, seq string")
    haps = spark.createDataFrame([("g", 2, 7, "AGTACG", 0, 1.0, 5.0), ("g", 2, 7, "CTTACC", 1, 1.0, 5.0)], "chrom string, beg int, end int, hap string, hap_id int, posterior double, ave_reads double")
    assert [tuple(r) for r in snv.most_snvs(snv.variants(haps, ref)).collect()] == [("g", 2, 2)]


def test_reference_in_pieces_is_the_reference(spark):
    seq = "".join(random.Random(2).choice("ACGT") for _ in range(3000))
    ref = spark.createDataFrame([("g", seq)], "chrom string, seq string")
    windows = [(b, b + 200) for b in (1, 2, 824, 1024, 1025, 1900, 2048, 2049, 2900)]
    w = spark.createDataFrame([("g", b, e) for b, e in windows], "chrom string, beg int, end int")
    got = {r.beg: (r.before, r.ref_part) for r in snv.with_reference(w, snv.reference_pieces(ref)).collect()}
    assert got == {b: (seq[b - 2] if b > 1 else "", seq[b - 1 : e]) for b, e in windows}


def test_strand_counts_agree_with_brute_force(spark):
    rng = random.Random(6)
    reads = []
    for i in range(300):
        n = rng.randrange(3, 60)
        reads.append(("g", f"r{rng.randrange(150)}", rng.randrange(0, 2100), "".join(rng.choice("ACGT--") for _ in range(n)), rng.random() < 0.5, i))
    variants = {("g", p, "A", "C") for p in range(1000, 1060)} | {("g", p, "ACG"[: 1 + p % 3], "A") for p in range(900, 1100) if p % 3} | {("g", 2500, "A", "G")}
    got = {tuple(r)[:4]: tuple(r)[4:] for r in strand.strand_counts(spark.createDataFrame(sorted(variants), "chrom string, pos int, ref string, var string"), spark.createDataFrame(reads, "chrom string, qname string, pos0 int, gapped string, is_rev boolean, file_ord long")).collect()}
    for v in variants:
        _, pos, ref, var = v
        lo, hi = (pos + 1, pos + len(ref) - 1) if len(ref) > 1 else (pos, pos)
        names, shown = {}, [0, 0]
        for _, name, pos0, seq, rev, _ in reads:
            for p in range(max(lo, pos0 + 1), min(hi, pos0 + len(seq)) + 1):
                names.setdefault((name, rev), set()).add(p)
            at = lambda p: seq[p - pos0 - 1] if 0 <= p - pos0 - 1 < len(seq) else None  # noqa: B023, E731
            if len(ref) == 1:
                shown[rev] += at(pos) == var
            else:
                shown[rev] += at(pos) not in (None, "-") and all(at(p) == "-" for p in range(lo, hi + 1)) and at(hi + 1) != "-"
        whole = [sum(1 for (n, r), ps in names.items() if r == rev and len(ps) == hi - lo + 1) for rev in (False, True)]
        assert got[v] == (*shown, *whole), v


#: Counts (Fvar, Rvar, Ftot, Rtot) and p-values at sigma 0.01 of published calls.
GOLDEN = ((147, 144, 511, 489, 0.942186), (147, 145, 511, 489, 0.918406), (146, 144, 511, 489, 0.91896))


def test_published_p_values(spark):
    t = spark.createDataFrame(GOLDEN, "fvar int, rvar int, ftot int, rtot int, want double")
    for r in t.select("want", strand_p_value(F.col("fvar"), F.col("rvar"), F.col("ftot"), F.col("rtot"), 0.01).alias("p")).collect():
        assert abs(r.p - r.want) < 1e-5


def test_blocks_of_a_compressed_file():
    import gzip

    data = bytes(random.Random(1).randrange(256) for _ in range(300_000))
    packed = b"".join(gzip.compress(data[i : i + 50_000]) for i in range(0, len(data), 50_000))
    assert b"".join(bam.unpacked(memoryview(packed))) == data


def bam_bytes(refs, reads, block, opening=bam.MARK):
    """A BAM file of blocks of ``block`` inflated bytes, wherever records end."""
    import struct
    import zlib

    text = b"@HD\tVN:1.6\n"
    data = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(refs))
    for name, length in refs:
        data += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", length)
    for name, flag, ref, pos, cigar, seq in reads:
        codes = [bam.LETTERS.index(x) for x in seq] + [0] * (len(seq) % 2)
        body = name.encode() + b"\0" + b"".join(struct.pack("<I", n << 4 | bam.OPERATIONS.index(op)) for n, op in cigar)
        body += bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True)) + b"\x28" * len(seq) + b"NMC\x01"
        data += struct.pack("<iiiBBHHHiiii", 32 + len(body), ref, pos, len(name) + 1, 60, 0, len(cigar), flag, len(seq), -1, -1, 0) + body
    out = b""
    for at in [*range(0, len(data), block), None]:
        z = zlib.compressobj(1, zlib.DEFLATED, -15)
        piece = b"" if at is None else data[at : at + block]
        packed = z.compress(piece) + z.flush()
        out += opening + struct.pack("<H", len(packed) + 25) + packed + struct.pack("<II", zlib.crc32(piece), len(piece))
    return out


def test_bam_in_splits(spark, tmp_path):
    rng = random.Random(8)
    reads = [(f"read{i}", rng.choice((0, 16)), rng.choice((-1, 0, 1)), rng.randrange(-1, 5000), [(3, "S"), (n, "M")], "".join(rng.choice("ACGTN") for _ in range(n + 3))) for i, n in enumerate(rng.choice((1, 40, 151, 3000)) for _ in range(600))]
    want = [(name, flag, ("chr1", "chr2", "*")[ref], pos, "".join(f"{n}{op}" for n, op in cigar), seq) for name, flag, ref, pos, cigar, seq in reads]
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    other = bam.MARK[:9] + b"\0" + bam.MARK[10:]
    try:
        for k, (block, split, opening) in enumerate(((700, 5_000, bam.MARK), (5_000, 30_001, bam.MARK), (60_000, 1 << 27, bam.MARK), (2_000, 50_000, other))):
            (tmp_path / f"{k}.bam").write_bytes(bam_bytes([("chr1", 9000), ("chr2", 9000)], reads, block, opening))
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
            got = readers.read_alignments(spark, str(tmp_path / f"{k}.bam")).orderBy("file_ord").collect()
            assert [tuple(r)[1:] for r in got] == [(*w,) for w in want], k
            assert len({r.file_ord for r in got}) == len(got)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_damaged_bam_is_an_error(spark, tmp_path):
    import pytest

    whole = bam_bytes([("c", 100)], [(f"r{i}", 0, 0, i, [(8, "M")], "ACGTACGT") for i in range(500)], 900)
    for name, content in (("cut", whole[: len(whole) // 2]), ("text", b"no alignments"), ("cram", b"CRAM\3")):
        (tmp_path / f"{name}.bam").write_bytes(content)
        with pytest.raises(Exception, match="block|BAM|CRAM|header"):
            readers.read_bam(spark, str(tmp_path / f"{name}.bam")).collect()


def test_fasta_and_fastq_in_splits(spark, tmp_path):
    rng = random.Random(9)
    seqs = ["".join(rng.choice("acgtN") for _ in range(rng.choice((0, 1, 70, 500)))) for _ in range(300)]
    for end in ("\n", "\r\n"):
        (tmp_path / "a.fa").write_bytes("".join(f">s{i} note > {i}{end}" + "".join(s[j : j + 60] + end for j in range(0, len(s), 60)) for i, s in enumerate(seqs)).encode())
        (tmp_path / "a.fq").write_bytes("".join(f"@q{i} t{i}{end}{s}{end}+{end}{'@' * len(s)}{end}" for i, s in enumerate(seqs)).encode())
        size = spark.conf.get("spark.sql.files.maxPartitionBytes")
        try:
            for split in (997, 20_000, 1 << 27):
                spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
                got = readers.read_fasta(spark, str(tmp_path / "a.fa")).orderBy("ord").collect()
                assert [(r.id, r.seq) for r in got] == [(f"s{i}", s.upper()) for i, s in enumerate(seqs)], split
                got = readers.read_fastq(spark, str(tmp_path / "a.fq")).orderBy("ord").collect()
                assert [(r.id, r.tag, r.seq, r.qual, r.ord) for r in got] == [(f"q{i}", f"t{i}", s, "@" * len(s), i) for i, s in enumerate(seqs)], split
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
