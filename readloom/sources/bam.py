"""BAM files, read in splits.

The text source cuts the file where a compressed block begins: every usual writer opens its blocks with
the same 16 bytes, so these are the line separator, and any store Spark can read will do. Blocks with another
opening stay attached to the one before and are inflated with it.

A record may begin in one split and end in the next. A task looks for the first place from which records
follow each other without a gap, decodes from there, and hands on the bytes before it and the bytes left over at its end.
These edges, one row for each split, meet by file: what a split left over and what the next one skipped must give
whole records. As the first split begins right behind the header, this proves every guessed place; where it
fails there is an error, never a wrong row. The blocks are inflated twice, for the records and for the edges.
"""

from __future__ import annotations

import itertools
import struct
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Opening of a compressed block; letters and operations by code.
MARK = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0"
LETTERS = "=ACMGRSVTWYHKDBN"
OPERATIONS = "MIDNSHP=X"
#: Inflated bytes over which records must follow each other before a place counts as a record's first.
LOOK = 1 << 20
ROWS = 10_000
HEAD = "<iiiBBHHHiiii"
HEAD_BYTES = struct.calcsize(HEAD)
COLUMNS = "file string, start long, file_ord long, qname string, flag int, ref int, pos0 int, cigar string, seq string, head binary, tail binary, names array<string>"
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


def unpacked(content: memoryview, step: int = 1 << 16) -> Iterator[bytes]:
    """The pieces of a block-compressed file, fed in small steps: what follows a block is never copied whole."""
    z = zlib.decompressobj(31)
    at = 0
    while at < len(content):
        part = content[at : at + step]
        yield z.decompress(part)
        at += len(part) - len(z.unused_data)
        if z.eof and at < len(content):
            z = zlib.decompressobj(31)
    if len(content) and not z.eof:
        raise ValueError("a compressed block is cut off")


def inflated(values: Iterable[bytes], first: bool) -> Iterator[bytes]:
    """The inflated bytes of a split; ``first``: it begins the file, before any mark."""
    for value in values:
        if first and value[:4] == b"CRAM":
            raise ValueError("CRAM files are not supported; convert to BAM or SAM")
        yield from unpacked(memoryview(value if first else MARK + value))
        first = False


def header(data: bytearray) -> tuple[list[str], int] | None:
    """Names of the reference sequences and where the first record begins; None: more bytes are needed."""
    if len(data) >= 4 and data[:4] != b"BAM\1":
        raise ValueError("not a BAM file")
    try:
        at = 8 + struct.unpack_from("<i", data, 4)[0]
        n = struct.unpack_from("<i", data, at)[0]
        at += 4
        names = []
        for _ in range(n):
            size = struct.unpack_from("<i", data, at)[0]
            names.append(data[at + 4 : at + 3 + size].decode())
            at += 8 + size
    except struct.error:
        return None
    return (names, at) if at <= len(data) else None


def plausible(data: bytes | bytearray, at: int) -> bool:
    """Whether the 36 bytes at ``at``, and the name as far as it is there, can open a record."""
    size, ref, pos, l_name, _, _, n_cigar, _, l_seq, next_ref, next_pos, _ = struct.unpack_from(HEAD, data, at)
    if min(ref, pos, next_ref, next_pos) < -1 or l_name < 1 or l_seq < 0 or 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq > size:
        return False
    name = data[at + 36 : at + 36 + l_name]
    return (len(name) < l_name or name[-1] == 0) and all(32 < b < 127 for b in name[: l_name - 1])


def whole(data: bytes | bytearray, at: int) -> int:
    """Bytes of the record at ``at``; 0 if it isn't all there."""
    if len(data) < at + HEAD_BYTES:
        return 0
    if not plausible(data, at):
        raise ValueError("no alignment record where one must begin; the file is damaged, or larger splits are needed (spark.sql.files.maxPartitionBytes)")
    size = 4 + struct.unpack_from("<i", data, at)[0]
    return size if at + size <= len(data) else 0


def first_record(data: bytearray) -> int | None:
    """The first place from which plausible records, one of them whole, follow each other to the end."""
    for begin in range(len(data) - HEAD_BYTES + 1):
        at, n = begin, 0
        while at + HEAD_BYTES <= len(data) and plausible(data, at):
            at += 4 + struct.unpack_from("<i", data, at)[0]
            n += at <= len(data)
        if n and at + HEAD_BYTES > len(data):
            return begin
    return None


def fields(data: bytes | bytearray, at: int) -> tuple:
    """(qname, flag, ref, pos0, cigar, seq) of the record at ``at``."""
    _, ref, pos, l_name, _, _, n_cigar, flag, l_seq, *_ = struct.unpack_from(HEAD, data, at)
    p = at + HEAD_BYTES
    qname = data[p : p + l_name - 1].decode()
    p += l_name
    cigar = "".join(f"{x >> 4}{OPERATIONS[x & 15]}" for x in struct.unpack_from(f"<{n_cigar}I", data, p)) or "*"
    p += 4 * n_cigar
    seq = "".join(LETTERS[b >> 4] + LETTERS[b & 15] for b in data[p : p + (l_seq + 1) // 2])[:l_seq] or "*"
    return qname, flag, ref, pos, cigar, seq


def of_split(file: str, start: int, values: Iterable[bytes], look: int = LOOK) -> Iterator[tuple]:
    """Rows (COLUMNS) of a split: its whole records, then one row with its edges (tail None: no record begins in it).

    ``file_ord`` is the split's start times 2^16 plus the inflated offset, which stays below the next split's:
    a block has at least 26 bytes and inflates to 2^16 at most.
    """
    data, at, base, begun, need = bytearray(), 0, 0, False, look
    names, skipped = None, b""
    for chunk in itertools.chain(inflated(values, start == 0), [None]):
        data += chunk or b""
        if not begun:
            if chunk is not None and len(data) < need:
                continue
            if start == 0:
                found = header(data)
                names, at = found or (None, None)
            else:
                at = first_record(data)
            if at is None:
                need = 2 * len(data)
                continue
            begun, skipped = True, bytes(data[:at]) if start else b""
        while size := whole(data, at):
            yield (file, start, (start << 16) + base + at, *fields(data, at), None, None, None)
            at += size
        base += at
        del data[:at]
        at = 0
    if start == 0 and not begun:
        raise ValueError("not a BAM file, or its header is longer than a split (spark.sql.files.maxPartitionBytes)")
    yield (file, start, (start << 16) + base, None, None, None, None, None, None, skipped if begun else bytes(data), bytes(data) if begun else None, names)


def frames(rows: Iterable[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    for part in itertools.batched(rows, ROWS):
        yield pd.DataFrame(list(part), columns=columns).astype({"flag": "Int32", "ref": "Int32", "pos0": "Int32"})


def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = (r for b in batches for r in zip(b["file"], b["start"], b["value"], strict=True))
    for (file, start), split in itertools.groupby(rows, key=lambda r: r[:2]):
        yield from frames(of_split(file, int(start), (r[2] for r in split)), NAMES)


def across(edges: pd.DataFrame) -> pd.DataFrame:
    """The records of one file that lie across splits."""
    edges = edges.sort_values("start")
    out, file, left, place = [], edges["file"].iloc[0], b"", 0

    def close() -> None:
        at = 0
        while size := whole(left, at):
            out.append((file, place + at, *fields(left, at)))
            at += size
        if at < len(left):
            raise ValueError("records do not meet at the border of two splits; the file is damaged, or larger splits are needed (spark.sql.files.maxPartitionBytes)")

    for head, tail, ord_ in zip(edges["head"], edges["tail"], edges["file_ord"], strict=True):
        left += head
        if tail is not None:
            close()
            left, place = tail, int(ord_)
    close()
    return pd.DataFrame(out, columns=["file", "file_ord", "qname", "flag", "ref", "pos0", "cigar", "seq"])


def read_bam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of BAM files: (file_ord, qname, flag, chrom, pos0, cigar, seq)."""
    lines = spark.read.options(lineSep=MARK.decode("latin-1"), encoding="ISO-8859-1").text(path)
    blocks = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))
    parts = blocks.mapInPandas(decode, COLUMNS)
    edges = parts.where(F.col("head").isNotNull())
    crossing = edges.select("file", "start", "file_ord", "head", "tail").groupBy("file").applyInPandas(across, "file string, file_ord long, qname string, flag int, ref int, pos0 int, cigar string, seq string")
    names = edges.where(F.col("names").isNotNull()).select(F.col("file").alias("of_file"), F.posexplode("names").alias("of_ref", "name"))
    records = parts.where(F.col("head").isNull()).select(*crossing.columns).union(crossing)
    named = records.join(names, (F.col("file") == F.col("of_file")) & (F.col("ref") == F.col("of_ref")), "left")
    return named.select("file_ord", "qname", "flag", F.coalesce("name", F.lit("*")).alias("chrom"), "pos0", "cigar", "seq")
