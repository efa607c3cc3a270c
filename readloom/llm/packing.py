"""Sum-of-squares online packing of token sequences (operator 10).

Documents become token ids; a document longer than a window first gives full windows, its rest is
one item. An item goes to the fill level ``h`` (or to a new window) for which the sum of the
squares of the counts of partially filled windows over all levels becomes least; the counts stand
in an array by level. Each input partition is packed on its own, in the order of its rows, so
nothing is shuffled and the state of a task is one array and the windows still open. When a
partition ends, the windows that stayed open would need padding: the fullest of them are filled up
with the ids of the emptiest, cut where needed, and the one left over is split into windows whose fill
is a power of two, which need no padding. All other windows stay as the placement made them.

A rerun of a task reads the same rows and packs them alike. Nulls: a null text is empty; every
document has at least its end id, so every row gives a piece; a null doc_id is kept. Repeated rows
are packed each on its own. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WINDOW = 1024
END_ID = 0
OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Special tokens of the tokenizer file; texts that hold one go to the tokenizers library itself.
SPECIAL = "<|endoftext|>"


class Ids:
    """Token ids of texts under a public byte-level BPE file, as the tokenizers library gives them.

    The same vocabulary as ranks is run by tiktoken, which is several times as fast. Where no two
    white-space characters meet, the look-ahead in its pattern decides nothing and is left out.
    """

    def __init__(self, name: str = "byte_bpe_50k") -> None:
        import public_tokenizers
        import tiktoken

        self.path = public_tokenizers.path(f"{name}.json")
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        pattern = public_tokenizers.PATTERN
        self.full = tiktoken.Encoding("full", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        plain = pattern.replace(r"|\s+(?!\S)|\s+", r"|\s+")
        self.plain = tiktoken.Encoding("plain", pat_str=plain, mergeable_ranks=ranks, special_tokens={})
        self.runs = re.compile(r"\s\s")
        self.exact = None

    def __call__(self, text: str) -> np.ndarray:
        if SPECIAL in text:
            if self.exact is None:
                from tokenizers import Tokenizer

                self.exact = Tokenizer.from_file(self.path)
            ids = self.exact.encode(text, add_special_tokens=False).ids
        else:
            ids = (self.full if self.runs.search(text) else self.plain).encode_ordinary(text)
        ids.append(END_ID)
        return np.array(ids, dtype="<u4")


class Packer:
    """Windows of one partition. A piece is (document, start, ids); ``done`` gets whole windows."""

    def __init__(self, window: int = WINDOW) -> None:
        self.window = window
        self.count = np.zeros(window + 1, dtype=np.int64)  # partially filled windows by fill level
        self.open: dict[int, list[list]] = {}  # level -> windows, each a list of pieces
        self.moved = 0  # ids that left the window they were placed into when the partition ended

    def add(self, piece: tuple) -> list | None:
        """Places a piece of fewer ids than a window; returns the window if that fills it."""
        size = len(piece[2])
        levels = np.flatnonzero(self.count[: self.window - size + 1])
        # change of the sum of squares when a window goes from level h to h + size; full windows do not count
        grow = 2 * self.count[size] + 1
        best, at = grow, 0
        if len(levels):
            to = levels + size
            change = 1 - 2 * self.count[levels] + np.where(to < self.window, 2 * self.count[np.minimum(to, self.window - 1)] + 1, 0)
            i = int(np.argmin(change[::-1]))  # of equal ones the fullest window
            i = len(levels) - 1 - i
            if change[i] <= grow:
                best, at = change[i], int(levels[i])
        if at:
            window = self.open[at].pop()
            self.count[at] -= 1
        else:
            window = []
        window.append(piece)
        level = at + size
        if level == self.window:
            return window
        self.open.setdefault(level, []).append(window)
        self.count[level] += 1
        return None

    def close(self) -> Iterator[list]:
        """The windows still open, fullest first; the ids of the emptiest, cut where needed, fill them up.

        A window that the fullest ones don't use up ends the row; it is split into powers of two.
        """
        windows = [w for level in sorted(self.open, reverse=True) for w in self.open[level]]
        lo, hi = 0, len(windows) - 1
        spare: list[tuple] = []
        while lo <= hi:
            window = windows[lo]
            lo += 1
            room = self.window - sum(len(p[2]) for p in window)
            while room and (spare or lo <= hi):
                if not spare:
                    spare = windows[hi]
                    hi -= 1
                doc, start, ids = spare.pop()
                window.append((doc, start, ids[:room]))
                if len(ids) > room:
                    spare.append((doc, start + room, ids[room:]))
                self.moved += len(window[-1][2])
                room -= len(window[-1][2])
            if room:
                yield from self.split(window)
            else:
                yield window
        if spare:
            yield from self.split(spare)

    def split(self, pieces: list[tuple]) -> Iterator[list]:
        """Pieces of less than a window as windows of powers of two, which need no padding."""
        rest = sum(len(p[2]) for p in pieces)
        left = list(reversed(pieces))
        for size in (1 << b for b in range(self.window.bit_length() - 1, -1, -1) if rest >> b & 1):
            window, room = [], size
            while room:
                doc, start, ids = left.pop()
                window.append((doc, start, ids[:room]))
                if len(ids) > room:
                    left.append((doc, start + room, ids[room:]))
                self.moved += len(window[-1][2])
                room -= len(window[-1][2])
            yield window


def pack(docs: DataFrame, window: int = WINDOW, tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """Pieces of all rows of ``docs`` (doc_id, text): OUT, sequence ids unique over all partitions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of, packer = Ids(tokenizer), Packer(window)
        sequence = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []

        def emit(pieces: list) -> None:
            nonlocal sequence
            offset = 0
            for (doc, total), start, ids in pieces:
                rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, sequence, offset))
                offset += len(ids)
            sequence += 1

        def flush() -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            rows.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch["doc_id"].astype("Int64"), batch["text"], strict=True):
                ids = ids_of(text or "")
                key = (None if doc is pd.NA else int(doc), len(ids))
                whole = len(ids) // window * window
                for start in range(0, whole, window):
                    emit([(key, start, ids[start : start + window])])
                if whole < len(ids) and (full := packer.add((key, whole, ids[whole:]))):
                    emit(full)
            if rows:
                yield flush()
        for pieces in packer.close():
            emit(pieces)
        yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, OUT)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
