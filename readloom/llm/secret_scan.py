r"""Secret scans with a linear-chain conditional random field (operator 4).

Base rules find three kinds of secrets in whole texts. The random field tags every word as secret
begin (B), inside (I) or outside (O) from its shape (length, digits, capitals, special characters),
the neighbouring words, and features of the whole text; decoding is exact Viterbi. It is trained
here, by maximum likelihood, on windows of words whose tags come from the base rules (at most
``TRAIN_ROWS`` texts, half that a base rule matches and half without; of the windows of these whole
texts ``TRAIN_WINDOWS``, half with a secret and half with none). Every window with a secret is
learned twice, the second time without cue and with its value cut shorter, so the field also knows a
secret by its shape and finds those that no rule names. Tagged spans that touch no base span are
added as kind ``crf``.

Nearly all words are outside whatever their neighbours are: where the score of O exceeds that of B
and I by more than all transitions together could make up for, Viterbi's path goes through O, so
only the runs of other words are decoded one by one.

Nulls: a null text is empty. Repeated rows give repeated rows; null ids are kept. Without any base
span in the sample the field adds nothing. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free, table, written
from .hashing import Words

KINDS = ("assign", "access", "hex", "crf")
TRAIN_ROWS = 1200
TRAIN_WINDOWS = 2000
SPAN_WORDS = 32
SHORTEST = 12
CUE = r"password|passwd|secret|token|api_?key"
ASSIGN = re.compile(rf"""(?:{CUE})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_FAST = (b"passw", b"secret", b"token", b"api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: The base rules as one pattern of Spark's: does any match?
ANY_BASE = rf"""(?i:{CUE})["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{{6}}|AKIA[A-Z0-9]{{16}}|[0-9a-f]{{24}}"""
CUE_BYTES = re.compile(CUE.encode())
B, I, O = 0, 1, 2  # noqa: E741
#: Sizes of the groups of features; a word has one feature of each.
GROUPS = (8, 8, 16, 8, 8, 512, 512, 16, 16, 32, 4)


def base_spans(text: str, longest: int | None = None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind. ``longest``: bytes of the longest word, if known.

    A run of hex digits or capitals that is long enough is what the plain pattern finds and keeps,
    so the least length stands in the pattern.
    """
    found = []
    low = text.lower().encode("utf-8", "surrogatepass")
    if any(c in low for c in ASSIGN_FAST):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    if longest is None or longest >= 24:
        found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


class Features:
    """Feature numbers of the words of a text, one column for each group."""

    def __init__(self) -> None:
        self.words = Words()
        kind = np.zeros((3, 256), dtype=np.int64)
        kind[0, 48:58] = 1
        kind[1, 65:91] = 1
        letters = [*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]
        kind[2, :] = 1
        kind[2, letters] = 0
        kind[2, [0x20, 9, 10, 11, 12, 13]] = 0
        # one number for each byte: digits, capitals and specials counted side by side
        self.kind = kind[0] + (kind[1] << 20) + (kind[2] << 40)
        self.not_hex = np.ones(256, dtype=np.int64)
        self.not_hex[[*range(48, 58), *range(97, 103), 0x20, 9, 10, 11, 12, 13]] = 0
        self.offset = np.cumsum((0, *GROUPS[:-1]))

    def __call__(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(features, starts, ends), positions in bytes."""
        a = np.frombuffer(data, dtype=np.uint8)
        starts, ends = self.words.spans(a)
        n = len(starts)
        if not n:
            return np.zeros((0, len(GROUPS)), dtype=np.int64), starts, ends
        size = ends - starts
        counts = np.add.reduceat(self.kind[a], starts)
        part = (1 << 20) - 1
        digits, capitals, special = counts & part, counts >> 20 & part, counts >> 40
        lengths = np.minimum(np.searchsorted((3, 5, 8, 12, 16, 24, 40), size, side="right"), 7)
        share = lambda c: np.where(c == 0, 0, 1 + np.minimum(2, 3 * c // size))
        last = a[ends - 1]
        sign = ((last == 0x3D) | (last == 0x3A)).astype(np.int64)
        equals = np.zeros(n, dtype=np.int64)
        if b"=" in data or b":" in data:
            equals = np.minimum(1, np.add.reduceat(((a == 0x3D) | (a == 0x3A)).astype(np.int64), starts))
        cue = np.zeros(n, dtype=np.int64)
        low = data.lower()
        if any(c in low for c in ASSIGN_FAST):
            at = [m.start() for m in CUE_BYTES.finditer(low)]
            cue[np.searchsorted(starts, at, side="right") - 1] = 1
        long_hex = np.zeros(n, dtype=np.int64)
        if (size >= 16).any():
            long_hex = ((np.add.reduceat(self.not_hex[a], starts) == 0) & (size >= 16)).astype(np.int64)
        names = (self.words.hashes(a, starts, ends) & np.uint64(511)).astype(np.int64)
        coarse = np.minimum(lengths, 3) + 4 * cue + 8 * equals
        shift = lambda x, by: np.r_[0, x[:-1]] if by < 0 else np.r_[x[1:], 0]
        text_len = int(np.searchsorted((200, 2000, 20000), len(data)))
        digit_share = int(np.searchsorted((0.002, 0.01, 0.05), digits.sum() / len(data)))
        whole = np.full(n, text_len + 4 * digit_share + 16 * int(cue.any()))
        # how often digits and other letters alternate in the word
        digit = (a >= 48) & (a < 58)
        turns = np.minimum(np.add.reduceat(np.r_[False, digit[1:] != digit[:-1]].astype(np.int64), starts) - digit[starts], 40)
        turns = np.searchsorted((1, 2, 3, 5, 8, 12, 20), turns, side="right")
        columns = (lengths, turns, share(digits) + 4 * share(capitals), np.minimum(special, 3) + 4 * equals, long_hex + 2 * cue + 4 * sign, shift(names, -1), shift(names, 1), shift(coarse, -1), shift(coarse, 1), whole, shift(sign + 2 * cue, -1))
        return np.stack(columns, 1) + self.offset, starts, ends


def code_points(data: bytes, at: np.ndarray) -> np.ndarray:
    """Code-point positions of byte positions."""
    a = np.frombuffer(data, dtype=np.uint8)
    return np.r_[0, np.cumsum((a & 0xC0) != 0x80)][at]


def tags_of(n: int, starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """B, I, O of words under spans in the same unit."""
    tags = np.full(n, O)
    for s, e in spans:
        first, last = np.searchsorted(ends, s, side="right"), np.searchsorted(starts, e, side="left")
        tags[first:last] = I
        tags[first : first + 1] = B
    return tags


def lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def train(windows: np.ndarray, tags: np.ndarray, rounds: int = 80, ridge: float = 2e-4) -> dict:
    """Weights of a field by AdaGrad on the log-likelihood; windows (S, T, groups), tags (S, T)."""
    s, t, _ = windows.shape
    emit, move = np.zeros((sum(GROUPS), 3)), np.zeros((3, 3))
    seen_e, seen_m = np.full_like(emit, 1e-6), np.full_like(move, 1e-6)
    hot = np.eye(3)[tags]
    true_moves = np.einsum("sti,stj->ij", hot[:, :-1], hot[:, 1:])
    flat = windows.reshape(s * t, -1)
    for _ in range(rounds):
        score = emit[windows].sum(2)
        fwd, bwd = np.zeros_like(score), np.zeros_like(score)
        fwd[:, 0] = score[:, 0]
        for i in range(1, t):
            fwd[:, i] = lse(fwd[:, i - 1][:, :, None] + move, 1) + score[:, i]
        for i in range(t - 2, -1, -1):
            bwd[:, i] = lse(move + (score[:, i + 1] + bwd[:, i + 1])[:, None, :], 2)
        z = lse(fwd[:, -1], 1)
        p = np.exp(fwd + bwd - z[:, None, None])
        pair = np.exp(fwd[:, :-1, :, None] + move + (score + bwd)[:, 1:, None, :] - z[:, None, None, None])
        diff = (hot - p).reshape(s * t, 3)
        grad_e = np.zeros_like(emit)
        for g in range(flat.shape[1]):
            for k in range(3):
                grad_e[:, k] += np.bincount(flat[:, g], weights=diff[:, k], minlength=len(emit))
        grad_e = grad_e / s - ridge * emit
        grad_m = (true_moves - pair.sum((0, 1))) / s - ridge * move
        seen_e += grad_e**2
        seen_m += grad_m**2
        emit += grad_e / np.sqrt(seen_e)
        move += grad_m / np.sqrt(seen_m)
    return {"emit": emit, "move": move}


def decode(score: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The best tags of a text (n, 3), exact."""
    n = len(score)
    # what any other tag could gain over O from the transitions on either side
    swing = max(0.0, *((move[p, k] - move[p, O]) + (move[k, q] - move[O, q]) for p in range(3) for q in range(3) for k in (B, I)), *((move[p, k] - move[p, O]) for p in range(3) for k in (B, I)), *((move[k, q] - move[O, q]) for q in range(3) for k in (B, I)))
    tags = np.full(n, O)
    unsure = np.flatnonzero(score[:, O] - score[:, :O].max(1) <= swing)
    if not len(unsure):
        return tags
    cuts = np.flatnonzero(np.diff(unsure) > 1) + 1
    rows = move.tolist()
    for run in np.split(unsure, cuts):
        lo, hi = int(run[0]), int(run[-1]) + 1
        start = rows[O] if lo else (0.0, 0.0, 0.0)
        end = [r[O] for r in rows] if hi < n else (0.0, 0.0, 0.0)
        values = score[lo:hi].tolist()
        best, back = [v + m for v, m in zip(values[0], start, strict=True)], []
        for v in values[1:]:
            step, new = [], []
            for k in range(3):
                options = [best[j] + rows[j][k] for j in range(3)]
                j = max(range(3), key=options.__getitem__)
                step.append(j)
                new.append(options[j] + v[k])
            back.append(step)
            best = new
        k = max(range(3), key=lambda j: best[j] + end[j])
        for i in range(hi - 1, lo - 1, -1):
            tags[i] = k
            if i > lo:
                k = back[i - lo - 1][k]
    return tags


def padded(x: np.ndarray, value) -> np.ndarray:
    """``x`` with rows of ``value`` behind, up to SPAN_WORDS rows."""
    return np.concatenate([x, np.broadcast_to(value, (max(0, SPAN_WORDS - len(x)), *x.shape[1:]))])


def without_cues(text: str, spans: list[tuple[str, int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """The text with each secret's bare value in its place, cut to SHORTEST characters or more; the values' places."""
    parts, places, at, size = [], [], 0, 0
    for kind, start, end in spans:
        if start < at:
            continue
        value = ASSIGN.match(text, start)[1] if kind == "assign" else text[start:end]
        value = value[: SHORTEST + zlib.crc32(value.encode()) % max(1, len(value) - SHORTEST + 1)]
        parts += [text[at:start], value]
        size += start - at
        places.append((size, size + len(value)))
        size += len(value)
        at = end
    return "".join([*parts, text[at:]]), places


def windows_of(features: Features, text: str) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    """(has a secret, features, tags) of the training windows of a whole text.

    One around each secret, as it stands and without its cue; one around each other word with
    digits, and one at one place more.
    """
    spans = base_spans(text)
    versions = [(text, [s[1:] for s in spans]), without_cues(text, spans)] if spans else [(text, [])]
    for version, places in versions:
        data = version.encode("utf-8", "surrogatepass")
        f, starts, ends = features(data)
        if not len(f):
            return
        t = tags_of(len(f), code_points(data, starts), code_points(data, ends), places)
        a = np.frombuffer(data, dtype=np.uint8)
        digits = np.add.reduceat(((a >= 48) & (a < 58)).astype(np.int64), starts)
        odd = np.flatnonzero((t == O) & (digits > 0))
        for i in (*np.flatnonzero(t == B), *odd, (len(f) * 7) // 11):
            lo = max(0, min(int(i) - SPAN_WORDS // 2, len(f) - SPAN_WORDS))
            tags = padded(t[lo : lo + SPAN_WORDS], O)
            yield bool((tags != O).any()), padded(f[lo : lo + SPAN_WORDS], features.offset), tags


def fit(docs: DataFrame, max_rows: int = TRAIN_ROWS, max_windows: int = TRAIN_WINDOWS) -> dict | None:
    """A field trained on a bounded sample of the texts; None if no base rule matches there."""
    ids = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id").alias("h"), F.col("text").rlike(ANY_BASE).alias("match"))
    ids = written(ids, "secret-ids")
    # the hashes are spread evenly: a share of them that surely holds the sample, then its smallest
    rows = {r["match"]: r["n"] for r in ids.groupBy("match").agg(F.count("*").alias("n")).collect()}
    share = {m: min(1.0, 4 * max_rows / n) for m, n in rows.items()}
    half = [ids.where((F.col("match") == m) & (F.col("h") / 2.0**64 + 0.5 <= x)).orderBy("h", "doc_id").limit(max_rows // 2) for m, x in share.items()]
    if not half:
        return None
    pick = written(half[0].unionByName(half[-1]).select("doc_id").distinct(), "secret-sample")
    free(ids)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(pick), "doc_id")  # at most max_rows rows

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = Features()
        for batch in batches:
            for text in batch["text"]:
                rows = [(secret, f.astype(np.int32).tobytes(), t.astype(np.int8).tobytes()) for secret, f, t in windows_of(features, text or "")]
                yield pd.DataFrame(rows, columns=["secret", "features", "tags"])

    found = texts.select("text").mapInPandas(cut, "secret boolean, features binary, tags binary").withColumn("h", F.xxhash64("features"))
    nth = F.row_number().over(Window.partitionBy("secret").orderBy("h", "features", "tags"))
    rows = found.withColumn("nth", nth).where(F.col("nth") <= max_windows // 2).collect()
    if not any(r["secret"] for r in rows):
        return None
    rows.sort(key=lambda r: (r["secret"], r["nth"]))
    windows = np.stack([np.frombuffer(r["features"], dtype=np.int32).reshape(SPAN_WORDS, -1) for r in rows]).astype(np.int64)
    return train(windows, np.stack([np.frombuffer(r["tags"], dtype=np.int8) for r in rows]).astype(np.int64))


class Scanner:
    """All spans of a text: (kind, start, end) by start, then kind."""

    def __init__(self, model: dict | None) -> None:
        self.features, self.model = Features(), model

    def __call__(self, text: str) -> list[tuple[str, int, int]]:
        data = text.encode("utf-8", "surrogatepass")
        f, starts, ends = self.features(data)
        base = base_spans(text, int((ends - starts).max()) if len(f) else 0)
        if self.model is None or not len(f):
            return base
        emit = self.model["emit"]
        score = emit[f[:, 0]]
        for g in range(1, f.shape[1]):
            score = score + emit[f[:, g]]
        tags = decode(score, self.model["move"])
        at = np.flatnonzero(tags != O)
        if not len(at):
            return base
        # a span begins at B, or at I after O, and goes on over the following I
        begins = at[(tags[at] == B) | (np.r_[-2, at[:-1]] != at - 1)]
        lasts = np.r_[at[np.searchsorted(at, begins[1:]) - 1], at[-1]]
        lo, hi = code_points(data, starts[begins]), code_points(data, ends[lasts])
        more = [("crf", int(s), int(e)) for s, e in zip(lo, hi, strict=True) if not any(s < b and a < e for _, a, b in base)]
        return sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0])))


SPANS = "array<struct<kind:string,start:long,end:long>>"


def find_secrets(docs: DataFrame, model: dict | None) -> DataFrame:
    """``docs`` with a column ``spans`` (which it replaces, if there) of all spans of ``text``."""

    @F.pandas_udf(SPANS)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner(model)
        for texts in batches:
            yield pd.Series([[{"kind": k, "start": s, "end": e} for k, s, e in scanner(t or "")] for t in texts])

    return docs.withColumn("spans", scan("text"))


def redact(docs: DataFrame, model: dict | None, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span in ``text`` replaced by ``mark``; overlapping spans give one mark."""

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner(model)
        for texts in batches:
            out = []
            for t in texts:
                at, parts = 0, []
                for _, s, e in scanner(t) if t else ():
                    if s >= at:
                        parts += [t[at:s], mark]
                    at = max(at, e)
                out.append("".join([*parts, t[at:]]) if parts else t)
            yield pd.Series(out, dtype=object)

    return docs.withColumn("text", clean("text"))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_secrets(docs, fit(docs))
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    # base spans are ordered by start, then kind, and a filter keeps the order
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
