r"""Information-theoretic sanitisation of personal data (operator 1).

Base rules find e-mail addresses, IP addresses, card and phone numbers in whole texts. Every
distinct value found is a protected entity, and so is each kind as a whole (whatever tells that a
person's number stands near). A term (a lower-cased word without outer punctuation that is in no base
span; digits and signs count as letters) discloses an entity when the two occur together so often that
the term tells most of what there is to know of it: with document frequencies over the whole corpus,

    PMI(entity; term) / IC(entity) >= DISCLOSURE,  IC(entity) = log2(N / n(entity)),
    PMI = log2(N * n(entity, term) / (n(entity) * n(term)))

for terms within ``REACH`` words of the entity in at least ``SUPPORT`` documents. An entity that is in
every document tells nothing (IC = 0), so nothing discloses it. Wherever a disclosing term occurs, in
any document, it becomes a span of its own: ``term``, generalised to its class when the share of
disclosed information is below ``REMOVE``, else removed.

Work: one pass finds entities and the terms around them, one counts the documents of candidate
terms, one looks for disclosing terms. The last two let only those words leave Python that hit a
bitmap of candidates (``SLOTS`` bits, of fixed size whatever the corpus); joins then decide exactly.

Nulls: a null text is empty; null ids are kept. Rows with one doc_id count as one document in
statistics; each row gets its own spans, and repeated rows repeat them. An empty table gives an
empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

KINDS = ("email", "ip", "card", "phone", "term")
DISCLOSURE = 0.8
REMOVE = 0.95
SUPPORT = 3
REACH = 5
SLOTS = 1 << 20
#: Spans and pairs, or places of terms, after which a frame leaves Python: texts may be full of personal data.
FRAME = 1 << 14

# An address is found from its @ backwards: a plain search from the left would try every letter.
DOMAIN = re.compile(r"@([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")
DIGIT = re.compile(r"[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SOLID = re.compile(r"\S+")
OUTER = ".,;:!?\"'()[]{}<>|*#$%&"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start: leftmost non-overlapping matches of each kind that hold."""
    out = []
    if "@" in text:
        done = 0
        for m in DOMAIN.finditer(text):
            start = m.start()
            while start > done and text[start - 1] in LOCAL:
                start -= 1
            if start < m.start():
                out.append(("email", start, m.end()))
                done = m.end()
    if DIGIT.search(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split("."))]
        for m in CARD.finditer(text):
            if 13 <= m.end() - m.start() and 13 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def term_of(word: str) -> str:
    return word.strip(OUTER).lower()


def contexts(text: str, spans: list[tuple[str, int, int]], reach: int) -> Iterator[tuple[str, str]]:
    """(entity, term), each once, for the terms within ``reach`` words of each span; entity: a value, or its kind."""
    parts, done = [], 0
    for _, s, e in sorted(spans, key=lambda x: x[1]):
        if e > done:
            parts += [text[done:s], " " * (e - max(done, s))]
            done = e
    starts, terms = [], []
    for m in SOLID.finditer("".join([*parts, text[done:]])):
        starts.append(m.start())
        terms.append(term_of(m[0]))
    places = defaultdict(list)
    for kind, s, e in spans:
        places[kind, text[s:e].lower()].append((bisect_left(starts, s), bisect_left(starts, e)))
    of_kind = defaultdict(set)
    for (kind, value), at in places.items():
        near = {t for i, j in at for t in (*terms[max(0, i - reach) : i], *terms[j : j + reach]) if t}
        of_kind[kind] |= near
        entity = f"{kind}:{value}"
        yield from ((entity, t) for t in sorted(near))
    for kind, near in of_kind.items():
        yield from ((kind, t) for t in sorted(near))


def slot(term: str) -> int:
    """A place in the bitmap; the same for a term in every process."""
    h = 2166136261
    for b in term.encode("utf-8", "surrogatepass"):
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return (h ^ h >> 15) % SLOTS


def bitmap(terms: DataFrame) -> np.ndarray:
    """Slots of all terms: at most SLOTS numbers come to the driver, however many terms there are."""

    @F.pandas_udf("int")
    def slots(s: pd.Series) -> pd.Series:
        return s.map(slot).astype("int32")

    hit = np.zeros(SLOTS, dtype=bool)
    hit[terms.select(slots("term").alias("slot")).distinct().toPandas()["slot"].to_numpy(dtype="int64")] = True
    return np.packbits(hit)


class Hits:
    """Distinct terms of texts that are in the bitmap; remembers words it has seen."""

    def __init__(self, packed: np.ndarray, most: int = 1 << 16) -> None:
        self.bits = np.unpackbits(packed).astype(bool)
        self.seen: dict[str, str] = {}
        self.most = most

    def __call__(self, words) -> set[str]:
        seen = self.seen
        if len(seen) > self.most:
            seen.clear()
        out = set()
        for w in words:
            t = seen.get(w)
            if t is None:
                t = term_of(w)
                t = seen[w] = t if t and self.bits[slot(t)] else ""
            if t:
                out.add(t)
        return out


def key_of(doc_id, text):
    return F.xxhash64(doc_id, text)


def base_table(docs: DataFrame) -> DataFrame:
    """(doc_id, key, spans, pairs): base spans of every row and the terms around them.

    Pairs beyond ``FRAME`` of a row follow in rows of their own whose ``spans`` are null.
    """

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["doc_id", "key", "spans", "pairs"]).astype({"doc_id": "Int64"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, held = [], 0
            for doc_id, key, text in zip(batch["doc_id"].astype("Int64"), batch["key"], batch["text"], strict=True):
                spans = base_spans(text or "")
                pairs = contexts(text, spans, REACH) if spans else iter(())
                found = [{"kind": k, "start": s, "end": e} for k, s, e in spans]
                while found is not None or part:
                    part = [{"entity": a, "term": b} for a, b in islice(pairs, FRAME)]
                    if found is not None or part:
                        rows.append((doc_id, key, found, part))
                        held += len(found or ()) + len(part)
                    found = None
                    if held >= FRAME:
                        yield frame(rows)
                        rows, held = [], 0
            if rows:
                yield frame(rows)

    schema = "doc_id long, key long, spans array<struct<kind:string,start:long,end:long>>, pairs array<struct<entity:string,term:string>>"
    return docs.mapInPandas(run, schema)


def disclosing_terms(base: DataFrame, docs: DataFrame) -> DataFrame:
    """(term, level): terms whose disclosure of some entity reaches the threshold, with its share."""
    n_docs = docs.select("doc_id").distinct().count()
    pairs = base.select("doc_id", F.explode("pairs").alias("p")).select("doc_id", "p.entity", "p.term").distinct()
    together = written(pairs.groupBy("entity", "term").agg(F.count("*").alias("both")).where(F.col("both") >= SUPPORT), "pii-pairs")
    packed = bitmap(together.select("term"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hits = Hits(packed)
        total: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                if text:
                    total.update(hits(set(text.split())))
            if len(total) > 1 << 15:
                yield pd.DataFrame(list(total.items()), columns=["term", "n"])
                total.clear()
        yield pd.DataFrame(list(total.items()), columns=["term", "n"]).astype({"term": "object", "n": "int64"})

    n_term = docs.select("text").mapInPandas(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_term"))
    entities = pairs.select("entity", "doc_id").distinct().groupBy("entity").agg(F.count("*").alias("n_entity"))
    x = together.join(n_term, "term").join(entities, "entity")
    total = F.lit(float(max(1, n_docs)))
    ic = F.log2(total / F.col("n_entity"))
    # documents that hold a term only elsewhere raise n_term; repeated rows must not raise it above all
    pmi = F.log2(total * F.col("both") / (F.col("n_entity") * F.greatest("n_term", "both")))
    level = F.when(ic > 0, pmi / ic).otherwise(F.lit(0.0))
    return x.select("term", level.alias("level")).where(F.col("level") >= DISCLOSURE).groupBy("term").agg(F.max("level").alias("level"))


def find_disclosures(docs: DataFrame) -> DataFrame:
    """(doc_id, key, spans, terms) of every row of ``docs`` (doc_id, text).

    ``spans``: base spans by kind, then start; ``terms``: spans of disclosing terms with their
    share of disclosed information (``level``); ``key`` is the hash of the row.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("key", key_of("doc_id", "text"))
    base = written(base_table(docs), "pii-base")
    telling = written(disclosing_terms(base, docs), "pii-terms")
    packed = bitmap(telling)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hits = Hits(packed)
        frame = lambda rows: pd.DataFrame(rows, columns=["key", "term", "start", "end"]).astype({"key": "int64", "term": "object", "start": "int64", "end": "int64"})
        for batch in batches:
            rows = []
            for key, text in zip(batch["key"], batch["text"], strict=True):
                found = hits(set(text.split())) if text else ()
                if found:
                    for m in WORD.finditer(text):
                        # split() knows more white space than the words of a term do: look inside
                        at = m.start()
                        for w in m[0].split():
                            at = text.index(w, at)
                            t = term_of(w)
                            if t in found:
                                lead = len(w) - len(w.lstrip(OUTER))
                                rows.append((key, t, at + lead, at + lead + len(w.strip(OUTER))))
                                if len(rows) == FRAME:
                                    yield frame(rows)
                                    rows = []
                            at += len(w)
            yield frame(rows)

    seen = docs.select("key", "text").mapInPandas(look, "key long, term string, start long, end long")
    spans = seen.join(telling, "term").groupBy("key").agg(F.sort_array(F.collect_set(F.struct("start", "end", "level"))).alias("terms"))
    return base.where(F.col("spans").isNotNull()).select("doc_id", "key", "spans").join(spans, "key", "left").select("doc_id", "key", "spans", F.coalesce("terms", F.array().cast("array<struct<start:bigint,end:bigint,level:double>>")).alias("terms"))


def sanitise(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with personal data replaced by its kind, and disclosing terms generalised or removed."""
    spans = found.select("key", F.concat(F.transform("spans", lambda s: F.struct(s["start"], s["end"], F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("by"))), F.transform("terms", lambda s: F.struct(s["start"], s["end"], F.when(s["level"] >= REMOVE, F.lit("")).otherwise(F.lit("[TERM]")).alias("by")))).alias("__all")).withColumnRenamed("key", "__key").dropDuplicates(["__key"])

    @F.pandas_udf("string")
    def clean(texts: pd.Series, marks: pd.Series) -> pd.Series:
        out = []
        for t, m in zip(texts, marks, strict=True):
            at, parts = 0, []
            for s in sorted(m if m is not None else (), key=lambda s: (s["start"], -s["end"])):
                if s["start"] >= at:
                    parts += [t[at : s["start"]], s["by"]]
                at = max(at, s["end"])
            out.append("".join([*parts, t[at:]]) if parts else t)
        return pd.Series(out, dtype=object)

    keyed = docs.withColumn("__key", key_of(F.col("doc_id").cast("long"), F.col("text"))).join(spans, "__key", "left")
    return keyed.withColumn("text", clean("text", "__all")).select(*docs.columns)


def op1_pii_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_disclosures(table(spark, sf_dir, "documents"))
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    terms = F.transform("terms", lambda s: F.struct(F.lit("term").alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", n("email"), n("ip"), n("card"), n("phone"), F.sha2(joined(F.col("spans")), 256).alias("base_sha256"), joined(F.concat("spans", terms)).alias("spans"))
