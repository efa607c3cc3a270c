r"""Main text of web pages by union-free regular-expression inference (operator 8).

The pages of a host are token streams of tags and text. Streams are aligned pairwise: tokens that
only one of two has become an optional group, neighbouring runs of the same tags a repeated group,
and text that differs a text slot (text that never differs stays a constant of the template). The
result, without unions, is the wrapper of the host. Each page is then matched with the wrapper of
its host, so that every block of its text falls into a slot. The article is what lies in the page's
main element (``article``, ``main`` or an element marked so), without the parts marked as menu,
header, footer, sidebar, notice, advert, form or comments; a page without such an element keeps the
blocks outside those parts. Blocks in slots of fixed template text go: slots whose text is the same
on two or more pages of different content (copies of a page are no evidence), in the main element
only if every page with that element has them.

Every page takes part in its host's wrapper. Pages of one structure are folded in the task that
reads them, then distinct structures by (host, part), then by host; merging gives a wrapper no
larger than what the structures differ in. Long paths are known by a number, and
nothing recurses by nesting, so pages may be as deep and long as they like.

Nulls: a null page is empty; a null or odd url has the empty host. Repeated rows are extracted
alike. Unclosed elements end with their parent, cut-off tags are dropped, unknown character
references stay. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import html
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Fixed values of HTML: elements without end tag, elements inside a block, elements of raw text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
RAW = "script|style|noscript|template|textarea|iframe|svg|select|title"
#: An element that starts closes these open ones.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table article section main div body aside nav footer header form".split())
#: Elements, and words of class, id or role, outside the article.
OUTSIDE_TAGS = frozenset("nav aside footer form head button dialog menu".split())
OUTSIDE_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disqus footer form gdpr legal login masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promotion recommended related replies reply respond search share sharing sidebar social sponsor sponsored subscribe toolbar warning widget".split()
)
HEAD_WORDS = frozenset("header head topbar".split())
MAIN_TAGS = frozenset(("article", "main"))
MAIN_WORDS = frozenset("article articlebody main content story post entry".split())

TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b[^>]*+(?:>.*?(?:</(?P=raw)[^>]*+(?:>|\Z)|\Z)|\Z)|<[!?][^>]*+(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:"[^"<]*+"|'[^'<]*+'|[^>])*?)(?:>|\Z)""",
    re.DOTALL | re.IGNORECASE,
)
MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.IGNORECASE)
WORDS = re.compile(r"[a-z]+")
LONGEST_KEY = 500
REST, MAIN, OUT = "r", "m", "o"


def number(text: str) -> int:
    """A number that stands for a text, the same in every process."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=7).digest(), "big")


@functools.lru_cache(1 << 14)
def label_of(name: str, marks: tuple[str, ...]) -> tuple[str, bool, bool, bool]:
    """(label, outside, outside unless in the main element, main) of an element with its marks."""
    out = name in OUTSIDE_TAGS or not OUTSIDE_WORDS.isdisjoint(marks)
    head = name == "header" or not HEAD_WORDS.isdisjoint(marks)
    main = name in MAIN_TAGS or name not in ("html", "body", "p") and not MAIN_WORDS.isdisjoint(marks)
    return ".".join((name, *marks)), out, head, main


class Element:
    """An open element: where it stands, the path to where that began, and the path from there."""

    __slots__ = ("name", "kind", "outer", "inner")

    def __init__(self, name: str, kind: str, outer: str, inner: str) -> None:
        self.name, self.kind, self.outer, self.inner = name, kind, outer, inner

    def child(self, name: str, marks: tuple[str, ...]) -> Element:
        label, out, head, main = label_of(name, marks)
        kind = self.kind
        if kind != OUT:
            kind = OUT if out or head and kind != MAIN else MAIN if main else kind
        if kind == self.kind:
            return Element(name, kind, self.outer, short(f"{self.inner}/{label}"))
        return Element(name, kind, short(f"{self.outer}{self.inner}/{label}"), "")


def short(path: str) -> str:
    """A path as it is, or a number for it if it is longer than LONGEST_KEY."""
    return path if len(path) <= LONGEST_KEY else f"/{number(path):x}"


class Open:
    """The open elements; each end tag finds its element at once."""

    def __init__(self) -> None:
        self.stack = [Element("", REST, "", "")]
        self.at: dict[str, list[int]] = {}  # name: places in the stack
        self.scopes = [0]

    def push(self, name: str, marks: tuple[str, ...]) -> None:
        self.at.setdefault(name, []).append(len(self.stack))
        if name in SCOPE:
            self.scopes.append(len(self.stack))
        self.stack.append(self.stack[-1].child(name, marks))

    def close(self, names: tuple[str, ...], inside_scope: bool) -> None:
        """Closes the last of the elements and what it holds; ``inside_scope``: only if no scope began since."""
        place = max((self.at[n][-1] for n in names if self.at.get(n)), default=0)
        if place and not (inside_scope and self.scopes[-1] > place):
            while len(self.stack) > place:
                last = self.stack.pop()
                self.at[last.name].pop()
                if self.scopes[-1] == len(self.stack):
                    self.scopes.pop()


def blocks(page: str) -> Iterator[tuple[Element, str]]:
    """(element, text) of each block of text, in page order."""
    opened = Open()
    text: list[str] = []
    at = 0

    def flush() -> Iterator[tuple[Element, str]]:
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if whole:
                yield opened.stack[-1], whole

    for m in TOKEN.finditer(page):
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        if not m["name"]:
            if m["raw"]:
                text.append(" ")
            continue
        name = m["name"].lower()
        if name in INLINE:
            continue
        if name in VOID:
            if name == "hr":
                yield from flush()
            elif name == "br":
                text.append(" ")
            continue
        yield from flush()
        if m["end"]:
            opened.close((name,), False)
            continue
        if name not in SCOPE or name in ("ul", "ol", "dl", "table", "div", "section", "form"):
            opened.close(("p",), True)
        if name in CLOSES:
            opened.close(CLOSES[name], True)
        if not m["attrs"].endswith("/"):
            opened.push(name, tuple(dict.fromkeys(WORDS.findall(" ".join(MARKS.findall(m["attrs"])).lower()))))
    if at < len(page):
        text.append(page[at:])
    yield from flush()


# A wrapper is a list of nodes [kind, key, inside] in two levels: "e" an element (key: a stretch of the
# path), "t" text (key: "#", inside: the number of the constant, or null for a slot, and up to two
# contents of pages that have it), "?" an optional group, "+" a repeated one.


def grown(found: list[tuple[Element, str]], leaves: list) -> list:
    """Elements of one page. Blocks that follow each other share the elements that their paths share."""
    root: list = []
    for (element, _), leaf in zip(found, leaves, strict=True):
        outer, inner = f"{element.kind}:{element.outer}", element.inner
        if not root or root[-1][1] != outer:
            root.append(["e", outer, []])
        level = root[-1][2]
        if not level or level[-1][1] != inner:
            level.append(["e", inner, []])
        level[-1][2].append(["t", "#", leaf])
    return root


def wanted(found: list[tuple[Element, str]]) -> str:
    """Where a page's article stands."""
    return MAIN if any(e.kind == MAIN for e, _ in found) else REST


def tree(found: list[tuple[Element, str]]) -> list:
    """Nodes of one page."""
    kind = wanted(found)
    seen = [number("\n".join(text for e, text in found if e.kind == kind))]
    return folded(grown(found, [[number(text), seen] for _, text in found]))


def repeated(node: list) -> bool:
    return node[0] == "+" or node[0] == "?" and node[2][0][0] == "+"


def inner(node: list) -> list:
    """What a group holds, or the node alone; an optional repeated group is seen through."""
    while node[0] in "?+":
        if node[0] == "+" or len(node[2]) > 1 or node[2][0][0] not in "?+":
            return node[2]
        node = node[2][0]
    return [node]


def same(a: list, b: list) -> list:
    """Two nodes of one key as one."""
    if a[0] in "?+" or b[0] in "?+":
        kind = "+" if repeated(a) or repeated(b) else "?"
        return [kind, a[1], aligned(inner(a), inner(b))]
    if a[0] == "t":
        (x, seen), (y, others) = a[2], b[2]
        return ["t", "#", [x if x == y else None, sorted({*seen, *others})[:2]]]
    return ["e", a[1], aligned(a[2], b[2])]


def places(nodes: list) -> dict[tuple[str, int], int]:
    """(key, how often it came before): place."""
    seen: dict[str, int] = {}
    out = {}
    for i, node in enumerate(nodes):
        n = seen.get(node[1], 0)
        seen[node[1]] = n + 1
        out[node[1], n] = i
    return out


def increasing(values: list[int]) -> list[int]:
    """Places of a longest increasing subsequence."""
    tops: list[int] = []
    last: list[int] = []
    before = []
    for i, v in enumerate(values):
        k = bisect.bisect_left(tops, v)
        tops[k : k + 1] = [v]
        last[k : k + 1] = [i]
        before.append(last[k - 1] if k else -1)
    out = []
    i = last[-1] if last else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def aligned(a: list, b: list) -> list:
    """Two lists of nodes as one: most nodes of one key that come in one order are matched, the rest is optional."""
    in_b = places(b)
    common = [(i, in_b[k]) for k, i in places(a).items() if k in in_b]
    matched = [common[k] for k in increasing([j for _, j in common])]
    out: list = []
    maybe = lambda x: x if x[0] == "?" else ["?", x[1], [x]]
    i = j = 0
    for p, q in (*matched, (len(a), len(b))):
        out += map(maybe, a[i:p])
        out += map(maybe, b[j:q])
        if p < len(a):
            out.append(same(a[p], b[q]))
        i, j = p + 1, q + 1
    return folded(out)


def folded(nodes: list) -> list:
    """Nodes with runs of equal keys, of any number of nodes, as repeated groups."""
    out: list = []
    last: dict[str, list[int]] = {}
    group = -1  # the last repeated group of several nodes

    def put(node: list, size: int) -> None:
        """A group in place of the last ``size`` nodes."""
        for old in reversed(out[-size:]):
            last[old[1]].pop()
        out[-size:] = [node]
        last.setdefault(node[1], []).append(len(out) - 1)

    for kind, key, x in nodes:
        out.append([kind, key, folded(x) if kind == "e" else x])
        last.setdefault(key, []).append(len(out) - 1)
        while True:
            n = len(out) - 1 - group
            if 0 <= group < len(out) - 1 and len(held := inner(out[group])) == n and [u[1] for u in held] == [v[1] for v in out[-n:]]:
                put(["+", out[group][1], [same(u, v) for u, v in zip(held, out[-n:], strict=True)]], n + 1)
                continue
            if len(last[out[-1][1]]) < 2:
                break
            size = len(out) - 1 - last[out[-1][1]][-2]
            first, second = out[-2 * size : -size], out[-size:]
            if 2 * size > len(out) or [u[1] for u in first] != [v[1] for v in second]:
                break
            if size == 1:
                put(["+", first[0][1], aligned_once(inner(first[0]), inner(second[0]))], 2)
            else:
                name = "+" + short("/" + " ".join(u[1] for u in first))
                put(["+", name, [same(u, v) for u, v in zip(first, second, strict=True)]], 2 * size)
        if out[-1][1].startswith("+"):
            group = len(out) - 1
        elif group >= len(out):
            group = -1
    return out


def aligned_once(a: list, b: list) -> list:
    return [same(a[0], b[0])] if len(a) == len(b) == 1 else aligned(a, b)


def shape(nodes: list) -> str:
    """A number for the structure without its text."""
    bare = lambda ns: [[k, key, "" if k == "t" else bare(x)] for k, key, x in ns]
    return f"{number(json.dumps(bare(nodes))):x}"


class Level:
    """The nodes of one level of a wrapper in their order, to be matched with the elements of a page."""

    def __init__(self, nodes: list, main: bool = False, varied: bool = False) -> None:
        self.main = main
        self.inside: list[Level | bool] = []  # the level of an element; of a text, is it fixed
        self.at: dict[str, list[int]] = {}  # key: its positions
        self.keys: list[str] = []
        self.required = [0]  # nodes before each position that are in no optional group
        self.loops: list[tuple[int, int]] = []
        self._add(nodes, varied, False)

    def _add(self, nodes: list, varied: bool, optional: bool) -> None:
        for kind, key, x in nodes:
            if kind in "?+":
                first = len(self.inside)
                self._add(x, True, optional or kind == "?")
                if kind == "+":
                    self.loops.append((first, len(self.inside)))
                continue
            self.at.setdefault(key, []).append(len(self.inside))
            self.keys.append(key)
            self.required.append(self.required[-1] + (not optional))
            if kind == "t":
                constant, seen = x
                self.inside.append(constant is not None and len(seen) > 1 and not (varied and self.main))
            else:
                enters = key.startswith(f"{MAIN}:")
                self.inside.append(Level(x, self.main or enters, varied and not enters))

    def step(self, p: int, q: int) -> int:
        """Required nodes that are left out when position q follows p; many if it cannot."""
        n = self.required
        if q > p:
            return n[q] - n[p + 1]
        return min((n[stop] - n[p + 1] + n[q] - n[first] for first, stop in self.loops if first <= q and p < stop), default=1000 + len(n))

    def match(self, nodes: list, fixed: list[bool]) -> None:
        """Sets ``fixed`` of the blocks below ``nodes`` (elements of a page with block numbers) by their slots."""
        known = [x for x in nodes if x[1] in self.at]
        ways: list[dict[int, tuple[int, int]]] = [{-1: (0, -1)}]  # position: least cost, position before
        for _, key, _ in known:
            ways.append({q: min((cost + self.step(p, q), p) for p, (cost, _) in ways[-1].items()) for q in self.at[key]})
        end = len(self.inside)
        at = min(ways[-1], key=lambda p: ways[-1][p][0] + self.step(p, end))
        for (kind, _, x), way in zip(reversed(known), reversed(ways), strict=False):
            if kind == "t":
                fixed[x] = self.inside[at]
            else:
                self.inside[at].match(x, fixed)
            at = way[at][1]


def kept_paths(wrapper: list, pages: int) -> list[list[str]]:
    """Paths of the text slots that may hold the article of one of so many pages."""
    whole = Level(wrapper)
    found = []
    for outer, level in zip(whole.keys, whole.inside, strict=True):
        for inner_, texts in zip(level.keys, level.inside, strict=True):
            if outer[0] != OUT and (pages == 1 or not all(texts.inside)):
                found.append(tuple(x for x in (outer[2:] + inner_).split("/") if x))
    return [list(p) for p in dict.fromkeys(found)]


def article(page: str | None, wrapper: Level | None) -> str:
    """The article of a page by the wrapper of its host; without a wrapper no text is template text."""
    found = list(blocks(page or ""))
    fixed = [False] * len(found)
    if wrapper is not None:
        wrapper.match(grown(found, list(range(len(found)))), fixed)
    kind = wanted(found)
    return "\n\n".join(text for (e, text), drop in zip(found, fixed, strict=True) if e.kind == kind and not drop)


HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
SALTS = 32
PART = "host string, shape string, wrapper string"


def infer(pages: DataFrame, parts: int = 64) -> DataFrame:
    """(host, wrapper): the wrapper of each host of ``pages`` (host, html), as JSON."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple[str, str], list] = {}

        def out() -> pd.DataFrame:
            rows = [(h, s, json.dumps(w)) for (h, s), w in seen.items()]
            seen.clear()
            return pd.DataFrame(rows, columns=["host", "shape", "wrapper"])

        for batch in batches:
            for host, page in zip(batch["host"], batch["html"], strict=True):
                nodes = tree(list(blocks(page or "")))
                key = (host, shape(nodes))
                old = seen.get(key)
                seen[key] = nodes if old is None else aligned(old, nodes)
            if len(seen) > 5000:
                yield out()
        if seen:
            yield out()

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for text in group.sort_values("shape")["wrapper"]:
            whole = json.loads(text) if whole is None else aligned(whole, json.loads(text))
        return pd.DataFrame([(group["host"].iloc[0], shape(whole), json.dumps(whole))], columns=["host", "shape", "wrapper"])

    found = pages.mapInPandas(read, PART)
    by_part = found.withColumn("part", F.pmod(F.xxhash64("shape"), F.lit(parts))).groupBy("host", "part").applyInPandas(merge, PART)
    return by_part.groupBy("host").applyInPandas(merge, PART).select("host", "wrapper")


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` (url, html, ...) with the article's ``text``, each by the wrapper of its host.

    Other columns stay, but for one named ``text``, which is replaced.
    """
    # names of their own, as pages may have columns of any name
    keyed = pages.withColumn("__host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1)))
    wrappers = infer(keyed.select(F.col("__host").alias("host"), "html")).withColumnsRenamed({"host": "__host", "wrapper": "__wrapper"})

    @F.pandas_udf("string")
    def articles(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known: dict[str, Level] = {}
        for pages_, wrapper in batches:
            out = []
            for page, w in zip(pages_, wrapper, strict=True):
                if w not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[w] = Level(json.loads(w))
                out.append(article(page, known[w]))
            yield pd.Series(out, dtype=object)

    # wrappers are small; copies of each spread the pages of a host that has very many
    keyed = keyed.withColumn("__salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)))
    wrappers = wrappers.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    out = keyed.join(wrappers, ["__host", "__salt"]).withColumn("text", articles("html", "__wrapper"))
    return out.select(*[c for c in pages.columns if c != "text"], "text")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
