r"""Conversation structure repair by Hirschberg's divide and conquer (operator 12).

A conversation's rows, in order, are edited so that the initials of its roles give ``(s?(ua)+)?``:
Keep costs 0, Rerole (to user or assistant) 3, Delete 4, Insert (an empty user or assistant text) 3;
blank and duplicate rows must go, truncated ones that stay cost 3 more. Four states say what was
last written (nothing, s, u, a). A forward vector of costs from the start and a backward one from the
end meet in the middle; of the crossings of least cost the one whose edits come first in ASCII order
is taken, and both halves are solved alike. Inserts belong to the half behind them, so edits before a
crossing hold equally many rows and none is a beginning of another; it is enough to carry the order
of the four beginnings as ranks. Memory is in proportion to the rows, not to rows times states times edits.

A conversation may hold any share of all rows. Rows are sorted by ranges of (conv_id, turn, role,
text); each task cuts its range into pieces of bounded rows and characters and repairs whole
conversations at once. Conversations that cross a piece's border are solved in the same way one
level up: each piece gives its 4 x 4 costs, a chain of these small rows finds the states at all
borders, and every piece is then repaired between its two states. Only the chain of one
conversation's pieces, and the digest of its text, are sequential.

Nulls: a null conv_id, turn, role or text is a value of its own; ``damaged`` has null roles and texts
as one space. Null turns come first; equal turns are ordered by role, then text. A fault is the first
that counts: blank (no ``[^\x20\x09-\x0D]``), duplicate (role and text seen earlier in the
conversation), truncated (the last such character is none of ``.?!``). Repeated rows are duplicates,
empty roles have no initial and are never kept. A row with ``gone`` only says that its conversation
exists. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import spread, table, written

WHITE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Rows and characters of a piece.
ROWS, CHARS = 2048, 4_000_000
START, S, U, A = range(4)
INF = 1 << 60
#: Where an insert leads, with its role; where a kept initial leads.
INSERTED = {START: U, S: U, A: U, U: A}
KEPT = {("s", START): S, ("u", START): U, ("u", S): U, ("u", A): U, ("a", U): A}
ROLE = {U: "user", A: "assistant"}


def chains(state: int) -> list[tuple[int, int]]:
    """(inserts, state after them): up to two inserts, as the third comes back to a state had with fewer."""
    one = INSERTED[state]
    return [(0, state), (1, one), (2, INSERTED[one])]


def moves(kind: str) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, edits) of a row; kind: its initial and its fault (``-`` none, ``t`` truncated, ``x`` must go)."""
    initial, fault = kind[:-1], kind[-1]
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for p in range(4):
        for n, q in chains(p):
            to = [(q, DELETE, "D")]
            if fault != "x":
                more = TRUNCATED if fault == "t" else 0
                to.append((INSERTED[q], REROLE + more, "R"))
                if (initial, q) in KEPT:
                    to.append((KEPT[initial, q], KEEP + more, "K"))
            for r, cost, letter in to:
                found = (cost + n * INSERT, "I" * n + letter)
                best[p, r] = min(best.get((p, r), (INF, "")), found)
    return [(p, r, *x) for (p, r), x in sorted(best.items())]


class Moves(dict):
    def __missing__(self, kind: str) -> list[tuple[int, int, int, str]]:
        self[kind] = moves(kind)
        return self[kind]


MOVES = Moves()
#: Inserts at the end: a state is final if nothing or an assistant was written last.
LAST = {START: 0, A: 0, U: 1, S: 2}


def forward(kinds: list[str], cost: list[int], rank: list[int]) -> tuple[list[int], list[int]]:
    """Costs of the states after the rows, and the order of their least edits."""
    for kind in kinds:
        best: list = [(INF, 9, "")] * 4
        for p, q, c, edits in MOVES[kind]:
            found = (cost[p] + c, rank[p], edits)
            if found < best[q]:
                best[q] = found
        order = {x[1:]: n for n, x in enumerate(sorted(best, key=lambda x: x[1:]))}
        cost, rank = [min(x[0], INF) for x in best], [order[x[1:]] for x in best]
    return cost, rank


def backward(kinds: list[str], cost: list[int]) -> list[int]:
    """Costs from the states before the rows to the end, given those behind them."""
    for kind in reversed(kinds):
        before = [INF] * 4
        for p, q, c, _ in MOVES[kind]:
            before[p] = min(before[p], cost[q] + c)
        cost = before
    return cost


def crossing(left: tuple[list[int], list[int]], right: list[int]) -> int:
    """The state in the middle: of the cheapest, the one whose edits so far come first."""
    return min(range(4), key=lambda s: (left[0][s] + right[s], left[1][s]))


def only(state: int) -> list[int]:
    return [0 if s == state else INF for s in range(4)]


def hirschberg(kinds: list[str], start: int, behind: list[int]) -> str:
    """Edits of the rows from state ``start``; ``behind``: costs of what follows for each last state (inserts at the end are left out)."""
    out, todo = [], [(0, len(kinds), start, behind)]
    while todo:
        a, b, s, end = todo.pop()
        if b - a == 1:
            # of one state's moves none begins like another: the least of the cheapest
            out.append(min((c + end[q], edits) for p, q, c, edits in MOVES[kinds[a]] if p == s)[1])
        elif b > a:
            mid = (a + b) // 2
            cross = crossing(forward(kinds[a:mid], only(s), [0] * 4), backward(kinds[mid:b], end))
            todo += [(mid, b, cross, end), (a, mid, s, only(cross))]
    return "".join(out)


FINAL = [LAST[s] * INSERT for s in range(4)]


def apply(edits: str, roles: list[str], texts: list[str], state: int) -> tuple[list[tuple[str, str]], int]:
    """The repaired rows and the state behind them."""
    out, at = [], 0
    for e in edits:
        if e in "IR":
            state = INSERTED[state]
            out.append((ROLE[state], texts[at] if e == "R" else ""))
        elif e == "K":
            state = KEPT[roles[at][:1], state]
            out.append((roles[at], texts[at]))
        at += e != "I"
    return out, state


def fault(text: str, seen: bool) -> str:
    """``b``lank, ``d``uplicate, ``t``runcated or ``-``."""
    bare = text.rstrip(WHITE)
    return "b" if not bare else "d" if seen else "t" if bare[-1] not in ".?!" else "-"


def kind_of(role: str, fault_: str) -> str:
    return role[:1] + ("x" if fault_ in "bd" else fault_)


PAIRS = {"su", "ua", "au"}
#: Ids travel as strings, as a null among numbers would make floats of them.
REPAIRED = "conv_id string, part int, piece int, whole boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, turns array<struct<role:string,text:string>>, raw array<struct<turn:long,role:string,text:string,gone:boolean>>"
COLUMNS = ["conv_id", "part", "piece", "whole", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "turns", "raw"]


def figures(rows: list[dict], faults: list[str]) -> dict:
    turns = {r["turn"] for r in rows if r["turn"] is not None}
    initials = [r["role"][:1] for r in rows]
    return {
        "gaps": int(max(turns) - min(turns) + 1 - len(turns)) if turns else 0,
        "blank": faults.count("b"),
        "duplicate": faults.count("d"),
        "truncated": faults.count("t"),
        "illegal": sum(a + b not in PAIRS for a, b in zip(initials, initials[1:], strict=False)),
    }


def whole(conv_id, rows: list[dict]) -> dict:
    """The repaired row of a conversation that lies in one piece."""
    rows = [r for r in rows if not r["gone"]]
    faults, seen = [], set()
    for r in rows:
        faults.append(fault(r["text"], (r["role"], r["text"]) in seen))
        seen.add((r["role"], r["text"]))
    kinds = [kind_of(r["role"], f) for r, f in zip(rows, faults, strict=True)]
    edits = hirschberg(kinds, START, FINAL)
    roles, texts = [r["role"] for r in rows], [r["text"] for r in rows]
    _, state = apply(edits, roles, texts, START)
    edits += "I" * LAST[state]
    return {"conv_id": conv_id, "whole": True, **figures(rows, faults), "cost": cost_of(edits, faults), "audit": edits, "turns": apply(edits, roles, texts, START)[0], "raw": None}


def cost_of(edits: str, faults: list[str]) -> int:
    stay = [e for e in edits if e != "I"]
    return sum({"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}[e] for e in edits) + TRUNCATED * sum(f == "t" and e != "D" for e, f in zip(stay, faults, strict=True))


def sorted_pieces(rows: DataFrame, most_rows: int, most_chars: int) -> DataFrame:
    """One row for each whole conversation, repaired, and for each piece of one that may go on elsewhere (``raw``)."""
    keys = (F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")
    dealt = rows.repartitionByRange(spread(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    dealt = dealt.select(F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role", "text", "gone", F.spark_partition_id().alias("part"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, piece, held, chars, conv, begun = 0, 0, [], 0, None, False
        out: list[dict] = []

        def close(more: bool, last: bool) -> None:
            """Ends the piece that is held; ``more``: its conversation goes on in this task; ``last``: the task's rows end here."""
            nonlocal held, chars, begun, piece
            # the first and the last conversation of a task may go on in others
            if begun or more or last or not closed:
                out.append({"conv_id": conv, "part": part, "piece": piece, "whole": False, "raw": held})
            else:
                out.append({"part": part, "piece": piece, **whole(conv, held)})
            piece, held, chars, begun = piece + 1, [], 0, more
            if not more:
                closed.append(True)

        closed: list[bool] = []
        started = False
        for frame in frames:
            for own, turn, role, text, gone in zip(frame["conv_id"], frame["turn"], frame["role"], frame["text"], frame["gone"], strict=True):
                if not started:
                    part, conv, started = int(frame["part"].iloc[0]), own, True
                if own != conv:
                    close(False, False)
                    conv = own
                elif len(held) == most_rows or chars > most_chars:
                    close(True, False)
                held.append({"turn": None if turn is None else int(turn), "role": role, "text": text, "gone": bool(gone)})
                chars += len(text)
            if out:
                yield frame_of(out)
                out.clear()
        if started:
            close(False, True)
            yield frame_of(out)

    return dealt.mapInPandas(run, REPAIRED)


def frame_of(rows: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame([{c: r.get(c) for c in COLUMNS} for r in rows], columns=COLUMNS)
    return out.astype({c: "Int64" for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")})


def crossing_pieces(pieces: DataFrame) -> DataFrame:
    """The repaired pieces of the conversations that are in several, or may be: (conv_id, part, piece, ..., turns)."""
    key = ("conv_id", "part", "piece")
    rows = pieces.select(*key, F.posexplode("raw").alias("at", "r")).select(*key, "at", "r.*")
    here = rows.where(~F.col("gone"))
    # a text seen earlier in the conversation, in whichever piece
    first = Window.partitionBy("conv_id", "role", F.xxhash64("text"), "text").orderBy("part", "piece", "at")
    seen = here.withColumn("seen", F.row_number().over(first) > 1)
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    faults = F.when(bare == "", "b").when(F.col("seen"), "d").when(F.right(bare, F.lit(1)).isin(".", "?", "!"), "-").otherwise("t")
    seen = written(seen.select(*key, "at", "turn", "role", "text", faults.alias("fault")), "turn-faults")

    kind = F.concat(F.left("role", F.lit(1)), F.when(F.col("fault").isin("b", "d"), "x").otherwise(F.col("fault")))
    heads = seen.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", kind.alias("k")))), lambda x: x["k"]).alias("kinds"))

    def costs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            sets = [[forward(list(k), only(s), [0] * 4) for s in range(4)] for k in f["kinds"]]
            yield f[list(key)].assign(
                costs=[[c for x in m for c in x[0]] for m in sets], ranks=[[c for x in m for c in x[1]] for m in sets],
                first=[k[0][:-1] for k in f["kinds"]], last=[k[-1][:-1] for k in f["kinds"]],
            )

    small = heads.mapInPandas(costs, "conv_id string, part int, piece int, costs array<long>, ranks array<int>, first string, last string")

    def chain(g: pd.DataFrame) -> pd.DataFrame:
        """States at the borders of one conversation's pieces, by the same meeting of costs, from the end to the start."""
        g = g.sort_values(["part", "piece"], ignore_index=True)
        behind = [FINAL]
        for c in reversed(g["costs"].to_list()):
            behind.append([min(min(c[4 * s + q] + behind[-1][q] for q in range(4)), INF) for s in range(4)])
        behind.reverse()
        state, out, illegal, before = START, [], 0, None
        for i, (c, r) in enumerate(zip(g["costs"], g["ranks"], strict=True)):
            last = i == len(g) - 1
            to = crossing((list(c[4 * state : 4 * state + 4]), list(r[4 * state : 4 * state + 4])), behind[i + 1])
            illegal = int(before is not None and before + g["first"][i] not in PAIRS)
            before = g["last"][i]
            out.append((state, to, last, illegal))
            state = to
        return g[list(key)].assign(**{n: [x[i] for x in out] for i, n in enumerate(("start", "to", "last", "border"))})

    # null ids are a group of their own in groupBy, but not in a plain join
    borders = small.groupBy("conv_id").applyInPandas(chain, "conv_id string, part int, piece int, start int, to int, last boolean, border int")
    borders = borders.withColumnsRenamed({c: f"b_{c}" for c in key})
    same = [F.col("part") == F.col("b_part"), F.col("piece") == F.col("b_piece")]
    full = seen.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("at", "turn", "role", "text", "fault"))).alias("rows")).join(borders, same)

    def repair(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples():
                rows, faults_ = [dict(x) for x in map(as_dict, r.rows)], [as_dict(x)["fault"] for x in r.rows]
                roles, texts = [x["role"] for x in rows], [x["text"] for x in rows]
                edits = hirschberg([kind_of(a, b) for a, b in zip(roles, faults_, strict=True)], r.start, only(r.to))
                edits += "I" * (LAST[r.to] if r.last else 0)
                n = figures(rows, faults_)
                n["illegal"] += r.border
                out.append({"conv_id": r.conv_id, "part": r.part, "piece": r.piece, "whole": False, **n, "gaps": 0, "cost": cost_of(edits, faults_), "audit": edits, "turns": apply(edits, roles, texts, r.start)[0]})
            yield frame_of(out)

    done = full.mapInPandas(repair, REPAIRED)
    # gaps, and conversations all of whose rows are gone, from the rows
    n = rows.groupBy("conv_id").agg(
        F.coalesce(F.max(here_turn := F.when(~F.col("gone"), F.col("turn"))) - F.min(here_turn) + 1 - F.countDistinct(here_turn), F.lit(0)).cast("long").alias("gaps"),
    )
    zero = F.lit(0).cast("long")
    heads = n.select("conv_id", F.lit(-1).alias("part"), F.lit(-1).alias("piece"), F.lit(False).alias("whole"), "gaps", *(zero.alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")), F.lit("").alias("audit"), F.array().cast(done.schema["turns"].dataType).alias("turns"))
    return done.drop("raw").unionByName(heads)


def as_dict(x) -> dict:
    return x if isinstance(x, dict) else x.asDict()


def repair(rows: DataFrame, most_rows: int = ROWS, most_chars: int = CHARS) -> DataFrame:
    """The repaired conversations of ``rows`` (conv_id, turn, role, text, gone), in pieces.

    Columns: conv_id, part and piece (their order is that of a conversation's pieces), whole (one
    piece holds all), gaps, blank, duplicate, truncated, illegal, cost (to be summed over the
    pieces), audit (edits), turns (role, text).
    """
    pieces = written(sorted_pieces(rows, most_rows, most_chars), "turn-pieces")
    out = pieces.where("whole").drop("raw").unionByName(crossing_pieces(pieces.where("NOT whole")))
    return out.withColumn("conv_id", F.col("conv_id").cast(rows.schema["conv_id"].dataType))


SUMS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def digests(repaired: DataFrame) -> DataFrame:
    """One row a conversation: sums, audit and the digest of its ``role:text`` lines.

    Whole conversations need no shuffle; the others' pieces go by their task in order, one at a time,
    through a digest that is kept open.
    """
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    one = repaired.where("whole").select("conv_id", *SUMS, "audit", F.sha2(lines, 256).alias("repaired_sha256"))
    rest = repaired.where("NOT whole").select(F.col("conv_id").cast("string"), "part", "piece", *SUMS, "audit", F.when(F.size("turns") > 0, lines).alias("lines"))
    rest = rest.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, sums, audit, sha, empty, started = None, [0] * len(SUMS), [], hashlib.sha256(), True, False

        def row() -> pd.DataFrame:
            return pd.DataFrame([(conv, *sums, "".join(audit), sha.hexdigest())], columns=["conv_id", *SUMS, "audit", "repaired_sha256"])

        for f in frames:
            for r in f.itertuples(index=False):
                if started and r.conv_id != conv:
                    yield row()
                    sums, audit, sha, empty = [0] * len(SUMS), [], hashlib.sha256(), True
                conv, started = r.conv_id, True
                sums = [a + int(getattr(r, c)) for a, c in zip(sums, SUMS, strict=True)]
                audit.append(r.audit)
                if r.lines is not None:
                    sha.update((("" if empty else "\n") + r.lines).encode("utf-8", "surrogatepass"))
                    empty = False
        if started:
            yield row()

    sums = ", ".join(f"{c} long" for c in SUMS)
    rest = rest.mapInPandas(run, f"conv_id string, {sums}, audit string, repaired_sha256 string")
    return one.unionByName(rest.withColumn("conv_id", F.col("conv_id").cast(repaired.schema["conv_id"].dataType)))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone) after the damage that the row's crc32 tells (nulls: one space)."""
    c = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    name: Column = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    c = c.withColumn("how", F.crc32(name) % 20)
    how = F.col("how")
    c = c.select(
        "conv_id", "turn", "how",
        F.when(how == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(how.isin(0, 1), "").when(how == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (how == 0).alias("gone"),
    )
    return c.withColumn("copy", F.explode(F.when(how == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("conv_id", "turn", "role", "text", "gone")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(repair(damaged(table(spark, sf_dir, "conversations"))))


SQL = r"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, row_number() OVER () AS o,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
-- crc32, bit by bit
x AS (SELECT o, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, 1 + strlen(name)), lambda k: ascii(name[k])::UBIGINT)),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
      lambda r, z: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384::UBIGINT) ELSE r >> 1 END)) AS a FROM c),
h AS (SELECT c.*, xor(a, 4294967295::UBIGINT) % 20 AS how FROM c JOIN x USING (o)),
d AS (
  SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role,
    CASE how WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM h, range(2) r(copy) WHERE how <> 0 AND (copy = 0 OR how = 3)),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS before,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM o),
f AS MATERIALIZED (
  SELECT *, role[1] AS initial,
    CASE WHEN bare = '' THEN 'b' WHEN seen THEN 'd' WHEN bare[-1] IN ('.', '!', '?') THEN '-' ELSE 't' END AS fault FROM n),
-- what is written before a row: (state, state behind the inserts, their number, their rows)
ins(p, q, k, said) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''),
  (0, 2, 1, chr(10) || 'user:'), (1, 2, 1, chr(10) || 'user:'), (3, 2, 1, chr(10) || 'user:'), (2, 3, 1, chr(10) || 'assistant:'),
  (0, 3, 2, chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 2, chr(10) || 'user:' || chr(10) || 'assistant:'),
  (3, 3, 2, chr(10) || 'user:' || chr(10) || 'assistant:'), (2, 2, 2, chr(10) || 'assistant:' || chr(10) || 'user:')),
-- edits of a row: (state behind the inserts, state after it, letter, initial that it needs, cost)
ed(q, r, letter, needs, price) AS (VALUES (0, 0, 'D', NULL, 4), (1, 1, 'D', NULL, 4), (2, 2, 'D', NULL, 4), (3, 3, 'D', NULL, 4),
  (0, 2, 'R', NULL, 3), (1, 2, 'R', NULL, 3), (3, 2, 'R', NULL, 3), (2, 3, 'R', NULL, 3),
  (0, 1, 'K', 's', 0), (0, 2, 'K', 'u', 0), (1, 2, 'K', 'u', 0), (3, 2, 'K', 'u', 0), (2, 3, 'K', 'a', 0)),
-- best.b: cost, edits and rows so far of the cheapest way, of equal ones the least edits
w(conv_id, i, state, b) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, 0, {'cost': 0, 'audit': '', 'said': ''} FROM f
  UNION ALL
  SELECT f.conv_id, f.i, ed.r, min({
    'cost': w.b.cost + 3 * ins.k + ed.price + CASE WHEN f.fault = 't' AND letter <> 'D' THEN 3 ELSE 0 END,
    'audit': w.b.audit || repeat('I', ins.k) || letter,
    'said': w.b.said || ins.said || CASE letter WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || f.role || ':' || f.text
      ELSE chr(10) || CASE ed.r WHEN 2 THEN 'user:' ELSE 'assistant:' END || f.text END})
  FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1 JOIN ins ON ins.p = w.state
    JOIN ed ON ed.q = ins.q AND (needs IS NULL OR needs = initial) AND (fault NOT IN ('b', 'd') OR letter = 'D')
  GROUP BY f.conv_id, f.i, ed.r),
e AS (
  SELECT w.conv_id, min({'cost': w.b.cost + 3 * k, 'audit': w.b.audit || repeat('I', k), 'said': w.b.said || ins.said}) AS b
  FROM w JOIN ins ON ins.p = w.state AND (ins.q = 3 OR (ins.p = 0 AND ins.k = 0))
  WHERE w.i = (SELECT max(i) FROM f WHERE f.conv_id IS NOT DISTINCT FROM w.conv_id) GROUP BY w.conv_id),
g AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
    count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(e.b.cost, 0)::BIGINT AS cost,
  coalesce(e.b.audit, '') AS audit, sha256(coalesce(e.b.said[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
  LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM a.conv_id
"""
