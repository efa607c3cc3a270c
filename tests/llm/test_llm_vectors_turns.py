"""Vector codes, conversation repair and nearest neighbours against brute force, and on odd rows."""

import hashlib
import itertools
import random

import duckdb
import numpy as np
import pytest

from conftest import SF
from oracle import rows_of
from readloom.llm import ann, turns, vector_codes

VECTORS = "vec_id long, embedding array<float>, label int, id string, v string, code string, error string, leaf string, key string"


def vectors_of(spark, rows):
    """embeddings with extra columns whose names operators use inside."""
    return spark.createDataFrame([(i, v, label, *"abcdef") for i, v, label in rows], VECTORS)


def odd_vectors(seed=5, n=90, dims=8):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=dims).tolist(), i % 3 if i % 7 else None) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [*rows[0][1][:-1], None], 1), (n + 2, [float("nan")] * dims, 1), (n + 3, [float("inf"), *rows[0][1][1:]], 1), (n + 4, [], 1), (n + 5, [0.5] * (dims + 1), 1)]
    return rows + [(3, rows[3][1], 0), (3, rows[4][1], 0), (None, rows[5][1], None), (n + 6, [0.0] * dims, 2)]


# --- vector codes -------------------------------------------------------------------------------


def plain_codes(rows, parts, entries, rounds, scale):
    x = [(i, label, np.floor(np.array(v, dtype=np.float32).astype(float) * scale).astype(np.int64)) for i, v, label in rows]
    start = sorted(x, key=lambda r: (r[0] is None, r[0] or 0, r[2].tolist()))[:entries]
    cut = [k * len(x[0][2]) // parts for k in range(parts + 1)]
    books = [[r[2][a:b].tolist() for r in start] for a, b in itertools.pairwise(cut)]

    def near(p, v):
        d = [sum((s - t) ** 2 for s, t in zip(v, e, strict=True)) for e in books[p]]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p, (a, b) in enumerate(itertools.pairwise(cut)):
            own = [near(p, r[2][a:b].tolist())[0] for r in x]
            for e in range(len(books[p])):
                mine = [r[2][a:b] for r, o in zip(x, own, strict=True) if o == e]
                if mine:
                    books[p][e] = [int(s) // len(mine) for s in np.sum(mine, axis=0)]
    out = []
    for i, label, v in x:
        found = [near(p, v[a:b].tolist()) for p, (a, b) in enumerate(itertools.pairwise(cut))]
        out.append((i, label, "".join(f"{e:02x}" for e, _ in found), sum(d for _, d in found)))
    return out, [x for b in books for e in b for x in e]


@pytest.mark.parametrize(("parts", "entries", "block"), [(4, 6, 16), (8, 200, 2048), (3, 5, 1)])
def test_codes_are_those_of_plain_rounds(spark, parts, entries, block):
    rows = odd_vectors()
    got, books = vector_codes.compress(vectors_of(spark, rows), parts=parts, entries=entries, scale=16, block=block)
    kept = [r for r in rows if r[1] and len(r[1]) == 8 and all(c is not None and np.isfinite(c) for c in r[1])]
    want, flat = plain_codes(kept, parts, entries, 2, 16)
    assert sorted(map(str, [tuple(r) for r in got.collect()])) == sorted(map(str, want))
    assert [x for b in books for x in b.reshape(-1).tolist()] == flat


def test_cover_trees_assign_like_brute_force_and_skip_points():
    rng = np.random.default_rng(1)
    centres = rng.integers(-5000, 5000, size=(12, 4))
    x = (centres[rng.integers(12, size=3000)] + rng.integers(-9, 10, size=(3000, 4))).astype(np.int64)
    tree = vector_codes.CoverTree.from_bytes(vector_codes.CoverTree.build(x).to_bytes())
    assert (tree.points[tree.place] == x).all() and tree.weight.sum() == 3000
    for book in (centres, x[:64], np.repeat(x[:3], 4, axis=0)):
        d = ((x[:, None] - book[None]) ** 2).sum(2)
        assert (tree.labels(book)[tree.place] == d.argmin(1)).all()
    ranges, exact = tree.assign(centres)
    assert exact < 300  # clusters go to their entries as whole subtrees
    assert sum((tree.counts[e] - tree.counts[s]).sum() for s, e, _ in ranges) == 3000
    # the tree's own promises: covering, nesting, separated siblings
    for (c, s, e, radius, first, last), below in itertools.pairwise(tree.levels):
        for n in range(len(c)):
            assert np.sqrt(((tree.points[s[n] : e[n]] - tree.points[c[n]]) ** 2).sum(1)).max() <= radius[n] + 1e-9
            if last[n] > first[n]:
                assert below[0][first[n]] == c[n]


def test_codes_of_no_rows_and_of_one(spark):
    got, books = vector_codes.compress(vectors_of(spark, []))
    assert got.collect() == [] and all(b.size == 0 for b in books)
    got, _ = vector_codes.compress(vectors_of(spark, [(None, [1e30] * 16, None)]))
    assert [tuple(r) for r in got.collect()] == [(None, None, "00" * 16, 0)]
    with pytest.raises(ValueError, match="256"):
        vector_codes.compress(vectors_of(spark, []), entries=300)


# --- conversation repair ------------------------------------------------------------------------


def plain_repair(kinds):
    """(cost, edits) over all ways."""
    ways = {(turns.START, ""): 0}
    for k in kinds:
        new = {}
        for (s, done), cost in ways.items():
            for n, q in turns.chains(s):
                to = [(q, 4, "D")]
                if k[-1] != "x":
                    late = 3 * (k[-1] == "t")
                    to.append((3 if q == 2 else 2, 3 + late, "R"))
                    to += [({"s": 1, "u": 2, "a": 3}[k[:-1]], late, "K")] if (k[:-1], q) in {("s", 0), ("u", 0), ("u", 1), ("u", 3), ("a", 2)} else []
                for r, c, letter in to:
                    way, c = (r, done + "I" * n + letter), cost + c + 3 * n
                    new[way] = min(c, new.get(way, c))
        ways = new
    last = {0: 0, 3: 0, 2: 1, 1: 2}
    return min((c + 3 * last[s], e + "I" * last[s]) for (s, e), c in ways.items())


def test_repair_is_the_cheapest_and_of_those_the_least():
    rng = random.Random(1)
    for _ in range(600):
        kinds = [rng.choice(["s", "u", "a", "x", ""]) + rng.choice("--tx") for _ in range(rng.randint(0, 6))]
        edits = turns.hirschberg(kinds, turns.START, turns.FINAL)
        _, state = turns.apply(edits, [k[:-1] for k in kinds], [""] * len(kinds), turns.START)
        edits += "I" * turns.LAST[state]
        assert (turns.cost_of(edits, [k[-1] for k in kinds]), edits) == plain_repair(kinds)


CONVERSATIONS = "conv_id long, turn long, role string, text string, part string, piece string, seen string"


def odd_conversations():
    rng = random.Random(3)
    rows = [(None, None, "user", "a."), (None, None, "user", "a."), (None, 2, None, None), (None, 10**17 + 1, "assistant", "b"), (None, 10**17 + 3, "assistant", "c!")]
    rows += [(1, None, None, None), (2, 0, "", ""), (3, 1, "system", "x? "), (3, 1, "user", "x?"), (3, 0, "assistant", "yes. " * 30_000), (4, 5, "sup", "q.")]
    return rows + [(9, i // 3, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b", "", "c?", "word " * 50 + "."]) + str(i % 7) + "!") for i in range(150)]


@pytest.mark.parametrize("piece", [1, 4, 2048])
def test_odd_conversations_agree_with_the_sql(spark, tmp_path, piece):
    """One conversation holds nine tenths of the rows; its pieces meet in other tasks."""
    spark.createDataFrame([(*r, "x", "y", "z") for r in odd_conversations()], CONVERSATIONS).write.parquet(str(tmp_path / "conversations.parquet"))
    got = turns.digests(turns.repair(turns.damaged(spark.read.parquet(str(tmp_path / "conversations.parquet"))), piece))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(turns.SQL)
    names = [c[0] for c in want.description]
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(names, want.fetchall())


def test_repaired_turns_alternate_and_lose_no_good_turn(spark):
    rows = turns.damaged(spark.read.parquet(f"{SF}/conversations.parquet"))
    repaired = turns.repair(rows, 3).orderBy("conv_id", "part", "piece").collect()
    by = {}
    for r in repaired:
        by.setdefault(r.conv_id, []).extend(r.turns or [])
    for said in by.values():
        initials = "".join(t.role[:1] for t in said)
        assert initials == "" or initials.removeprefix("s") == "ua" * (len(initials.removeprefix("s")) // 2)
    texts = {hashlib.sha256((r.text or "").encode()).hexdigest() for r in rows.where("NOT gone").collect()}
    assert all(t.text == "" or hashlib.sha256(t.text.encode()).hexdigest() in texts for said in by.values() for t in said)
    empty = spark.createDataFrame([], CONVERSATIONS)
    assert turns.digests(turns.repair(turns.damaged(empty))).count() == 0


# --- nearest neighbours -------------------------------------------------------------------------


def plain_nearest(rows, queries, k):
    out = {}
    for i, v in queries:
        d = sorted((float(np.sqrt(((np.array(x, dtype=float) - np.array(v, dtype=float)) ** 2).sum())), j) for j, x in rows if j != i)
        out.setdefault(i, []).append(d[:k])
    return out


def test_search_of_one_leaf_is_exact_on_odd_rows(spark):
    rows = odd_vectors()
    kept = ann.usable(vectors_of(spark, rows))
    good = [(r.vec_id, r.v) for r in kept.collect()]
    assert len(good) == 92  # null, zero, other lengths, null and infinite components, no id
    got = ann.search(kept, kept.where("vec_id % 10 = 3"), k=4).collect()
    want = plain_nearest(good, [q for q in good if q[0] % 10 == 3], 4)
    # id 3 has two vectors besides its repeated one: two queries of their own
    assert len(got) == 4 * (9 + 1)
    for r in got:
        assert any(r.vec_id == w[r["rank"] - 1][1] and r.score == pytest.approx(w[r["rank"] - 1][0], rel=1e-12) for w in want[r.query_id])
    assert ann.search(kept, kept.where("vec_id = 13"), k=500).count() == 91
    assert ann.search(kept.limit(0), kept.limit(0)).collect() == []


def test_visits_widen_to_the_wanted_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 16)) * 3
    x = centres[rng.integers(60, size=3000)] + rng.normal(size=(3000, 16))
    x[:1000] = x[0]  # a third of all rows is one vector
    rows = ann.usable(vectors_of(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)]))
    good = [(r.vec_id, r.v) for r in rows.collect()]
    got = ann.search(rows, rows.where("vec_id % 20 = 0"), leaf_rows=100, calibration=200).collect()
    want = plain_nearest(good, [q for q in good if q[0] % 20 == 0], 10)
    found = {}
    for r in got:
        found.setdefault(r.query_id, {})[r["rank"]] = (r.score, r.vec_id)
    assert len(found) == 150 and all(sorted(f) == list(range(1, 11)) for f in found.values())
    assert np.mean([len({v for _, v in f.values()} & {v for _, v in want[i][0]}) / 10 for i, f in found.items()]) >= 0.9
    exact = dict(good)
    assert all(s == pytest.approx(np.linalg.norm(np.array(exact[i]) - np.array(exact[v]))) for i, f in found.items() for s, v in f.values())
    # copies of the query come by their ids
    assert [found[20][n][1] for n in range(1, 4)] == [0, 1, 2]


def test_best_bin_first_opens_leaves_by_distance_and_visits_all():
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(size=(200, 5)) + 20 * c for c in range(6)])
    tree = ann.Tree(x, len(x), 50)
    order = list(tree.visits(x[0]))
    assert sorted(order) == list(range(tree.leaves)) and tree.leaves > 6
    place = tree.place(x)
    assert order[0] == place[0] and set(place[:200]) == set(order[: len(set(place[:200]))])


def test_recall_of_the_query_on_the_tables(spark):
    rows = ann.usable(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"))
    good = [(r.vec_id, r.v) for r in rows.collect()]
    want = plain_nearest(good, [q for q in good if q[0] % 100 == 0], 10)
    got = ann.op13_nearest_neighbours(spark, "/root/testdata/sf0.1").collect()
    assert len(got) == 10 * len(want)
    assert np.mean([r.vec_id in {v for _, v in want[r.query_id][0]} for r in got]) >= 0.9
