"""Operators of the subpackage against brute force, and on odd rows."""

import collections
import hashlib
import html
import itertools
import json
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from readloom.llm import chat, fingerprint, mixing, ngram_join, packing, pii, quality, secret_scan, topk, wrappers

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, key string, id string"


def docs_of(spark, rows):
    """documents with extra columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "r", "k", "x") for i, t, s in rows], DOCS)


def odd_docs(spark):
    long = "word " * 20000
    return docs_of(spark, [(1, None, "a"), (2, "", None), (3, long, "a"), (4, "same text here now", "b"), (5, "same text here now", "b"), (5, "same text here now", "b"), (None, "no id at all", "c"), (6, " \n\t ", "c")])


# --- personal data ------------------------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_pii(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]


def test_base_spans_of_personal_data_agree_with_plain_patterns():
    rng = random.Random(1)
    for _ in range(5000):
        text = "".join(rng.choice("ab@.@-+_ é12 34.5(6)7890%") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(text) == plain_pii(text)
    assert pii.base_spans("x" * 200_000 + "1" * 200_000 + "." * 1000) == plain_pii("1" * 10)


def test_terms_that_tell_an_entity_are_found_and_sanitised(spark):
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "eps"]
    rows = [(i, " ".join(rng.choices(words, k=30)), "s") for i in range(60)]
    rows += [(100 + i, f"the Zorblax, person {words[i]} wrote jo@mail.example.org {' '.join(rng.choices(words, k=9))}", "s") for i in range(5)]
    rows += [(200, "only zorblax is named", "s")]
    docs = docs_of(spark, rows)
    found = pii.find_disclosures(docs)
    got = {r.doc_id: r for r in found.collect()}
    assert [(s.start, s.end) for s in got[200].terms] == [(5, 12)] and not got[0].terms
    clean = {r.doc_id: r.text for r in pii.sanitise(docs, found).collect()}
    assert "jo@" not in clean[100] and "[EMAIL]" in clean[100] and "orblax" not in clean[100] and "orblax" not in clean[200] and clean[0] == rows[0][1]


def test_personal_data_in_odd_rows(spark):
    found = pii.find_disclosures(odd_docs(spark)).collect()
    assert len(found) == 8 and all(not r.spans for r in found)
    assert pii.find_disclosures(docs_of(spark, [])).count() == 0


# --- mixing -------------------------------------------------------------------------------------


def test_targets_and_permutations():
    assert mixing.targets([10, 10, 10]) == [18.75, 7.5, 3.75]
    t = mixing.targets([1, 100, 100, 5])
    assert t[0] == 3 and t[3] == 15 and abs(t[1] / t[2] - 2) < 1e-9 and abs(sum(t) - 206) < 1e-9
    for n in (1, 2, 3, 7, 100, 1000):
        assert sorted(mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 9))) == list(range(n))


def test_mix_comes_near_its_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.op2_source_mixing(spark, SF).collect()
    size = {r.doc_id: len((r.text or "").encode().split()) for r in docs.collect()}
    assert len(rows) == len(size) and all(r["size"] == size[r.doc_id] and 0 <= r.taken <= 3 * r["size"] for r in rows)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    for own in by.values():
        assert own[0].source_size == sum(r["size"] for r in own)
        assert abs(sum(r.taken for r in own) - own[0].target) <= mixing.BLOCK
    assert abs(sum(v[0].target for v in by.values()) - sum(size.values())) < 1e-3
    assert sorted(rows) == sorted(mixing.op2_source_mixing(spark, SF).collect())
    texts = mixing.mixed_texts(docs).collect()
    taken = {r.doc_id: r.taken for r in rows if r.taken}
    words = collections.Counter()
    for r in texts:
        words[r.doc_id] += len(r.text.encode().split())
    assert words == taken


def test_mix_of_odd_rows(spark):
    d, pieces = mixing.mixed(odd_docs(spark))
    assert d.count() == 8 and {r.source for r in d.collect()} == {"a", "b", "c", None}
    assert mixing.mixed_texts(odd_docs(spark)).columns == odd_docs(spark).columns
    assert mixing.mixed(docs_of(spark, []))[1].count() == 0
    assert mixing.mixed(docs_of(spark, [(1, None, "a")]))[1].count() == 0


# --- similarity join ----------------------------------------------------------------------------


def plain_components(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        n = min(size, len(w))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_join_agrees_with_brute_force(spark, size, percent):
    rng = random.Random(size)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for group in range(40):
        base = rng.choices(vocabulary, k=rng.choice([1, 2, 3, 5, 12, 40, 200, 900]))
        for _ in range(rng.choice([1, 2, 3, 8])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, len(base) // 40, len(base) // 15])):
                text[rng.randrange(len(text))] = rng.choice(vocabulary).upper()
            rows.append((len(rows), " ".join(text)))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "one"), (1004, "ONE")]
    df = docs_of(spark, [(i, t, "s") for i, t in rows])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df, size, percent).collect()}
    assert got == plain_components(rows, size, percent)


@pytest.mark.parametrize(("size", "percent"), [(1, 50), (2, 60), (1, 30)])
def test_join_of_low_thresholds_links_sets_of_very_different_sizes(spark, size, percent):
    rng = random.Random(percent)
    rows = [(0, " ".join(f"w{i}" for i in range(10))), (1, " ".join(f"w{i}" for i in range(18)))]
    for group in range(25):
        base = [f"g{group}x{i}" for i in range(rng.choice([4, 9, 30, 120]))]
        for _ in range(4):
            some = base[: max(1, int(len(base) * rng.uniform(percent / 100 - 0.1, 1)))]
            rows.append((len(rows), " ".join(some + [f"y{rng.randrange(99)}" for _ in range(rng.randrange(1 + len(base) // 8))])))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs_of(spark, [(i, t, "s") for i, t in rows]), size, percent).collect()}
    assert got == plain_components(rows, size, percent)
    with pytest.raises(ValueError, match="percent"):
        ngram_join.jaccard_components(docs_of(spark, rows[:0]), size, 0)


def test_sketch_distance_is_a_lower_bound():
    rng = np.random.default_rng(0)
    for n in (5, 50, 700):
        a = np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64))
        b = np.unique(np.r_[a[n // 10 :], rng.integers(0, 1 << 60, n // 9 + 1).astype(np.uint64)])
        x, y = ngram_join.sketch(a, 40, 3)[0], ngram_join.sketch(b, 40, 3)[0]
        apart = len(np.setxor1d(a, b))
        bits = lambda v: int(np.unpackbits(v.view(np.uint8)).sum())
        assert bits(ngram_join.fold(x) ^ ngram_join.fold(y)) <= bits(x ^ y) <= apart


def test_join_of_odd_rows(spark):
    rows = ngram_join.jaccard_components(odd_docs(spark)).collect()
    assert len(rows) == 8
    got = {r.doc_id: r.component_id for r in rows}
    assert got[5] == 4 and got[1] == 1 and got[None] is None
    assert ngram_join.jaccard_components(docs_of(spark, [])).count() == 0


# --- secrets ------------------------------------------------------------------------------------


def plain_secrets(text):
    a = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [("assign", *m.span()) for m in a.finditer(text) if len(m[1]) >= 6]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], secret_scan.KINDS.index(s[0])))


def test_base_spans_of_secrets_agree_with_plain_patterns():
    rng = random.Random(3)
    parts = ["pAssword", "token", "api_key", "APIKEY", "secret", "ſecret", "AKIA", "ABCDEFGH", "0123456789abcdef", " ", "  ", "=", ":", "'", '"', "x", "é", "\n", "passwd"]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert secret_scan.base_spans(text) == plain_secrets(text)


def test_decoding_is_exact():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(1, 7))
        score, move = rng.normal(size=(n, 3)) * 2, rng.normal(size=(3, 3))
        score[:, 2] += rng.choice([0, 20], size=n)
        value = lambda t: sum(score[i, k] for i, k in enumerate(t)) + sum(move[a, b] for a, b in itertools.pairwise(t))
        best = max(itertools.product(range(3), repeat=n), key=value)
        assert abs(value(best) - value(secret_scan.decode(score, move))) < 1e-9


def test_field_learns_and_redacts(spark):
    rng = random.Random(5)
    words = "the of and to in that is was for on with as his they be at one have this from".split()
    code = lambda: "".join(rng.choices("ABCDEFGHJKLMNPQRSTUVWXYZ23456789abcdefgh", k=16))
    rows = []
    for i in range(120):
        text = rng.choices(words, k=60)
        if i % 2:
            text[30:30] = ["password", "=", code()]
        rows.append((i, " ".join(text), "s"))
    docs = docs_of(spark, rows)
    model = secret_scan.fit(docs.select("doc_id", "text"))
    hidden = [(500, " ".join([*rng.choices(words, k=30), "password", code(), *rng.choices(words, k=30)]), "s"), (501, rows[0][1], "s")]
    got = {r.doc_id: r.spans for r in secret_scan.find_secrets(docs_of(spark, hidden), model).collect()}
    assert not got[501]
    clean = {r.doc_id: r.text for r in secret_scan.redact(docs, model).collect()}
    assert all((clean[i].count("[SECRET]") == 1) == bool(i % 2) for i in range(120))


def test_secrets_in_odd_rows(spark):
    docs = odd_docs(spark)
    assert secret_scan.fit(docs) is None
    assert [r.text for r in secret_scan.redact(docs, None).orderBy("doc_id", "text").collect()] == [r.text for r in docs.orderBy("doc_id", "text").collect()]
    assert secret_scan.find_secrets(docs_of(spark, []), None).count() == 0 and secret_scan.fit(docs_of(spark, [])) is None


# --- fingerprints -------------------------------------------------------------------------------


def test_fingerprints_follow_the_order_of_ids(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows.sort(reverse=True)
    sampler = fingerprint.Sampler()
    got = {r.doc_id: r for r in fingerprint.op5_fingerprints(spark, SF).collect()}
    assert len(got) == len(rows)
    for (i, t), (_, nxt) in zip(rows, [*rows[1:], rows[0]]):
        n = len(t) // 3
        new = t[: len(t) - n] + nxt[:n]
        r = got[i]
        assert r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest() and r.n_chars == len(t)
        assert r.fingerprint == sampler(t) and r.edited_fingerprint == sampler(new)
        assert r.near_next == fingerprint.likeness(sampler(t), sampler(nxt))


def test_likeness_estimates_generalised_jaccard():
    rng = random.Random(6)
    sampler = fingerprint.Sampler(samples=512)
    words = [f"t{i}" for i in range(60)]
    for share in (0.1, 0.5, 0.9):
        a = rng.choices(words, k=300)
        b = a[: int(300 * share)] + rng.choices(words, k=300 - int(300 * share))
        x, y = collections.Counter(a), collections.Counter(b)
        true = sum((x & y).values()) / sum((x | y).values())
        assert abs(fingerprint.likeness(sampler(" ".join(a)), sampler(" ".join(b))) - true) < 0.09


def test_long_texts_without_a_common_word_are_not_alike():
    sampler = fingerprint.Sampler()
    texts = [" ".join(f"{side}{i}" for i in range(40_000)) for side in "ab"]
    a, b = map(sampler, texts)
    assert fingerprint.likeness(a, b) < 0.05
    assert [a, b] == [fingerprint.Sampler()(t) for t in texts] == [sampler(t) for t in texts]
    half = " ".join(f"{'a' if i % 2 else 'b'}{i}" for i in range(40_000))
    assert abs(fingerprint.likeness(a, sampler(half)) - 1 / 3) < 0.2


def test_fingerprints_of_odd_rows(spark):
    rows = fingerprint.fingerprints(odd_docs(spark)).collect()
    assert len(rows) == 8 and len({r.fingerprint for r in rows if r.doc_id in (4, 5)}) == 1
    assert fingerprint.fingerprints(docs_of(spark, [])).count() == 0
    one = fingerprint.fingerprints(docs_of(spark, [(1, "abcdef", "s")])).collect()
    assert one[0].near_next == 1 and one[0].edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()


# --- quality ------------------------------------------------------------------------------------


def test_quality_of_held_out_rows(spark):
    sf = SF.replace("0.001", "0.1")
    rows = quality.op6_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.95 and np.mean([s >= 0.3 for s in good]) > 0.98 and np.mean([s >= 0.3 for s in bad]) < 0.2


def test_quality_is_learnt_from_whole_texts(spark):
    rng = random.Random(8)
    words = lambda letters: ["".join(rng.choices(letters, k=6)) for _ in range(60)]
    plain, good, bad = words("abcdefgh"), words("ijklmnop"), words("qrstuvwx")
    text = lambda i: " ".join(rng.choices(plain, k=700) + rng.choices(good if i % 2 else bad, k=1500))
    docs = docs_of(spark, [(i, text(i), "s") for i in range(80)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(80)], "doc_id long, quality int, toxic int")
    rows = quality.score(docs, quality.fit(docs, labels)).where(quality.fold(F.col("doc_id")) == 0).collect()
    assert {r.doc_id % 2 for r in rows} == {0, 1} and all((r.score > 0.5) == r.doc_id % 2 for r in rows)


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(3, 1, 0), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(odd_docs(spark), labels)
    rows = quality.score(odd_docs(spark), model, "out").collect()
    assert len(rows) == 8 and all(0 <= r.out <= 1 for r in rows)
    none = quality.fit(docs_of(spark, []), labels.limit(0))
    assert quality.score(docs_of(spark, [(1, "a", "s")]), none).first()["score"] == 0.5
    assert quality.fold is not None and zlib.crc32(b"10") % 5 == spark.range(10, 11).select(quality.fold(F.col("id"))).first()[0]


# --- chat ---------------------------------------------------------------------------------------


def test_chat_examples_and_round_trip(spark):
    rows = [(1, 0, "system", "a\\e<b"), (1, 1, "user", "[x] </s>"), (1, 2, "assistant", "yes\\"), (1, 3, "assistant", None), (1, 4, "user", "bye"), (2, 0, "user", "only"), (None, 0, None, "odd]")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    ex = sorted(chat.expand(df).collect(), key=lambda r: (r.conv_id or 0, r.example))
    own = [r for r in ex if r.conv_id == 1]
    assert [r.n_context for r in own] == [2, 3, 5] and own[2].loss_start is None
    assert own[0].text[own[0].loss_start : own[0].loss_end] == "yes\\e" and "yes" in own[1].text
    back = {r.conv_id: r for r in chat.read_back(chat.expand(df)).collect()}
    want = "".join(f"{r}\n{t or ''}\n" for _, _, r, t in rows[:5])
    assert back[1].turns_sha256 == hashlib.sha256(want.encode()).hexdigest() and back[1].n_turns == 5
    assert back[1].loss_sha256 == hashlib.sha256(b"yes\\").hexdigest() and back[2].loss_chars == 0
    assert back[1].formatted_chars == sum(len(r.text) for r in own) and back[None].n_turns == 1
    assert chat.expand(df.limit(0)).count() == 0


def test_chat_of_repeated_rows_long_texts_and_clashing_names(spark):
    long = "a[b]\\\\</s> " * 20000
    rows = [(1, 0, "user", long, "x", 1), (1, 1, "assistant", long, "x", 2), (1, 1, "assistant", long, "x", 2), (2, None, "assistant", "", None, None), (None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, example string, last int")
    back = {r.conv_id: r for r in chat.read_back(chat.expand(df)).collect()}
    want = "".join(f"{r}\n{t}\n" for _, _, r, t, *_ in rows[:3])
    assert back[1].n_turns == 3 and back[1].turns_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert back[1].loss_sha256 == hashlib.sha256((long + long).encode()).hexdigest() and back[1].loss_chars == 2 * len(long)
    assert back[2].n_turns == 1 and back[2].loss_chars == 0 and back[None].n_turns == 1


# --- web pages ----------------------------------------------------------------------------------


def test_pages_of_one_template(spark):
    page = lambda i: f"""<html><head><title>t{i}</title><script>var a = "</p>";</script></head><body><header>Site {i}</header><nav><ul><li>a{i}<li>b</ul></nav>
      <div class='ad box'>buy</div><article><h1>Head &amp; {i}</h1><p>One <b>bold<br>two</b>
      three<p>Second &lt;{i}&gt;{"<ul><li>item</ul>" if i % 2 else ""}<section class="comments"><p>first!</section></article><form>name <input></form>
      <aside>side</aside><footer>foot</footer></body></html>"""  # noqa: E731
    rows = [(i, f"http://Host.example.com/{i}", page(i)) for i in range(20)] + [(50, None, None), (51, "odd", ""), (52, "http://x.example.com/", "<p>plain &unknown; text<div cla")]
    got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("z"))).collect()}
    for i in range(20):
        assert got[i] == f"Head & {i}\n\nOne bold two three\n\nSecond <{i}>" + ("\n\nitem" if i % 2 else "")
    assert got[50] == "" and got[51] == "" and got[52] == "plain &unknown; text"
    assert wrappers.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_constant_text_outside_an_article_is_template():
    pages = [f"<body><div class='x'>Welcome</div><div class='y'><p>news {i}</p></div></body>" for i in range(3)]
    trees = [wrappers.tree(list(wrappers.blocks(p))) for p in pages]
    whole = wrappers.aligned(wrappers.aligned(trees[0], trees[1]), trees[2])
    assert wrappers.kept_paths(whole, 3) == [["body", "div.y", "p"]]


def test_pages_of_mixed_templates_are_read_by_their_own_slots(spark):
    story = lambda i: f"<body><nav>menu</nav><article><h2>Our paper</h2><p>story {i}</p></article></body>"
    plain = lambda i: f"<body><nav>menu</nav><div class='box'><h2>Welcome</h2><p>note {i}</p></div></body>"
    rows = [(i, "http://a.example.com/", story(i)) for i in range(4)] + [(10 + i, "http://a.example.com/", plain(i)) for i in range(4)]
    rows += [(20, None, story(1)), (21, "odd", "<body><p>no main</p></body>")]
    rows += [(30 + i, "http://copies.example.com/", f"<body><div class='ad'>{i}</div><p>one page</p></body>") for i in range(3)]
    got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(4)] == [f"story {i}" for i in range(4)]
    assert [got[10 + i] for i in range(4)] == [f"note {i}" for i in range(4)]
    assert got[20] == "Our paper\n\nstory 1" and got[21] == "no main"
    assert {got[30 + i] for i in range(3)} == {"one page"}


def test_pages_of_the_tables(spark):
    for r in wrappers.extract(spark.read.parquet(f"{SF}/pages.parquet").withColumn("own", F.lit(1))).collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*(>|$)", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n\n".join(x for x in parts if x)


# --- search -------------------------------------------------------------------------------------


def test_search_with_ties_repeats_and_odd_vectors(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.integers(-3, 4, 4).astype(float).tolist()) for i in range(150)]
    rows += [(100, [1.0, 2.0, 3.0, 1.0]), (None, [1.0] * 4), (300, None), (350, [1.0, None, 1.0, 1.0]), (400, [float("nan")] * 4), (450, [float("inf"), 0.0, 0.0, 0.0]), (500, [1.0, 2.0]), (550, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    ints = topk.as_integers(df)
    got = collections.defaultdict(list)
    for r in topk.top_k(ints, ints.where("vec_id % 50 = 0"), 5, pivots=6).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    usable = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    for q in (0, 50):
        v = dict(usable)[q]
        want = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in usable if i != q and len(w) == len(v))[:5]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]
    assert len(got[100]) == 10 and 500 not in got and not {300, 350, 400, 450} & set(got)
    empty = topk.as_integers(df.limit(0))
    assert topk.top_k(empty, empty).count() == 0


def test_search_with_clashing_names(spark):
    rows = [(i, [float(i % 7), 1.0], "s", i, "q") for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string, rank int, query_id string")
    plain, clash = topk.as_integers(df.select("vec_id", "embedding")), topk.as_integers(df)
    found = [sorted(map(tuple, topk.top_k(x, x.where("vec_id % 50 = 0"), 5).select("query_id", "rank", "vec_id", "score").collect())) for x in (plain, clash)]
    assert found[0] == found[1] and len(found[0]) == 10


# --- packing ------------------------------------------------------------------------------------


def test_packing_holds_every_id_once(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60)
    docs = docs.union(spark.createDataFrame([(9001, None), (9002, ""), (9003, "a <|endoftext|> b"), (9004, "two  spaces \n\n end  "), (None, "no id")], "doc_id long, text string"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    pieces = packing.pack(docs).collect()
    of, seq = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        of[p.doc_id].append(p)
        seq[p.sequence_id].append(p)
    assert set(of) == set(texts)
    for i, own in of.items():
        ids = [*t.encode(texts[i], add_special_tokens=False).ids, 0]
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], dtype="<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for own in seq.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024 and at & (at - 1) == 0
    assert packing.pack(docs.limit(0)).count() == 0


def test_packing_of_repeated_rows_long_texts_and_clashing_names(spark):
    rows = [(1, "word " * 20000), (2, "same here"), (2, "same here"), (2, "other text there"), (None, None), (None, None)]
    df = spark.createDataFrame([(i, t, "a", 5, "b") for i, t in rows], "doc_id long, text string, sequence_id string, start int, ids string")
    pieces = packing.pack(df).collect()
    seq = collections.defaultdict(list)
    for p in pieces:
        seq[p.sequence_id].append((p.offset, p.length))
    for own in seq.values():
        ends = [0, *(o + n for o, n in sorted(own))]
        assert [o for o, _ in sorted(own)] == ends[:-1] and ends[-1] <= 1024 and ends[-1] & (ends[-1] - 1) == 0
    whole = {t: p.doc_tokens for t in ("same here", "other text there") for p in packing.pack(df.where(F.col("text") == t)).collect()}
    total = collections.Counter()
    for p in pieces:
        total[p.doc_id] += p.length
    assert total[2] == 2 * whole["same here"] + whole["other text there"] and total[None] == 2
    assert total[1] == next(p.doc_tokens for p in pieces if p.doc_id == 1)


def test_items_go_to_the_level_with_the_least_sum_of_squares():
    rng = random.Random(8)
    p = packing.Packer(16)
    for _ in range(400):
        size = rng.randint(1, 15)
        count = p.count.copy()

        def after(level):
            c = count.copy()
            if level:
                c[level] -= 1
            if level + size < 16:
                c[level + size] += 1
            return int((c[:16] ** 2).sum())

        best = min(after(h) for h in range(16 - size + 1) if h == 0 or count[h])
        p.add((0, 0, np.zeros(size)))
        assert int((p.count[:16] ** 2).sum()) == best
