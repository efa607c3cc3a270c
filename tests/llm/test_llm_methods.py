"""Does the dealt method decide the result? Planted cases that no base rule or list tells."""

import collections
import random

from pyspark.sql import functions as F

from readloom.llm import mixing, ngram_join, packing, pii, secret_scan, wrappers


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_an_entity_in_every_document_discloses_nothing(spark):
    docs = docs_of(spark, [(i, "please write to help@site.example.org for the one offer", "s") for i in range(5)])
    found = pii.find_disclosures(docs)
    assert {r.text for r in pii.sanitise(docs, found).collect()} == {"please write to [EMAIL] for the one offer"}


def test_terms_of_a_kind_agree_with_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        words = [rng.choice(("red", "blue", "green", "grey")) for _ in range(12)]
        if i % 6 == 0:
            words[4:4] = ["hotline7", f"+1 (017) 555-{1000 + i}", "x" * 400]
        rows.append((i, " ".join(words), "s"))
    docs = docs_of(spark, rows)
    base = pii.base_table(docs.select("doc_id", "text").withColumn("key", pii.key_of("doc_id", "text")))
    got = {r.term: r.level for r in pii.disclosing_terms(base, docs).collect()}
    n, holders = len(rows), {i for i, t, _ in rows if "+1" in t}
    want = {}
    for term in {w for _, t, _ in rows for w in t.split()}:
        near = 0
        for i, t, _ in rows:
            if i in holders:
                at = t.index("+1")
                end = t.index("555-") + 8
                near += term in t[:at].split()[-5:] + t[end:].split()[:5]
        of_term = sum(term in t.split() for _, t, _ in rows)
        if near >= pii.SUPPORT:
            import math

            level = math.log2(n * near / (len(holders) * of_term)) / math.log2(n / len(holders))
            if level >= pii.DISCLOSURE:
                want[term] = level
    assert set(got) == set(want) >= {"hotline7", "x" * 400} and all(abs(got[t] - want[t]) < 1e-9 for t in want)


def plain_contexts(text, spans):
    out, bare = set(), text
    for _, s, e in spans:
        bare = bare[:s] + " " * (e - s) + bare[e:]
    for kind, s, e in spans:
        for w in (*bare[:s].split()[-pii.REACH :], *bare[e:].split()[: pii.REACH]):
            if t := pii.term_of(w):
                out |= {(f"{kind}:{text[s:e].lower()}", t), (kind, t)}
    return sorted(out)


def test_contexts_agree_with_plain_splits():
    rng = random.Random(3)
    some = ["a@b.example", "1.2.3.4", "+1 555 010 2030", "4111 1111 1111 1111", "x", "y,", "(z)", "...", "\x1f", "\u2003", "\n"]
    for _ in range(2000):
        text = "".join(rng.choice(some) + rng.choice(("", " ", "  ")) for _ in range(rng.randint(1, 40)))
        spans = pii.base_spans(text)
        assert sorted(pii.contexts(text, spans, pii.REACH)) == plain_contexts(text, spans)


def log_text(rng, lines):
    return " ".join(f"w{rng.randrange(10**6)} 10.{rng.randrange(256)}.{i // 256 % 256}.{i % 256} v{rng.randrange(10**6)}" for i in range(lines))


def test_texts_full_of_personal_data_leave_in_small_frames():
    import pandas as pd

    class Docs:
        def mapInPandas(self, run, schema):
            return run

    rng = random.Random(4)
    texts = [log_text(rng, n) for n in (300,) * 40] + [log_text(rng, 3000), None, "no data"]
    batch = pd.DataFrame({"doc_id": [*range(len(texts) - 1), None], "key": range(len(texts)), "text": texts})
    frames = list(pii.base_table(Docs())(iter([batch])))
    assert max(sum(len(x or ()) for c in ("spans", "pairs") for x in f[c]) for f in frames) <= 2 * (1 << 14)
    rows = pd.concat(frames)
    whole = rows[rows["spans"].notna()]
    assert list(whole["key"]) == list(range(len(texts))) and whole["doc_id"].isna().sum() == 1
    for key, text in enumerate(texts):
        spans = pii.base_spans(text or "")
        assert [(s["kind"], s["start"], s["end"]) for s in whole["spans"].iloc[key]] == spans
        pairs = [(p["entity"], p["term"]) for part in rows[rows["key"] == key]["pairs"] for p in part]
        assert sorted(pairs) == plain_contexts(text or "", spans)


def test_one_text_with_very_many_spans_and_terms(spark):
    rng = random.Random(6)
    rows = [(i, f"the zorblax wrote jo@mail.example.org w{i}", "s") for i in range(4)] + [(i, "plain words only", "s") for i in range(10, 60)]
    rows += [(100, log_text(rng, 3000), "s"), (101, "zorblax " * 20_000, "s")]
    found = {r.doc_id: r for r in pii.find_disclosures(docs_of(spark, rows)).collect()}
    assert len(found) == len(rows) and len(found[100].spans) == 3000 and not found[10].spans
    assert len(found[101].terms) == 20_000 and [(s.start, s.end) for s in found[0].terms if s.start == 4] == [(4, 11)]


def test_another_seed_draws_other_shards(spark):
    docs = docs_of(spark, [(i, " ".join(f"w{k}" for k in range(200)), f"s{i % 3}") for i in range(2000)])
    shards = {}
    for seed in (1, 1, 2):
        pieces = mixing.mixed(docs, seed=seed)[1]
        counts = {(r["no"], r["shard"]): r["n"] for r in pieces.select("no", "shard", "slot").distinct().groupBy("no", "shard").agg(F.count("*").alias("n")).collect()}
        shards.setdefault(seed, []).append(counts)
    assert shards[1][0] == shards[1][1] != shards[2][0]
    # slots of a shard are told apart by their places
    places = pieces.select("shard", "slot", "no", "pass").distinct().groupBy("shard", "slot").agg(F.count("*").alias("n"))
    assert places.where("n > 1").isEmpty()


def test_secrets_that_no_rule_names_are_found(spark):
    """Hex words too short for the base rules, without a cue, in texts of the tables."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    scan = secret_scan.Scanner(secret_scan.fit(docs))
    rng = random.Random(3)
    texts = [r.text.split() for r in docs.where("length(text) between 800 and 3000").limit(40).collect()]
    hit = miss = 0
    for words in texts:
        secret = "".join(rng.choices("0123456789abcdef", k=20))
        put = lambda w: " ".join([*words[:15], w, *words[15:60]])  # noqa: B023, E731
        hit += ("crf", secret) in [(k, put(secret)[s:e]) for k, s, e in scan(put(secret))]
        miss += any(k == "crf" for k, _, _ in scan(put("4417744280351547")))
    assert len(texts) == 40 and hit >= 36 and miss <= 2


def test_deep_and_long_pages_are_read(spark):
    deep = "<body>" + "<div>" * 20_000 + "<p>deep text</p>"
    long = "<body><article>" + "".join(f"<h2>h{i}</h2><p>p{i}</p>" for i in range(5000)) + "</article>"
    rows = [(1, "http://a.example.com/", deep), (2, "http://a.example.com/", long), (3, "http://a.example.com/", deep)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("own")).withColumn("host", F.lit(1))
    out = wrappers.extract(pages)
    got = {r.page_id: r.text for r in out.collect()}
    assert got[1] == got[3] == "deep text" and got[2].count("\n\n") == 9999 and set(out.columns) == {"page_id", "url", "html", "host", "text"}


def test_alignment_decides_which_text_is_template(spark):
    page = lambda i: f"<body><div class='b'><p>Read our terms</p></div><div class='c'><p>story {i}</p></div></body>"
    rows = [(i, "http://a.example.com/", page(i)) for i in range(4)]
    got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"story {i}" for i in range(4)}
    assert wrappers.article(page(0), None) == "Read our terms\n\nstory 0"


def test_long_constants_and_groups_of_any_size():
    text = "x" * 500
    group = "".join(f"<h{k}>t{k}</h{k}>" for k in range(1, 6))
    trees = [wrappers.tree(list(wrappers.blocks(f"<body><div>{text}</div>{group * n}<p>own {n}</p></body>"))) for n in (2, 3)]
    level = trees[0][0][2]
    assert [n[0] for n in level] == ["e", "+", "e"] and len(level[1][2]) == 5
    whole = wrappers.aligned(*trees)
    assert wrappers.kept_paths(whole, 2)[-1] == ["body", "p"] and ["body", "div"] not in wrappers.kept_paths(whole, 2)


def test_only_what_would_be_padded_leaves_its_window():
    import numpy as np

    rng = random.Random(2)
    packer = packing.Packer(64)
    sizes = [rng.randint(1, 63) for _ in range(3000)]
    done = [w for i, n in enumerate(sizes) if (w := packer.add(((i, n), 0, np.full(n, i))))]
    left = list(packer.close())
    assert packer.moved < 0.05 * sum(sizes)
    ids = collections.Counter()
    for w in done + left:
        n = sum(len(p[2]) for p in w)
        assert n == 64 or n & (n - 1) == 0
        for (doc, _), start, part in w:
            ids[doc] += len(part)
            assert (part == doc).all()
    assert ids == {i: n for i, n in enumerate(sizes)}


def test_one_large_group_and_long_sets(spark):
    rng = random.Random(7)
    base = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
    rows = []
    for i in range(60):
        words = list(base)
        for k in rng.sample(range(3000), 5):
            words[k] = f"e{i}x{k}"
        rows.append((i, " ".join(words), "s"))
    # long texts that share a passage only
    rows += [(100 + i, " ".join([*base[:300], *(f"v{i}x{k}" for k in range(2700))]), "s") for i in range(20)]
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(docs_of(spark, rows), size=5, percent=80).collect()}
    assert all(got[i] == 0 for i in range(60)) and all(got[100 + i] == 100 + i for i in range(20))
