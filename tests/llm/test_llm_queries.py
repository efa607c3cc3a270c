import pytest

import __spark_entry__ as entry
import corpus_pipeline
from conftest import SF
from oracle import compare
from readloom.llm import mixing, ngram_join, packing, quality, registry, secret_scan


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_agrees_with_its_sql(spark, name):
    compare(spark, SF, registry.QUERIES[name], registry.ORACLES[name])


def test_all_operators_and_the_pipeline_are_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names


def test_pipeline_stages_take_effect(spark, tmp_path):
    """Each stage against a plain version of its decision, on what the stage before kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, steps[-1], SF).write.parquet(str(tmp_path / name))
        steps.append(spark.read.parquet(str(tmp_path / name)))
    assert all(s.columns == docs.columns for s in steps[:-1])
    texts = [{r.doc_id: r.text for r in s.collect()} for s in steps[:4]]
    model = quality.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert set(texts[1]) == {r.doc_id for r in quality.score(docs, model).where("score >= 0.3").collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").encode().lower().split()) else {i} for i, t in texts[1].items()}
    linked = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    kept = set(texts[2])
    assert not any(linked(a, b) for a in kept for b in kept if a < b)
    assert all(any(linked(a, b) for b in sets if b != a) for a in set(sets) - kept)
    assert set(texts[3]) == kept
    assert all(t == texts[2][i] or "[SECRET]" in t for i, t in texts[3].items())
    assert not any(secret_scan.base_spans(t or "") for t in texts[3].values())
    assert steps[4].count() > 0 and {r.doc_id for r in steps[4].collect()} <= kept
    pieces = steps[5].collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in steps[4].collect()}
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, SF)
        assert out.count() == 0
        empty = out if out.columns == docs.columns else empty
    assert mixing and ngram_join and packing
