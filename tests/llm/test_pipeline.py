"""The pipeline's stages, each held against the operator's rule on its own input."""

from collections import Counter

import corpus_pipeline
from eventide.llm.common import table
from eventide.llm.fmindex import contamination
from eventide.llm.simhash import near_duplicates
from eventide.llm.toxicity import toxicity


def stages(spark, sf_dir):
    docs, seen = table(spark, sf_dir, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        seen[name] = (docs, out)
        docs = out
    return seen


def key(df):
    return Counter((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def test_stages(spark, edge):
    seen = stages(spark, edge)
    for name, (docs, out) in list(seen.items())[:-1]:
        assert out.columns == docs.columns, name
    docs, out = seen["toxicity"]
    bad = {r["doc_id"] for r in toxicity(docs, table(spark, edge, "labels")).where("predicted = 1").collect()}
    assert key(out) == Counter({k: n for k, n in key(docs).items() if k[0] not in bad})
    docs, out = seen["simhash_dedup"]
    groups = {r["component_id"] for r in near_duplicates(docs).collect()}
    assert Counter(d for d, _ in key(out).elements()) == Counter(groups)
    docs, out = seen["decontamination"]
    bad = {r["doc_id"] for r in contamination(docs, table(spark, edge, "benchmark")).where("contaminated").collect()}
    assert bad and key(out) == Counter({k: n for k, n in key(docs).items() if k[0] not in bad})
    docs, out = seen["pii"]
    assert Counter(d for d, _ in key(docs).elements()) == Counter(d for d, _ in key(out).elements())
    docs, out = seen["sentencepiece"]
    assert Counter((r["doc_id"], r["decoded"]) for r in out.collect()) == Counter((d, t or "") for d, t in key(docs).elements())


def test_run(spark, edge, empty):
    assert corpus_pipeline.run(spark, edge).count() > 100
    assert corpus_pipeline.run(spark, empty).count() == 0
