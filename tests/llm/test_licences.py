"""Licence scans against a search at every place, and against SQL."""

import math
import random
import re

import pytest

from eventide.llm import licences as own
from eventide.llm.oracle import licence_sql
from eventide.llm.queries import op12_licences

from ..oracle import differences

TEMPLATES = (*own.BASE, *own.NOTICES)


def words(text):
    return re.findall("[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(texts):
    """A row for each text, by trying every template at every place."""
    docs = [words(t) for t in texts]
    df = {w: sum(w in set(d) for d in docs) for t in TEMPLATES for w in t.words}
    out = []
    for d in docs:
        base, labels, score = [], set(), 0.0
        for t, template in enumerate(TEMPLATES):
            tw = template.words
            idf = {w: math.log((len(docs) + 1) / (df[w] + 1)) + 1 for w in tw}
            short = len(tw) <= 8
            index = sorted(idf, key=lambda w: (-idf[w], w))[: len(tw) if short else 8]
            at = lambda i: d[i] if 0 <= i < len(d) else None
            for s in range(-len(tw), len(d)):
                hits = [w for w in index if at(s + tw.index(w)) == w]
                if len(hits) < len(index) - (0 if short else 3):
                    continue
                phrases = [tw] if short else [m.split() for m in template.mandatory]
                firsts = [next(i for i in range(len(tw)) if tw[i : i + len(p)] == p) for p in phrases]
                if all(any([at(s + e + f + j) for j in range(len(p))] == p for e in ([0] if short else range(-2, 3))) for p, f in zip(phrases, firsts)):
                    labels.add(template.label)
                    score = max(score, sum(idf[w] for w in hits) / sum(idf[w] for w in index))
                    if t < len(own.BASE):
                        base.append((s, template.label))
        places = [s for s, _ in base]
        out.append((len(d), len(base), min(places, default=None), max(places, default=None), ",".join(sorted({n for _, n in base})), ",".join(sorted(labels)), 1.0 if base else round(score, 6)))
    return out


def mixed(n, seed):
    """Texts of template pieces with words lost, put in and changed."""
    rng, vocabulary = random.Random(seed), sorted({w for t in TEMPLATES for w in t.words})
    for _ in range(n):
        text = []
        for _ in range(rng.randint(0, 6)):
            piece = list(rng.choice(TEMPLATES).words)
            for _ in range(rng.choice([0, 0, 0, 1, 2])):
                i = rng.randrange(len(piece) + 1)
                piece[i : i + rng.randint(0, 1)] = [rng.choice(vocabulary)] * rng.randint(0, 2)
            text += piece[rng.choice([0, 0, 1]) :] + rng.choices(["the", "of", "gnu", "license", "Ünder", "K"], k=rng.randint(0, 4))
        yield "".join(rng.choice([w, w.upper(), w.title()]) + rng.choice([" ", ", ", "-", "\n"]) for w in text)


def test_mixed_texts_against_every_place(spark):
    texts = [*mixed(500, 3), None, "", "...", "gnu", "General Public License", "-- CC-BY", "MIT license MIT License mit license", "K cc by 4 0", "cc\x00by", "GNU General Public License, version 3. apache license"]
    rows = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, words string, found string").repartition(4)
    got = {r[0]: tuple(r)[1:] for r in own.licences(rows).collect()}
    for i, want in enumerate(brute(texts)):
        assert got[i][:-1] == want[:-1] and got[i][-1] == pytest.approx(want[-1], abs=2e-6), texts[i]
    assert sum(g[5] != g[4] for g in got.values()) > 50  # labels of the method's own


def test_whole_query_against_sql(spark, edge, middle):
    assert differences(spark, middle, op12_licences, licence_sql(own.BASE, own.NOTICES)) == ""
    assert differences_of_documents(spark, edge) == ""


def differences_of_documents(spark, sf_dir):
    import duckdb

    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    want = db.execute(licence_sql(own.BASE, own.NOTICES)).fetchall()
    found = [tuple(r) for r in op12_licences(spark, sf_dir).collect()]
    return "" if sorted(map(repr, want)) == sorted(map(repr, found)) else "differs"


def test_no_rows(spark, empty):
    assert op12_licences(spark, empty).count() == 0


def test_a_document_of_one_word_a_million_times(spark):
    text = "gnu " * 1_000_000 + "gnu general public license version 3"
    row = own.licences(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row["n_words"], row["n_base"], row["first_word"], row["labels"]) == (1_000_006, 1, 1_000_000, "gpl,gpl-3.0")


def test_no_python_and_no_shuffle_of_documents(spark, small):
    plan = op12_licences(spark, small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "ArrowEval" not in plan and "Exchange" not in plan
