"""Collocations against every phrase spelt out, in Python and in SQL."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from eventide.llm import collocations as own
from eventide.llm import oracle
from eventide.llm.queries import op13_collocations

from ..oracle import differences

SCHEMA = "lang string, text string, word string, n string, chunk string"


def brute(rows, least, top, longest=5):
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            w = [x for x in re.split("[ \t]+", piece) if x]
            total[lang] += len(w)
            f.update((lang, tuple(w[i : i + m])) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    inside = {}
    for (lang, p), a in candidates.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                k = (lang, p[i : i + m])
                inside[k] = max(inside.get(k, 0), a)
    out = []
    for (lang, p), a in candidates.items():
        if 100 * inside.get((lang, p), 0) >= 100 * a:
            continue
        n = total[lang]
        score, _, l, r = min((1000 * a * n // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, l, r, n, score))
    ranked = []
    for lang in {x[0] for x in out}:
        best = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:top]
        ranked += [(x[0], i + 1, *x[1:]) for i, x in enumerate(best)]
    return sorted(ranked)


def found(spark, rows, least, top, parts=5):
    made = spark.createDataFrame([(lang, text, "x", "y", "z") for lang, text in rows], SCHEMA).repartition(parts)
    return sorted(tuple(r) for r in own.collocations(made, least=least, top=top).collect())


def prose(n, seed, words="a b a c d é b 漢 e_f x'y A B".split()):
    rng = random.Random(seed)
    for _ in range(n):
        yield rng.choice(["en", "en", "de", None, ""]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "\x85 ", " "]) for _ in range(rng.randint(0, 60)))


@pytest.mark.parametrize("hot, sent", [(own.HOT, own.SENT), (20, 0), (own.HOT, 0)])
def test_prose_against_every_phrase(spark, monkeypatch, hot, sent):
    """With a small limit nearly every pivot is dealt to several shares; with none to send each chunk asks for its words."""
    monkeypatch.setattr(own, "HOT", hot)
    monkeypatch.setattr(own, "SENT", sent)
    monkeypatch.setattr(own, "CHUNK_BYTES", 2000)
    rows = [*prose(300, 5), *[("en", "one two three four five six")] * 40, *[("en", "a a a a a a")] * 9, (None, None), ("en", None), ("en", ""), ("fr", "seul")]
    want = brute(rows, 6, 25)
    assert len(want) > 60 and found(spark, rows, 6, 25) == want


def test_ties_and_limits(spark):
    rows = [("en", f"x{i} y{i}") for i in range(50) for _ in range(3)]
    assert found(spark, rows, 3, 7) == brute(rows, 3, 7)
    assert found(spark, rows, 4, 7) == []


def test_a_long_text_and_one_word_over_and_over(spark):
    rows = [("en", "ha " * 300_000), ("en", "ha ha, ha. no no no")]
    assert found(spark, rows, 2, 10) == brute(rows, 2, 10)


def test_whole_query_against_sql(spark, middle):
    assert differences(spark, middle, op13_collocations, oracle.COLLOCATIONS) == ""


def test_odd_tables(spark, edge, empty):
    import pyarrow.parquet as pq

    rows = pq.read_table(f"{edge}/documents.parquet", columns=["lang", "text"]).to_pydict()
    assert sorted(tuple(r) for r in op13_collocations(spark, edge).collect()) == brute(list(zip(rows["lang"], rows["text"])), 100, 2000)
    assert op13_collocations(spark, empty).count() == 0


def test_scores_beyond_64_bits(spark):
    big = 3 * 10**12
    words = spark.createDataFrame([("en", "a", big, 1), ("en", "b", big - 1, 2)], "lang string, word string, f long, id int")
    grams = spark.createDataFrame([(bytearray((1).to_bytes(4, "big") + (2).to_bytes(4, "big")), big - 7)], "gram binary, n long")
    row = own.scored(grams, words, spark.createDataFrame([("en", 10**13 + 1)], "lang string, n long"), 1000).first()
    assert row["score"] == 1000 * (big - 7) * (10**13 + 1) // (big * (big - 1))


def test_each_ngram_lies_in_one_fragment():
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 6, 3000).astype(np.int32)
    rows = own.windows(ids, 4)
    use = (rows[:, 3] > 0) | (rows[:, 5] > 0)
    got = {}
    for keys, n in own.mined(own._trimmed(rows[use]), np.ones(int(use.sum()), np.int64), 5, 1):
        got |= {tuple(k): int(c) for k, c in zip(keys.tolist(), n)}
    want = Counter(tuple(ids[i : i + m].tolist()) for m in range(2, 6) for i in range(len(ids) - m + 1) if (ids[i : i + m] > 0).all())
    assert got == dict(want)
    assert own.mined(pa.array([], pa.binary()), np.zeros(0, np.int64), 5, 1)[0][0].shape == (0, 2)
