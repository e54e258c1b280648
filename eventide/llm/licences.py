"""Licence scans by a positional index of rare words, with DataFrame functions only.

Templates are word sequences of licences and their notices. One pass over the corpus counts in how many documents each of
their words occurs. A template's index entries are its words of highest IDF with their positions. A document looks up its
own highest-IDF words among them; each of their places gives, by relative position, where the template would start; there
the other index words must stand at theirs, and the template's mandatory phrases nearby. All this happens within a row:
no document is shuffled.

With k index words of which m must agree, any place that agrees lacks at most k - m of them: so the k - m + 1 rarest that a
document has at all are enough to find it, and no place is lost.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What parts words. KELVIN is the one character beyond ASCII that lower-casing would turn into an ASCII letter.
BETWEEN, KELVIN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "\u212a"
#: A template of at most so many words must stand as it is; of a longer one so many words are indexed.
INDEXED = 8
#: Of a longer template's index words so many may stand elsewhere, and its mandatory phrases by so many words.
MISSING, SLACK = 3, 2


class Template(NamedTuple):
    """Words, and the phrases among them that must be there; short templates are their own mandatory phrase."""

    label: str
    text: str
    mandatory: tuple[str, ...] = ()

    @property
    def words(self) -> list[str]:
        return self.text.split()


#: Phrases whose places are counted.
BASE = (Template("gpl", "gnu general public license"), Template("apache", "apache license"), Template("cc-by", "cc by"), Template("mit", "mit license"))
#: Notices as the licences' publishers word them, by label.
NOTICES = (
    Template("gpl-1.0", "gnu general public license version 1"),
    Template("gpl-2.0", "gnu general public license version 2"),
    Template("gpl-3.0", "gnu general public license version 3"),
    Template("gpl-3.0", "spdx license identifier gpl 3 0"),
    Template("gpl-2.0", "spdx license identifier gpl 2 0"),
    Template(
        "gpl-2.0-or-later",
        "gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
        ("free software foundation", "version 2 of the license"),
    ),
    Template(
        "gpl-3.0-or-later",
        "gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        ("free software foundation", "version 3 of the license"),
    ),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("apache-2.0", "apache license version 2 0"),
    Template("apache-2.0", "spdx license identifier apache 2 0"),
    Template(
        "apache-2.0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
        ("in compliance with the license", "apache org licenses license 2 0"),
    ),
    Template("cc-by-4.0", "cc by 4 0"),
    Template("cc-by-sa-3.0", "cc by sa 3 0"),
    Template("cc-by-sa-4.0", "cc by sa 4 0"),
    Template("cc-by-nc-4.0", "cc by nc 4 0"),
    Template("cc-by-nd-4.0", "cc by nd 4 0"),
    Template("cc-by-nc-sa-4.0", "cc by nc sa 4 0"),
    Template("cc-by-nc-nd-4.0", "cc by nc nd 4 0"),
    Template("cc-by-4.0", "creative commons attribution 4 0"),
    Template("cc-by-sa-4.0", "creative commons attribution sharealike 4 0"),
    Template("cc-by-nc-4.0", "creative commons attribution noncommercial 4 0"),
    Template("cc0-1.0", "cc0 1 0 universal"),
    Template("mit", "spdx license identifier mit"),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        ("permission is hereby granted free of charge", "deal in the software without restriction"),
    ),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "with or without fee is hereby granted")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms", "the following conditions are met")),
    Template("bsd-3-clause", "may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products", "specific prior written permission")),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("source code form", "mozilla public license v 2 0")),
    Template("epl-2.0", "eclipse public license 2 0"),
    Template("bsl-1.0", "boost software license version 1 0"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software", "public domain")),
)


def words_of(text: Column) -> Column:
    """Words of a text, none of a null, in lower case: exactly so in ASCII, which is what templates are written in."""
    known = F.coalesce(text, F.lit(""))
    lower = F.when(F.contains(known, F.lit(KELVIN)), F.translate(known, UPPER, LOWER)).otherwise(F.lower(known))
    return F.array_remove(F.split(lower, BETWEEN), "")


def document_frequencies(docs: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """How many documents there are, and how many hold each word: one row for each word of the vocabulary comes back."""
    found = F.array_distinct(F.filter(words_of(F.col("text")), lambda w: w.isin(*vocabulary)))
    rows = docs.select(F.explode(F.concat(F.array(F.lit("")), found)).alias("word")).groupBy("word").count().collect()
    counts = {r["word"]: r["count"] for r in rows}
    return counts.pop("", 0), counts


#: Templates as the plan holds them: one literal, as small as the templates are.
INDEX = (
    "array<struct<base:boolean,label:string,known:array<string>,lookups:int,agreeing:int,at:map<string,int>,"
    "entries:array<struct<w:string,q:int,v:double>>,mandatory:array<array<struct<w:string,q:int>>>,shifts:array<int>>>"
)


def indexed(template: Template, base: bool, n: int, counts: dict[str, int]) -> dict:
    """An element of ``INDEX``: a template's entries (word, position, share of IDF) by falling IDF, and how they are looked up."""
    words = template.words
    idf = {w: math.log((n + 1) / (counts.get(w, 0) + 1)) + 1 for w in words}
    rare = sorted(idf, key=lambda w: (-idf[w], w))
    whole = len(words) <= INDEXED
    if not whole:
        rare = rare[:INDEXED]
    lookups = 1 if whole else MISSING + 1
    total = sum(idf[w] for w in rare)

    def phrase(text: str) -> list[dict]:
        own = text.split()
        first = next(i for i in range(len(words)) if words[i : i + len(own)] == own)
        return [{"w": w, "q": first + i} for i, w in enumerate(own)]

    return {
        "base": base,
        "label": template.label,
        "known": rare[: 2 * lookups - 1],  # those that can be among a document's rarest in a place that agrees
        "lookups": lookups,
        "agreeing": len(rare) - lookups + 1,
        "at": {w: words.index(w) for w in rare},
        "entries": [{"w": w, "q": words.index(w), "v": idf[w] / total} for w in rare],
        "mandatory": [phrase(template.text)] if whole else [phrase(m) for m in template.mandatory],
        "shifts": [0] if whole else list(range(-SLACK, SLACK + 1)),
    }


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.transform(F.array(value), use)[0]


def stands(words: Column, entry: Column, at: Column) -> Column:
    return F.coalesce(F.get(words, at + entry["q"]) == entry["w"], F.lit(False))


def starts(t: Column, words: Column, places: Column, present: Column) -> Column:
    """Array of (at, share): where the template ``t`` stands, and how much of its index words' IDF agrees there."""
    rarest = F.slice(F.filter(t["known"], lambda w: F.array_contains(present, w)), F.lit(1), t["lookups"])
    begins = let(rarest, lambda r: F.array_distinct(F.transform(F.filter(places, lambda p: F.array_contains(r, p["w"])), lambda p: p["i"] - F.element_at(t["at"], p["w"]))))
    tallied = F.transform(begins, lambda s: F.struct(s.alias("at"), F.filter(t["entries"], lambda e: stands(words, e, s)).alias("hits")))
    agreed = F.filter(tallied, lambda x: F.size(x["hits"]) >= t["agreeing"])
    sure = F.filter(agreed, lambda x: F.forall(t["mandatory"], lambda phrase: F.exists(t["shifts"], lambda d: F.forall(phrase, lambda e: stands(words, e, x["at"] + d)))))
    return F.transform(sure, lambda x: F.struct(x["at"].alias("at"), F.least(F.aggregate(x["hits"], F.lit(0.0), lambda a, e: a + e["v"]), F.lit(1.0)).alias("share")))


LICENCES = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def licences(docs: DataFrame, base: tuple[Template, ...] = BASE, notices: tuple[Template, ...] = NOTICES) -> DataFrame:
    """(doc_id, ``LICENCES``) of each row of (doc_id, text): the licences that its words name.

    Words are runs of digits, letters and all characters beyond ASCII, A-Z lower-cased. ``n_base`` counts the places of all
    ``base`` phrases, overlapping ones too; ``first_word`` and ``last_word`` are the least and the greatest word that one
    starts at, null without any. ``labels`` also has those of ``notices``. ``score`` is the greatest share of IDF with
    which a template's index words agree in a place that holds its mandatory phrases: 1 for a base phrase, 0 without any.

    A null text is empty and has no words; a null doc_id stays null; repeated rows each have their row; other columns play
    no part and are left behind. Words tied in IDF rank by themselves; labels are sorted. No rows give no rows.
    """
    n, counts = document_frequencies(docs, sorted({w for t in (*base, *notices) for w in t.words}))
    index = [*(indexed(t, True, n, counts) for t in base), *(indexed(t, False, n, counts) for t in notices)]
    rare = sorted({w for t in index for w in t["known"]})
    templates = F.from_json(F.lit(json.dumps(index)), INDEX)

    # generators keep the optimizer from working out a text's words again each time that they are looked at
    own = docs.select("doc_id", F.explode(F.array(words_of(F.col("text")))).alias("words"))
    places = F.filter(F.transform("words", lambda w, i: F.when(w.isin(*rare), F.struct(w.alias("w"), i.alias("i")))), lambda p: p.isNotNull())
    own = own.select("doc_id", "words", F.explode(F.array(places)).alias("places"))
    own = own.withColumn("present", F.array_distinct(F.transform("places", lambda p: p["w"])))
    asked = F.when(F.size("places") > 0, F.filter(templates, lambda t: F.arrays_overlap(t["known"], "present")))
    hits = F.transform(asked, lambda t: F.struct(t["base"].alias("base"), t["label"].alias("label"), starts(t, F.col("words"), F.col("places"), F.col("present")).alias("starts")))
    found = F.coalesce(F.filter(hits, lambda x: F.size(x["starts"]) > 0), F.array().cast("array<struct<base:boolean,label:string,starts:array<struct<at:int,share:double>>>>"))
    own = own.select("doc_id", F.size("words").cast("long").alias("n_words"), F.explode(F.array(found)).alias("found"))

    in_base = F.filter("found", lambda x: x["base"])
    begins = F.flatten(F.transform(in_base, lambda x: F.transform(x["starts"], lambda s: s["at"])))
    labels = lambda rows: F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(rows, lambda x: x["label"]))))
    shares = F.flatten(F.transform("found", lambda x: F.transform(x["starts"], lambda s: s["share"])))
    return own.select(
        "doc_id", "n_words",
        F.size(begins).cast("long").alias("n_base"),
        F.array_min(begins).cast("long").alias("first_word"),
        F.array_max(begins).cast("long").alias("last_word"),
        labels(in_base).alias("base_labels"),
        labels(F.col("found")).alias("labels"),
        F.round(F.coalesce(F.when(F.size(in_base) > 0, F.lit(1.0)).otherwise(F.array_max(shares)), F.lit(0.0)), 6).alias("score"),
    )
