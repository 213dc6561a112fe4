"""Licence scans by a positional index of rare words.

The index holds, for each licence template, its words with their positions. How rare a word is
comes from the corpus: one aggregation counts in how many documents each template word occurs
(at most as many rows as the templates have words, whatever the corpus). Each template is found
by the ``ANCHORS`` words of its mandatory phrase with the highest inverse document frequency, so
that every file with the phrase is verified, whatever else it or other files hold: a file's words
among them are looked up, every posting votes for the place where its template would start (position in the
file less position in the template), and places with two votes or more are verified: all words
of the template's mandatory phrase must stand at their relative positions. The score is the
largest share of a template's words that stand where they should; a base phrase counts as 1.

The scan is one chain of narrow projections: votes of a file are sorted and compared with their
neighbours inside the row, in time linear in the text but for that sort. Files never meet.

Defined results: null or wordless text gives 0 words, no labels, score 0. Rows are judged one by
one, so repeated rows agree and other columns do not matter.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import text_of

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANCHORS = 3
#: Phrases that always count, and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    #: First and last word (from 0, end exclusive) of the phrase that must be there.
    mandatory: tuple[int, int]

    @property
    def words(self) -> list[str]:
        return self.text.split()


#: Characteristic sentences of public licences, as words.
TEMPLATES = (
    Template("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", (8, 20)),
    Template("apache", "licensed under the apache license version 2 0", (3, 8)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", (0, 8)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", (2, 7)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", (2, 7)),
    Template("cc-by", "creative commons attribution 4 0 international license", (0, 3)),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", (3, 11)),
    Template("gpl", "licensed under the gnu general public license version 3", (3, 7)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", (0, 9)),
    Template("lgpl", "gnu lesser general public license", (0, 5)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", (0, 12)),
    Template("mit", "released under the mit license", (3, 5)),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", (11, 14)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", (2, 6)),
)


def _lookup(array: str | Column, index: Column) -> Column:
    return F.get(array, index)


def scanned_words(text: Column) -> Column:
    """Words of lower-cased text.

    ``lower`` also changes letters beyond ASCII; that neither joins nor parts words, and no
    template word can arise from it but through the Kelvin sign, which counts as a k.
    """
    return F.filter(F.split(F.lower(text), NOT_WORD, -1), lambda w: w != "")


def document_frequencies(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> tuple[int, dict[str, int]]:
    """Number of documents, and of those that hold each template word. Counted over all rows."""
    vocabulary = sorted({w for t in templates for w in t.words})
    found = F.array_distinct(F.filter(scanned_words(text_of()), lambda w: w.isin(vocabulary)))
    # The empty string stands for the document itself.
    words = docs.select(F.explode(F.concat(F.array(F.lit("")), found)).alias("word"))
    # At most one row per template word comes back.
    counts = {r["word"]: r["n"] for r in words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return counts.get("", 0), {w: counts.get(w, 0) for w in vocabulary}


def anchors(total: int, frequencies: dict[str, int], templates: tuple[Template, ...] = TEMPLATES) -> list[list[int]]:
    """Positions of the words of highest IDF in each mandatory phrase, if files hold them; earlier ones first among equals."""
    def idf(word: str) -> float:
        return math.log((total + 1) / (frequencies.get(word, 0) + 1))
    held = [[i for i in range(*t.mandatory) if frequencies.get(t.words[i])] for t in templates]
    return [sorted(sorted(h, key=lambda i, t=t: (-idf(t.words[i]), i))[:ANCHORS]) for t, h in zip(templates, held)]


def scan(docs: DataFrame, places: list[list[int]], templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """One row per document; ``places`` are the anchors of each template."""
    postings: dict[str, list[tuple[int, int]]] = {}
    for t, template in enumerate(templates):
        for p in places[t]:
            postings.setdefault(template.words[p], []).append((t, p))
    ends = {phrase.split()[-1] for phrase, _ in BASE}
    if not postings:  # no file holds a template word; keep the index typed
        postings[""] = [(0, 0)]
    index = F.create_map(*[x for w, ps in sorted(postings.items()) for x in (
        F.lit(w), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")) for t, p in ps]))])
    texts = F.array(*[F.array(*[F.lit(w) for w in t.words]) for t in templates])
    firsts, lasts = (F.array(*[F.lit(t.mandatory[i]) for t in templates]) for i in (0, 1))
    labels = F.array(*[F.lit(t.label) for t in templates])

    step = docs.select("doc_id", scanned_words(text_of()).alias("w"))
    step = step.select("doc_id", "w", F.array_compact(F.transform(
        "w", lambda x, i: F.when(x.isin(sorted(postings | dict.fromkeys(ends))), i))).alias("hits"))

    def ending(i: Column) -> Column:
        """Start and label of the base phrase that ends at word i."""
        found = None
        for phrase, label in BASE:
            ws = phrase.split()
            here = reduce(lambda a, b: a & b, [_lookup("w", i - (len(ws) - 1 - k)).eqNullSafe(F.lit(x)) for k, x in enumerate(ws)])
            hit = F.struct((i - (len(ws) - 1)).alias("start"), F.lit(label).alias("label"))
            found = F.when(here, hit) if found is None else found.when(here, hit)
        return found

    votes = F.flatten(F.transform("hits", lambda i: F.coalesce(
        F.transform(F.get(F.array(index), F.lit(0))[_lookup("w", i)], lambda x: F.struct(x["t"].alias("t"), (i - x["p"]).alias("o"))),
        F.array().cast("array<struct<t:int,o:int>>"))))
    step = step.select("doc_id", "w", F.array_compact(F.transform("hits", ending)).alias("base"), F.sort_array(votes).alias("votes"))
    step = step.select("doc_id", "w", "base", F.filter("votes", lambda v, j: v.eqNullSafe(F.get("votes", j + 1)) & ~v.eqNullSafe(F.get("votes", j - 1))).alias("at"))

    def share(v: Column) -> Column:
        words = _lookup(texts, v["t"])
        right = F.transform(words, lambda x, k: x.eqNullSafe(_lookup("w", v["o"] + k)))
        phrase = F.slice(right, _lookup(firsts, v["t"]) + 1, _lookup(lasts, v["t"]) - _lookup(firsts, v["t"]))
        return F.when(F.forall(phrase, lambda x: x), F.struct(
            (F.size(F.filter(right, lambda x: x)) / F.size(words)).alias("share"), _lookup(labels, v["t"]).alias("label"), v["o"].alias("start")))

    step = step.select("doc_id", "w", "base", F.array_compact(F.transform("at", share)).alias("found"))
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    base_labels = F.transform("base", lambda b: b["label"])
    starts = F.transform("base", lambda b: b["start"])
    best = F.coalesce(F.array_max(F.transform("found", lambda x: x["share"])), F.lit(0.0))
    return step.select(
        "doc_id", F.size("w").cast("long").alias("n_words"), F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        names(base_labels).alias("base_labels"), names(F.concat(base_labels, F.transform("found", lambda x: x["label"]))).alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(best).alias("score"))


def report(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text")
    return scan(docs, anchors(*document_frequencies(docs)))
