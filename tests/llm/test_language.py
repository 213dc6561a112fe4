"""Language identification: counts and backoff by hand, held-out accuracy, edge rows."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import language

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, rows int, word string, gram long"


def words_of(text):
    return [w for w in re.findall(r"[^\W\d_]+", (text or "").lower()) if any(c.isalpha() for c in w)]


def grams_of(word, n):
    padded = word if n == 1 else f" {word} "
    return [padded[i:i + n] for i in range(len(padded) - n + 1)]


class ByHand:
    def __init__(self, rows):
        self.words, self.grams = defaultdict(Counter), {n: defaultdict(Counter) for n in language.LENGTHS}
        for text, lang in rows:
            if text is not None and lang is not None:
                for w in words_of(text):
                    self.words[lang][w] += 1
                    for n in language.LENGTHS:
                        for g in grams_of(w, n):
                            self.grams[n][lang][g] += 1
        self.langs = sorted(lang for lang in self.words if self.words[lang])
        self.base = {id(c): {x: sum(c[x].values()) + 0.5 * max(len(set().union(*c.values())), 1) for x in self.langs}
                     for c in (self.words, *self.grams.values())}

    def log(self, counts, key, lang):
        return math.log((counts[lang][key] + 0.5) / self.base[id(counts)][lang])

    def word(self, w, lang):
        if any(w in self.words[x] for x in self.langs):
            return self.log(self.words, w, lang)
        for n in language.LENGTHS:
            known = [g for g in grams_of(w, n) if any(g in self.grams[n][x] for x in self.langs)]
            if known:
                return sum(self.log(self.grams[n], g, lang) for g in known) / len(known)
        return 0.0

    def predict(self, text):
        words = words_of(text)
        if not words or not self.langs:
            return "und", 0.0
        sums = {x: sum(self.word(w, x) for w in words) for x in self.langs}
        best = max(self.langs, key=lambda x: sums[x])
        return best, 1 / sum(math.exp(s - sums[best]) for s in sums.values())


def check(docs):
    rows = docs.select("doc_id", "text", "lang").collect()
    held = {r.doc_id: zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 3 == 1 for r in rows}
    model = ByHand([(r.text, r.lang) for r in rows if not held[r.doc_id]])
    want = sorted((str(r.doc_id), held[r.doc_id], *model.predict(r.text)) for r in rows)
    got = sorted((str(r.doc_id), r.held_out, r.lang_pred, r.score) for r in language.report(docs).collect())
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [(g, w) for g, w in zip(got, want) if abs(g[3] - w[3]) > 1e-6] == []
    return rows, got


def test_whole_table_and_accuracy(spark):
    rows, got = check(spark.read.parquet(f"{SF}/documents.parquet"))
    lang = {str(r.doc_id): r.lang for r in rows}
    held = [lang[key] == pred for key, out, pred, _ in got if out and lang[key] is not None]
    assert len(held) > 50 and sum(held) >= 0.97 * len(held)


def edge_rows():
    rows = [(i, t, lang, 1, "w", 2) for i, (t, lang) in enumerate([
        ("the cat sat on the mat", "en"), ("der Hund saß auf der Matte", "de"), ("le chat était là", "fr"), ("the dog and the cat", "en"),
        ("und die Katze", "de"), ("où est le chien", "fr")] * 8)]
    return rows + [(100, None, "en", 1, "w", 2), (101, "", "en", 1, "w", 2), (102, "12 34 _ ²!", "en", 1, "w", 2), (103, "the unlabelled", None, 1, "w", 2),
                   (None, "the cat", "en", 1, "w", 2), (None, "der Hund", "de", 1, "w", 2), (5, "the cat", "", 1, "w", 2), (104, "Žluťoučký кот 猫", "en", 1, "w", 2),
                   (105, "zzqq thecat hundsaß x² y", "en", 1, "w", 2), (106, "m²a ŉ İstanbul", "de", 1, "w", 2), (107, "ab" * 20_000 + " der", "de", 1, "w", 2),
                   (108, "the cat sat " * 30_000, "en", 1, "w", 2)]


def test_edge_rows(spark):
    rows, got = check(spark.createDataFrame(edge_rows(), SCHEMA).repartition(5))
    found = {key: (pred, score) for key, _, pred, score in got}
    assert found["100"] == found["101"] == found["102"] == ("und", 0.0)
    assert found["108"][0] == "en"


def test_portions_change_nothing(spark, monkeypatch):
    docs = spark.createDataFrame(edge_rows()[:-2], SCHEMA)
    model = language.learned(docs)
    texts = [r[1] for r in edge_rows()]
    whole = list(model.predict(texts))
    monkeypatch.setattr(language, "PORTION", 3)
    small = list(model.predict(texts))
    assert [a[0] for a in whole] == [b[0] for b in small]
    assert np.allclose([a[1] for a in whole], [b[1] for b in small])


def test_bound_leaves_ties_out_together(spark):
    table = spark.createDataFrame([("en", w, n) for w, n in [("a", 9), ("b", 5), ("c", 5), ("d", 1)]], "lang string, word string, rows long")
    kept = {bound: sorted(r.word for r in language.frequent(table, ["lang"], bound).collect()) for bound in (0, 1, 2, 3, 4)}
    assert kept == {0: [], 1: ["a"], 2: ["a"], 3: ["a", "b", "c"], 4: ["a", "b", "c", "d"]}


def test_words_beyond_the_bound_fall_back_to_their_grams(spark, monkeypatch):
    docs = spark.createDataFrame(edge_rows()[:48], SCHEMA)
    monkeypatch.setattr(language, "WORDS", 0)
    rows = language.predicted(docs, language.learned(docs), ["lang"]).collect()
    assert all(r.lang == r.lang_pred for r in rows)


@pytest.mark.parametrize("rows", [[], [(1, "some text", None, 1, "w", 2)], [(1, "1 2", "en", 1, "w", 2)]])
def test_nothing_to_learn(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    assert [(r.lang_pred, r.score) for r in language.report(docs).collect()] == [("und", 0.0)] * len(rows)


@pytest.mark.parametrize("width", language.LENGTHS)
def test_windows_stay_in_their_words(width):
    words = ["ab", "c", "überlang", "de"]
    _, owner = language.windows(words, width)
    assert owner.tolist() == [i for i, w in enumerate(words) for _ in grams_of(w, width)]


def test_mirrored_windows_differ():
    hashes = language.word_hashes([w.encode() for w in "a b b a b a a b".split()])
    first, *_, last = language.window_hashes(hashes, 4)
    assert first != last


def test_no_other_column_is_an_input(spark):
    docs = spark.createDataFrame(edge_rows(), SCHEMA)
    held = docs.withColumn("held", language.fold() == 1)
    changed = held.select("doc_id", "text", F.when(~F.col("held"), F.col("lang")).alias("lang"))
    one, two = (sorted(map(str, language.report(d).collect())) for d in (docs, changed))
    assert one == two
