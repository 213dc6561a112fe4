"""Language of a text, learned from labelled texts.

Method: word-first backoff. A word of the lexicon scores by its log frequency in each language.
A word that is not in it scores by its character n-grams, five letters first, and falls back to
the next shorter length as long as none of its n-grams is known; a word's n-gram score is the
mean over those known. Word scores add up, and the language of the highest sum is predicted.

Words are lower-cased runs of word characters without digits and underscores; runs without a
letter are left out. N-grams see a blank on either side of a word, single letters do not.

Scale: words are counted over all training texts, n-grams over all counted words, by aggregation
with partial sums in the tasks. The model that tasks receive has a bound of its own: at most
``WORDS`` (word, language) and ``GRAMS`` (n-gram, language) entries, those of the highest
counts per language and length; counts that would pass the bound leave together, so no tie is
decided. Words beyond it count as unseen, in every language, and are scored by their n-grams.
Entries travel as 64-bit hashes. Texts are scored where they are read, without a shuffle, in
portions of ``PORTION`` words.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so is every text
where nothing could be learned. A null id counts as the empty text in the fold and is not held
out. Equal sums give the language that is first by code point; a text of which nothing is known
is such a tie. Repeated rows are learned as often as they occur. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from typing import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import join_small, written
from granary.llm.shingles import finished, window_hashes, word_hashes

UNKNOWN = "und"
LENGTHS = (5, 4, 3, 2, 1)
WORDS = 1 << 20
GRAMS = 1 << 20
#: Added to every count.
ADDED = 0.5
#: Words scored at once, and different words counted before a task hands them on.
PORTION = 200_000
HELD = 300_000

_RUN = re.compile(r"[^\W\d_]+")


def fold(key: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 3


def words_in(text: str | None) -> list[str]:
    return _RUN.findall(text.lower()) if text else []


def lettered(words: Iterable[str]) -> np.ndarray:
    return np.fromiter((w.isalpha() or any(map(str.isalpha, w)) for w in words), bool)


# --- counting ----------------------------------------------------------------------------

def word_counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, word, rows): occurrences of each word in the texts of each language."""
    def part(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def handed() -> Iterator[pa.RecordBatch]:
            for name, found in counts.items():
                keep = lettered(found)
                words = [w for w, k in zip(found, keep) if k]
                yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(words), pa.string()), "word": pa.array(words, pa.string()),
                                                  "rows": pa.array([found[w] for w in words], pa.int64())})
            counts.clear()

        for batch in batches:
            for body, name in zip(batch.column(0), batch.column(1)):
                counts.setdefault(name.as_py(), Counter()).update(words_in(body.as_py()))
                if sum(map(len, counts.values())) > HELD:
                    yield from handed()
        yield from handed()

    chosen = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("lang is not null and text is not null")
    return chosen.mapInArrow(part, "lang string, word string, rows long").groupBy("lang", "word").agg(F.sum("rows").alias("rows"))


def windows(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and word number of every n-gram of that width within blank-padded words."""
    letters = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(letters) - width + 1
    if not words or n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    blank = letters == 32
    place = np.cumsum(blank)
    # No blank may lie inside; a single letter may not be one.
    inside = place[:n] * 0 if width < 3 else place[width - 2:width - 2 + n] - place[:n]
    valid = ~blank[:n] if width == 1 else inside == 0
    valid &= place[:n] <= len(words)
    return window_hashes(finished(letters.astype(np.uint64)), width)[valid], place[:n][valid] - 1


def gram_counts(words: DataFrame) -> DataFrame:
    """(lang, length, gram, rows): occurrences of each n-gram, from counted words."""
    def part(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, rows = np.array(batch.column("lang").to_pylist(), object), batch.column("rows").to_numpy()
            texts = batch.column("word").to_pylist()
            for name in sorted(set(lang)):
                own = np.flatnonzero(lang == name)
                for width in LENGTHS:
                    grams, owner = windows([texts[i] for i in own], width)
                    keys, at = np.unique(grams, return_inverse=True)
                    total = np.zeros(len(keys), np.int64)
                    np.add.at(total, at, rows[own][owner])
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(keys), pa.string()), "length": pa.array([width] * len(keys), pa.int32()),
                                                      "gram": keys.view(np.int64), "rows": total})

    return words.select("lang", "word", "rows").mapInArrow(part, "lang string, length int, gram long, rows long").groupBy(
        "lang", "length", "gram").agg(F.sum("rows").alias("rows"))


def frequent(table: DataFrame, group: list[str], bound: int) -> DataFrame:
    """Rows of the highest counts per group, at most ``bound``: the least count kept is read off a histogram of counts."""
    falling = Window.partitionBy(*group).orderBy(F.desc("rows"))
    counts = table.groupBy(*group, "rows").agg(F.count(F.lit(1)).alias("k")).withColumn("k", F.sum("k").over(falling))
    least = written(counts.where(F.col("k") <= bound).groupBy(*group).agg(F.min("rows").alias("least")), "language-least")
    return join_small(table, least, group).where(F.col("rows") >= F.col("least")).drop("least")


# --- model -------------------------------------------------------------------------------

class Scores:
    """Log frequencies per language of the known keys of one kind; others score as never seen."""

    def __init__(self, keys: np.ndarray, langs: np.ndarray, rows: np.ndarray, totals: np.ndarray):
        order = np.lexsort((langs, keys))
        keys, self.lang, rows = keys[order], langs[order], rows[order]
        self.keys, starts = np.unique(keys, return_index=True)
        self.starts = np.append(starts, len(keys))
        self.base = totals + ADDED * max(len(self.keys), 1)
        self.log = np.log((rows + ADDED) / self.base[self.lang])

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are known, and a row of scores for each key."""
        out = np.tile(np.log(ADDED / self.base), (len(keys), 1))
        if not len(self.keys):
            return np.zeros(len(keys), bool), out
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[at] == keys
        at, row = at[known], np.flatnonzero(known)
        sizes = self.starts[at + 1] - self.starts[at]
        entry = np.repeat(self.starts[at] - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())
        out[np.repeat(row, sizes), self.lang[entry]] = self.log[entry]
        return known, out


class Model:
    def __init__(self, langs: list[str], words: Scores, grams: dict[int, Scores]):
        self.langs, self.words, self.grams = langs, words, grams

    def word_scores(self, words: list[str]) -> np.ndarray:
        """A row of log scores for each word; zeros where nothing about it is known."""
        known, scores = self.words.of(word_hashes([w.encode("utf-8", "surrogatepass") for w in words]))
        scores[~known] = 0
        unseen = np.flatnonzero(~known)
        for length, table in self.grams.items():
            if not len(unseen):
                break
            grams, owner = windows([words[i] for i in unseen], length)
            held, found = table.of(grams)
            grams, owner, found = grams[held], owner[held], found[held]
            times = np.bincount(owner, minlength=len(unseen))
            for k in range(len(self.langs)):
                sums = np.bincount(owner, weights=found[:, k], minlength=len(unseen))
                scores[unseen, k] = np.divide(sums, times, out=np.zeros(len(unseen)), where=times > 0)
            unseen = unseen[times == 0]
        return scores

    def predict(self, texts: Iterable[str | None]) -> Iterator[tuple[str, float]]:
        """Language and its share among all languages, for one text after another."""
        sums: list[np.ndarray | None] = []
        held: list[str] = []
        owner: list[tuple[int, int]] = []

        def settle() -> None:
            codes, words = pd.factorize(np.array(held, object))
            kept = lettered(words)
            scores = np.zeros((len(words), len(self.langs)))
            scores[kept] = self.word_scores([w for w, k in zip(words, kept) if k])
            at = 0
            for number, size in owner:
                own = codes[at:at + size]
                at += size
                if kept[own].any():
                    part = scores[own].sum(axis=0)
                    sums[number] = part if sums[number] is None else sums[number] + part
            held.clear()
            owner.clear()

        for number, text in enumerate(texts):
            words = words_in(text) if self.langs else []
            sums.append(None)
            for start in range(0, len(words), PORTION):
                part = words[start:start + PORTION]
                held.extend(part)
                owner.append((number, len(part)))
                if len(held) >= PORTION:
                    settle()
        if held:
            settle()
        for total in sums:
            if total is None:
                yield UNKNOWN, 0.0
            else:
                best = int(total.argmax())
                yield self.langs[best], float(1 / np.exp(total - total[best]).sum())


def learned(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Counts all of ``docs`` and gathers the bounded model."""
    words = written(word_counts(docs, text, lang), "language-words")
    totals = {r.lang: r.rows for r in words.groupBy("lang").agg(F.sum("rows").alias("rows")).collect()}
    langs = sorted(totals)
    if not langs:
        return Model([], Scores(*[np.empty(0, t) for t in (np.uint64, np.int64, np.int64)], np.ones(0)), {})
    number = {name: i for i, name in enumerate(langs)}

    def entries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = word_hashes([w.encode("utf-8", "surrogatepass") for w in batch.column("word").to_pylist()])
            yield pa.RecordBatch.from_pydict({"lang": batch.column("lang"), "length": pa.array([0] * len(hashes), pa.int32()),
                                              "gram": hashes.view(np.int64), "rows": batch.column("rows")})

    grams = written(gram_counts(words), "language-grams")
    sums = {(r.lang, r.length): r.rows for r in grams.groupBy("lang", "length").agg(F.sum("rows").alias("rows")).collect()}
    sums |= {(name, 0): rows for name, rows in totals.items()}
    kept = frequent(words, ["lang"], WORDS // len(langs)).select("lang", "word", "rows")
    table = kept.mapInArrow(entries, "lang string, length int, gram long, rows long").unionByName(
        frequent(grams, ["lang", "length"], GRAMS // (len(LENGTHS) * len(langs))).select("lang", "length", "gram", "rows")).toArrow()
    length = table.column("length").to_numpy()
    keys, rows = table.column("gram").to_numpy().view(np.uint64), table.column("rows").to_numpy()
    own = np.array([number[name] for name in table.column("lang").to_pylist()], np.int64)

    def scores(n: int) -> Scores:
        at = length == n
        return Scores(keys[at], own[at], rows[at], np.array([sums.get((name, n), 0) for name in langs], float))

    return Model(langs, scores(0), {n: scores(n) for n in LENGTHS})


def predicted(docs: DataFrame, model: Model, kept: list[str], text: str = "text") -> DataFrame:
    """The columns ``kept`` with lang_pred and score, one row per row of ``docs``."""
    def part(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(model.predict(t.as_py() for t in batch.column(0)))
            columns = batch.columns[1:] + [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "lang_pred", "score"])

    chosen = docs.select(F.col(text).alias("__text"), *kept)
    types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return chosen.mapInArrow(part, f"{types}, lang_pred string, score double")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the documents that are not held out."""
    held = docs.select("doc_id", "text", "lang", (fold() == 1).alias("held_out"))
    model = learned(held.where(~F.col("held_out")))
    return predicted(held, model, ["doc_id", "held_out"])
