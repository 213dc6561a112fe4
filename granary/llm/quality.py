"""Quality rules: a table of thresholds compiled into one projection.

Every rule is an integer comparison ``scale * measure`` against ``bound * base`` over measures
of the same row, so the whole verdict is a chain of narrow projections: no shuffle, no user
function, and the same decision on every engine.

Defined results: a null or blank text has no words, all measures are 0 and the base rule on
length rejects it. Repeated rows are judged one by one and agree. Columns of the input other
than the text are passed through, whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import BLANK_RUN, text_of, where_computed, words_of

P = "__quality_"
#: Low bits of a packed window that hold its place in the text.
PLACE_BITS = 24
PLACE = (1 << PLACE_BITS) - 1
NOT_BLANK = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"

#: Frequent function words of English, Spanish, French and German.
STOP_WORDS = (
    "the be to of and that have with in is are was for on it as at by this from or an a "
    "de la que el en y los del se las por un una con no para su al lo como es "
    "le les des et est du dans qui ne pas pour sur au ce il avec "
    "der die und den von zu das mit sich ist im dem nicht ein eine auf für"
).split()

MEASURES = ("n_words", "word_chars", "n_symbols", "n_marks", "n_stop_words", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """Rejects a row if ``scale * measure`` is below ``low * base`` or above ``high * base``."""

    name: str
    measure: str
    scale: int = 1
    base: str | None = None
    low: int | None = None
    high: int | None = None


#: Part of every verdict.
BASE_RULES = (
    Rule("too_short", "n_words", low=50),
    Rule("repeated_windows", "n_repeat_words", 100, "n_words", high=50),
)
#: The method's own table. Bounds are wide: they are meant for boilerplate, not for style.
RULES = (
    Rule("word_length", "word_chars", 1, "n_words", low=2, high=20),
    Rule("symbols", "n_symbols", 100, "n_words", high=40),
    Rule("marks", "n_marks", 100, "n_words", high=60),
    Rule("stop_words", "n_stop_words", low=2),
    Rule("duplicate_lines", "n_dup_lines", 100, "n_lines", high=50),
)


def _count_of(text: Column, characters: str) -> Column:
    rest = text
    for c in characters:
        rest = F.replace(rest, F.lit(c), F.lit(""))
    return F.length(text) - F.length(rest)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the measures as long columns named ``__quality_`` + name."""
    t, w, k, e, p, lines = (P + x for x in ("t", "w", "k", "e", "p", "lines"))
    keep = list(docs.columns)
    step = docs.select(*keep, text_of(text).alias(t))
    step = step.select(*keep, t, words_of(F.col(t)).alias(w),
                       F.filter(F.split(t, "\n", -1), lambda x: x.rlike(NOT_BLANK)).alias(lines))
    # Each window of three words as one long: hash above, place below, so that equal ones sort together.
    packed = F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(F.lit(~PLACE)).bitwiseOR(i.cast("long")))
    lowered = F.filter(F.split(F.lower(t), BLANK_RUN, -1), lambda x: x.isin(STOP_WORDS))
    step = step.select(
        *keep, w, F.sort_array(F.slice(packed, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0)))).alias(e),
        F.size(w).cast("long").alias(P + "n_words"),
        F.length(F.array_join(w, "")).cast("long").alias(P + "word_chars"),
        _count_of(F.col(t), SYMBOLS).cast("long").alias(P + "n_symbols"),
        _count_of(F.col(t), "!?").cast("long").alias(P + "n_marks"),
        F.size(lowered).cast("long").alias(P + "n_stop_words"),
        F.size(lines).cast("long").alias(P + "n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias(P + "n_dup_lines"),
    )
    counted = [P + m for m in MEASURES if m != "n_repeat_words"]
    step = step.select(*keep, *counted, w, F.filter(e, lambda x, j: _same(F.get(e, j - 1), x) | _same(x, F.get(e, j + 1))).alias(k))
    # Equal hashes of unequal windows, or places beyond the low bits: sort the windows themselves.
    doubtful = (F.size(w) > PLACE) | F.exists(
        F.transform(k, lambda x, j: F.when(_same(x, F.get(k, j + 1)), _window(w, x) != _window(w, F.get(k, j + 1)))),
        lambda x: F.coalesce(x, F.lit(False)))
    places = F.when(doubtful, _places_of_repeats(w)).otherwise(F.transform(k, lambda x: x.bitwiseAND(F.lit(PLACE)).cast("int")))
    step = step.select(*keep, *counted, F.sort_array(places).alias(p))
    # A window covers three words, or as many as there are up to the next repeated window.
    covered = F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3))))
    repeat = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x).alias(P + "n_repeat_words")
    return step.select(*keep, *counted, repeat)


def _same(a: Column, b: Column) -> Column:
    """Equal hash bits; false beside the ends."""
    return F.coalesce(F.shiftrightunsigned(a.bitwiseXOR(b), PLACE_BITS) == 0, F.lit(False))


def _window(w: str, packed: Column) -> Column:
    i = packed.bitwiseAND(F.lit(PLACE)).cast("int")
    return F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))


def _places_of_repeats(w: str) -> Column:
    """Places of repeated windows by sorting the windows' own text."""
    texts = F.slice(F.transform(w, lambda x, i: F.struct(F.concat_ws(" ", x, F.get(w, i + 1), F.get(w, i + 2)).alias("k"), i.alias("i"))),
                    F.lit(1), F.greatest(F.size(w) - 2, F.lit(0)))
    # A one-element array binds the sorted windows to a name inside the expression.
    bound = F.transform(F.array(F.sort_array(texts)), lambda e: F.transform(
        F.filter(e, lambda x, j: F.get(e, j - 1)["k"].eqNullSafe(x["k"]) | F.get(e, j + 1)["k"].eqNullSafe(x["k"])), lambda x: x["i"]))
    return F.get(bound, F.lit(0))


def _broken(rule: Rule) -> Column:
    value = F.col(P + rule.measure) * rule.scale
    base = F.col(P + rule.base) if rule.base else F.lit(1)
    out = F.lit(False)
    if rule.low is not None:
        out = out | (value < base * rule.low)
    if rule.high is not None:
        out = out | (value > base * rule.high)
    return out


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Adds the measures, ``__quality_base_failed`` and the names of all broken rules."""
    base = F.lit(False)
    for rule in BASE_RULES:
        base = base | _broken(rule)
    names = F.array_compact(F.array(*[F.when(_broken(r), F.lit(r.name)) for r in (*BASE_RULES, *rules)]))
    return measure(docs, text).select("*", base.alias(P + "base_failed"), names.alias(P + "broken"))


def accepted(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows that break no rule, with the columns of the input."""
    # The row travels as one value, so that its own names cannot clash with those of the measures.
    held = docs.select(F.struct(*docs.columns).alias(P + "row"), F.col(text).alias(P + "text"))
    judged = judge(held, rules, P + "text").select(P + "row", (F.size(P + "broken") == 0).alias(P + "kept"))
    return where_computed(judged, F.col(P + "kept")).select(P + "row.*")


def report(docs: DataFrame) -> DataFrame:
    """One row per document: its measures and the verdict."""
    judged = judge(docs.select("doc_id", "text"))
    return judged.select(
        "doc_id", *[F.col(P + m).alias(m) for m in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        F.col(P + "base_failed").alias("base_failed"), (F.size(P + "broken") == 0).alias("kept"),
        F.array_join(P + "broken", ",").alias("broken"))


def _sql_rule(rule: Rule) -> str:
    base = rule.base or "1"
    parts = []
    if rule.low is not None:
        parts.append(f"{rule.scale} * {rule.measure} < {rule.low} * {base}")
    if rule.high is not None:
        parts.append(f"{rule.scale} * {rule.measure} > {rule.high} * {base}")
    return "(" + " OR ".join(parts) + ")"


def measures_sql(source: str = "documents") -> str:
    """DuckDB SQL: one row per document with its measures (``doc_id`` is taken as a key)."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"""
    SELECT d.doc_id, len(w) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
           length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
           length(t) - length(regexp_replace(t, '[!?]', '', 'g')) AS n_marks,
           len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS n_stop_words,
           len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
           coalesce(r.n, 0) AS n_repeat_words
    FROM (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
                 list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
          FROM {source}) d
    LEFT JOIN (
        SELECT doc_id, count(DISTINCT i + o) AS n
        FROM (SELECT doc_id, i, k, count(*) OVER (PARTITION BY doc_id, k) AS c
              FROM (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k
                    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i
                          FROM (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM {source})))) x,
             (VALUES (0), (1), (2)) v(o)
        WHERE c > 1 GROUP BY doc_id) r ON r.doc_id = d.doc_id"""


def report_sql(source: str = "documents") -> str:
    rules = (*BASE_RULES, *RULES)
    base = " OR ".join(_sql_rule(r) for r in BASE_RULES)
    broken = " OR ".join(_sql_rule(r) for r in rules)
    names = ", ".join(f"CASE WHEN {_sql_rule(r)} THEN '{r.name}' END" for r in rules)
    return f"""SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       ({base}) AS base_failed, NOT ({broken}) AS kept, concat_ws(',', {names}) AS broken
FROM ({measures_sql(source)}) m"""
