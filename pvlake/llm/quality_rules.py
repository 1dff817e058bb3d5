"""Operator 1, quality rules: a threshold table compiled into one Spark projection.

Measures are built-in expressions over the whole text; every rule of ``RULES`` is a ratio with a
lowest and a highest allowed value and becomes one boolean of the projection. No user function
runs and nothing is shuffled: each row is judged on its own.

Defined results: null and empty texts have no words, fail the base rule and are not kept; repeated
rows are judged one by one; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pvlake.llm.common import WS, documents, whole_text

#: Frequent function words of the corpus' languages, lower case, in the order of the languages.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "it", "with", "as", "was", "on", "are", "by", "this", "at", "from", "or", "an", "a",
    "der", "die", "und", "das", "den", "von", "zu", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als",
    "de", "la", "le", "et", "les", "un", "une", "du", "dans", "qui", "que", "au", "pour", "pas", "sur", "par", "est", "en",
    "el", "y", "los", "se", "del", "las", "por", "con", "no", "una", "su", "para", "al", "lo", "como",
)
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """``numerator / denominator`` must lie between ``low`` and ``high`` (None: open)."""

    name: str
    numerator: str
    denominator: str
    low: float | None = None
    high: float | None = None


#: The threshold table. Texts under 50 words are too short for the ratio of function words.
RULES = (
    Rule("mean_word_chars", "word_chars", "n_words", 2.0, 14.0),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.2),
    Rule("marks_per_word", "n_marks", "n_words", None, 0.3),
    Rule("stop_words_per_word", "n_stop_words", "n_long_words", 0.02, None),
    Rule("dup_lines_per_line", "n_dup_lines", "n_lines", None, 0.7),
)


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, text and the counts that rules read, all over whole texts; ``row`` is the whole row."""
    base = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"),
                       F.struct(*[docs[c] for c in docs.columns]).alias("row")).withColumn("text", whole_text())
    split = base.select(
        "*", F.array_remove(F.split("text", WS), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    counted = split.select(
        "*", F.size("words").cast("long").alias("n_words"),
        F.when(F.size("words") >= WINDOW, F.transform(
            F.sequence(F.lit(0), F.size("words") - WINDOW),
            lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)]))).otherwise(
                F.array().cast("array<bigint>")).alias("windows"))
    return counted.select(
        "doc_id", "text", "row", "n_words",
        # a filter on the verdict must not be pushed below this projection, where it would repeat its work per word
        F.monotonically_increasing_id().alias("at"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        _matches(r"[#*$%&|<>]").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.when(F.size("windows") == F.size(F.array_distinct("windows")), F.lit(0)).otherwise(
            _covered(F.col("windows"))).cast("long").alias("n_repeat_words"),
        _matches("!").alias("n_marks"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.when(F.col("n_words") >= 50, F.col("n_words")).alias("n_long_words"))


def _matches(pattern: str) -> Column:
    return (F.char_length("text") - F.char_length(F.regexp_replace("text", pattern, ""))).cast("long")


def _bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: a lambda's variable holds it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _covered(windows: Column) -> Column:
    """Words inside windows that occur twice or more: sort (window, position), compare neighbours, add the steps."""
    pairs = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def repeated(p: Column) -> Column:
        same = F.filter(p, lambda x, k: F.coalesce(F.get(p, k - 1)["h"] == x["h"], F.lit(False))
                        | F.coalesce(F.get(p, k + 1)["h"] == x["h"], F.lit(False)))
        return F.sort_array(F.transform(same, lambda x: x["i"]))

    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    return F.aggregate(
        _bind(pairs, repeated), start,
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")),
        lambda a: a["n"])


def compile_rules(rules: tuple[Rule, ...] = RULES) -> dict[str, Column]:
    """Each rule as a boolean column, true where the text breaks it; a ratio without a denominator breaks nothing."""
    out = {}
    for r in rules:
        ratio = F.try_divide(F.col(r.numerator).cast("double"), F.col(r.denominator).cast("double"))
        breaks = F.lit(False)
        if r.low is not None:
            breaks = breaks | (ratio < r.low)
        if r.high is not None:
            breaks = breaks | (ratio > r.high)
        out[r.name] = F.coalesce(breaks, F.lit(False))
    return out


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts, the base verdict, the broken rules' names and the final verdict of each document."""
    broken = compile_rules(rules)
    any_broken = F.lit(False)
    for c in broken.values():
        any_broken = any_broken | c
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in broken.items()]))
    return measures(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), ((F.col("at") >= 0) & ~base_failed() & ~any_broken).alias("kept"),
        F.array_join(names, ",").alias("broken_rules"))


def quality_stage(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Pipeline form: the rows of ``docs`` that are kept, unchanged."""
    any_broken = F.lit(False)
    for c in compile_rules(rules).values():
        any_broken = any_broken | c
    return measures(docs).where((F.col("at") >= 0) & ~base_failed() & ~any_broken).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


def _sql(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB statement of the same projection; the rule table is compiled a second time, into SQL."""
    tests = {}
    for r in rules:
        ratio = f"({r.numerator}::DOUBLE / nullif({r.denominator}, 0)::DOUBLE)"
        parts = ([f"{ratio} < {r.low!r}"] if r.low is not None else []) + ([f"{ratio} > {r.high!r}"] if r.high is not None else [])
        tests[r.name] = f"coalesce({' OR '.join(parts)}, false)"
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         [x for x in regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> ''] AS words,
         [x for x in string_split(coalesce(text, ''), chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines
  FROM documents
), w AS (
  SELECT doc_id, i, list_slice(words, i, i + 4) AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM d)
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM w) WHERE n > 1
), c AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (length(text) - length(replace(text, '!', '')))::BIGINT AS n_marks,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines)::BIGINT AS n_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len([x for x in words if lower(x) IN ({stops})])::BIGINT AS n_stop_words,
         CASE WHEN len(words) >= 50 THEN len(words) END AS n_long_words
  FROM d LEFT JOIN c USING (doc_id)
), b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT ({' OR '.join(tests.values())}) AS kept,
       concat_ws(',', {', '.join(f"CASE WHEN {c} THEN '{n}' END" for n, c in tests.items())}) AS broken_rules
FROM b
"""


SQL = _sql()
