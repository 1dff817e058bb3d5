"""Operator 10, line dedup: a suffix array over line-id sequences by distributed prefix doubling.

Every line with a word is an element of its document's sequence; its id is a 128-bit hash of the
trimmed line. Round 0 ranks single lines; each further round joins a position with the prefix that starts
within its own and ranks the longer prefix, until prefixes hold ``min_lines`` lines. Suffixes of
equal rank are one longest-common-prefix interval. Only positions in intervals of two or more go to
the next round, so unique text leaves at once.

In each interval the first position in (doc_id, line) order stays. Any other one is a later copy, unless
it overlaps the first: a copy in the same document starts after the first one's end. Later copies of runs of at
least ``min_lines`` lines, or of at least ``min_words`` words in all, are deleted. Rounds end at ``min_lines``
because longer intervals are nested in those and delete nothing more: a later copy of a longer run is a union of
later copies of ``min_lines`` lines each, as its first copy's end lies before its start. Adjacent deleted
lines are one maximal run.

Only DataFrame functions run. Intervals are aggregated before the shuffle and written, so that the join of a
very common line with its interval can be split.

Defined results: null text counts as empty; lines without words never match and stay; rows that
repeat a doc_id are separate documents in row order; rows without doc_id come last; an empty table
gives no rows; other columns are never read and their names are free.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pvlake.llm.common import documents, id_and_text, store, unpacked, whole_row, whole_text
from pvlake.session import materialize

MIN_LINES = 3
MIN_WORDS = 20
_WORD = r"[^\x20\x09-\x0D]"


def _ranked(positions: DataFrame, length: int) -> DataFrame:
    """Positions in intervals of two or more, with ``later``: a copy of the interval's first that doesn't overlap it."""
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid", "seq")
    intervals = positions.groupBy("a", "b").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    intervals = materialize(intervals.drop("n"), f"llm-intervals-{length}")
    apart = (F.col("rid") != F.col("first.rid")) | (F.col("seq") >= F.col("first.seq") + length)
    return positions.join(intervals, ["a", "b"]).select(*positions.columns, apart.alias("later"))


def repeated_lines(rows: DataFrame, min_lines: int, min_words: int) -> DataFrame:
    """(rid, seq, line) of every line to delete; ``rows`` has rid, doc_id, text."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("line"), F.trim(x).alias("x")))
    one = rows.select(
        "rid", "doc_id", F.posexplode(F.filter(lines, lambda s: s["x"].rlike(_WORD))).alias("seq", "s")).select(
            "rid", "doc_id", "seq", F.col("s.line").alias("line"),
            F.size(F.split("s.x", r"[\x20\x09-\x0D]+")).alias("own"),
            F.xxhash64("s.x").alias("a"), F.xxhash64(F.lit("b"), "s.x").alias("b")).withColumn("words", F.col("own"))
    ranked = materialize(_ranked(materialize(one, "llm-lines"), 1), "llm-lines-1")
    at = ranked.select("rid", "seq", "line")
    marked = []
    for length in range(1, min_lines + 1):
        if length > 1:  # two prefixes of length - 1, the second one line on
            ahead = ranked.select("rid", (F.col("seq") - 1).alias("seq"), F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("words").alias("w2"))
            longer = ranked.drop("later").join(ahead, ["rid", "seq"]).withColumns({
                "a": F.xxhash64("a", "a2"), "b": F.xxhash64(F.lit("b"), "b", "b2"), "words": F.col("own") + F.col("w2")}).drop("a2", "b2", "w2")
            ranked = materialize(_ranked(longer, length), f"llm-lines-{length}")
        hit = F.col("later") if length == min_lines else F.col("later") & (F.col("words") >= min_words)
        marked.append(ranked.where(hit).select("rid", F.explode(F.sequence("seq", F.col("seq") + (length - 1))).alias("seq")))
    every = marked[0]
    for m in marked[1:]:
        every = every.union(m)
    return every.distinct().join(at, ["rid", "seq"])


def deduped(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """(row, text, n_lines, n_removed, n_runs): each row of ``docs`` as a struct, and its text without later copies."""
    held = store(docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"),
                             F.col("text").cast("string").alias("text"), whole_row(docs.drop("text")).alias("row")), "llm-line-docs")
    rows = held.select("rid", "doc_id", whole_text().alias("text"))
    deleted = repeated_lines(rows, min_lines, min_words).groupBy("rid").agg(
        F.collect_list("line").alias("gone"), F.collect_list("seq").alias("seqs"))
    none = F.array().cast("array<int>")
    joined = held.join(deleted, "rid", "left").withColumns({
        "lines": F.split(whole_text(), "\n"), "gone": F.coalesce("gone", none), "seqs": F.coalesce("seqs", none)})
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept_text = F.when(F.size("gone") == 0, F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))
    return joined.select(
        "row", F.when(F.col("text").isNull(), F.lit(None)).otherwise(kept_text).alias("text"), "doc_id",
        F.size("lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_removed"),
        F.size(F.array_except("seqs", F.transform("seqs", lambda p: p + 1))).cast("long").alias("n_runs"))


def line_dedup(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``docs`` without later copies in their text."""
    return unpacked(deduped(docs, min_lines, min_words), docs.columns, text=F.col("text"))


def line_dedup_stage(docs: DataFrame) -> DataFrame:
    """Pipeline form: the columns of ``docs``; a document whose every word was a later copy goes."""
    done = deduped(docs)
    gone = (F.col("n_removed") > 0) & ~whole_text().rlike(_WORD)
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length("text").cast(kind)).otherwise(F.col("row").getField("n_chars"))
    return unpacked(done.where(~gone), docs.columns, **new)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = deduped(id_and_text(documents(spark, sf_dir)))
    return done.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(whole_text(), 256).alias("text_sha256"))


def _windows() -> str:
    """For each length, whether the window of lines at a position is a later copy to delete; a column each."""
    out = []
    for n in range(1, MIN_LINES + 1):
        xs = ", ".join("x" if k == 0 else f"x{k}" for k in range(n))
        first = f"first_value({{}}) OVER (PARTITION BY {xs} ORDER BY doc_id, seq)"
        rule = "" if n == MIN_LINES else f" AND {' + '.join('words' if k == 0 else f'words{k}' for k in range(n))} >= {MIN_WORDS}"
        whole = "" if n == 1 else f"x{n - 1} IS NOT NULL AND "
        out.append(f"{whole}(doc_id <> {first.format('doc_id')} OR seq >= {first.format('seq')} + {n}){rule} AS later{n}")
    return ",\n         ".join(out)


SQL = rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
e AS (
  SELECT doc_id, line, trim(lines[line + 1], ' ') AS x FROM (SELECT doc_id, lines, unnest(range(0, len(lines))) AS line FROM d)
), s AS (
  SELECT doc_id, line, x, row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS seq,
         len(regexp_split_to_array(x, '[\x20\x09-\x0D]+')) AS words
  FROM e WHERE regexp_matches(x, '[^\x20\x09-\x0D]')
), w AS (
  SELECT *, {', '.join(f"lead(x, {k}) OVER (PARTITION BY doc_id ORDER BY seq) AS x{k}, lead(words, {k}) OVER (PARTITION BY doc_id ORDER BY seq) AS words{k}" for k in range(1, MIN_LINES))} FROM s
), m AS (
  SELECT doc_id, seq, {_windows()}
  FROM w
), g AS (
  {" UNION ".join(f"SELECT doc_id, seq + k AS seq FROM m, (SELECT unnest(range(0, {n})) AS k) WHERE later{n}" for n in range(1, MIN_LINES + 1))}
), j AS (
  SELECT s.doc_id, s.seq, s.line, lag(g.seq) OVER (PARTITION BY s.doc_id ORDER BY s.seq) AS prev
  FROM s JOIN g ON s.doc_id = g.doc_id AND s.seq = g.seq
), a AS (
  SELECT doc_id, count(*) AS n_removed, sum((prev IS NULL OR prev <> seq - 1)::BIGINT) AS n_runs, list(line) AS gone FROM j GROUP BY doc_id
)
SELECT d.doc_id, len(lines)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_runs, 0)::BIGINT AS n_runs,
       sha256(CASE WHEN gone IS NULL THEN array_to_string(lines, chr(10))
              ELSE array_to_string([lines[i + 1] for i in range(0, len(lines)) if NOT list_contains(gone, i)], chr(10)) END) AS text_sha256
FROM d LEFT JOIN a USING (doc_id)
"""
