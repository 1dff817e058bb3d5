"""Operator 12, mixing sources to target weights: budgets found on hash-threshold histograms.

Sources in code-point order (null last) weigh 1, 2, 3, 1, ... and share the words of all documents;
a source stops at ``limit`` times its own words and the excess is shared again by weight. A source
takes its documents as often as its budget holds them whole, and the rest of the budget from the
documents below a hash threshold, so a smaller budget's documents are among a larger one's.

The threshold is found without sorting documents. A document's key is the first 60 bits of the MD5 of
its id and text. Words are summed by source and the leading ``DIGIT`` bits of the key; the bucket
in which the budget ends is split by the next bits, for its own rows alone, until it holds one
document or the bits are used up. Documents below the bucket are taken whole, those above are not;
the documents of the last bucket share what is left, the one at the border with its first words.

Every source's taken words equal its target rounded to a whole word. The row that the budget ends
in depends on the rows alone, so reruns agree.

Defined results: null text has no words and nothing is taken from it; a null source is a source of
its own; rows without doc_id and rows that repeat one are documents like others (equal rows are
interchangeable); a source without words has target 0; an empty table gives no rows; other columns
are never read by the query and carried unchanged by ``mixed_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pvlake.llm.common import documents, store
from pvlake.llm.running import running
from pvlake.operators.ranking import ordinal_position
from pvlake.session import materialize

WEIGHTS = (1, 2, 3)
LIMIT = 3
WORD = r"[^\x20\x09-\x0D]+"
KEY_BITS = 60
#: Bits a histogram splits by: at most 1,024 buckets a source.
DIGIT = 10
#: Source tables of more rows are joined by a shuffle (a row is under 200 bytes, so this is at most 20 MB).
BROADCAST_ROWS = 100_000
_BIG = "decimal(38,0)"


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _sized(docs: DataFrame, row: Column) -> DataFrame:
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    source = docs["source"].cast("string")
    digest = F.md5(F.concat_ws(":", F.coalesce(docs["doc_id"].cast("string"), F.lit("")), text).cast("binary"))
    return docs.select(
        F.coalesce(F.md5(source.cast("binary")), F.lit("none")).alias("s"), source.alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), digest.alias("digest"),
        F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long").alias("key"), row.alias("row"))


def source_targets(sized: DataFrame, weights: tuple = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """(s, source_size, target) of each source; ``sized`` has s, source and size.

    The level is the words a unit of weight gets. Each round raises it by what capped sources leave,
    so a source once capped stays so; the rounds end when no further source is.
    """
    totals = sized.groupBy("s", "source").agg(F.sum("size").alias("source_size"))
    ranked = ordinal_position(totals, [F.col("source").asc_nulls_last()]).select(
        "s", "source_size", F.element_at(F.array(*map(F.lit, weights)), (F.col("pos") % len(weights) + 1).cast("int")).alias("weight"))
    ranked = materialize(ranked, "llm-mix-sources")
    total, weight = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    free, share = total or 0, weight or 1
    cap = (F.col("source_size") * limit).cast(_BIG)
    while True:
        over = F.col("weight") * F.lit(free).cast(_BIG) > cap * F.lit(share).cast(_BIG)
        taken, left = ranked.agg(F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight")))).first()
        now = (total or 0) - int(taken or 0), left or share
        if now == (free, share):
            break
        free, share = now
    level = F.col("weight").cast("double") * F.lit(float(free)) / F.lit(float(share))
    return ranked.select("s", "source_size", F.when(over, cap.cast("double")).otherwise(level).alias("target"))


def mix(docs: DataFrame, row: Column, weights: tuple = WEIGHTS, limit: int = LIMIT, digit: int = DIGIT) -> DataFrame:
    """(row, size, source_size, target, taken) of each document; ``row`` is what to carry of it."""
    sized = store(_sized(docs, row), "llm-mix-sized")
    targets = source_targets(sized, weights, limit)
    budget = F.floor(F.col("target") + 0.5)
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    targets = materialize(targets.withColumns({"times": whole, "part": budget - whole * F.col("source_size")}), "llm-mix-targets")
    border, bits = None, 0
    inside = sized
    while border is None or (bits < KEY_BITS and border.where("n > 1").limit(1).count()):
        bits = min(KEY_BITS, bits + digit)
        bucket = F.shiftright("key", KEY_BITS - bits)
        sums = inside.groupBy("s", bucket.alias("bucket")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        known = targets.select("s", F.col("part").alias("room")) if border is None else border.select("s", "room")
        upto = F.sum("words").over(Window.partitionBy("s").orderBy("bucket"))
        found = sums.join(_small(known), "s").withColumn("upto", upto).where(
            "upto > room AND upto - words <= room").select("s", "bucket", (F.col("room") - F.col("upto") + F.col("words")).alias("room"), "n")
        border = materialize(found, f"llm-mix-border-{bits}")
        inside = materialize(inside.join(_small(border.select("s", "bucket")), "s").where(bucket == F.col("bucket")).drop("bucket"),
                             f"llm-mix-inside-{bits}")
    bucket = F.shiftright("key", KEY_BITS - bits)
    cuts = _small(targets.join(border.select("s", "bucket", "room"), "s", "left"))
    at_border = running(inside.select("s", "size", "digest", "row"), "s", ["digest"], {"upto": (F.sum, "size")}, "llm-mix-last").join(cuts, "s")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("room") - F.col("upto") + F.col("size")))
    others = sized.join(cuts, "s").where(F.col("bucket").isNull() | (bucket != F.col("bucket")))
    below = F.when(bucket < F.col("bucket"), F.col("size")).otherwise(0)
    return at_border.withColumn("p", part).select("row", "size", "source_size", "target", "times", "p").union(
        others.withColumn("p", below).select("row", "size", "source_size", "target", "times", "p")).select(
            "row", "size", "source_size", "target", (F.col("size") * F.col("times") + F.col("p")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """The mix itself: each document's row once for every time it is taken, the last time perhaps cut after its first words."""
    done = mix(docs, F.struct(*[docs[c] for c in docs.columns]), weights, limit).where("taken > 0")
    copies = done.withColumn("_left", F.explode(F.expr("transform(sequence(0L, (taken - 1) div size), i -> taken - i * size)")))
    text = F.col("row.text").cast("string")
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), 1, F.col("_left").cast("int")), "")
    return copies.select(*[(F.when(F.col("_left") < F.col("size"), cut).otherwise(text) if c == "text" else F.col("row").getField(c)).alias(c)
                           for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    done = mix(docs, docs["doc_id"].cast("long"))
    return done.select(F.col("row").alias("doc_id"), "size", "source_size", "target", "taken")


SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(concat_ws(':', coalesce(doc_id::VARCHAR, ''), coalesce(text, ''))) AS digest
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS pos FROM d GROUP BY source
), w AS (
  SELECT source, source_size, [{', '.join(map(str, WEIGHTS))}][pos % {len(WEIGHTS)} + 1] AS weight FROM s
), o AS (
  SELECT *, sum(source_size) OVER () AS total,
         coalesce(sum({LIMIT} * source_size) OVER before, 0) AS capped, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS free
  FROM w WINDOW before AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT (total - capped)::DOUBLE AS free_words, free::DOUBLE AS free_weight FROM o
  WHERE {LIMIT} * source_size * free >= weight * (total - capped) ORDER BY source_size::DOUBLE / weight, source NULLS LAST LIMIT 1
), t AS (
  SELECT source, source_size, least(({LIMIT} * source_size)::DOUBLE, weight::DOUBLE * free_words / free_weight) AS target FROM w, l
), b AS (
  SELECT *, floor(target + 0.5)::BIGINT AS budget, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS times FROM t
), c AS (
  SELECT d.doc_id, d.size, b.source_size, b.target, b.times, b.budget - b.times * b.source_size AS part,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.digest ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target, (size * times + greatest(0, least(size, part - upto + size)))::BIGINT AS taken FROM c
"""
