"""Operator 11, conversation prefix trie by whole-sequence collapse.

Conversations are rebuilt (``rebuild``), identical ones become one weighted sequence named by its
smallest conv_id, and only those sequences are walked. A node is a prefix of a sequence; its key is
(depth, two 64-bit values), each the exclusive or of a hash of (position, turn digest) over its turns. So
a whole sequence's key is one aggregate, prefixes are running totals, and a parent's key is the key
without its last turn. Sequences that are proper prefixes of others fall out by an anti-join; the rest
are the leaves. Every node belongs to the sequence of its smallest member, which carries its numbers
once: totals from the end of each sequence towards its start, added up by node, are subtree totals.

No group has to fit into a task: running totals split long conversations (``running``), members of a
node are joined in blocks, and the digest of a node's members reads those blocks as a
stream. Texts never travel, only their MD5 and length. Different nodes share a key with
probability about pairs / 2 ** 128.

Defined results: rows without conv_id belong to no conversation; null role and text become empty;
turns of equal number (null is a number of its own, before the others) are ordered by the MD5
of role and text, and repeated rows are turns of their own; an empty table gives no rows, any
other one a root; other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pvlake.llm.common import on_workers
from pvlake.llm.running import running
from pvlake.session import materialize

#: Conversations that share their first turns, and the number of different shares.
HUNDRED, SHARES = 100, 6
#: Member ids a block holds.
BLOCK = 512
_KEY = ["pos", "x1", "x2"]


def rebuild(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations (c), rebuilt turns (c, pos, chars, v1, v2)): the first h turns of the hundred's first conversation, then the own ones after h."""
    conv = conversations.select(conversations["conv_id"].cast("long").alias("c"), conversations["turn"].cast("long").alias("turn"),
                                F.coalesce(conversations["role"].cast("string"), F.lit("")).alias("r"),
                                F.coalesce(conversations["text"].cast("string"), F.lit("")).alias("t")).where("c IS NOT NULL")
    turns = conv.select("c", "turn", F.md5(F.concat(F.char_length("r").cast("string"), F.lit(":"), "r", "t").cast("binary")).alias("digest"),
                        F.char_length("t").cast("long").alias("chars"))
    own = materialize(running(turns, "c", ["turn", "digest"], {"pos": (F.count, "digest")}, "llm-trie-turns").drop("turn"), "llm-trie-own")
    h = F.crc32(F.col("c").cast("string").cast("binary")) % SHARES
    known = materialize(own.groupBy("c").agg(F.least(F.count("*"), F.lit(SHARES)).alias("n")), "llm-trie-known")
    plan = known.select("c", h.alias("h"), (F.col("c") - F.col("c") % HUNDRED).alias("base")).join(
        known.where(F.col("c") % HUNDRED == 0).select(F.col("c").alias("base"), F.col("n").alias("n_base")), "base", "left")
    plan = materialize(plan.withColumn("skip", F.col("h") - F.least("h", F.coalesce("n_base", F.lit(0)))).drop("n_base"), "llm-trie-plan")
    heads = own.where((F.col("c") % HUNDRED == 0) & (F.col("pos") < SHARES)).withColumnRenamed("c", "base")
    shared = plan.drop("skip").join(heads, "base").where("pos <= h").select("c", "pos", "digest", "chars")
    rest = own.where(F.col("pos") > h).join(plan.select("c", "skip"), "c").select("c", (F.col("pos") - F.col("skip")).alias("pos"), "digest", "chars")
    turns = shared.union(rest).select("c", "pos", "chars", F.xxhash64("digest", "pos").alias("v1"), F.xxhash64(F.lit("b"), "pos", "digest").alias("v2"))
    return known.select("c"), materialize(turns, "llm-trie-rebuilt")


def _collapsed(convs: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(whole sequence of each conversation, distinct sequences with smallest conversation and weight)."""
    zero = F.lit(0).cast("long")
    parts = turns.select("c", F.lit(1).alias("one"), "v1", "v2").union(convs.select("c", F.lit(0), zero, zero))
    wholes = materialize(parts.groupBy("c").agg(F.sum("one").alias("pos"), F.bit_xor("v1").alias("x1"), F.bit_xor("v2").alias("x2")), "llm-trie-wholes")
    return wholes, materialize(wholes.groupBy(*_KEY).agg(F.min("c").alias("c"), F.count("*").alias("weight")), "llm-trie-sequences")


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal keys as comma-joined ids, ``BLOCK`` at most; rows come in order of key and id."""
    names = [*_KEY, "first", "ids"]
    for b in batches:
        cols: list[list] = [[], [], [], [], []]
        rows = zip(*[b.column(b.schema.get_field_index(k)).to_pylist() for k in [*_KEY, "c"]], strict=True)
        for key, members in groupby(rows, lambda r: r[:3]):
            ids = [r[3] for r in members]
            for i in range(0, len(ids), BLOCK):
                for col, v in zip(cols, (*key, ids[i], ",".join(map(str, ids[i:i + BLOCK]))), strict=True):
                    col.append(v)
        yield pa.RecordBatch.from_pydict(dict(zip(names, cols, strict=True)), pa.schema([*[(k, pa.int64()) for k in names[:4]], ("ids", pa.string())]))


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's blocks, read one after another."""
    schema = pa.schema([*[(k, pa.int64()) for k in _KEY], ("ends_sha256", pa.string())])
    now, state = None, None
    for b in batches:
        out = []
        for *key, ids in zip(*[b.column(b.schema.get_field_index(k)).to_pylist() for k in [*_KEY, "ids"]], strict=True):
            if key != now:
                if now is not None:
                    out.append((*now, state.hexdigest()))
                now, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 4, schema, strict=True)], schema=schema)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*now, state.hexdigest()), schema, strict=True)], schema=schema)


def end_digests(wholes: DataFrame) -> DataFrame:
    """(key, SHA-256 of the ascending comma-joined ids of the conversations that end there)."""
    on_workers(wholes.sparkSession)
    n = int(wholes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = wholes.repartitionByRange(n, *_KEY, "c").sortWithinPartitions(*_KEY, "c")
    blocks = dealt.mapInArrow(_blocks, "pos long, x1 long, x2 long, `first` long, ids string")
    return blocks.repartition(*_KEY).sortWithinPartitions(*_KEY, "first").mapInArrow(_digests, "pos long, x1 long, x2 long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """A row for each node, with its key (``pos`` = depth, x1, x2)."""
    convs, turns = rebuild(conversations)
    wholes, sequences = _collapsed(convs, turns)
    held = turns.join(sequences.select("c", "weight", F.col("pos").alias("n")), "c")
    paths = materialize(running(held, "c", ["pos"], {"x1": (F.bit_xor, "v1"), "x2": (F.bit_xor, "v2")}, "llm-trie-held"), "llm-trie-paths")
    inner = paths.where("pos < n").select(*_KEY).distinct()
    leaves = sequences.where("pos > 0").join(inner, _KEY, "left_anti").select(*_KEY, F.lit(1).alias("leaf"))
    nodes = paths.groupBy(*_KEY).agg(
        F.sum("weight").alias("n_convs"), F.min("c").alias("c"), F.min("chars").alias("chars"),
        F.min(F.col("x1").bitwiseXOR(F.col("v1"))).alias("p1"), F.min(F.col("x2").bitwiseXOR(F.col("v2"))).alias("p2"))
    nodes = nodes.join(leaves, _KEY, "left").withColumns({
        "leaf": F.coalesce("leaf", F.lit(0)), "saved": (F.col("n_convs") - 1) * F.col("chars")})
    nodes = materialize(nodes, "llm-trie-nodes")
    # each node on the path of its smallest member only
    carried = paths.select("c", *_KEY).join(nodes.select("c", *_KEY, "leaf", "saved"), ["c", *_KEY], "left").fillna(0, ["leaf", "saved"])
    carried = carried.withColumn("up", -F.col("pos"))
    below = running(carried, "c", ["up"], {"n_leaves": (F.sum, "leaf"), "saved_tokens": (F.sum, "saved")}, "llm-trie-carried")
    below = below.groupBy(*_KEY).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    children = nodes.groupBy((F.col("pos") - 1).alias("pos"), F.col("p1").alias("x1"), F.col("p2").alias("x2")).agg(F.count("*").alias("n_children"))
    zero = F.lit(0).cast("long")
    root = wholes.select("c", F.lit(1).alias("n"), zero.alias("kids"), zero.alias("leaf"), zero.alias("saved")).union(
        nodes.select(F.lit(None), zero, (F.col("pos") == 1).cast("long"), "leaf", "saved")).agg(
            F.min("c").alias("conv_id"), F.sum("n").alias("n_convs"), F.sum("kids").alias("n_children"),
            F.greatest(F.sum("leaf"), F.lit(1)).alias("n_leaves"), F.sum("saved").alias("saved_tokens")).where("n_convs > 0")
    up = nodes.select((F.col("pos") + 1).alias("pos"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("c").alias("parent")).union(
        root.select(F.lit(1).cast("long"), zero, zero, "conv_id"))
    up = materialize(up, "llm-trie-parents")
    rows = nodes.drop("leaf", "saved", "chars").join(up, ["pos", "p1", "p2"], "left").join(below, _KEY, "left").join(children, _KEY, "left")
    rows = rows.select(*_KEY, F.col("c").alias("conv_id"), F.col("parent").alias("parent_conv_id"), "n_convs",
                       F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens")
    rows = rows.union(root.select(zero, zero, zero, "conv_id", F.lit(None).cast("long"), "n_convs", "n_children", "n_leaves", "saved_tokens"))
    ends = end_digests(wholes)
    return rows.join(ends, _KEY, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = trie(on_workers(spark).read.parquet(f"{sf_dir}/conversations.parquet"))
    return nodes.select("conv_id", F.col("pos").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


_CRC = """xor(4294967295::UBIGINT, list_reduce(
  list_prepend(4294967295::UBIGINT, list_transform(string_split(c::VARCHAR, ''), lambda ch: ascii(ch)::UBIGINT)),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
    lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END))))"""

SQL = f"""
WITH i AS (
  SELECT conv_id AS c, turn, md5(concat(length(coalesce(role, ''))::VARCHAR, ':', coalesce(role, ''), coalesce(text, ''))) AS d,
         length(coalesce(text, '')) AS chars
  FROM conversations WHERE conv_id IS NOT NULL
), o AS (
  SELECT c, d, chars, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, d) AS pos FROM i
), v AS (
  SELECT c, c - c % {HUNDRED} AS base, ({_CRC} % {SHARES})::BIGINT AS h FROM (SELECT DISTINCT c FROM o)
), b AS (
  SELECT v.c, 0 AS part, o.pos, o.d, o.chars FROM v JOIN o ON o.c = v.base AND o.pos <= v.h
  UNION ALL SELECT v.c, 1, o.pos, o.d, o.chars FROM v JOIN o ON o.c = v.c AND o.pos > v.h
), r AS (
  SELECT c, d, chars, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS depth FROM b
), p AS (
  SELECT c, depth, chars, string_agg(d, '') OVER (PARTITION BY c ORDER BY depth) AS k FROM r
  UNION ALL SELECT c, 0, 0, '' FROM v
), w AS (
  SELECT c, max(depth) AS depth, arg_max(k, depth) AS k FROM p GROUP BY c
), n AS (
  SELECT depth, k, min(c) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars FROM p GROUP BY depth, k
), u AS (
  SELECT n.*, m.conv_id AS parent_conv_id, m.k AS parent FROM n LEFT JOIN n m ON m.depth = n.depth - 1 AND m.k = left(n.k, 32 * (n.depth - 1)::INT) AND n.depth > 0
), kids AS (
  SELECT depth - 1 AS depth, parent AS k, count(*) AS n_children FROM u WHERE depth > 0 GROUP BY 1, 2
), below AS (
  SELECT p.depth, p.k, sum((n.n_convs - 1) * n.chars) AS saved_tokens, sum((kids.k IS NULL)::INT) AS n_leaves
  FROM n JOIN p ON p.c = n.conv_id AND p.depth <= n.depth LEFT JOIN kids ON kids.depth = n.depth AND kids.k = n.k
  GROUP BY 1, 2
), ends AS (
  SELECT depth, k, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM w GROUP BY 1, 2
)
SELECT u.conv_id, u.depth, u.parent_conv_id, u.n_convs, coalesce(kids.n_children, 0) AS n_children, below.n_leaves::BIGINT AS n_leaves,
       below.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(ends.ids, '')) AS ends_sha256
FROM u LEFT JOIN kids USING (depth, k) LEFT JOIN below USING (depth, k) LEFT JOIN ends USING (depth, k)
"""
