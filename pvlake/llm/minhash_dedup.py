"""Operator 2, MinHash near-dedup with tensored banding.

Rows with the same shingle set (size and 128-bit fingerprint) are one class. Two collections of
``HALVES`` half keys, each of ``PER_HALF`` minhashes, are computed per class; a table's key joins
one half of the first collection with one of the second. So ``HALVES ** 2`` tables of
``2 * PER_HALF`` hashes need only ``2 * HALVES * PER_HALF`` minhashes.

``ROUNDS`` first rounds look at single halves: each class is compared with the best of a few leaders of
its halves in other components, and what it links with is joined. A half's leader is first the holder
with most company, which is the centre of a group of copies, then a random one. This takes large
groups together with few comparisons. What can still have a partner is narrowed before pairs are
formed. A pair at 0.8 shares under ``LEAST_HALVES`` single halves with probability 7e-6, so classes
with fewer halves in common with other components go. Of the rest, the full sets tell how many shingles of a class any other class holds; a
pair needs that many on both sides, which excludes the far edges of large groups without comparing
them one by one. The last round groups what is left by its halves: classes that share a half of the
first collection, directly or through others, and among these again by the halves of the second. So
every pair that shares a key is in one candidate group, and the work grows with the halves and not with their
products. A group is compared in blocks of ``BLOCK`` classes, a pair
of blocks a task: classes that are still apart, whose sizes, shared shingles and common minhashes
allow 0.8, are confirmed on full sets until they are joined. Only links leave a task.

At similarity 0.8 a pair misses all tables with probability 9e-5, and less above. No partner is
capped. Comparing minhashes inside a candidate group is quadratic in the classes of one group that
the first rounds and the counts of shared shingles leave.

Defined results: null texts and texts without words have an empty set and link with nothing; rows
that repeat a doc_id are documents of their own with the same id; rows without doc_id come last in
order; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pvlake.llm.common import documents, id_and_text, mix, sliced, store, text_buffers, unpacked, whole_row, whole_text
from pvlake.llm.components import components
from pvlake.llm.shingles import minhashes, shingle_sets
from pvlake.session import materialize

HALVES, PER_HALF = 14, 3
COUNT = 2 * HALVES * PER_HALF
#: Least number of common minhashes of a pair to be confirmed; at similarity 0.8 fewer are common with probability 1e-4.
LEAST_COMMON = 53
BLOCK = 1024
#: A column of this name, where ``docs`` has it, numbers the rows.
#: First rounds, and the holders that a class is compared with in each.
ROUNDS, HOLDERS = 1, 6
LEAST_HALVES = 4
SLICE = 4 << 20
#: Class ids up to this count (16 bytes each) are broadcast to find their texts; beyond it the join shuffles.
BROADCAST_IDS = 1_000_000


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64), pa.int64())


def _signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, SLICE):
            sets, offsets = shingle_sets(*text_buffers(batch), size)
            sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(sets, k))]) for k in (11, 12)]
            marks = minhashes(sets, offsets, COUNT)
            # key halves: a hash of the PER_HALF minhashes and the half's number
            halves = sum(mix(marks[:, k::PER_HALF].astype(np.uint64), 20 + k) for k in range(PER_HALF))
            halves = mix(halves + np.arange(halves.shape[1], dtype=np.uint64) * np.uint64(_ODD), 30).view(np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(np.diff(offsets), pa.int64()),
                *[_signed(s[offsets[1:]] - s[offsets[:-1]]) for s in sums],
                pa.array([m.tobytes() for m in marks], pa.binary()),
                pa.array(list(halves), pa.list_(pa.int64())),
            ], names=["rid", "doc_id", "n", "fa", "fb", "marks", "halves"])
    return run


_ODD = 0xD1342543DE82EF95
_SIGNATURES = "rid long, doc_id long, n long, fa long, fb long, marks binary, halves array<long>"


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, SLICE):
            sets, offsets = shingle_sets(*text_buffers(batch), size)
            sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(sets, k))]) for k in (11, 12)]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.diff(offsets), pa.int64()),
                *[_signed(s[offsets[1:]] - s[offsets[:-1]]) for s in sums],
                pa.array([sets[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary()),
            ], names=["n", "fa", "fb", "shingles"])
    return run


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = [len(v.as_buffer()) // 8 if v.as_buffer() else 0 for v in batch.column(1)]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(batch.column(0).to_numpy(), sizes), pa.int64()),
            _signed(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64))], names=["cid", "s"])


def _near_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the number of common minhashes and drops pairs that share too few."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = (np.frombuffer(b"".join(batch.column(batch.schema.get_field_index(c)).to_pylist()), np.uint32).reshape(-1, COUNT)
                for c in ("marks_a", "marks_b"))
        common = (x == y).sum(axis=1)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(common, pa.int64())],
                                         names=["a", "b", "common"]).filter(pa.array(common >= LEAST_COMMON))


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _blocks(percent: int):
    """Links inside one pair of blocks: classes apart, confirmed on full sets, none that an earlier link makes needless."""
    def run(table: pa.Table) -> pa.Table:
        get = lambda name: table.column(name).to_numpy()
        cid, root, n, c, first = get("cid"), get("root"), get("n"), get("c"), get("first")
        marks = np.frombuffer(b"".join(table.column("marks").to_pylist()), np.uint32).reshape(-1, COUNT)
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        joined = {r: r for r in np.unique(root).tolist()}

        def top(r: int) -> int:
            while joined[r] != r:
                joined[r] = joined[joined[r]]
                r = joined[r]
            return r

        left, right = np.flatnonzero(first), np.flatnonzero(~first)
        same = not len(right)
        right = left if same else right
        links = []
        for i in left.tolist():
            others = right[right > i] if same else right
            others = others[(root[others] != root[i])
                            & (100 * np.minimum(n[others], n[i]) >= percent * np.maximum(n[others], n[i]))
                            & ((100 + percent) * np.minimum(c[others], c[i]) >= percent * (n[others] + n[i]))]
            common = (marks[others] == marks[i]).sum(axis=1)
            order = np.argsort(-common, kind="stable")
            for j in others[order[common[order] >= LEAST_COMMON]].tolist():
                x, y = top(int(root[i])), top(int(root[j]))
                if x != y:
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                        joined[max(x, y)] = min(x, y)
                        links.append((cid[i], cid[j]))
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return run


def led(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(a, b): each class and the least one of its key, for keys whose holders are not all joined."""
    least = rows.groupBy(*keys).agg(F.min("cid").alias("b"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi")
    return rows.join(least.select(*keys, "b"), keys).select(F.col("cid").alias("a"), "b").distinct()


class NearDuplicates:
    """One run over ``docs``; each step's table is written once."""

    def __init__(self, docs: DataFrame, size: int, percent: int, rid=None):
        self.percent, self.size = percent, size
        self.docs = id_and_text(docs)
        rid = F.monotonically_increasing_id() if rid is None else rid
        self.rows = materialize(docs.select(
            rid.alias("rid"), docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).select(
            "rid", "doc_id", whole_text().alias("text")).mapInArrow(_signatures(size), _SIGNATURES), "llm-near")
        place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid")
        # the class id keeps document order, so the smallest class of a component holds its first document
        self.members = materialize(self.rows.where("n > 0").groupBy("n", "fa", "fb").agg(F.min(place).alias("first")), "llm-near-first")
        self.classes = materialize(self.members.select(F.col("first.rid").alias("rid")).join(self.rows, "rid").withColumnRenamed("rid", "cid"), "llm-near-class")

    def halves(self) -> DataFrame:
        """(cid, i, h): halves of both collections that two classes or more hold."""
        half = self.classes.select("cid", F.posexplode("halves").alias("i", "h"))
        shared = half.groupBy("h").agg(F.count("*").alias("c")).where("c > 1")
        held = materialize(half.join(materialize(shared, "llm-near-shared"), "h"), "llm-near-holders")
        company = held.groupBy("cid").agg(F.sum("c").alias("company"))
        return materialize(held.drop("c").join(company, "cid").join(self.classes.select("cid", "n"), "cid"), "llm-near-halves")

    @staticmethod
    def mixed(halves: DataFrame, roots: DataFrame, turn: int) -> DataFrame:
        """Halves whose holders are not all joined, with each holder's root and the half's random leader."""
        small = roots.count() <= BROADCAST_IDS
        rooted = materialize(halves.join(F.broadcast(roots) if small else roots, halves["cid"] == roots["node"], "left").select(
            "cid", "i", "h", "company", "n", F.coalesce("root", "cid").alias("root")), "llm-near-rooted")
        rank = F.col("company") if turn == 0 else F.xxhash64("cid", F.lit(turn))
        leader = F.max(F.struct(rank.alias("r"), F.col("cid"), F.col("root")))
        apart = rooted.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), leader.alias("x"), F.min("n").alias("least_n")).where("lo != hi").select(
            "h", F.col("x.cid").alias("a"), F.col("x.root").alias("root_a"), "least_n")
        return rooted.join(materialize(apart, "llm-near-mixed"), "h")

    @staticmethod
    def groups(mixed: DataFrame) -> DataFrame:
        """(node, root) of candidate groups: classes that share a half of the first collection, directly or through others,
        and within such a group a half of the second. A pair that shares a key shares both, so it is in one group."""
        first = components(led(mixed.where(F.col("i") < HALVES), ["h"]), "llm-near-u")
        second = mixed.where(F.col("i") >= HALVES).join(first.select(F.col("node").alias("cid"), F.col("root").alias("u")), "cid")
        return components(led(second, ["u", "h"]), "llm-near-g")

    def with_marks(self, pairs: DataFrame) -> DataFrame:
        """(a, b, common) of pairs that their sizes and minhashes allow."""
        side = lambda s: self.classes.select(F.col("cid").alias(s), F.col("n").alias(f"n_{s}"), F.col("marks").alias(f"marks_{s}"))
        return pairs.join(side("a"), "a").join(side("b"), "b").where(
            F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * self.percent).select(
            "a", "b", "marks_a", "marks_b").mapInArrow(_near_marks, "a long, b long, common long")

    def sets(self, ids: DataFrame, name: str) -> DataFrame:
        """(cid, shingles) of the classes in ``ids``, from their first documents' whole texts."""
        wanted = materialize(ids.distinct().join(self.classes.select("cid", "doc_id", "n", "fa", "fb"), "cid"), f"{name}-ids")
        by_id = wanted.select("doc_id").distinct()
        if wanted.count() <= BROADCAST_IDS:
            by_id = F.broadcast(by_id)
        texts = self.docs.join(by_id, self.docs["doc_id"].eqNullSafe(by_id["doc_id"]), "left_semi")
        sets = texts.mapInArrow(_sets(self.size), "n long, fa long, fb long, shingles binary")
        return materialize(wanted.select("cid", "n", "fa", "fb").join(sets, ["n", "fa", "fb"]).groupBy("cid").agg(
            F.first("shingles").alias("shingles")), f"{name}-sets")

    def confirmed(self, pairs: DataFrame, name: str) -> DataFrame:
        """Pairs whose full sets are as similar as asked for."""
        pairs = materialize(pairs.select("a", "b"), f"{name}-pairs")
        sets = self.sets(pairs.select(F.col("a").alias("cid")).union(pairs.select("b")), name)
        side = lambda s: sets.select(F.col("cid").alias(s), F.col("shingles").alias(f"shingles_{s}"))
        return materialize(pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "shingles_a", "shingles_b").mapInArrow(
            _confirm(self.percent), "a long, b long"), f"{name}-links")

    def able(self, mixed: DataFrame) -> tuple[DataFrame, DataFrame]:
        """((cid, c) of classes that may still have a partner, their sets); c: shingles that another class holds."""
        ids = mixed.groupBy("cid").agg(F.count("*").alias("c"), F.max((F.col("i") < HALVES).cast("int")).alias("u"),
                                       F.max((F.col("i") >= HALVES).cast("int")).alias("v"),
                                       F.min("least_n").alias("least_n"), F.max("n").alias("n")).where(
            (F.col("c") >= LEAST_HALVES) & (F.col("u") == 1) & (F.col("v") == 1)).drop("c")
        sets = self.sets(ids.select("cid"), "llm-near-able")
        each = sets.mapInArrow(_exploded, "cid long, s long")
        held = each.groupBy("s").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi")).where("lo != hi").select("s")
        shared = each.join(held, "s").groupBy("cid").agg(F.count("*").alias("c"))
        least = F.greatest(F.col("least_n"), F.col("n") * self.percent / 100)  # no partner can be smaller
        able = shared.join(ids, "cid").where(F.col("c") * (100 + self.percent) >= (F.col("n") + least) * self.percent)
        return materialize(able.select("cid", "c"), "llm-near-able"), sets

    def first_round(self, mixed: DataFrame, turn: int) -> DataFrame:
        chosen = mixed.where("root != root_a").groupBy("cid").agg(F.slice(F.sort_array(F.collect_set(
            F.struct(F.xxhash64("a", F.lit(turn)).alias("r"), "a"))), 1, HOLDERS).alias("x"))
        pairs = chosen.select(F.explode("x.a").alias("a"), F.col("cid").alias("b"))
        best = self.with_marks(pairs).groupBy("b").agg(F.max(F.struct("common", "a")).alias("x"))
        return self.confirmed(best.select("x.a", "b"), f"llm-near-{turn}")

    def last_round(self, halves: DataFrame, roots: DataFrame) -> DataFrame:
        """Links between classes that the first rounds left apart."""
        able, sets = self.able(self.mixed(halves, roots, ROUNDS))
        mixed = self.mixed(halves.join(able.select("cid"), "cid"), roots, ROUNDS)
        mixed = materialize(mixed.select("cid", "root", "i", "h"), "llm-near-left")
        groups = self.groups(mixed)
        size = groups.groupBy("root").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
        roots = mixed.select("cid", F.col("root").alias("own")).distinct()
        rows = materialize(groups.withColumnRenamed("root", "g").join(size.withColumnRenamed("root", "g"), "g").select(
            F.col("node").alias("cid"), "g", "blocks", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block")).join(
                roots, "cid").join(able, "cid").join(self.classes.select("cid", "n", "marks"), "cid").join(sets, "cid"), "llm-near-rows")
        # a class goes to each pair of blocks that holds its block, as the first or the second
        paired = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
            "g", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") <= F.col("other")).alias("first"),
            "cid", F.col("own").alias("root"), "n", "c", "marks", "shingles")
        return materialize(paired.groupBy("g", "i", "j").applyInArrow(_blocks(self.percent), "a long, b long"), "llm-near-last")

    def run(self) -> DataFrame:
        halves = self.halves()
        links = roots = None
        for turn in range(ROUNDS):
            mixed = self.mixed(halves, halves.select(F.col("cid").alias("node"), F.col("cid").alias("root")).limit(0) if roots is None else roots, turn)
            found = self.first_round(mixed, turn)
            links = found if links is None else links.union(found)
            roots = components(links, f"llm-near-c{turn}")
        more = self.last_round(halves, roots)
        roots = components(links.union(more), "llm-near-c")
        # root: smallest class id; the component's first document is the least of its classes' first documents
        classes = self.members.select("n", "fa", "fb", "first", F.col("first.rid").alias("cid"))
        labelled = classes.join(roots, classes["cid"] == roots["node"], "left").select(
            "n", "fa", "fb", "first", F.coalesce("root", "cid").alias("root"))
        labelled = materialize(labelled, "llm-near-roots")
        first = materialize(labelled.groupBy("root").agg(F.min("first").alias("top")), "llm-near-top")
        top = materialize(labelled.join(first, "root").select("n", "fa", "fb", "top"), "llm-near-out")
        out = self.rows.select("rid", "doc_id", "n", "fa", "fb").join(top, ["n", "fa", "fb"], "left")
        return out.select(
            "rid", "doc_id", F.col("n").alias("n_shingles"),
            F.when(F.col("top").isNull(), F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("component_id"),
            F.coalesce(F.col("rid") == F.col("top.rid"), F.lit(True)).alias("first"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, rid=None) -> DataFrame:
    """rid, doc_id, n_shingles, component_id and whether the row is its component's first. ``rid``: a column that
    numbers the rows for good (by default they are numbered here)."""
    return NearDuplicates(docs, size, percent, rid).run()


def near_duplicate_stage(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Pipeline form: the rows of ``docs`` but for all but the first of each component."""
    held = store(docs.select(whole_row(docs).alias("row"), F.monotonically_increasing_id().alias("rid")), "llm-near-docs")
    texts = held.select("rid", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"))
    gone = materialize(near_duplicates(texts, size, percent, F.col("rid")).where(~F.col("first")).select("rid"), "llm-near-gone")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return unpacked(held.join(gone, "rid", "left_anti"), docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), size=4).select(
        "doc_id", "n_shingles", "component_id", F.col("first").alias("kept"))
