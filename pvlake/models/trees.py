"""Regression trees on binned rows.

Each input is cut into at most ``BINS`` bins once, and the rows are written as blocks of
one byte a value, so a fit reads a fraction of the vectors' bytes and never decodes them
again. A level of the open nodes is one pass: every task adds up its blocks' rows by node,
input and bin, the sums of a node meet in one task, and its best split comes back. Nothing
that reaches the driver grows with the rows.

A forest grows a node like that while it holds more than ``LOCAL_ROWS`` rows. The rows of a
smaller node are gathered in one task, which grows the rest of its tree there: a deep tree
has thousands of nodes with a few rows each, and sums by bin would be far larger than these
rows. Binned rows of at most ``SHARED_BYTES`` are sent to the workers as a whole, and then
nothing is shuffled. Weights and the inputs tried at a node are hashes of its place in the
tree and of the row's place in its block, so all ways give the same trees.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pvlake.llm.common import on_workers
from pvlake.session import materialize

BINS = 32
BLOCK_ROWS = 65_536
#: Rows for which a partition more is worth its task.
TASK_ROWS = 25_000
LOCAL_ROWS = 1_000_000
SHARED_BYTES = 256 << 20
#: Trees of a forest grown at a time where rows are shuffled.
BATCH_TREES = 20
#: Bytes of trees that the driver and a worker hold at a time.
MODEL_BYTES = 128 << 20
#: A split has to take this share of a node's sum of squares off at least: less is rounding.
LEAST_GAIN = 1e-12

TREE = "tree int, node long, n int, feature binary, cut binary, left binary, value binary"
NODES = pa.schema([("tree", pa.int32()), ("node", pa.int64()), ("n", pa.int32()), *[(c, pa.binary()) for c in ("feature", "cut", "left", "value")]])


@dataclass
class Tree:
    """Nodes in arrays; ``left`` is -1 at a leaf, the right child follows the left one. Codes up to ``cut`` go left."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray

    @staticmethod
    def leaf(value: float) -> Tree:
        return Tree(np.zeros(1, np.int32), np.zeros(1, np.uint8), np.full(1, -1, np.int32), np.array([value]))

    @staticmethod
    def read(row) -> Tree:
        return Tree(np.frombuffer(row["feature"], np.int32), np.frombuffer(row["cut"], np.uint8), np.frombuffer(row["left"], np.int32), np.frombuffer(row["value"]))

    def row(self, tree: int, node: int) -> dict:
        return {"tree": tree, "node": node, "n": len(self.left), "feature": self.feature.tobytes(), "cut": self.cut.tobytes(), "left": self.left.tobytes(), "value": self.value.tobytes()}

    def reach(self, codes: np.ndarray) -> np.ndarray:
        """The leaf of each row of ``codes`` (rows x inputs)."""
        at, rows = np.zeros(len(codes), np.int32), np.arange(len(codes))
        while len(rows):
            here = at[rows]
            inner = self.left[here] >= 0
            rows, here = rows[inner], here[inner]
            at[rows] = self.left[here] + (codes[rows, self.feature[here]] > self.cut[here])
        return at

    def predict(self, codes: np.ndarray) -> np.ndarray:
        return self.value[self.reach(codes)]

    def grafted(self, parts: dict[int, Tree]) -> Tree:
        """With the leaves ``parts`` names replaced by trees."""
        out, size = [self.feature.copy(), self.cut.copy(), self.left.copy(), self.value.copy()], len(self.left)
        more: list[list[np.ndarray]] = [[x] for x in out]
        for at, t in parts.items():
            moved = np.where(t.left >= 0, t.left + (size - 1), -1).astype(np.int32)
            for whole, own, some in zip(out, (t.feature, t.cut, moved, t.value), more, strict=True):
                whole[at] = own[0]
                some.append(own[1:])
            size += len(t.left) - 1
        return Tree(*[np.concatenate(x) for x in more])


def _mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _key(*parts: int) -> np.ndarray:
    out = np.zeros(1, np.uint64)
    for p in parts:
        out = _mixed(out ^ np.uint64(p & (2**64 - 1)))
    return out


def tried(seed: int, tree: int, nodes: np.ndarray, n: int, k: int) -> np.ndarray:
    """``k`` of ``n`` inputs for each node (its number counts from 1 at the root, children are 2i and 2i + 1)."""
    if k >= n:
        return np.broadcast_to(np.arange(n), (len(nodes), n))
    at = _mixed(_key(seed, tree) ^ nodes.astype(np.uint64))
    with np.errstate(over="ignore"):
        order = _mixed(at[:, None] + np.arange(n, dtype=np.uint64)[None] * np.uint64(0xD1B54A32D192ED03))
    return np.argpartition(order, k - 1, axis=1)[:, :k]


def best_cuts(count: np.ndarray, total: np.ndarray, n: np.ndarray, s: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """For each row of bin counts and sums: (bin, gain, count left, sum left) of its best split; gain -inf without one."""
    nl, sl = count.cumsum(axis=1)[:, :-1], total.cumsum(axis=1)[:, :-1]
    nr, sr = n[:, None] - nl, s[:, None] - sl
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where((nl >= least) & (nr >= least), sl * sl / nl + sr * sr / nr, -np.inf)
    cut, rows = gain.argmax(axis=1), np.arange(len(gain))
    return cut, gain[rows, cut] - s * s / np.maximum(n, 1e-300), nl[rows, cut], sl[rows, cut]


def grow(codes: np.ndarray, weight: np.ndarray, value: np.ndarray, depth: int, least: int, k: int, seed: int, tree: int, root: int = 1) -> Tree:
    """A tree on rows that one task holds, level by level with all nodes of a level at once."""
    width, used = codes.shape[1], np.flatnonzero(weight)
    flat, at, w = np.ascontiguousarray(codes).ravel(), used * width, weight[used].astype(float)
    wy = w * value[used]
    node, names = np.zeros(len(used), np.intp), np.array([root])
    n, s, q = np.array([w.sum()]), np.array([wy.sum()]), np.array([(wy * value[used]).sum()])
    out: list[tuple[np.ndarray, ...]] = []
    size = 0
    while True:
        size += len(names)
        some, mean, split = len(names), s / np.maximum(n, 1e-300), np.zeros(len(names), bool)
        if depth > 0 and len(node):
            chosen = tried(seed, tree, names, width, k)
            feature, cut, gain, nl, sl = np.zeros(some, np.int32), np.zeros(some, np.intp), np.full(some, -np.inf), np.zeros(some), np.zeros(some)
            base = node * BINS
            for j in range(chosen.shape[1]):
                f = chosen[:, j]
                key = base + flat[at + f[node]]
                got = best_cuts(np.bincount(key, w, some * BINS).reshape(some, BINS), np.bincount(key, wy, some * BINS).reshape(some, BINS), n, s, least)
                better = (got[1] > gain) | ((got[1] == gain) & (f < feature))
                feature[better], cut[better], gain[better], nl[better], sl[better] = f[better], got[0][better], got[1][better], got[2][better], got[3][better]
            split = gain > LEAST_GAIN * q
            rank = np.cumsum(split) - 1
            out.append((np.where(split, feature, 0).astype(np.int32), np.where(split, cut, 0).astype(np.uint8), np.where(split, size + 2 * rank, -1).astype(np.int32), mean))
        else:
            out.append((np.zeros(some, np.int32), np.zeros(some, np.uint8), np.full(some, -1, np.int32), mean))
        if not split.any():
            return Tree(*[np.concatenate(x) for x in zip(*out, strict=True)])
        stays = split[node]
        node, at, w, wy = node[stays], at[stays], w[stays], wy[stays]
        node = 2 * rank[node] + (flat[at + feature[node]] > cut[node])
        pair = lambda a, b: np.stack([a, b], axis=1).ravel()
        names = pair(2 * names[split], 2 * names[split] + 1)
        n, s = pair(nl[split], n[split] - nl[split]), pair(sl[split], s[split] - sl[split])
        q = np.bincount(node, wy * wy / w, len(names))
        depth -= 1


# ------------------------------------------------------------------ binned rows
@dataclass
class Binned:
    """Blocks of rows: ``codes`` (a byte for each row and input) and the kept columns as doubles."""

    blocks: DataFrame
    cuts: list[np.ndarray]
    rows: int

    @property
    def width(self) -> int:
        return len(self.cuts)

    def written(self, blocks: DataFrame, name: str) -> Binned:
        """``blocks`` in as many partitions, written in place of these."""
        return Binned(materialize(blocks, name).coalesce(self.blocks.rdd.getNumPartitions()), self.cuts, self.rows)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def coded(values: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bins of each row; missing values are in the last one."""
    out = np.empty(values.shape, np.uint8)
    for i, c in enumerate(cuts):
        out[:, i] = np.searchsorted(c, values[:, i], side="left")
    return out


def find_cuts(table: DataFrame, width: int) -> list[np.ndarray]:
    """Thresholds of each input over all rows: between all values where they are few, else quantiles."""
    arrays = table.select(vector_to_array("features").alias("v"))

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {i: np.empty(0) for i in range(width)}
        for b in batches:
            values = _matrix(b.column(0), width)
            for i in [i for i, x in seen.items() if len(x) <= BINS]:
                seen[i] = np.unique(np.concatenate([seen[i], values[:, i][~np.isnan(values[:, i])]]))
        yield pa.RecordBatch.from_pydict({"i": pa.array(list(seen), pa.int32()), "v": pa.array([x[:BINS + 1].tolist() for x in seen.values()], pa.list_(pa.float64()))})

    values: dict[int, set[float]] = {i: set() for i in range(width)}
    for r in arrays.mapInArrow(few, "i int, v array<double>").collect():
        values[r["i"]].update(r["v"])
    many = [i for i, x in values.items() if len(x) > BINS]
    probs = [0.0, *[j / (BINS - 1) for j in range(1, BINS - 1)]]
    found = arrays.select(*[F.col("v")[i].alias(f"c{i}") for i in many]).approxQuantile([f"c{i}" for i in many], probs, 0.001) if many else []
    out = [(lambda x: (x[:-1] + x[1:]) / 2)(np.array(sorted(values[i]))) for i in range(width)]
    for i, q in zip(many, found, strict=True):
        out[i] = np.unique(np.array(q))
    return out


def bin_rows(table: DataFrame, keep: list[str], name: str) -> Binned:
    """``table`` with a vector column ``features``, written as blocks."""
    spark = on_workers(table.sparkSession)
    first = table.select("features").first()
    if first is None:
        raise ValueError(f"{name}: no rows to fit on")
    cuts, width = find_cuts(table, first[0].size), first[0].size

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, n, number = TaskContext.get().partitionId(), [], 0, 0

        def packed() -> pa.RecordBatch:
            whole = [np.concatenate(x) for x in zip(*held, strict=True)]
            return pa.RecordBatch.from_pydict({"block": pa.array([part << 32 | number], pa.int64()), "codes": [whole[0].tobytes()], **{k: [x.tobytes()] for k, x in zip(keep, whole[1:], strict=True)}})

        for b in batches:
            held.append([coded(_matrix(b.column(0), width), cuts), *[b.column(1 + i).to_numpy(zero_copy_only=False) for i in range(len(keep))]])
            n += b.num_rows
            if n >= BLOCK_ROWS:
                yield packed()
                held, n, number = [], 0, number + 1
        if n:
            yield packed()

    arrays = table.select(vector_to_array("features").alias("v"), *[F.col(c).cast("double").alias(c) for c in keep])
    out = materialize(arrays.mapInArrow(blocks, "block long, codes binary, " + ", ".join(f"{c} binary" for c in keep)), name)
    spread = min(max(1, table.rdd.getNumPartitions()), 4 * spark.sparkContext.defaultParallelism)
    return Binned(out.coalesce(spread), cuts, table.count())


def task_rows(spark: SparkSession, rows: int) -> int:
    """Rows a partition holds: a few partitions for each core, if there are rows for them."""
    return max(TASK_ROWS, -(-rows // (4 * spark.sparkContext.defaultParallelism)))


def each_block(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[int, np.ndarray, dict[str, np.ndarray]]]:
    for b in batches:
        for r in b.to_pylist():
            number, codes = r.pop("block"), np.frombuffer(r.pop("codes"), np.uint8).reshape(-1, width)
            yield number, codes, {k: np.frombuffer(x) if isinstance(x, bytes) else x for k, x in r.items()}


# --------------------------------------------------------------- levels over blocks
class Growing:
    """A tree whose open nodes are split by passes over all blocks."""

    def __init__(self):
        self.feature, self.cut, self.left, self.value = [0], [0], [-1], [0.0]
        self.names, self.counts = [1], [math.inf]
        self.open = [0]

    def tree(self) -> Tree:
        return Tree(np.array(self.feature, np.int32), np.array(self.cut, np.uint8), np.array(self.left, np.int32), np.array(self.value))

    def take(self, at: int, r) -> list[int]:
        """The best split of a node; returns its children."""
        self.value[at], self.counts[at] = r["mean"], r["count"]
        if r["feature"] is None:
            return []
        self.feature[at], self.cut[at], self.left[at] = r["feature"], r["cut"], len(self.left)
        for i in (0, 1):
            self.feature.append(0), self.cut.append(0), self.left.append(-1)
            self.value.append(r["sums"][i] / r["counts"][i]), self.counts.append(r["counts"][i])
            self.names.append(2 * self.names[at] + i)
        return [len(self.left) - 2, len(self.left) - 1]


#: (block number, its columns, its codes) -> for each tree (weights, values).
Weigh = Callable[[int, dict, np.ndarray], list[tuple[np.ndarray, np.ndarray]]]


def split_open(data: Binned, weigh: Weigh, growing: list[Growing], ids: list[int], least: int, k: int, seed: int) -> None:
    """One pass over the blocks: the open nodes of all trees are split, their children become the open ones."""
    width, trees, opened = data.width, [g.tree() for g in growing], [g.open for g in growing]
    if not any(opened):
        return

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((2, width, len(o), BINS)) for o in opened]
        squares = [np.zeros(len(o)) for o in opened]
        place = []
        for t, o in zip(trees, opened, strict=True):
            p = np.full(len(t.left), -1, np.intp)
            p[o] = np.arange(len(o))
            place.append(p)
        for number, codes, columns in each_block(batches, width):
            across = np.ascontiguousarray(codes.T)
            for i, (w, y) in enumerate(weigh(number, columns, codes)):
                if not opened[i]:
                    continue
                node = place[i][trees[i].reach(codes)]
                used = np.flatnonzero((w > 0) & (node >= 0))
                base, wu, n = node[used] * BINS, w[used], len(opened[i]) * BINS
                wy = wu * y[used]
                squares[i] += np.bincount(node[used], wy * y[used], len(opened[i]))
                for f in range(width):
                    key = base + across[f][used]
                    total[i][0, f] += np.bincount(key, wu, n).reshape(-1, BINS)
                    total[i][1, f] += np.bincount(key, wy, n).reshape(-1, BINS)
        for i, o in enumerate(opened):
            for j, at in enumerate(o):
                yield pa.RecordBatch.from_pydict({"tree": pa.array([i], pa.int32()), "at": pa.array([at], pa.int32()), "squares": [float(squares[i][j])], "sums": [total[i][:, :, j].tobytes()]})

    names = [{at: g.names[at] for at in g.open} for g in growing]

    def best(key: tuple, rows: pa.Table) -> pa.Table:
        tree, at = (x.as_py() for x in key)
        count, total = sum(np.frombuffer(x).reshape(2, width, BINS) for x in rows.column("sums").to_pylist())
        q = sum(rows.column("squares").to_pylist())
        n, s = count[0].sum(), total[0].sum()
        chosen = np.sort(tried(seed, ids[tree], np.array([names[tree][at]]), width, k)[0])
        cut, gain, nl, sl = best_cuts(count[chosen], total[chosen], np.full(len(chosen), n), np.full(len(chosen), s), least)
        j = int(gain.argmax())
        split = gain[j] > LEAST_GAIN * q
        return pa.table({"tree": pa.array([tree], pa.int32()), "at": pa.array([at], pa.int32()), "mean": [float(s / n) if n else 0.0], "count": [float(n)],
                         "feature": pa.array([int(chosen[j]) if split else None], pa.int32()), "cut": pa.array([int(cut[j])], pa.int32()),
                         "counts": [[float(nl[j]), float(n - nl[j])]], "sums": [[float(sl[j]), float(s - sl[j])]]})

    found = data.blocks.mapInArrow(sums, "tree int, at int, squares double, sums binary").groupBy("tree", "at").applyInArrow(
        best, "tree int, at int, mean double, count double, feature int, cut int, counts array<double>, sums array<double>").collect()
    for i, g in enumerate(growing):
        g.open = [c for r in sorted((r for r in found if r["tree"] == i), key=lambda r: r["at"]) for c in g.take(r["at"], r)]


def grow_over_blocks(data: Binned, weigh: Weigh, depth: int, least: int, k: int, seed: int, tree: int) -> Tree:
    """A whole (shallow) tree by passes over the blocks."""
    g = Growing()
    for _ in range(depth):
        split_open(data, weigh, [g], [tree], least, k, seed)
    return g.tree()


# ----------------------------------------------------------------------- forest
def bag(seed: int, tree: int, number: int, rows: int) -> np.ndarray:
    """How often each row of a block is drawn for a tree: Poisson with mean 1, as for draws with replacement."""
    return np.random.default_rng([seed, tree, number]).poisson(1.0, rows).astype(float)


@dataclass
class Forest:
    """Mean of its trees, which stay in a table of the checkpoint folder."""

    trees: DataFrame
    cuts: list[np.ndarray]
    count: int

    def batches(self) -> list[tuple[int, int]]:
        """Ranges of trees that a worker holds at a time."""
        out, held = [[0, 0]], 0
        for r in self.trees.groupBy("tree").agg(F.sum("n").alias("n")).orderBy("tree").collect():
            held += r["n"] * 17
            if held > MODEL_BYTES and out[-1][1] > out[-1][0]:
                out.append([r["tree"], r["tree"]])
                held = r["n"] * 17
            out[-1][1] = r["tree"] + 1
        return [(a, b) for a, b in out]

    def load(self, first: int, end: int) -> list[Tree]:
        parts: dict[int, dict[int, Tree]] = {}
        for r in self.trees.filter(F.col("tree").between(first, end - 1)).collect():
            parts.setdefault(r["tree"], {})[r["node"]] = Tree.read(r)
        return [(p.pop(-1).grafted(p) if -1 in p else p[0]) for p in parts.values()]

    def predict(self, rows: DataFrame, features: Column, out: str) -> DataFrame:
        """``rows`` with the prediction; the trees of a batch at a time where they are too many for a worker."""
        batches = self.batches()
        rows = rows.withColumn("_of", vector_to_array(features))
        for i, (first, end) in enumerate(batches):
            mine = sum_of(rows.sparkSession, self.load(first, end), self.cuts)(F.col("_of"))
            rows = rows.withColumn(out, mine / self.count + (F.col(out) if i else 0.0))
            if i + 1 < len(batches):
                rows = materialize(rows, "forest_sums")
        return rows.drop("_of")


def sum_of(spark: SparkSession, trees: list[Tree], cuts: list[np.ndarray]):
    """A function of an array column: the sum of the trees' values."""
    sent = on_workers(spark).sparkContext.broadcast((trees, cuts))

    @F.arrow_udf("double")
    def total(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        trees, cuts = sent.value
        for a in arrays:
            codes = coded(_matrix(a, len(cuts)), cuts)
            value = np.zeros(len(codes))
            for t in trees:
                value += t.predict(codes)
            yield pa.array(value)

    return total


def fit_forest(table: DataFrame, label: str, trees: int, depth: int, least: int, seed: int) -> Forest:
    """Trees on draws with replacement, a third of the inputs (rounded up) tried at each node."""
    data = bin_rows(table, [label], "forest_rows")
    k = -(-data.width // 3)
    grown = _from_shared if data.rows * data.width <= SHARED_BYTES else _from_shuffled
    return Forest(materialize(grown(data, label, trees, depth, least, k, seed), "forest"), data.cuts, trees)


def _from_shared(data: Binned, label: str, trees: int, depth: int, least: int, k: int, seed: int) -> DataFrame:
    """The binned rows go to every worker, a tree is one task."""
    spark, width = data.blocks.sparkSession, data.width
    rows = sorted(data.blocks.toLocalIterator(), key=lambda r: r["block"])
    sizes = [(r["block"], len(r["codes"]) // width) for r in rows]
    sent = spark.sparkContext.broadcast((b"".join(r["codes"] for r in rows), b"".join(r[label] for r in rows)))

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, y = np.frombuffer(sent.value[0], np.uint8).reshape(-1, width), np.frombuffer(sent.value[1])
        for b in batches:
            for tree in b.column(0).to_pylist():
                w = np.concatenate([bag(seed, tree, number, n) for number, n in sizes])
                row = grow(codes, w, y, depth, least, k, seed, tree).row(tree, 0)
                yield pa.RecordBatch.from_pylist([row], NODES)

    return spark.range(0, trees, 1, trees).mapInArrow(one, TREE)


def _from_shuffled(data: Binned, label: str, trees: int, depth: int, least: int, k: int, seed: int) -> DataFrame:
    """Some trees at a time."""
    parts = [part for first in range(0, trees, BATCH_TREES)
             for part in _shuffled_batch(data, label, list(range(first, min(first + BATCH_TREES, trees))), depth, least, k, seed)]
    return reduce(DataFrame.unionByName, parts)


def _shuffled_batch(data: Binned, label: str, ids: list[int], depth: int, least: int, k: int, seed: int) -> list[DataFrame]:
    """Large nodes by passes over the blocks, then each smaller one in the task that gathers its rows."""
    width, growing = data.width, [Growing() for _ in ids]

    def weigh(number: int, columns: dict, codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(bag(seed, t, number, len(codes)), columns[label]) for t in ids]

    for _ in range(depth if data.rows > LOCAL_ROWS else 0):
        for g in growing:
            g.open = [at for at in g.open if g.counts[at] > LOCAL_ROWS]
        split_open(data, weigh, growing, ids, least, k, seed)
    tops = [g.tree() for g in growing]
    small = [np.array([left < 0 and not LOCAL_ROWS < c < math.inf for left, c in zip(g.left, g.counts, strict=True)]) for g in growing]
    names = {(t, at): name for t, g in zip(ids, growing, strict=True) for at, name in enumerate(g.names)}

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, codes, columns in each_block(batches, width):
            for i, (w, y) in enumerate(weigh(number, columns, codes)):
                at = tops[i].reach(codes)
                used = np.flatnonzero((w > 0) & small[i][at])
                order = used[np.argsort(at[used], kind="stable")]
                for some in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
                    if len(some):
                        yield pa.RecordBatch.from_pydict({"tree": pa.array([ids[i]], pa.int32()), "at": pa.array([int(at[some[0]])], pa.int32()), "block": pa.array([number], pa.int64()),
                                                          "codes": [codes[some].tobytes()], "w": [w[some].astype(np.uint8).tobytes()], "y": [y[some].tobytes()]})

    def finished(key: tuple, rows: pa.Table) -> pa.Table:
        tree, at = (x.as_py() for x in key)
        rows = rows.sort_by("block").to_pydict()
        codes, w, y = (np.frombuffer(b"".join(rows[c]), kind) for c, kind in (("codes", np.uint8), ("w", np.uint8), ("y", float)))
        name = names[tree, at]
        below = depth - (name.bit_length() - 1)
        return pa.Table.from_pylist([grow(codes.reshape(-1, width), w, y, below, least, k, seed, tree, name).row(tree, at)], NODES)

    rows = data.blocks.mapInArrow(dealt, "tree int, at int, block long, codes binary, w binary, y binary")
    return [materialize(rows.groupBy("tree", "at").applyInArrow(finished, TREE), "forest_nodes"),
            data.blocks.sparkSession.createDataFrame([t.row(i, -1) for i, t in zip(ids, tops, strict=True)], TREE)]
