"""Conversation trie, source mix and whitening against SQL, brute force and defined edge cases."""

from __future__ import annotations

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pvlake.llm import conversation_trie, source_mix, whitening
from pvlake.llm.running import running

SF = "/root/testdata/sf0.001"
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def same(got: pd.DataFrame, want: pd.DataFrame, keys: list[str]) -> None:
    pd.testing.assert_frame_equal(got.sort_values(keys).reset_index(drop=True)[sorted(got)],
                                  want.sort_values(keys).reset_index(drop=True)[sorted(want)], check_dtype=False)


def sql(statement: str, **tables: pd.DataFrame) -> pd.DataFrame:
    con = duckdb.connect()
    for name, t in tables.items():
        con.register(name, t)
    return con.execute(statement).df()


# conversation trie

def brute_trie(rows: list[tuple]) -> pd.DataFrame:
    """Nodes of (conv_id, turn, role, text, ...) rows by nested loops."""
    turns: dict = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns.setdefault(c, []).append((turn is not None, turn or 0, tie, role, text))
    turns = {c: [t[3:] for t in sorted(v)] for c, v in turns.items()}
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in turns}
    built = {c: tuple(turns.get(c - c % 100, [])[:h[c]] + turns[c][h[c]:]) for c in turns}
    members: dict = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    out = []
    for node, ids in members.items():
        under = [m for m in members if m[:len(node)] == node]
        leaves = [m for m in under if not any(len(x) == len(m) + 1 and x[:len(m)] == m for x in members)]
        out.append((min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids),
                    sum(len(m) == len(node) + 1 for m in under), len(leaves),
                    sum((len(members[m]) - 1) * len(m[-1][1]) for m in under if m),
                    hashlib.sha256(",".join(map(str, sorted(c for c in ids if built[c] == node))).encode()).hexdigest()))
    return pd.DataFrame(out, columns=NODE)


CONV = "conv_id long, turn long, role string, text string, c long, pos long, digest string, x1 long"


def trie_rows(kind: str) -> list[tuple]:
    rnd = random.Random(4)
    extra = (9, 9, "z", 9)
    if kind == "odd":
        rows = [(100, 0, "user", "a"), (100, 1, "assistant", "bb"), (100, 2, "user", "é\U0001f600"), (101, 0, "user", "x"),
                (101, None, None, None), (101, None, "user", None), (101, 1, "", ""), (101, 1, "", ""), (205, 0, "user", "only"),
                (None, 0, "user", "lost"), (None, None, None, None), (103, 3, "user", "t" * 200_000), (103, 3, "user", "tie"), (107, 0, None, "a")]
    elif kind == "hot":  # one turn and one conversation hold a third of all rows, one conversation is very long
        rows = [(c, t, "user", "hi" if t == 0 or c % 3 == 0 else f"{rnd.randrange(3)}") for c in range(300) for t in range(c % 4)]
        rows += [(1002, t, "user", f"{t % 7}") for t in range(400)]
    else:
        rows = [(c, t, rnd.choice("ua"), rnd.choice(["", "x", "yy"])) for c in rnd.sample(range(1000), 120) for t in range(rnd.randrange(1, 9))]
    return [(*r, *extra) for r in rows]


@pytest.mark.parametrize("kind", ["odd", "hot", "random"])
def test_trie_brute_force(spark, kind):
    rows = trie_rows(kind)
    frame = spark.createDataFrame(rows, CONV).repartition(5)
    got = conversation_trie.trie(frame).withColumnRenamed("pos", "depth").select(*NODE).toPandas()
    want = brute_trie(rows)
    same(got, want, ["depth", "conv_id"])
    given = frame.select("conv_id", "turn", "role", "text").toPandas().astype({"conv_id": "Int64", "turn": "Int64"})
    same(sql(conversation_trie.SQL, conversations=given), want, ["depth", "conv_id"])


def test_trie_turnless_and_empty(spark):
    empty = spark.createDataFrame([], CONV)
    assert conversation_trie.trie(empty).count() == 0
    rows = [(c, 0, "user", "own") for c in range(1, 30) if zlib.crc32(str(c).encode()) % 6]  # no first conversation: own turn falls out
    got = conversation_trie.trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    (root,) = got.collect()
    ids = ",".join(str(r[0]) for r in rows)
    assert (root.conv_id, root.pos, root.parent_conv_id, root.n_convs, root.n_children, root.n_leaves, root.saved_tokens) == (
        rows[0][0], 0, None, len(rows), 0, 1, 0)
    assert root.ends_sha256 == hashlib.sha256(ids.encode()).hexdigest()


def test_trie_blocks_of_members(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "BLOCK", 4)
    rows = [(c, t, "user", "same") for c in range(0, 4000, 100) for t in range(3)]
    got = conversation_trie.trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).where("pos = 3").collect()
    assert [r.ends_sha256 for r in got] == [hashlib.sha256(",".join(map(str, range(0, 4000, 100))).encode()).hexdigest()]


def test_trie_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SF}/conversations.parquet')")
    same(conversation_trie.query(spark, SF).toPandas(), con.execute(conversation_trie.SQL).df(), ["depth", "conv_id"])


def test_running_splits_a_hot_group(spark):
    rows = [(1, i, i % 5) for i in range(3000)] + [(g, i, g) for g in range(2, 40) for i in range(3)]
    frame = spark.createDataFrame(rows, "g long, o long, v long").repartition(7)
    got = running(frame, "g", ["o"], {"s": (F.sum, "v"), "n": (F.count, "v"), "x": (F.bit_xor, "v")}, "test-running")
    for g, part in got.toPandas().groupby("g"):
        part = part.sort_values("o")
        assert (part.s.values == part.v.cumsum().values).all() and (part.n.values == np.arange(1, len(part) + 1)).all()
        assert (part.x.values == np.bitwise_xor.accumulate(part.v.values)).all(), g


# source mix

DOC = "doc_id long, text string, lang string, source string, n_chars long, size long, s string, `key` long, bucket long, room long"


def mix_rows() -> list[tuple]:
    rnd = random.Random(1)
    extra = (None, 7, "s", 7, 7, 7)
    words = lambda n: "  ".join(["w"] * n) + "\n"
    rows = [(i, words(rnd.randrange(1, 40)), "en", rnd.choice(["a", "b", "é", "B"])) for i in range(200)]
    rows += [(300 + i, words(3), "en", None) for i in range(5)] + [(400, words(2), "en", "tiny"), (401, None, "en", "silent"), (402, " \n", "en", "silent")]
    rows += [(500, words(50_000), "en", "long")] + [(501, words(7), None, "a")] * 60 + [(None, words(5), "en", "nameless")] * 60
    rows += [(None, None, None, None), (501, words(8), None, "a"), (600, "", "en", "")]
    return [(*r, *extra) for r in rows]


def test_mix_against_sql(spark):
    frame = spark.createDataFrame(mix_rows(), DOC).repartition(4)
    got = source_mix.mix(frame, frame["doc_id"]).withColumnRenamed("row", "doc_id")
    want = sql(source_mix.SQL, documents=frame.toPandas().astype({"doc_id": "Int64"}))
    keys = ["doc_id", "size", "target", "taken"]
    same(got.toPandas(), want, keys)
    again = source_mix.mix(frame.repartition(9), frame["doc_id"]).withColumnRenamed("row", "doc_id")
    same(got.toPandas(), again.toPandas(), keys)


def water(sizes: dict, limit: int) -> dict:
    """Targets by sharing the excess again and again."""
    weight = {s: 1 + i % 3 for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    target = dict.fromkeys(sizes, 0.0)
    left, free = float(sum(sizes.values())), set(sizes)
    while left > 1e-9 and free:
        total = sum(weight[s] for s in free)
        for s in free:
            target[s] += left * weight[s] / total
        left = sum(max(0, target[s] - limit * sizes[s]) for s in free)
        for s in list(free):
            if target[s] >= limit * sizes[s]:
                target[s] = limit * sizes[s]
                free.discard(s)
    return target


@pytest.mark.parametrize("digit", [4, 20])
def test_mix_targets_and_limits(spark, digit):
    frame = spark.createDataFrame(mix_rows(), DOC).repartition(4)
    out = source_mix.mix(frame, F.struct("doc_id", "source"), digit=digit).toPandas()
    out["source"] = [r["source"] for r in out.row]
    sizes = {s if isinstance(s, str) else None: int(g["size"].sum()) for s, g in out.groupby("source", dropna=False)}
    want = water(sizes, 3)
    assert len(out) == len(mix_rows())
    assert (out.taken <= 3 * out["size"]).all() and (out.taken >= 0).all()
    for s, g in out.groupby("source", dropna=False):
        s = s if isinstance(s, str) else None
        assert g.target.iloc[0] == pytest.approx(want[s]) and g.target.nunique() == 1 and (g.source_size == sizes[s]).all()
        assert abs(g.taken.sum() - want[s]) <= 0.5
        cut = g[(g["size"] > 0) & (g.taken % g["size"].clip(lower=1) != 0)]
        assert len(cut) <= 1  # only the document at the border is cut
        times = g[g["size"] > 0].taken // g[g["size"] > 0]["size"]
        assert times.empty or times.max() - times.min() <= 1


def test_mix_documents(spark):
    frame = spark.createDataFrame(mix_rows(), DOC).repartition(4)
    out = source_mix.mixed_documents(frame)
    assert out.columns == frame.columns
    plan = source_mix.mix(frame, frame["doc_id"]).toPandas()
    assert sum(len((t or "").split()) for t in out.toPandas().text) == plan.taken.sum()
    texts = {r[1] for r in mix_rows()}
    cut = [t for t in out.toPandas().text if t not in texts]
    assert all(any(t and t.startswith(c) for t in texts) for c in cut) and len(cut) <= 8


def test_mix_empty(spark):
    frame = spark.createDataFrame([], DOC)
    assert source_mix.mix(frame, frame["doc_id"]).count() == 0
    none = spark.createDataFrame([(1, None, None, "a"), (2, "", None, None)], "doc_id long, text string, lang string, source string")
    assert {tuple(r) for r in source_mix.mix(none, none["doc_id"]).collect()} == {(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)}


def test_mix_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    same(source_mix.query(spark, SF).toPandas(), con.execute(source_mix.SQL).df(), ["doc_id"])


# whitening

VEC = "vec_id long, embedding array<float>, label int, n long, c double, x double, d long"


def expected(vectors: np.ndarray, k: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whitened, explained, deviation) by an eigendecomposition of the covariance."""
    x = np.floor(1024 * vectors).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    off = (n * x - s) / n
    v = off.T @ off / n
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1][:k], axes[:, ::-1][:, :k]
    return off @ axes / np.sqrt(e), e / np.trace(v), ((n * x - s) ** 2).sum(1)


def check_whitened(out: pd.DataFrame, ids: list, vectors: np.ndarray) -> None:
    whitened, explained, deviation = expected(vectors)
    k = whitened.shape[1]
    got = out.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    assert got.shape == whitened.shape and list(out.component.unique()) == list(range(1, k + 1))
    sign = np.sign((got * whitened).sum(0))
    assert np.abs(got * sign - whitened).max() < 1e-9
    assert np.abs(out.groupby("component").explained.first().to_numpy() / explained - 1).max() < 1e-9
    assert (out.groupby("vec_id").deviation.first().loc[ids].to_numpy() == deviation).all()
    assert out.identity_error.nunique() == 1 and out.identity_error.iloc[0] < 1e-10 and (out.n == len(ids)).all()


def test_whitening_table(spark):
    given = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    check_whitened(whitening.query(spark, SF).toPandas(), list(given.vec_id), np.stack(given.embedding).astype(float))


def test_whitening_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate((rng.normal(size=(60, 12)) * 2.0 ** -np.arange(12)).astype(np.float32) * 50)]
    good = list(rows)
    bad = [(100, None), (101, []), (102, [1.0] * 11), (103, [float("nan")] * 12), (104, [float("inf")] + [0.0] * 11), (105, [None] + [0.0] * 11)]
    frame = spark.createDataFrame([(i, v, 1, 1, 1.0, 1.0, 1) for i, v in rows + bad], VEC).repartition(4)
    out = whitening.whiten(frame).toPandas()
    check_whitened(out, [i for i, _ in good], np.array([v for _, v in good]))


def test_whitening_repeats_nulls_and_rank(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 3))
    vectors = np.hstack([base, base, np.ones((40, 4))]).astype(np.float32).astype(float)
    rows = [(None if i == 0 else i, v.tolist()) for i, v in enumerate(vectors)] * 2
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    assert sorted(out.component.unique()) == [1, 2, 3] and len(out) == 240 and out.vec_id.isna().sum() == 6
    assert out.identity_error.iloc[0] < 1e-9 and (out.n == 80).all()
    assert out.groupby("component").explained.first().sum() == pytest.approx(1)


def test_whitening_large_offsets(spark):
    """Tiny spread around a large value: the offset cancels before rounding; deviations beyond 64 bits are null."""
    rng = np.random.default_rng(6)
    vectors = 2.0 ** 20 + rng.integers(0, 50, size=(200, 9)) / 1024
    out = whitening.whiten(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")).toPandas()
    check_whitened(out, list(range(200)), vectors)
    wide = spark.createDataFrame([(i, [float((-1) ** i * 2.0 ** 39), float(i)]) for i in range(50)], "vec_id long, embedding array<double>")
    assert whitening.whiten(wide).where("deviation IS NOT NULL").count() == 0


def test_whitening_without_variance(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], schema)).count() == 0


def test_whitening_matrices_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    given = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    frame = spark.read.parquet(f"{SF}/embeddings.parquet").repartition(13)
    check_whitened(whitening.whiten(frame).toPandas(), list(given.vec_id), np.stack(given.embedding).astype(float))


def test_triangular_solve():
    rng = np.random.default_rng(7)
    factor = np.triu(rng.normal(size=(150, 150))) + 20 * np.eye(150)
    rows = rng.normal(size=(30, 150))
    assert np.allclose(whitening.solve(rows, factor) @ factor, rows)
