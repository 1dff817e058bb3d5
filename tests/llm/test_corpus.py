"""Operators against brute-force versions, SQL, public libraries and defined edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pvlake.llm import (
    bpe_transducer,
    edit_counts,
    exact_dedup,
    line_dedup,
    minhash_dedup,
    packing,
    pii,
    quality_rules,
    repeat_index,
    toxicity,
)
from pvlake.llm.common import documents
from pvlake.llm.components import components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, `key` string, rid long"


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, SF)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and extra columns with clashing names."""
    long_text = "alpha beta gamma delta epsilon zeta " * 3000
    texts = [None, "", " \n\t ", "x", "a b c d", "a b c d", "a  b\tc d", long_text, long_text + "tail", "one two three four five six " * 4, "\x00\x1c é́ ñ"]
    rows = [(i, t, "en", "s", None, "w", "k", 0) for i, t in enumerate(texts)]
    rows += [rows[4], (None, "a b c d", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("module", [quality_rules, exact_dedup, line_dedup])
def test_sql(spark, module):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = con.execute(module.SQL).df().sort_values("doc_id").reset_index(drop=True)
    got = module.query(spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert sorted(got.columns) == sorted(want.columns)
    for c in want.columns:
        assert (got[c] == want[c]).all(), c


def test_edge_cases_run(odd, empty):
    """Every operator takes odd rows and an empty table, and gives one row per document where it says so."""
    run = {
        "quality": quality_rules.quality_rules, "near": minhash_dedup.near_duplicates, "repeat": repeat_index.repeated_bytes,
        "exact": exact_dedup.exact_dedup, "toxic": lambda d: toxicity.toxicity(d, None), "edits": edit_counts.edit_counts,
        "bpe": bpe_transducer.encode_digests, "pii": lambda d: pii.find_personal_data(d, pii.fit(d)), "lines": line_dedup.line_dedup,
    }
    for name, f in run.items():
        assert f(odd).count() == odd.count(), name
        assert f(empty).count() == 0, name
    assert packing.pack(empty).count() == 0
    assert packing.pack(odd).agg(F.sum(F.when(F.col("start") == 0, 1))).first()[0] == odd.count()


def test_stages_keep_columns(spark, odd, empty):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for d in (odd, empty):
            out = stage(spark, d, SF)
            assert out.columns == d.columns, name
            assert out.count() <= d.count(), name


def test_exact_collisions(spark):
    """With an 8-bit hash nearly every group collides; bytes decide."""
    d = spark.createDataFrame([(i, f"t {i % 70}") for i in range(300)], "doc_id long, text string").repartition(4)
    rows = exact_dedup.exact_dedup(d, hash_bits=8).collect()
    assert all(r.keep_id == r.doc_id % 70 and r.group_size == len(range(r.doc_id % 70, 300, 70)) and r.kept == (r.doc_id < 70) for r in rows)


def test_exact_defined(odd):
    rows = exact_dedup.exact_dedup(odd).collect()
    same = [r for r in rows if r.text_sha256 == hashlib.sha256(b"a b c d").hexdigest()]
    assert {r.keep_id for r in same} == {4} and sum(r.kept for r in same) == 1 and {r.group_size for r in same} == {5}


def test_near_duplicates_brute_force(spark, docs):
    rows = docs.collect()
    words = re.compile(r"[^\x20\x09-\x0D]+")
    sets = {}
    for r in rows:
        w = words.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        sets[r.doc_id] = {tuple(w[i:i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())
    root = {k: k for k in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    got = minhash_dedup.query(spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), top(r.doc_id), top(r.doc_id) == r.doc_id)


def test_near_duplicates_groups(spark):
    """Candidate groups: both a half of the first and one of the second collection in common; no row for each product."""
    near = minhash_dedup.NearDuplicates
    u, v = range(minhash_dedup.HALVES), range(minhash_dedup.HALVES, 2 * minhash_dedup.HALVES)
    held = {1: (10, 20), 2: (10, 20), 3: (10, 21), 4: (11, 21), 5: (12, 22), 6: (12, 22)}
    rows = [(c, 5 if c == 6 else c, i, h) for c, (a, b) in held.items() for half, h in ((u, a), (v, b)) for i in half]
    mixed = spark.createDataFrame(rows, "cid long, root long, i int, h long")
    assert {(r.node, r.root) for r in near.groups(mixed).collect()} == {(1, 1), (2, 1)}
    plan = minhash_dedup.led(mixed, ["h"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and minhash_dedup.led(mixed, ["h"]).count() == 5


def test_components_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_repeated_bytes_brute_force(spark, docs):
    rows = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    rows |= {1000: b"a" * 300, 1001: b"a" * 120 + b"b", 1002: b"", 1003: rows[0][10:400] + b"#" + rows[0][:70]}
    first = {}
    for k in sorted(rows):
        for i in range(len(rows[k]) - 49):
            first.setdefault(rows[k][i:i + 50], k)
    d = spark.createDataFrame([(k, v.decode(errors="ignore")) for k, v in rows.items()], "doc_id long, text string").repartition(5)
    rows = {k: v.decode(errors="ignore").encode() for k, v in rows.items()}
    for r in repeat_index.repeated_bytes(d).collect():
        b = rows[r.doc_id]
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if first.get(b[i:i + 50], r.doc_id) < r.doc_id:
                gone[i:i + 50] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), gone.sum(), spans, hashlib.sha256(kept).hexdigest())


def test_repeated_bytes_hot_minimizer(monkeypatch):
    """A passage between texts of their own gives each document a segment of its own at both ends; no index takes
    all of them, and the result is that of the definition. The steps run here without Spark, on three blocks."""
    ri, part, n = repeat_index, 60, 600
    monkeypatch.setattr(ri, "PART", part)
    rnd = np.random.default_rng(5)
    passage = bytes(rnd.integers(97, 123, 90, dtype=np.uint8))
    ids = rnd.permutation(n)
    rows = {int(k): bytes(rnd.integers(97, 123, 60, dtype=np.uint8)) + passage + bytes(rnd.integers(97, 123, 60, dtype=np.uint8)) for k in ids}
    rows[int(ids[-1])] = b"a" * 400
    blocks = []
    for k in range(3):
        own = [int(i) for i in ids[k::3]]
        offsets = np.cumsum([0, *[len(rows[i]) for i in own]])
        blocks.append((k, np.array(own, np.int64).tobytes(), offsets.astype(np.int64).tobytes(), ri._zip(b"".join(rows[i] for i in own))))
    taken, build = [], ri.RunIndex

    def index(texts, lengths, doc):
        taken.append(len(texts))
        return build(texts, lengths, doc)

    monkeypatch.setattr(ri, "RunIndex", index)

    def batches(extra):
        lists = [list(c) for c in zip(*[(*b, *extra(b[0])) for b in blocks], strict=True)]
        return iter([pa.RecordBatch.from_arrays([pa.array(c) for c in lists], names=[str(i) for i in range(len(lists))])])

    def by_bucket(parts, step):
        table = pa.Table.from_batches(list(parts))
        keys = table.column("bucket").to_pylist()
        return [r for b in sorted(set(keys)) for r in step(table.filter(pa.array([x == b for x in keys]))).to_pylist()]

    told = by_bucket(ri._send_minimizers(8)(batches(lambda k: ())), ri._shared)
    sent = list(ri._send_segments(8)(batches(lambda k: ([r for r in told if r["block"] == k],))))
    answers = by_bucket(sent, ri._match)
    got = [r for b in ri._cut(8)(batches(lambda k: ([r for r in answers if r["block"] == k],))) for r in b.to_pylist()]
    first = {}
    for k in sorted(rows):
        for i in range(len(rows[k]) - 49):
            first.setdefault(rows[k][i:i + 50], k)
    assert sorted(r["doc_id"] for r in got) == sorted(rows)
    for r in got:
        b = rows[r["doc_id"]]
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if first[b[i:i + 50]] < r["doc_id"]:
                gone[i:i + 50] = True
        assert (r["n_removed"], r["kept_sha256"]) == (gone.sum(), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    assert max(taken, default=0) < 2 * part
    # a window is one entry per block at most, however many documents hold it
    assert all(len(set(c)) == len(c) for b in sent for r in b.to_pylist() if r["bucket"] < 0
               for c in [np.frombuffer(ri._unzip(r["payload"]), np.uint64, r["n"]).tolist()])
    assert any(r["bucket"] < 0 for b in sent for r in b.to_pylist())


def test_repeated_bytes_only_hot_minimizers():
    """A block all of whose segments have hot minimizers sends windows only."""
    ri = repeat_index
    text = bytes(np.random.default_rng(6).integers(97, 123, 200, dtype=np.uint8))
    block = (np.array([1, 2], np.int64).tobytes(), np.array([0, 200, 400], np.int64).tobytes(), ri._zip(text + text))
    bucket, name = ri.Segments(*block).names(8)
    got = [{"bucket": b, "held": short.tobytes(), "hot": short.tobytes()}
           for b in sorted(set(bucket.tolist())) for short in [np.unique(name[bucket == b]).astype(np.uint32)]]
    batch = pa.RecordBatch.from_arrays([pa.array([c]) for c in (0, *block, got)], names=list("abcde"))
    sent = [r for b in ri._send_segments(8)(iter([batch])) for r in b.to_pylist()]
    assert sum(r["n"] for r in sent) == 200 - ri.LENGTH + 1 and all(r["bucket"] < 0 for r in sent)


def test_repeat_buckets_growth():
    """Each block sends a row to each bucket: buckets grow with the corpus, but not in proportion once they are many."""
    few, many = repeat_index._buckets(1 << 29), repeat_index._buckets(52 << 30)
    assert few == 256 and repeat_index._buckets(1 << 30) == 512 and 512 < many < 52 << 8
    assert repeat_index._buckets(208 << 30) == pytest.approx(2 * many, abs=2)


def test_repeat_index_cost():
    """An index takes the time of a few sorts of its suffixes, and finds the windows that brute force finds."""
    ri, rnd = repeat_index, np.random.default_rng(8)
    pool = [bytes(rnd.integers(97, 123, 180, dtype=np.uint8)) for _ in range(150)] + [b"ab" * 90, b"\xff" * 180, bytes(range(180))]
    texts = []
    for k in range(6000):
        p, a, n = pool[k % len(pool)], int(rnd.integers(0, 70)), int(rnd.integers(ri.LENGTH, ri.LENGTH + ri.MOST))
        texts.append(p[a:a + n])
    lengths, doc = np.array([len(x) for x in texts]), rnd.integers(0, 2000, len(texts))
    rows = np.zeros((len(texts), lengths.max() + 1), np.int16)
    for r, x in zip(rows, texts, strict=True):
        r[:len(x)] = np.frombuffer(x, np.uint8).astype(np.int16) + 1

    def cost(f):
        begin = time.process_time()
        out = f()
        return time.process_time() - begin, out

    numbers = rnd.integers(0, 1 << 62, int(lengths.sum()))
    sort = min(cost(lambda: np.sort(numbers, kind="stable"))[0] for _ in range(3))
    runs = [cost(lambda: ri.RunIndex(rows, lengths, doc).covered(lengths, doc)) for _ in range(3)]
    first = {}
    for x, d in zip(texts, doc.tolist(), strict=True):
        for w in range(len(x) - ri.LENGTH + 1):
            first[x[w:w + ri.LENGTH]] = min(d, first.get(x[w:w + ri.LENGTH], d))
    for x, d, got in zip(texts, doc.tolist(), runs[0][1].tolist(), strict=True):
        assert got == sum(1 << w for w in range(len(x) - ri.LENGTH + 1) if first[x[w:w + ri.LENGTH]] < d)
    assert min(r[0] for r in runs) < 8 * sort


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    d, labels = documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.toxicity(d, toxicity.fit(d, labels)).join(labels, "doc_id").where("held_out").toPandas()
    assert ((zlib.crc32(str(int(got.doc_id[0])).encode()) % 4) == 2) and got.score.between(0, 1).all()
    assert got[got.toxic == 1].predicted.mean() > 0.6 and got[got.toxic == 0].predicted.mean() < 0.06


@pytest.fixture(scope="module")
def toxicity_model(spark):
    sf = "/root/testdata/sf0.01"
    return toxicity.fit(documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"))


def naive_features(model, text):
    import zstandard as zs

    def lengths(content):
        c = zs.ZstdCompressor(level=toxicity.LEVEL, write_content_size=False, write_dict_id=False,
                              dict_data=zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT))
        return [len(c.compress(x)) for x in cut]

    found = re.findall(r"[^\W\d_]{1,64}", text.lower())
    cut = [f" {' '.join(found[i:i + 3])} ".encode() for i in range(0, max(len(found) - 1, min(len(found), 1)), 2)]
    gaps = [a - b for a, b in zip(lengths(model.ordinary), lengths(model.toxic))]
    return [*(math.log1p(sum(g >= t for g in gaps)) for t in toxicity.DISTANCES), max([0, *gaps]), math.log1p(sum(map(len, cut)))]


def test_toxicity_scores_every_window(spark, toxicity_model):
    """Scores of the query's columns against a plain reading of the definition, window by window."""
    texts = {r.doc_id: r.text or "" for r in documents(spark, SF).collect()}
    got = toxicity.toxicity(documents(spark, SF), toxicity_model).collect()
    assert {r.doc_id for r in got} == set(texts) and len(got) == len(texts)
    m = toxicity_model
    for r in got:
        z = np.r_[1.0, (np.array(naive_features(m, texts[r.doc_id])) - m.mean) / m.scale] @ m.weights
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-9 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_toxicity_windows():
    for n in range(12):
        found = [chr(97 + k) * 3 for k in range(n)]
        got = [w.split() for w in toxicity.windows("1 ".join(found) + " .")]
        assert {w for x in got for w in x} == set(found) and all(len(x) <= 3 for x in got)
        assert all(a[-1] == b[0] for a, b in zip(got, got[1:])) and len(got) == (n // 2 if n > 1 else n)
    assert [len(w) for w in toxicity.words("x" * 150)] == [64, 64, 22]
    assert list(toxicity.around("a stupid one", {" stup"})) == [" a stupid one "]
    assert list(toxicity.around("stupid", {" stup"})) == [" stupid "] and not list(toxicity.around("", {" stup"}))


def test_toxicity_edges(odd, empty, toxicity_model):
    """A fitted model on nulls, empty, very long and repeated texts."""
    rows = toxicity.toxicity(odd, toxicity_model).collect()
    score = {r.doc_id: r.score for r in rows}
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.held_out in (True, False) for r in rows)
    assert score[0] == score[1] == score[2]  # null, empty and blank: no windows
    assert score[4] == score[5] == score[6] and len([r for r in rows if r.doc_id == 4]) == 2
    assert toxicity.toxicity(empty, toxicity_model).collect() == []


def test_toxicity_fit_edges(spark, odd, empty):
    schema = "doc_id long, toxic int, quality int"
    labels = [(i, i % 2, None) for i in range(120)] + [(1, None, 0), (None, 1, 0), (2, 0, 1), (2, 0, 1)]
    few = spark.createDataFrame([(i, "dumb clown " * 9 if i % 2 else "fine day today " * 9) for i in range(120)] + [(4, None), (None, "x")],
                                "doc_id long, text string")
    model = toxicity.fit(few, spark.createDataFrame(labels, schema))
    got = {r.doc_id: r.score for r in toxicity.toxicity(few, model).collect() if r.doc_id not in (4, None)}
    assert min(got[i] for i in got if i % 2) > max(got[i] for i in got if i % 2 == 0)  # rows held out among them
    assert toxicity.fit(few, spark.createDataFrame([r for r in labels if r[1] == 0], schema)) is None
    assert toxicity.fit(empty, spark.createDataFrame(labels, schema)) is None
    assert toxicity.fit(odd, spark.createDataFrame([], schema)) is None


def test_bpe_matches_library(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(bpe_transducer.VOCABULARY))
    own = bpe_transducer.transducer(public_tokenizers.path(bpe_transducer.VOCABULARY))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in bpe_transducer.query(spark, SF).collect():
        ids = t.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    for x in ("Σίσυφος ΟΔΟΣ", "<|startoftext|>Hi<|endoftext|> x", "don't I'LL １２3 ½", "a\x1cb \x85c", "th" * 3000, "é" * 2000):
        assert own.encode(x) == t.encode(x, add_special_tokens=False).ids
    letters = random.Random(5)
    for size in (97, 500, 4400, 9000):  # one space-free word: streamed, merged from a heap
        x = "".join(letters.choice("abcdeing") for _ in range(size))
        ids = t.encode(x, add_special_tokens=False).ids
        assert own.encode(x) == ids and own.decode(ids) == t.decode(ids, skip_special_tokens=False)
    symbols = [own.symbols[b] for b in ("inthan" * 700).encode()]
    assert list(own.stream(symbols, window=3)) == own.merge(list(symbols))
    machine = bpe_transducer.TextDecoder(own)
    assert "".join(map(machine.feed, own.encode("Hello wörld 日本"))) + machine.close() == "hello wörld 日本 "


def test_bpe_long_words_in_time():
    """A megabyte of letters is one pre-token; its time grows with its length."""
    import public_tokenizers

    own, letters = bpe_transducer.transducer(public_tokenizers.path(bpe_transducer.VOCABULARY)), random.Random(1)
    x = "".join(letters.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))
    started = time.monotonic()
    ids = own.encode(x)
    assert time.monotonic() - started < 120
    assert "".join(own.strings[i] for i in ids) == x + bpe_transducer.SUFFIX


def test_joined_decoder_by_runs():
    """The state machine gives the same text whatever runs the ids come in."""
    import public_tokenizers

    own = bpe_transducer.transducer(public_tokenizers.path(bpe_transducer.VOCABULARY))
    ids = [str(i) for i in own.encode("Hello wörld, don't <|endoftext|> stop 日本 " * 20)]
    want = " ".join(own.strings[int(i)] for i in ids)
    for size in (1, 2, 7, len(ids)):
        machine = bpe_transducer.JoinedDecoder(own)
        got = [machine.feed([" ".join(ids[i:i + size])]) for i in range(0, len(ids), size)]
        assert "".join(got) == want and machine.feed([]) == ""


def test_packing_round_trip(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    p = packing.pack(docs.repartition(7)).toPandas()
    windows = p.groupby("sequence_id").length.sum()
    assert windows.max() <= packing.SEQ_LEN and all(x == packing.SEQ_LEN or x & (x - 1) == 0 for x in windows)
    ordered = p.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()
    pieces = dict(list(p.sort_values("start").groupby("doc_id")))
    for r in docs.collect():
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        at = 0
        for x in pieces[r.doc_id].itertuples():
            assert x.start == at and zlib.crc32(ids[4 * at:4 * (at + x.length)]) == x.ids_crc32 and 4 * x.doc_tokens == len(ids)
            at += x.length
        assert 4 * at == len(ids)


def test_personal_data_base(docs):
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    texts = [r.text for r in docs.collect()] + ["a@b.c@d.e", "@@a@b.c", "1.2.3.4.5.6.7.8", "999.1.1.1 1.1.1.1", "4111-1111-1111-1111 5", "+1 2 +1 (017) 555-7713)"]
    for x in texts:
        want = [(m.start(), 0, m.end()) for m in email.finditer(x)]
        want += [(m.start(), 1, m.end()) for m in ip.finditer(x) if all(int(p) <= 255 for p in m[0].split("."))]
        want += [(m.start(), 2, m.end()) for m in card.finditer(x) if 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
        want += [(m.start(), 3, m.end()) for m in phone.finditer(x) if 10 <= len(digits(m)) <= 15]
        assert pii.base_spans(x) == sorted(want)


def test_personal_data_query_columns(docs):
    """Counts, digest and spans as the query returns them, with overlaps decided pair by pair."""
    model = pii.fit(docs)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = pii.find_personal_data(docs, model).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        x = texts[r.doc_id]
        base = pii.base_spans(x)
        taken = list(base)
        apart = lambda c: not any(b[0] < c[2] and c[0] < b[2] for b in taken)
        for score, c in sorted(((model.score(pii.features(x, c)), c) for c in pii.candidates(x)), key=lambda v: (-v[0], v[1])):
            if score >= model.thresholds[c[1]] and apart(c):
                taken.append(c)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(b[1] == k for b in base) for k in range(4))
        written = [",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(v)) for v in (base, taken)]
        assert r.base_sha256 == hashlib.sha256(written[0].encode()).hexdigest() and r.spans == written[1]


def test_personal_data_many_spans_in_time(docs):
    model = pii.fit(docs)
    x = " ".join(f"u{i}@host{i}.com" for i in range(100_000)) + " 10 . 2 . 3 . 4" * 2_000
    started = time.monotonic()
    base, every = pii.spans(x, model)
    assert time.monotonic() - started < 60 and len(base) == 100_000 and every[:100_000] == base


def test_personal_data_added(spark):
    model = pii.fit(documents(spark, "/root/testdata/sf0.1"))
    for x, kind in (("call (617) 555-1234 now", 3), ("mail john.doe at example dot com please", 0), ("10[.]0[.]0[.]12 host", 1)):
        base, every = pii.spans(x, model)
        assert not base and [s[1] for s in every] == [kind]
    assert pii.spans("we meet at noon dot matrix style", model)[1] == []
    assert pii.redact("x a@b.cd y", pii.base_spans("x a@b.cd y")) == "x <EMAIL> y"


def test_personal_data_whole_sample(spark, monkeypatch):
    """Every sampled candidate is trained on or calibrates; each kind and label is in both halves."""
    n, seen, scored = 13_000, [], []
    monkeypatch.setattr(pii, "boost", lambda x, y: seen.append((x, y)) or (0.0, []))
    monkeypatch.setattr(pii.Model, "score", lambda self, x: scored.append(x) or 0.5)
    d = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("write to some"), "id", F.lit("@example.com please")).alias("text"))
    pii.fit(d.union(spark.createDataFrame([(n, "ping 10.20.30.40 now"), (n + 1, "ping 10.20.30.41 now")], "doc_id long, text string")))
    x, y = seen[0]
    assert len(x) + len(scored) == 2 * n + 6  # an address and plain words; each IP text is also a candidate as it stands
    for half, label in ((x, y), (np.array(scored), None)):
        assert {0.0, 1.0} == set(half[:, 0].tolist()) and len(half) >= n
    assert 0.49 < y.mean() < 0.51


def test_personal_data_all_candidates(spark, monkeypatch):
    """Every document trains, long texts too; counted by distinct features the model is that of the rows one by one."""
    texts = [f"write to some{i}@ex{i % 7}ample.com please" if i % 3 else f"ping 10.20.{i}.40 now or call {i} 555 123 4567 99" for i in range(200)]
    texts += ["word " * 25_000 + "mail a.b@c.example.org", "meet at noon dot com maybe", None, "", "we saw 10. 20. 30. 40 of them"]
    d = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(3, "doc_id")
    read, boost = [], pii.boost
    monkeypatch.setattr(pii, "boost", lambda x, y: read.append(len(y)) or boost(x, y))
    small = pii.fit(d)
    rows = [r for b in pii._examples(iter([pa.RecordBatch.from_pydict({"doc_id": [*range(len(texts))], "text": texts})])) for r in b.to_pylist()]
    assert len(rows) - 1 <= 2 * read[0] <= len(rows) + 8
    monkeypatch.setattr(pii, "IN_MEMORY", 0)
    monkeypatch.setattr(pii, "ROWS_PER_TASK", 50)
    large = pii.fit(d)
    assert len(read) == 1 and len(large.trees) == pii.ROUNDS
    assert np.allclose([small.score(r["x"]) for r in rows], [large.score(r["x"]) for r in rows], atol=1e-6)
    assert np.allclose(small.thresholds, large.thresholds, atol=1e-6) and min(large.thresholds) < 2


def test_personal_data_proposed():
    """Spaced addresses with a plain dot, and long ones to their end, are proposed."""
    for x in ("jane.doe at example.com", "j" * 60 + " [at] " + "h" * 60 + " [dot] " + ".".join(["k" * 60] * 4)):
        assert (5, 0, 5 + len(x)) in pii.candidates("mail " + x + " now")
        assert (905, 0, 905 + len(x)) in pii.candidates("word " * 180 + "mail " + x + " now, " + "word " * 300)
    assert pii.candidates("we meet at noon. Then we go on") == []
    assert (0, 0, 23) in [(s[0], s[1], s[2]) for s in [pii.loosened("jane.doe@example.com", (0, 0, 20), 8)[1]]]


def test_edit_tree():
    import random

    rng = random.Random(5)
    for x in ["", "a b c " * 300, "a" * 900 + " b  c" * 99, "word, " * 400 + "\n\n tail"]:
        tree, now = edit_counts.CountTree(x), x
        for _ in range(25):
            a = rng.randrange(len(now) + 1)
            b, new = min(len(now), a + rng.choice([0, 1, 5, 300])), rng.choice(["", " ", "x", "  ", "hello world", "\n"])
            tree.edit(a, b, new)
            now = now[:a] + new + now[b:]
            assert tree.text() == now and tree.total == edit_counts.count(now)


def test_line_runs(spark):
    run = "first line here\nsecond line here\nthird line here"
    d = spark.createDataFrame([(1, f"x\n{run}\ny"), (2, f"{run}\nz"), (3, "first line here\nq"), (4, run)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(d).collect()}
    assert got == {1: f"x\n{run}\ny", 2: "z", 3: "first line here\nq", 4: ""}
    assert sorted(r.doc_id for r in line_dedup.line_dedup_stage(d).collect()) == [1, 2, 3]


def test_pipeline(spark):
    """The run equals its stages one by one: kept documents, redacted texts, and every token packed once."""
    docs = documents(spark, SF)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    texts = {r.doc_id: r.text for r in docs.collect()}
    packed = corpus_pipeline.run(spark, SF).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in packed} == {k: edit_counts.count(t) + 1 for k, t in texts.items()}
    assert not any(pii.base_spans(t) for t in texts.values())


def brute_lines(texts: dict[int, str], min_lines: int = 3, min_words: int = 20) -> dict[int, list[int]]:
    """Deleted line numbers of each document: for each position the longest run that an earlier position holds and that
    doesn't overlap it, deleted if it has enough lines or words. All lengths are tried."""
    lines = [(d, i, x.strip(" ")) for d, t in sorted(texts.items()) for i, x in enumerate(t.split("\n")) if re.search(r"[^\x20\x09-\x0D]", x)]
    gone: dict[int, set[int]] = {d: set() for d in texts}
    for at, (d, _, _) in enumerate(lines):
        best = 0
        for e in range(at):
            n = 0
            while at + n < len(lines) and lines[at + n][0] == d and lines[e + n][0] == lines[e][0] and lines[e + n][2] == lines[at + n][2] and (
                    lines[e][0] != d or e + n < at):
                n += 1
            best = max(best, n)
        words = sum(len(lines[at + k][2].split()) for k in range(best))
        if best >= min_lines or words >= min_words:
            gone[d] |= {lines[at + k][1] for k in range(best)}
    return {d: sorted(g) for d, g in gone.items()}


def check_lines(spark, texts: dict[int, str]) -> None:
    want = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in brute_lines(texts)[d]) for d, t in texts.items()}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.text for r in line_dedup.line_dedup(frame).collect()} == want
    con = duckdb.connect()
    con.register("documents", frame.toPandas())
    sql = {r[0]: r[1] for r in con.execute(f"SELECT doc_id, text_sha256 FROM ({line_dedup.SQL})").fetchall()}
    assert sql == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in want.items()}


def test_line_runs_of_two_lines_and_overlaps(spark):
    long = [" ".join(f"w{k}{i}" for i in range(19)) for k in range(2)]
    check_lines(spark, {1: "\n".join(long), 2: "a\n" + "\n".join(long) + "\nb", 3: long[0],  # two lines of 19 words, and one alone
                        4: "\n".join(["go on"] * 5), 5: "\n".join(["to and fro", "again"] * 5)})


def test_line_runs_brute_force(spark):
    rng = np.random.default_rng(11)
    pool = [" ".join(["w"] * n) + f" {i}" for i, n in enumerate([1, 1, 2, 5, 9, 12, 19, 25])] + ["", "  "]
    texts = {d: "\n".join(rng.choice(pool, size=rng.integers(1, 14))) for d in range(60)}
    texts |= {100 + d: texts[d] + "\n" + texts[d + 1] for d in range(10)}
    check_lines(spark, texts)


CLASHING = ("rid", "seq", "line", "lines", "gone", "seqs", "row", "a", "b", "first", "later", "own", "n", "n_removed", "__rid", "__gone", "__seq", "__lines",
            "__n_removed", "__llm_rid", "at", "words", "key", "kept", "select")


def test_stages_leave_clashing_columns_alone(spark):
    """Values of columns with any name stay as they are, in every stage."""
    docs = documents(spark, SF).where("doc_id < 60")
    docs = docs.withColumns({c: F.col("doc_id") * 100 + k for k, c in enumerate(CLASHING)})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert len(got) > 10 and all([r[c] for c in CLASHING] == [r["doc_id"] * 100 + k for k in range(len(CLASHING))] for r in got), name
