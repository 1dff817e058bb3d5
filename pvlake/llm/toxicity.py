"""Operator 5, toxicity by compression distance with two zstandard dictionaries.

Training takes a bounded sample of labelled rows (``SAMPLE``), halved by a hash of doc_id. One half
trains two dictionaries with zstandard: the ordinary one on windows of ordinary texts, the toxic one
on windows of toxic texts around words, or word beginnings, that more toxic than ordinary texts hold
(``MIN_Z``); most of a toxic text is ordinary prose, and a dictionary of all its windows would be
too. The ordinary dictionary is the tail of both, so shared content has the same offsets. A window
is three words, the last one also the first of the next; every window of a text is compressed under
both, and its distance is the ordinary length less the toxic one. Counts of windows per distance
threshold are calibrated on the other half of the sample by a logistic function, weighted by how
many labelled rows of each class there are.

Counting pieces, cutting windows and measuring the calibration half are tasks over the written
sample; the driver gets at most ``WINDOWS`` windows a class and one row of numbers a sampled text.

Defined results: null and empty texts have no windows and get the calibrated score of that; words
over ``WORD`` letters are cut there; rows that repeat a doc_id are scored one by one, and train once,
with the smallest text; repeated labels of a doc_id count as toxic if one does; windows too few for
zstandard to train on are the dictionary themselves; without a toxic or an ordinary text in one of
the halves every score is 0; an empty table gives no rows; other columns, labels, lang, source and
doc_id are never inputs of a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pvlake.llm.common import documents, id_and_text, store, whole_text

#: Labelled rows per class that training reads, and windows per class that a dictionary trains on.
SAMPLE = {1: 3000, 0: 6000}
WINDOWS = 200_000
THRESHOLD = 0.3
#: Compression level, and longest run of letters taken as one word.
LEVEL, WORD = 13, 64
#: Least z value of a piece's document share, and least toxic texts with it.
MIN_Z, MIN_DOCS = 5.0, 3
#: Size of each dictionary, and zstandard's segment and fragment lengths in training it.
ORDINARY, TOXIC = (16384, 32, 6), (4096, 16, 8)
DISTANCES = (1, 2, 3, 4, 5, 6, 8)
#: Letters read at once (to the end of a word), and distances that a task remembers.
BLOCK, KNOWN = 1 << 18, 1 << 17
_WORD = re.compile(r"[^\W\d_]{1,%d}" % WORD)
_GAP = re.compile(r"[\W\d_]")


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def words(text: str) -> Iterator[str]:
    return map(re.Match.group, _WORD.finditer(text.lower()))


def window_blocks(text: str) -> Iterator[list[str]]:
    """Windows of three words, the last one also the first of the next window; lists of a block's windows."""
    text, start, rest, some = text.lower(), 0, [], False
    while start < len(text):
        gap = _GAP.search(text, start + BLOCK)
        stop = gap.end() if gap else len(text)
        found = rest + _WORD.findall(text[start:stop])
        out = [f" {x} {y} {z} " for x, y, z in zip(found[0::2], found[1::2], found[2::2])]
        start, rest, some = stop, found[2 * len(out):], some or bool(out)
        yield out
    if len(rest) == 2 or rest and not some:
        yield [f" {' '.join(rest)} "]


def windows(text: str) -> Iterator[str]:
    return chain.from_iterable(window_blocks(text))


def pieces(word: str) -> list[str]:
    """The word and its beginnings, each after the blank before it."""
    return [f" {word} ", *(f" {word[:n]}" for n in (4, 5, 6, 7) if len(word) > n)]


def around(text: str, wanted: set[str]) -> Iterator[str]:
    """Words with a wanted piece, each between its neighbours."""
    before, word = None, None
    for after in (*words(text), None):
        if word is not None and not wanted.isdisjoint(pieces(word)):
            yield f" {' '.join(w for w in (before, word, after) if w is not None)} "
        before, word = word, after


def trained(samples: list[str], size: int, segment: int, fragment: int) -> bytes:
    import zstandard as zs

    raw = [s.encode() for s in samples]
    try:
        return zs.train_dictionary(size, raw, k=segment, d=fragment, level=LEVEL).as_bytes()
    except zs.ZstdError:  # too little to train on
        return b"".join(dict.fromkeys(raw))[:size]


class Distances:
    """Window distances of texts under a pair of dictionaries."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        import zstandard as zs

        def compressor(content: bytes):
            return zs.ZstdCompressor(level=LEVEL, write_content_size=False, write_dict_id=False,
                                     dict_data=zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT))

        self.ordinary, self.toxic = compressor(ordinary).compress, compressor(toxic).compress
        self.known: dict[str, int] = {}

    def of(self, window: str) -> int:
        raw = window.encode()
        distance = len(self.ordinary(raw)) - len(self.toxic(raw))
        if len(self.known) >= KNOWN:
            self.known.clear()
        self.known[window] = distance
        return distance

    def features(self, text: str) -> list[float]:
        """Windows at or over each distance threshold, the largest distance and the bytes of all windows."""
        counts, size, most, known = [0] * (DISTANCES[-1] + 1), 0, 0, self.known
        for block in window_blocks(text):
            size += len("".join(block).encode())
            for window, n in Counter(block).items():
                distance = known.get(window)
                if distance is None:
                    distance = self.of(window)
                if distance > 0:
                    counts[min(distance, DISTANCES[-1])] += n
                    most = max(most, distance)
        return [*(math.log1p(sum(counts[t:])) for t in DISTANCES), float(most), math.log1p(size)]


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / scale]
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = (z * (weight * p * (1 - p))[:, None]).T @ z + np.eye(len(w))
        step = np.linalg.solve(hessian, z.T @ (weight * (y - p)) - w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return mean, scale, w


def _piece_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of each class with a piece, summed over the task."""
    held: dict[int, Counter[str]] = {0: Counter(), 1: Counter()}
    for batch in batches:
        for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist()):
            held[toxic].update({p for w in set(words(text.as_py())) for p in pieces(w)})
    for toxic, counter in held.items():
        yield pa.RecordBatch.from_pydict({"piece": pa.array(list(counter), pa.string()),
                                          "toxic": pa.array([toxic] * len(counter), pa.int32()),
                                          "n": pa.array(list(counter.values()), pa.int64())})


def telling_pieces(half: DataFrame, n_toxic: int, n_ordinary: int) -> set[str]:
    """Pieces in significantly more toxic than ordinary texts of the sample."""
    held = half.mapInArrow(_piece_counts, "piece string, toxic int, n long").groupBy("piece").agg(
        F.sum(F.col("n") * F.col("toxic")).alias("a"), F.sum(F.col("n") * (1 - F.col("toxic"))).alias("b"))
    share = (F.col("a") + F.col("b")) / (n_toxic + n_ordinary)
    deviation = F.sqrt(share * (1 - share) * (1 / n_toxic + 1 / n_ordinary) + F.lit(1e-12))
    z = (F.col("a") / n_toxic - F.col("b") / n_ordinary) / deviation
    return {r["piece"] for r in held.where((F.col("a") >= MIN_DOCS) & (z >= MIN_Z)).select("piece").collect()}


def sample_windows(half: DataFrame, wanted: set[str] | None) -> list[str]:
    """At most ``WINDOWS`` windows of the texts, the first by a hash of their place."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                out = list(windows(text.as_py()) if wanted is None else around(text.as_py(), wanted))
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc_id] * len(out), pa.int64()),
                                                  "place": pa.array(range(len(out)), pa.int64()),
                                                  "window": pa.array(out, pa.string())})

    found = half.mapInArrow(cut, "doc_id long, place long, window string")
    return [r["window"] for r in found.orderBy(F.xxhash64("doc_id", "place"), "doc_id", "place").limit(WINDOWS).collect()]


def _measured(ordinary: bytes, toxic: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distances = Distances(ordinary, toxic)
        for batch in batches:
            rows = [distances.features(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "toxic": batch.column("toxic"),
                                              "features": pa.array(rows, pa.list_(pa.float64()))})
    return run


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Dictionaries and calibration from a bounded sample of labelled rows outside the held-out part."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(
        "doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(
            ~held_out(F.col("doc_id")))
    size = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not size.get(1) or not size.get(0):
        return None
    order = F.xxhash64("doc_id")
    chosen = known.where("toxic = 1").orderBy(order, "doc_id").limit(SAMPLE[1]).union(
        known.where("toxic = 0").orderBy(order, "doc_id").limit(SAMPLE[0]))
    sample = store(id_and_text(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(
        F.min(whole_text()).alias("text")).withColumn("calibrates", F.xxhash64("doc_id").bitwiseAND(F.lit(1)) == 1),
        "toxicity_sample")
    n = {(r["calibrates"], r["toxic"]): r["count"] for r in sample.groupBy("calibrates", "toxic").count().collect()}
    if len(n) < 4:
        return None
    half = sample.where("not calibrates").select("doc_id", "text", "toxic")
    wanted = telling_pieces(half, n[False, 1], n[False, 0])
    ordinary = trained(sample_windows(half.where("toxic = 0"), None), *ORDINARY) or b" "
    toxic = trained(sample_windows(half.where("toxic = 1"), wanted), *TOXIC) + ordinary
    rows = sample.where("calibrates").select("doc_id", "text", "toxic").mapInArrow(
        _measured(ordinary, toxic), "doc_id long, toxic int, features array<double>").orderBy("doc_id").collect()
    y = np.array([float(r["toxic"]) for r in rows])
    weight = np.array([size[r["toxic"]] / n[True, r["toxic"]] for r in rows])
    return Model(ordinary, toxic, *fit_logistic(np.array([r["features"] for r in rows]), y, weight / weight.mean()))


def _scored(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distances = model and Distances(model.ordinary, model.toxic)
        for batch in batches:
            if model is None:
                score = np.zeros(batch.num_rows)
            else:
                x = np.array([distances.features(t.as_py()) for t in batch.column(1)]).reshape(-1, len(model.mean))
                z = np.c_[np.ones(len(x)), (x - model.mean) / model.scale] @ model.weights
                score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], names=["doc_id", "score"])
    return run


def toxicity(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score and predicted of each document."""
    scores = id_and_text(docs).select("doc_id", whole_text().alias("text")).mapInArrow(_scored(model), "doc_id long, score double")
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
