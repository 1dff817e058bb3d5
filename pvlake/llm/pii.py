"""Operator 9, personal data: candidate spans scored by gradient boosted trees.

Base spans (e-mail, IP address, payment card, phone) are found by fixed patterns and always stay.
High-recall generators propose further, overlapping spans of the same kinds: spaced or bracketed
forms ("name at host dot com", "192[.]168[.]0[.]1"), digit groups in other layouts. Boosted
regression trees score a candidate by its format and by the words around it. They are trained on
the candidates of all documents: those that overlap a base span of their kind, and
base spans rewritten into the looser forms, are positive; the rest, and plain words rewritten so, are negative. The threshold of each
kind is the lowest one that keeps precision on the half not trained on (every second candidate of
each kind and label, by document and place); spans that pass it and touch no base span are added,
best first. Up to ``IN_MEMORY`` candidates are fitted on the driver. More are counted by distinct features,
and a level of a tree is one aggregate over these: each task sums its rows' gradients by node, feature and
value, in fixed point, so the order of addition doesn't matter. Only the sums reach the driver.

Defined results: null and empty texts have no spans; rows that repeat a doc_id are read one by one;
without a base span nothing is added; an empty table gives no rows; other columns are
never read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pvlake.llm.common import documents, id_and_text, on_workers
from pvlake.operators.ranking import ordinal_position
from pvlake.session import materialize

KINDS = ("email", "ip", "card", "phone")
#: Up to this number of candidates is fitted on the driver, and this number of distinct ones in a task beyond.
IN_MEMORY, ROWS_PER_TASK = 40_000, 100_000
PRECISION = 0.99
#: No threshold lies under this score.
LEAST_SCORE = 0.8
ROUNDS, DEPTH, RATE = 30, 3, 0.3
#: A split is tried after each of a feature's least values, up to this number.
CUTS = 64
#: Gradients are added as multiples of this.
_UNIT = 2.0 ** -32

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: No match can begin inside a run of digits, as the whole run would have matched or failed alike.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_DIGITS_ONLY = re.compile("[^0-9]")

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Left to right around each at sign, which a local part cannot hold."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        host = _DOMAIN.match(text, at + 1) if start < at else None
        if host:
            yield start, host.end()
            free = host.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[Span]:
    out: list[Span] = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := _DIGITS_ONLY.sub("", m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_DIGITS_ONLY.sub("", m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


_AT = r"(?:\s?[\[({]\s?at\s?[\])}]\s?|\sat\s|\s?@\s?)"
_DOT = r"(?:\s?[\[({]\s?(?:dot|\.)\s?[\])}]\s?|\sdot\s|\.)"
#: What makes a loose e-mail rare; the pattern itself is tried only around such places.
_HINT = re.compile(r"[\[({]\s?(?:at|dot|\.)\s?[\])}]|\sdot\s|\s@|@\s|\sat\s(?=[A-Za-z0-9-]+\.[A-Za-z0-9-])", re.I)
#: No loose e-mail has more characters.
_LOOSE_LENGTH = 500
_LOOSE_EMAIL = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,5}}", re.I)
_LOOSE_IP = re.compile(r"(?<![0-9A-Za-z])[0-9]{1,3}(?:\s?[\[(]?[.][\])]?\s?[0-9]{1,3}){3}(?![0-9A-Za-z])")
_LONG_NUMBER = re.compile(r"(?<![0-9A-Za-z])[0-9]{13,19}(?![0-9A-Za-z])")
_LOOSE_DIGITS = re.compile(r"(?<![0-9A-Za-z])[(]?[0-9](?:[\s().\-/]{0,3}[0-9]){8,24}(?![0-9A-Za-z])")
#: Words before a span that name its kind.
CONTEXT = (
    ("mail", "email", "e-mail", "contact", "write"),
    ("ip", "host", "server", "address", "ping"),
    ("card", "visa", "mastercard", "credit", "payment", "iban"),
    ("phone", "tel", "telephone", "call", "mobile", "fax", "cell"),
)
#: Common last labels of host names.
TOP_LEVEL = ("com", "org", "net", "edu", "gov", "info", "io", "eu", "uk", "de", "fr", "es", "it", "us", "ca")
_BEFORE = re.compile(r"[\w-]+")


def candidates(text: str) -> list[Span]:
    """Overlapping proposals of the four kinds; more than will be kept."""
    out: list[Span] = []
    last = -1
    for hint in _HINT.finditer(text):
        for m in _LOOSE_EMAIL.finditer(text, max(0, hint.start() - _LOOSE_LENGTH), hint.end() + 2 * _LOOSE_LENGTH):
            if m.start() > hint.end() + 200:  # what starts later has a hint of its own, or none
                break
            if m.start() > last:
                out.append((m.start(), 0, m.end()))
                last = m.start()
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _LOOSE_IP.finditer(text)]
        out += [(m.start(), 2, m.end()) for m in _LONG_NUMBER.finditer(text)]
        for m in _LOOSE_DIGITS.finditer(text):
            n = len(_DIGITS_ONLY.sub("", m[0]))
            if 13 <= n <= 19:
                out.append((m.start(), 2, m.end()))
            if 9 <= n <= 15:
                out.append((m.start() - (text[m.start() - 1:m.start()] == "+"), 3, m.end()))
    return out


def features(text: str, span: Span) -> list[float]:
    start, kind, end = span
    s = text[start:end]
    digits = _DIGITS_ONLY.sub("", s)
    groups = re.findall("[0-9]+", s)
    before = [w.lower() for w in _BEFORE.findall(text[max(0, start - 40):start])[-3:]]
    octets = len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)
    top = re.findall("[A-Za-z]+", s)
    return [
        kind, len(s), len(digits), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        float(luhn(digits)) if 13 <= len(digits) <= 19 else 0.0, float(octets), float(s.startswith("+")), s.count("("),
        s.count("-"), s.count("."), s.count(" "), s.count("/"), s.count("["), float("@" in s),
        float(re.search(r"\bat\b", s, re.I) is not None), float(re.search(r"\bdot\b", s, re.I) is not None),
        len(top[-1]) if top else 0, float(bool(top) and top[-1].lower() in TOP_LEVEL), float(len(groups) > 0 and len(set(digits)) <= 2),
        float(any(w in CONTEXT[kind] for w in before)), float(any(w in c for k, c in enumerate(CONTEXT) if k != kind for w in before)),
        float(text[start - 1:start].isalnum()), float(text[end:end + 1].isalnum()),
    ]


def loosened(text: str, span: Span, turn: int) -> tuple[str, Span] | None:
    """The text with one base span rewritten into a looser form, and that form's span."""
    start, kind, end = span
    s = text[start:end]
    digits = _DIGITS_ONLY.sub("", s)
    if kind == 0:
        local, _, host = s.partition("@")
        if turn % 2:  # most addresses of a corpus may hold digits; the forms must not depend on them
            local, host = _DIGIT.sub("", local) or "a", _DIGIT.sub("", host)
        forms = (f"{local} at {host.replace('.', ' dot ')}", f"{local} [at] {host.replace('.', ' [dot] ')}",
                 f"{local}(at){host}", f"{local} @ {host}", f"{local} at {host}")
    elif kind == 1:
        forms = (s.replace(".", "[.]"), s.replace(".", " . "), s.replace(".", "(.)"))
    elif kind == 2:
        forms = tuple(sep.join(digits[i:i + 4] for i in range(0, len(digits), 4)) for sep in (".", "/", " - "))
    else:
        national = digits[-10:]
        forms = (f"({national[:3]}) {national[3:6]}-{national[6:]}", f"{national[:3]}-{national[3:6]}-{national[6:]}",
                 f"{national[:3]}.{national[3:6]}.{national[6:]}")
    new = forms[turn // 2 % len(forms)]
    text = text[max(0, start - 60):start] + new + text[end:end + 60]
    at = min(start, 60)
    return text, (at, kind, at + len(new))


@dataclass
class Model:
    """Trees as (feature, threshold, value) arrays of complete binary trees, and a threshold per kind."""

    first: float
    trees: list[tuple[list[int], list[float], list[float]]]
    thresholds: list[float]

    def score(self, x: list[float]) -> float:
        total = self.first
        for feature, cut, leaf in self.trees:
            node = 0
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[feature[node]] > cut[node])
            total += leaf[node - len(feature)]
        return 1 / (1 + float(np.exp(-total)))


def boost(x: np.ndarray, y: np.ndarray) -> tuple[float, list]:
    """Gradient boosting of logistic loss; splits at observed values."""
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    first = float(np.log(share / (1 - share)))
    total, trees = np.full(len(y), first), []
    values = [np.unique(x[:, j])[:-1][:CUTS] for j in range(x.shape[1])]
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        feature, cut = [0] * (2 ** DEPTH - 1), [np.inf] * (2 ** DEPTH - 1)
        node = np.zeros(len(y), int)
        for k in range(2 ** DEPTH - 1):
            here = node == k
            if here.any():
                xs, gs, hs = x[here], g[here], h[here]
                G, H = gs.sum(), hs.sum()
                best = 1e-6
                for j, cuts in enumerate(values):
                    for c in cuts:
                        left = xs[:, j] <= c
                        gl, hl = gs[left].sum(), hs[left].sum()
                        gain = gl * gl / (hl + 1) + (G - gl) ** 2 / (H - hl + 1) - G * G / (H + 1)
                        if gain > best:
                            best, feature[k], cut[k] = gain, j, float(c)
            node = np.where(here, 2 * k + 1 + (x[:, feature[k]] > cut[k]), node)
        leaf = [0.0] * 2 ** DEPTH
        for k in range(2 ** DEPTH):
            here = node == k + 2 ** DEPTH - 1
            leaf[k] = float(RATE * g[here].sum() / (h[here].sum() + 1))
        total += np.array(leaf)[node - (2 ** DEPTH - 1)]
        trees.append((feature, cut, leaf))
    return first, trees


def places(found: list[Span], size: int) -> bytearray:
    """One byte a character, set inside the spans: whether a span touches one is a look at its own characters."""
    held = bytearray(size)
    for a, _, b in found:
        held[a:b] = b"\1" * (b - a)
    return held


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(features, label) of each candidate and of loosened base spans."""
    for batch in batches:
        xs, ys, ends = [], [], []
        for turn, text in enumerate(batch.column(1)):
            text = text.as_py() or ""
            base = base_spans(text)
            held = [places([b for b in base if b[1] == k], len(text)) for k in range(len(KINDS))]
            for c in candidates(text):
                xs.append(features(text, c))
                ys.append(int(held[c[1]].find(1, c[0], c[2]) >= 0))
            words = _BEFORE.findall(text[:200])[:3]
            if len(words) == 3:  # plain words in the form of a loose address
                t = f"{words[0]} at {words[1]} dot {words[2]}"
                xs.append(features(t, (0, 0, len(t))))
                ys.append(0)
            for b in base:
                t, span = loosened(text, b, turn)
                xs.append(features(t, span))
                ys.append(1)
            ends.append(len(ys))
        n = np.diff([0, *ends])
        ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(n)), n)))
        place = np.arange(len(ys)) - np.repeat(np.array(ends, int) - n, n)
        yield pa.RecordBatch.from_arrays([ids, pa.array(place, pa.int64()), pa.array(xs, pa.list_(pa.float64())), pa.array(ys, pa.int64())],
                                         names=["doc_id", "place", "x", "y"])


def halves(kind: np.ndarray, y: np.ndarray) -> np.ndarray:
    """True for every second row of each kind and label, in the order given."""
    order = np.lexsort((y, kind))
    new = np.append(True, (kind[order][1:] != kind[order][:-1]) | (y[order][1:] != y[order][:-1]))
    first = np.flatnonzero(new)
    out = np.empty(len(y), bool)
    out[order] = (np.arange(len(y)) - np.repeat(first, np.diff(np.append(first, len(y))))) % 2 == 0
    return out


def totals(x: np.ndarray, first: float, trees: list) -> np.ndarray:
    """Sums of first value and leaves for many rows, as ``Model.score`` adds them."""
    out, row = np.full(len(x), first), np.arange(len(x))
    for feature, cut, leaf in trees:
        node = np.zeros(len(x), int)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[row, np.array(feature)[node]] > np.array(cut)[node])
        out += np.array(leaf)[node - len(feature)]
    return out


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)


def _least_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each feature's least values in a batch, one more than cuts are tried."""
    for batch in batches:
        if batch.num_rows:
            least = [np.unique(c)[:CUTS + 1] for c in _matrix(batch).T]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(least)), [*map(len, least)]), pa.int64()),
                                              pa.array(np.concatenate(least), pa.float64())], names=["j", "v"])


def _sums(first: float, trees: list, feature: list[int], cut: list[float], level: int, cuts: list[np.ndarray]):
    """Gradient sums of a level's nodes by feature and place of the value among its cuts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, nodes = CUTS + 1, 2 ** level
        sums = np.zeros((2, nodes * len(cuts) * width), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, n = _matrix(batch), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            p = 1 / (1 + np.exp(-totals(x, first, trees)))
            gh = [np.rint(v / _UNIT).astype(np.int64) * n for v in (y - p, p * (1 - p))]
            node, row = np.zeros(len(x), int), np.arange(len(x))
            for _ in range(level):
                node = 2 * node + 1 + (x[row, np.array(feature)[node]] > np.array(cut)[node])
            for j, c in enumerate(cuts):
                at = ((node - (nodes - 1)) * len(cuts) + j) * width + np.searchsorted(c, x[:, j])
                for total, v in zip(sums, gh, strict=True):
                    np.add.at(total, at, v)
        held = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), *[pa.array(t[held], pa.int64()) for t in sums]], names=["at", "g", "h"])
    return run


def boost_counted(rows: DataFrame) -> tuple[float, list]:
    """``boost`` over (x, y, n) rows, n counting equal ones: a level of a tree is one aggregate."""
    n, right = rows.agg(F.sum("n"), F.sum(F.col("y") * F.col("n"))).first()
    share = min(max(right / n, 1e-3), 1 - 1e-3)
    first = float(np.log(share / (1 - share)))
    least = rows.mapInArrow(_least_values, "j long, v double").distinct().withColumn(
        "r", F.row_number().over(Window.partitionBy("j").orderBy("v"))).where(F.col("r") <= CUTS + 1).orderBy("j", "v").collect()
    values: list[list[float]] = [[] for _ in range(1 + max(r["j"] for r in least))]
    for r in least:
        values[r["j"]].append(r["v"])
    cuts = [np.array(v[:-1][:CUTS]) for v in values]
    trees: list = []
    for _ in range(ROUNDS):
        feature, cut, leaf = [0] * (2 ** DEPTH - 1), [np.inf] * (2 ** DEPTH - 1), [0.0] * 2 ** DEPTH
        for level in range(DEPTH):
            found = rows.mapInArrow(_sums(first, trees, feature, cut, level, cuts), "at long, g long, h long").groupBy("at").agg(
                F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            sums = np.zeros((2, 2 ** level * len(cuts) * (CUTS + 1)), np.int64)
            for r in found:
                sums[:, r["at"]] = r["g"], r["h"]
            upto = np.cumsum(sums.reshape(2, 2 ** level, len(cuts), CUTS + 1), axis=-1) * _UNIT
            for i in range(2 ** level):
                G, H = upto[:, i, 0, -1]
                k, best, sides = 2 ** level - 1 + i, 1e-6, ((G, H), (0.0, 0.0))
                for j, c in enumerate(cuts):
                    for b in range(len(c)):
                        gl, hl = upto[:, i, j, b]
                        gain = gl * gl / (hl + 1) + (G - gl) ** 2 / (H - hl + 1) - G * G / (H + 1)
                        if gain > best:
                            best, feature[k], cut[k], sides = gain, j, float(c[b]), ((gl, hl), (G - gl, H - hl))
                if level == DEPTH - 1:
                    leaf[2 * i:2 * i + 2] = [float(RATE * g / (h + 1)) for g, h in sides]
        trees.append((feature, cut, leaf))
    return first, trees


def _scored(first: float, trees: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, n = _matrix(batch), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([
                pa.array(x[:, 0].astype(np.int64), pa.int64()), pa.array(1 / (1 + np.exp(-totals(x, first, trees))), pa.float64()),
                pa.array(n, pa.int64()), pa.array(y * n, pa.int64())], names=["kind", "s", "n", "good"])
    return run


def thresholds_counted(rows: DataFrame, first: float, trees: list) -> list[float]:
    """Each kind's threshold from all of ``rows`` (x, y, n): counts from the best score down, by score within ten thousand ranges."""
    scored = materialize(rows.mapInArrow(_scored(first, trees), "kind long, s double, n long, good long").groupBy("kind", "s").agg(
        F.sum("n").alias("n"), F.sum("good").alias("good")).withColumn("b", F.floor(F.col("s") * 10_000)), "pii-scores")
    down = Window.partitionBy("kind").orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    before = scored.groupBy("kind", "b").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).select(
        "kind", "b", *[F.coalesce(F.sum(c).over(down), F.lit(0)).alias(f"{c}_before") for c in ("n", "good")])  # <= 10,001 rows a kind
    inside = Window.partitionBy("kind", "b").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    share = (F.col("good_before") + F.sum("good").over(inside)) / (F.col("n_before") + F.sum("n").over(inside))
    last = scored.join(F.broadcast(before), ["kind", "b"]).withColumn("share", share).where(
        (F.col("share") >= PRECISION) & (F.col("s") >= 0.5)).groupBy("kind").agg(F.min("s").alias("last"))
    out = [2.0] * len(KINDS)
    for r in scored.join(F.broadcast(last), "kind").groupBy("kind", "last").agg(
            F.max(F.when(F.col("s") < F.col("last"), F.col("s"))).alias("next")).collect():
        out[r["kind"]] = max(LEAST_SCORE, (r["last"] + r["next"]) / 2 if r["next"] is not None else 0.0)
    return out


def fit_counted(examples: DataFrame) -> Model:
    """``fit`` on any number of examples: the same halves, trees and thresholds from counts of distinct features."""
    group = ["kind", "y"]
    placed = ordinal_position(examples.withColumns({"kind": F.col("x")[0], "hash": F.xxhash64("doc_id")}),
                              [F.col(c) for c in (*group, "hash", "doc_id", "place", "x")])
    firsts = placed.groupBy(*group).agg(F.min("pos").alias("first"))  # at most 8 rows
    counted = materialize(placed.join(F.broadcast(firsts), group).groupBy(
        "x", "y", ((F.col("pos") - F.col("first")) % 2 == 0).alias("trained")).agg(F.count("*").alias("n")), "pii-counted")
    parts = max(1, -(-counted.count() // ROWS_PER_TASK))
    trained, rest = (counted.where(c).select("x", "y", "n").coalesce(parts) for c in ("trained", "not trained"))
    first, trees = boost_counted(trained)
    return Model(first, trees, thresholds_counted(rest, first, trees))


def fit(docs: DataFrame) -> Model | None:
    """The model of all candidates of ``docs``."""
    rows = id_and_text(docs).where("text IS NOT NULL")
    examples = materialize(rows.mapInArrow(_examples, "doc_id long, place long, x array<double>, y long"), "pii-examples")
    n, right = examples.agg(F.count("*"), F.sum("y")).first()
    if not right:
        return None
    if n > IN_MEMORY:
        return fit_counted(examples)
    got = examples.orderBy(F.xxhash64("doc_id"), "doc_id", "place", "x", "y").select("x", "y").collect()
    x, y = np.array([r["x"] for r in got]), np.array([r["y"] for r in got], float)
    trained = halves(x[:, 0], y)
    first, trees = boost(x[trained], y[trained])
    model = Model(first, trees, [2.0] * len(KINDS))
    rest = np.flatnonzero(~trained)
    scores = np.array([model.score(r) for r in x[rest].tolist()])
    for kind in range(len(KINDS)):
        own = x[rest, 0] == kind
        order = np.argsort(-scores[own], kind="stable")
        if own.any():
            s, right = scores[own][order], y[rest][own][order]
            good = np.flatnonzero((np.cumsum(right) / np.arange(1, len(s) + 1) >= PRECISION) & (s >= 0.5)
                                  & np.append(s[1:] < s[:-1], True))
            if len(good):
                i = good[-1]
                model.thresholds[kind] = max(LEAST_SCORE, float(s[i] + s[i + 1]) / 2 if i + 1 < len(s) else 0.0)
    return model


def spans(text: str, model: Model | None) -> tuple[list[Span], list[Span]]:
    """(base spans, base and added spans), both by start and kind."""
    base = base_spans(text)
    proposed = candidates(text) if model else []
    if not proposed:
        return base, base
    taken, held = list(base), places(base, len(text))
    scored = [(model.score(features(text, c)), c) for c in proposed if held.find(1, c[0], c[2]) < 0]
    for score, c in sorted(scored, key=lambda x: (-x[0], x[1])):
        if score >= model.thresholds[c[1]] and held.find(1, c[0], c[2]) < 0:
            taken.append(c)
            held[c[0]:c[2]] = b"\1" * (c[2] - c[0])
    return base, sorted(taken)


def digest(found: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def redact(text: str, found: list[Span]) -> str:
    """Each run of overlapping spans is replaced by the name of its first kind."""
    out, at = [], 0
    runs: list[list[int]] = []
    for a, k, b in found:
        if runs and a < runs[-1][2]:
            runs[-1][2] = max(runs[-1][2], b)
        else:
            runs.append([a, k, b])
    for a, k, b in runs:
        out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = b
    return "".join(out) + text[at:]


_SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _found(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, shas, texts = [[] for _ in KINDS], [], []
            for text in batch.column(1):
                base, every = spans(text.as_py() or "", model)
                for k, c in enumerate(counts):
                    c.append(sum(b[1] == k for b in base))
                shas.append(hashlib.sha256(digest(base).encode()).hexdigest())
                texts.append(digest(every))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(shas, pa.string()), pa.array(texts, pa.string())],
                names=[c.split()[0] for c in _SCHEMA.split(", ")])
    return run


def find_personal_data(docs: DataFrame, model: Model | None) -> DataFrame:
    """Spans of every document, see the module's text."""
    return id_and_text(docs).mapInArrow(_found(model), _SCHEMA)


def redact_personal_data(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with the spans in ``text`` replaced; ``n_chars`` follows where it is there."""
    on_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [t if t is None else redact(t, spans(t, model)[1]) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return find_personal_data(docs, fit(docs))
