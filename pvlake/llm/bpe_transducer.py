"""Operator 7, BPE encoding and decoding as a bounded-lookahead streaming transducer.

Merging in rank order moves the point up to which two continuations of a text agree to the left, by
the left part of a merge, only if the token before that point is the merge's left part and its right
part begins at the point. Two such steps follow each other only if the earlier merge's left part is
a prefix of the later merge's right part, so the longest chain of such merges, in rank order, bounds
how far the end of the input can matter. ``sufficient_lookahead`` computes that bound from the
merge list. A token that ends at least that many symbols before the end of what has been read is
stable: it is emitted, its symbols are forgotten, and memory stays constant whatever the input's
length. Pre-tokens are independent, so most words are complete at once and their ids are remembered
in a bounded table.

Decoding reads the ids only. ``JoinedDecoder`` is the incremental machine of the library's form for a
vocabulary without a decoder: token strings with one blank between, its state being whether a token
came before. ``TextDecoder`` gives the text itself: bytes of the tokens go through a UTF-8 state
machine, and the end-of-word suffix becomes a blank. Both hold a constant amount whatever was fed.

Defined results: null and empty texts have no ids and decode to the empty text; rows that repeat a
doc_id are encoded one by one; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pvlake.llm.common import documents, id_and_text

VOCABULARY = "word_bpe_49k.json"
SUFFIX = "</w>"
#: Words and space-free chunks remembered by each Python worker; a full table is emptied.
REMEMBERED_WORDS = 300_000
REMEMBERED_CHUNKS = 400_000
LONGEST = 48
SLICE = 1 << 18
_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Characters that Python counts as white space and the vocabulary's patterns do not.
_NOT_SPACE = re.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """Printable stand-in of each byte: printable Latin-1 bytes are themselves, the rest follow from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, nxt = [], 256
    for b in range(256):
        out.append(chr(b if b in own else nxt))
        nxt += b not in own
    return out


def sufficient_lookahead(merges: list[tuple[str, str]]) -> int:
    """Symbols before the end of the input that later input may still change."""
    by_left: dict[str, int] = {}
    longest = 0
    for left, right in merges:
        chain = len(left) + max((by_left.get(right[:i], 0) for i in range(1, len(right) + 1)), default=0)
        by_left[left] = max(by_left.get(left, 0), chain)
        longest = max(longest, chain)
    return longest + 1


class Remembered(dict):
    """Values of a function, kept for keys of at most ``longest`` characters; a full table is emptied."""

    def __init__(self, function, size: int, longest: int):
        self.function, self.size, self.longest = function, size, longest

    def __missing__(self, key):
        value = self.function(key)
        if len(key) <= self.longest:
            if len(self) >= self.size:
                self.clear()
            self[key] = value
        return value


class Transducer:
    """Encoder of one vocabulary file (a BPE model with an end-of-word suffix)."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        merges = [tuple(m) for m in spec["model"]["merges"]]
        self.ranks = {m: i for i, m in enumerate(merges)}
        self.lookahead = sufficient_lookahead(merges)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.numbers = {s: str(i) for s, i in self.vocab.items()}
        self.named = {str(i): s for i, s in self.strings.items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.pre_tokens = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.symbols = byte_symbols()
        self.bytes = {s: bytes([b]) for b, s in enumerate(self.symbols)}
        self.words = Remembered(self.word, REMEMBERED_WORDS, LONGEST)
        self.chunks = Remembered(self.chunk, REMEMBERED_CHUNKS, LONGEST)
        self.decoded = Remembered(self.joined, REMEMBERED_CHUNKS, 4 * LONGEST)

    def merge(self, symbols: list[str]) -> list[str]:
        """Lowest rank first, each rank from left to right."""
        rank, none = self.ranks.get, 1 << 30
        if len(symbols) <= LONGEST:
            ranks = [rank(p, none) for p in zip(symbols, symbols[1:])]
            while ranks and (best := min(ranks)) < none:
                i = ranks.index(best)
                symbols[i:i + 2] = [symbols[i] + symbols[i + 1]]
                del ranks[i]
                if i:
                    ranks[i - 1] = rank((symbols[i - 1], symbols[i]), none)
                if i < len(ranks):
                    ranks[i] = rank((symbols[i], symbols[i + 1]), none)
            return symbols
        # a heap of ranked pairs over a linked list; an entry whose pair has changed since is passed over
        symbols, n = list(symbols), len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i, r in enumerate(rank(p, none) for p in zip(symbols, symbols[1:])) if r < none]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if not symbols[i] or j >= n or rank((symbols[i], symbols[j])) != r:
                continue
            symbols[i] += symbols[j]
            symbols[j] = ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank((symbols[i], symbols[k]), none)) < none:
                    heapq.heappush(heap, (r, i))
            if (k := before[i]) >= 0 and (r := rank((symbols[k], symbols[i]), none)) < none:
                heapq.heappush(heap, (r, k))
        return [s for s in symbols if s]

    def stream(self, symbols: Iterable[str], window: int | None = None) -> Iterator[str]:
        """Tokens of one pre-token, emitted once stable; holds ``window`` plus the lookahead in symbols."""
        window = window or 4 * self.lookahead
        held: list[str] = []
        for s in symbols:
            held.append(s)
            if len(held) >= self.lookahead + window:
                used, limit = 0, len(held) - self.lookahead
                for token in self.merge(held):
                    size = self._size(token)
                    if used + size > limit:
                        break
                    used += size
                    yield token
                held = held[used:]
        yield from self.merge(held)

    def _size(self, token: str) -> int:
        """Symbols in a token; the suffix belongs to the last symbol."""
        return len(token) - (len(SUFFIX) if token.endswith(SUFFIX) and len(token) > len(SUFFIX) else 0)

    def word(self, pre_token: str) -> str:
        """Decimal ids of one pre-token, joined by a blank."""
        symbols = [self.symbols[b] for b in pre_token.encode()]
        symbols[-1] += SUFFIX
        tokens = self.merge(symbols) if len(symbols) <= 2 * LONGEST else self.stream(symbols)
        return " ".join([self.numbers[t] for t in tokens if t in self.numbers])

    def normal(self, chunk: str) -> str:
        if not chunk.isascii():
            # lower case letter by letter: a sigma at the end of a word is like any other
            chunk = unicodedata.normalize("NFC", chunk).replace("Σ", "σ")
        return chunk.lower()

    def chunk(self, chunk: str) -> str:
        """Decimal ids, joined by a blank, of a text without white space."""
        if chunk.isascii() and chunk.isalpha():  # one pre-token
            return self.words[chunk.lower()]
        return " ".join(filter(None, map(self.words.__getitem__, self.pre_tokens(self.normal(chunk)))))

    def joined(self, run: str) -> str:
        """Token strings, joined by a blank, of such ids."""
        return " ".join(map(self.named.__getitem__, run.split(" ")))

    def encode_chunks(self, text: str) -> Iterator[list[str]]:
        """The ids of the text's chunks, slice by slice; special strings are one id each."""
        known = self.chunks.__getitem__
        for part in self.split_special.split(text) if "<|" in text else [text]:
            if part in self.special:
                yield [str(self.special[part])]
                continue
            for piece in _space_slices(part):
                # a chunk may hold nothing that the vocabulary's pattern takes
                if runs := list(filter(None, map(known, self.pre_spaces(piece)))):
                    yield runs

    @staticmethod
    def pre_spaces(text: str) -> list[str]:
        if _NOT_SPACE.search(text):
            return re.split("[^\\S\x1c-\x1f]+", text)
        return text.split()

    def encode(self, text: str) -> list[int]:
        return [int(i) for runs in self.encode_chunks(text) for run in runs for i in run.split(" ")]

    def decode(self, ids: Iterable[int]) -> str:
        return JoinedDecoder(self).feed([str(i) for i in ids])


class JoinedDecoder:
    """Incremental ids to the library's form: feed runs of ids (decimal, joined by a blank), get what follows."""

    def __init__(self, transducer: Transducer):
        self.t = transducer
        self.started = False

    def feed(self, runs: list[str]) -> str:
        if not runs:
            return ""
        text = " ".join(map(self.t.decoded.__getitem__, runs))
        if self.started:
            return " " + text
        self.started = True
        return text


class TextDecoder:
    """Incremental ids to text: feed ids, get the text that is certain so far."""

    def __init__(self, transducer: Transducer):
        self.t = transducer
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, token_id: int) -> str:
        token = self.t.strings[token_id]
        if token in self.t.special:
            return self.utf8.decode(b"", final=True) + token
        end = token.endswith(SUFFIX)
        raw = b"".join(self.t.bytes[c] for c in (token[:-len(SUFFIX)] if end else token))
        return self.utf8.decode(raw, final=end) + " " * end

    def close(self) -> str:
        return self.utf8.decode(b"", final=True)


def _space_slices(text: str) -> Iterator[str]:
    """Slices of about ``SLICE`` characters that end at white space."""
    start, n = 0, len(text)
    while n - start > SLICE:
        found = re.compile("[ \t\n\r]").search(text, start + SLICE)
        if not found:
            break
        yield text[start:found.start()]
        start = found.end()
    yield text[start:]


_held: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """The worker's transducer; the file is read once."""
    if path not in _held:
        _held[path] = Transducer(path)
    return _held[path]


def _digests(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        t = transducer(public_tokenizers.path(vocabulary))
        for batch in batches:
            counts, ids, texts = [], [], []
            for text in batch.column(1):
                n, a, b, decoder = 0, hashlib.sha256(), hashlib.sha256(), JoinedDecoder(t)
                for runs in t.encode_chunks(text.as_py() or ""):
                    written = " ".join(runs)
                    a.update(((" " if decoder.started else "") + written).encode())
                    b.update(decoder.feed(runs).encode())
                    n += written.count(" ") + 1
                counts.append(n)
                ids.append(a.hexdigest())
                texts.append(b.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return run


def encode_digests(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Number of ids and digests of ids and decoded text, per document."""
    return id_and_text(docs).mapInArrow(_digests(vocabulary), _SCHEMA)


def _ids(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        t = transducer(public_tokenizers.path(vocabulary))
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([t.encode(x.as_py() or "") for x in batch.column(1)], pa.list_(pa.int32()))],
                names=["doc_id", "ids"])
    return run


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and ids of each text."""
    return id_and_text(docs).mapInArrow(_ids(vocabulary), "doc_id long, ids array<int>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(documents(spark, sf_dir))
