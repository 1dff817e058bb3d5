"""Operator 3, suffix-array dedup with a run-length index.

Texts are held as UTF-8 in compressed blocks of about ``BLOCK`` bytes, so every later step reads the
same rows. A window of ``LENGTH`` bytes is named by its minimizer, the least hash of its 20-byte
strings; equal windows have equal minimizers. A segment is a run of windows with one minimizer.

1. Blocks send the minimizers they hold; a bucket tells them which occur in two blocks or more, and
   which have more than ``PART`` segments in all ("hot", as at the ends of a passage that very many
   documents share: there, each document's own text makes a segment of its own).
2. Blocks send each distinct segment with such a minimizer once, with its smallest document. A bucket
   so has all texts around its minimizers. Where a minimizer stands in one segment only, its first
   document is the answer. The others form the repetitive text that the bucket indexes: suffixes are
   sorted by prefix doubling, the Burrows-Wheeler transform is compressed to runs, and at the borders
   of suffix intervals of ``LENGTH`` common bytes the smallest document is sampled. The suffix array
   is dropped, and all segments stream through the runs from their ends backwards, which gives each
   window's interval and whether its match reaches a document before its own.
   Segments of a hot minimizer are not indexed: each of their windows is keyed anew by a hash of its
   ``LENGTH`` bytes, and a block sends each distinct one once, with its smallest document. These go
   to buckets by that key, so that one minimizer is dealt over all buckets.
3. Blocks get the covered windows of their segments back and cut the covered bytes.

Only blocks, minimizers, distinct segments and distinct windows of hot minimizers move. One window is
at most one entry per block, however many documents hold it; so is one segment. No text is compared
with all others.

Defined results: null and empty texts have no bytes; rows that repeat a doc_id are judged one by
one, and do not cover each other; rows without doc_id come after all others; an empty table gives
no rows; other columns are never read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pvlake.llm.common import documents, id_and_text, mix, sliced, text_buffers
from pvlake.session import materialize

LENGTH, GRAM = 50, 20
BLOCK = 3 << 20
#: Most windows of a segment; with LENGTH - 1 bytes more it stays under 112 symbols, 4 doublings of 7.
MOST = 62
#: Text bytes per bucket; the number of buckets grows with the corpus.
BUCKET = 2 << 20
#: Beyond so many buckets, their number and their size grow alike, as a block sends a row to each.
MANY = 512
#: Texts that one run index takes: minimizers are put together up to it, and one with more is hot.
PART = 8_000
LAST = np.iinfo(np.int64).max
_P = 0x9E3779B97F4A7C15
_VALUE = mix(np.arange(256, dtype=np.uint64), 41)
_CHUNK = 1 << 15
_WHOLE = np.uint64(0xFFFFFFFFFFFFFFFF)
_BLOCKS = "block long, ids binary, offsets binary, data binary"


def _power(k: int) -> np.uint64:
    return np.uint64(pow(_P, k, 1 << 64))


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in the order of ``key``, where in it each key's rows begin, and how many they are."""
    order = np.argsort(key)
    ranked = key[order]
    begin = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])[:len(ranked)])
    return order, begin, np.diff(np.append(begin, len(ranked)))


def _held(key: np.ndarray, ranked: np.ndarray) -> np.ndarray:
    """Which of the ascending ``ranked`` occur in ``key``."""
    key = np.sort(key)
    if not len(key):
        return np.zeros(len(ranked), bool)
    return key[np.minimum(np.searchsorted(key, ranked), len(key) - 1)] == ranked


def _zip(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=9).compress(raw)


def _unzip(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(raw)


def _to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    for batch in sliced(batches, BLOCK):
        raw, offsets = text_buffers(batch)
        ids = batch.column(0)
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        numbers = np.where(known, ids.fill_null(0).to_numpy(), LAST)
        yield pa.RecordBatch.from_arrays([
            pa.array([number], pa.int64()), pa.array([numbers.astype(np.int64).tobytes()], pa.binary()),
            pa.array([offsets.astype(np.int64).tobytes()], pa.binary()), pa.array([_zip(raw.tobytes())], pa.binary()),
        ], names=["block", "ids", "offsets", "data"])
        number += 1


class Segments:
    """A block's texts and their segments: first byte, number of windows, minimizer, content hash, document."""

    def __init__(self, ids: bytes, offsets: bytes, data: bytes):
        self.ids = np.frombuffer(ids, np.int64)
        self.offsets = np.frombuffer(offsets, np.int64)
        self.raw = np.frombuffer(_unzip(data), np.uint8)
        long = np.flatnonzero(np.diff(self.offsets) >= LENGTH)
        self.start = self.windows = np.zeros(0, np.int64)
        self.minimizer = self.content = self.grams = np.zeros(0, np.uint64)
        if not len(long):
            self.row = self.doc = self.start
            return
        grams = self.grams = self._grams()
        least = self._least(grams)
        # a segment begins where the minimizer changes or a text does, and ends there or after a text's last window
        new = np.ones(len(least) + 1, bool)
        np.not_equal(least[1:], least[:-1], out=new[1:-1])
        new[self.offsets[long]] = new[self.offsets[long + 1] - LENGTH + 1] = True
        mark = np.flatnonzero(new)
        row = np.searchsorted(self.offsets, mark[:-1], side="right") - 1
        within = np.flatnonzero(mark[:-1] + LENGTH <= self.offsets[row + 1])
        first, length, row = mark[within], np.diff(mark)[within], row[within]
        value = least[first]
        while (length > MOST).any():  # long runs of one minimizer, as in a repeated letter
            pieces = -(-length // MOST)
            k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first, length = np.repeat(first, pieces) + MOST * k, np.minimum(MOST, np.repeat(length, pieces) - MOST * k)
            value, row = np.repeat(value, pieces), np.repeat(row, pieces)
        self.start, self.windows, self.minimizer = first, length, value
        # a segment's bytes are named by enough of its strings to cover them
        end = self.start + self.windows + LENGTH - 1 - GRAM
        self.content = self.windows.astype(np.uint64)
        for k in range(-(-(MOST + LENGTH - 1) // GRAM)):
            self.content = mix(self.content * np.uint64(_P) + grams[np.minimum(self.start + k * GRAM, end)], 7)
        self.row = row
        self.doc = self.ids[self.row]

    def names(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Bucket of each segment, and a name that joins it and the short minimizer; both fit 64 bits."""
        bucket = (self.minimizer % np.uint64(buckets)).astype(np.int64)
        return bucket, (bucket << 32) | (self.minimizer >> np.uint64(32)).astype(np.int64)

    def each_window(self, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First byte, content hash and document of each window of the segments ``pick``."""
        size = self.windows[pick]
        place = np.repeat(self.start[pick] - np.cumsum(size) + size, size) + np.arange(size.sum())
        content = np.full(len(place), LENGTH, np.uint64)
        for k in range(-(-LENGTH // GRAM)):
            content = mix(content * np.uint64(_P) + self.grams[place + min(k * GRAM, LENGTH - GRAM)], 8)
        return place, content, np.repeat(self.doc[pick], size)

    def _grams(self) -> np.ndarray:
        """Hash of the GRAM bytes from each place, in chunks that fit a processor's cache."""
        n = len(self.raw) - GRAM + 1
        out = np.empty(n, np.uint64)
        for c in range(0, n, _CHUNK):
            h = _VALUE.take(self.raw[c:c + _CHUNK + GRAM - 1])
            width, have, x = 1, 0, np.zeros(len(h) + 1, np.uint64)
            while True:  # ``h`` hashes ``width`` bytes, ``x`` the last ``have`` of a string
                if GRAM & width:
                    y = h[:len(x) - width] * _power(have)
                    y += x[width:]
                    x, have = y, have + width
                if have == GRAM:
                    break
                y = h[:-width] * _power(width)
                y += h[width:]
                h, width = y, 2 * width
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(29)
            out[c:c + len(x)] = x
        return out

    @staticmethod
    def _least(grams: np.ndarray) -> np.ndarray:
        """The least of the strings in each window."""
        span = LENGTH - GRAM + 1
        n = len(grams) - span + 1
        out = np.empty(n, np.uint64)
        for c in range(0, n, _CHUNK):
            x, width = grams[c:c + _CHUNK + span - 1], 1
            while 2 * width <= span:
                x = np.minimum(x[:-width], x[width:])
                width *= 2
            rest = span - width
            x = np.minimum(x[:len(x) - rest], x[rest:]) if rest else x
            out[c:c + len(x)] = x
        return out


def _buckets(total: int) -> int:
    n = max(total // BUCKET, 8)
    return int(n if n <= MANY else math.sqrt(MANY * n))


def _more(count: np.ndarray) -> bytes:
    """Places and values of the counts over one, which are few."""
    at = np.flatnonzero(count > 1)
    return at.astype(np.uint32).tobytes() + count[at].tobytes()


def _counts(n: int, more: bytes) -> np.ndarray:
    count = np.ones(n, np.int64)
    at, value = np.frombuffer(more, np.uint32).reshape(2, -1)
    count[at] = value
    return count


def _send_minimizers(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids, offsets, data in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                s = Segments(ids, offsets, data)
                order, begin, _ = _groups(s.content)  # equal content has one minimizer
                name = np.sort(s.names(buckets)[1][order[begin]])
                at = np.flatnonzero(np.append(True, name[1:] != name[:-1])[:len(name)])
                bucket, short = name[at] >> 32, name[at].astype(np.uint32)
                count = np.diff(np.append(at, len(name))).astype(np.uint32)
                cuts = [*np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[:len(bucket)]).tolist(), len(bucket)]
                pieces = list(zip(cuts[:-1], cuts[1:], strict=True))
                yield pa.RecordBatch.from_arrays([
                    pa.array(bucket[cuts[:-1]].astype(np.int32)), pa.array([block] * (len(cuts) - 1), pa.int64()),
                    pa.array([short[a:b].tobytes() for a, b in pieces], pa.binary()),
                    pa.array([_more(count[a:b]) for a, b in pieces], pa.binary())],
                    names=["bucket", "block", "held", "more"])
    return run


def _shared(table: pa.Table) -> pa.Table:
    """For each block, those of its minimizers that another block holds, and the hot ones."""
    held = [np.frombuffer(x, np.uint32) for x in table.column("held").to_pylist()]
    count = np.concatenate([_counts(len(h), m) for h, m in zip(held, table.column("more").to_pylist(), strict=True)])
    every = np.concatenate(held)
    ranked = np.sort((every.astype(np.uint64) << np.uint64(32)) | np.arange(len(every), dtype=np.uint64))
    order, ranked = ranked.astype(np.uint32), ranked >> np.uint64(32)
    begin = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    size = np.diff(np.append(begin, len(ranked)))
    hot, told = np.zeros(len(every), bool), np.zeros(len(every), bool)
    hot[order] = np.repeat(np.add.reduceat(count[order], begin) > PART, size)
    told[order] = np.repeat(size > 1, size)
    told |= hot
    ends = np.cumsum([len(h) for h in held])[:-1]
    found = [(h[t], h[x]) for h, t, x in zip(held, np.split(told, ends), np.split(hot, ends), strict=True)]
    some = [i for i, f in enumerate(found) if len(f[0])]
    return pa.table({"bucket": table.column("bucket").take(pa.array(some, pa.int64())).cast(pa.int32()),
                     "block": table.column("block").take(pa.array(some, pa.int64())).cast(pa.int64()),
                     "held": pa.array([found[i][0].tobytes() for i in some], pa.binary()),
                     "hot": pa.array([found[i][1].tobytes() for i in some], pa.binary())})


def _told(got: list[dict] | None, column: str) -> np.ndarray:
    parts = [np.frombuffer(g[column], np.uint32).astype(np.int64) | (g["bucket"] << 32) for g in got or []]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _send_windows(s: Segments, pick: np.ndarray, hot: np.ndarray, buckets: int, block: int) -> list[tuple]:
    """Rows with each distinct window of the segments ``pick`` and its smallest document; their buckets are
    the numbers under zero. The first row also holds the names ``hot`` of the minimizers, for ``_cut``."""
    _, content, doc = s.each_window(pick)
    bucket = (content % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((doc, content, bucket))
    content, doc, bucket = content[order], doc[order], bucket[order]
    new = np.append(True, content[1:] != content[:-1])
    content, doc, bucket = content[new], doc[new], bucket[new]
    cuts = np.flatnonzero(np.append(True, np.diff(bucket) != 0))
    return [(-1 - int(bucket[k]), block, c - k, _zip(content[k:c].tobytes() + doc[k:c].tobytes() + (b"" if k else hot.tobytes())))
            for k, c in zip(cuts.tolist(), [*cuts[1:].tolist(), len(content)], strict=True)]


def _send_segments(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids, offsets, data, got in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                s = Segments(ids, offsets, data)
                bucket, name = s.names(buckets)
                order, begin, size = _groups(name)
                ranked = name[order[begin]]
                hot = _told(got, "hot")
                hot_name = _held(hot, ranked)
                # minimizers that another block holds, or two documents of this block
                wanted_name = _held(_told(got, "held"), ranked)
                if len(order):
                    doc = s.doc[order]
                    wanted_name |= np.minimum.reduceat(doc, begin) != np.maximum.reduceat(doc, begin)
                windowed, wanted = np.empty(len(name), bool), np.empty(len(name), bool)
                windowed[order], wanted[order] = np.repeat(hot_name, size), np.repeat(wanted_name, size)
                rows = _send_windows(s, np.flatnonzero(windowed), hot, buckets, block) if windowed.any() else []
                pick = np.flatnonzero(wanted & ~windowed)
                if not len(pick) and not rows:
                    continue
                # each distinct segment with its smallest document, by bucket
                order, begin, _ = _groups(s.content[pick])
                least = np.minimum.reduceat(s.doc[pick[order]], begin) if len(pick) else pick
                pick = pick[order[begin]]
                by = np.sort((bucket[pick] << 32) | np.arange(len(pick))) & 0xFFFFFFFF
                pick, least = pick[by], least[by]
                cuts = [*np.flatnonzero(np.append(True, np.diff(bucket[pick]) != 0)[:len(pick)]).tolist(), len(pick)]
                for k, c in zip(cuts[:-1], cuts[1:], strict=True):
                    p = pick[k:c]
                    size = s.windows[p] + LENGTH - 1
                    text = s.raw[np.repeat(s.start[p] - np.cumsum(size) + size, size) + np.arange(size.sum())]
                    payload = _zip(b"".join([(s.minimizer[p] >> np.uint64(32)).astype(np.uint32).tobytes(), s.content[p].tobytes(), least[k:c].tobytes(),
                                             s.windows[p].astype(np.uint8).tobytes(), text.tobytes()]))
                    rows.append((int(bucket[p[0]]), block, c - k, payload))
                yield pa.RecordBatch.from_arrays([
                    pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.binary()), strict=True)],
                    names=["bucket", "block", "n", "payload"])
    return run


class RunIndex:
    """Run-compressed transform of many short texts, each with its own terminator, and interval samples."""

    def __init__(self, texts: np.ndarray, lengths: np.ndarray, doc: np.ndarray):
        """``texts``: one row per text, byte + 1, zero after its end (the terminator and what follows)."""
        n = len(texts)
        size = lengths + 1  # the terminator is a suffix of its own
        symbols = texts[np.arange(texts.shape[1])[None, :] < size[:, None]]
        total = len(symbols)
        end = np.cumsum(size)
        rest = np.repeat(end, size) - np.arange(total)

        def ahead(x: np.ndarray, k: int) -> np.ndarray:
            """``x`` of the suffix ``k`` symbols on, plus one; zero after a text's end."""
            out = np.zeros(total, np.int64)
            out[:total - k] = x[k:] + 1
            out[rest <= k] = 0
            return out

        # a place and two ranks, or as many symbols as have room there, are sorted as one number
        bits = total.bit_length()
        if 3 * bits > 63:
            raise ValueError(f"{total} suffixes are too many for one index")
        places, mask = np.arange(total), (1 << bits) - 1
        used = np.bincount(symbols, minlength=257) > 0
        code = (np.cumsum(used) - 1)[symbols]
        per = int(used.sum()).bit_length()
        width = min((63 - bits) // per, LENGTH)
        key = code + 1
        for k in range(1, width):
            key = (key << per) | ahead(code, k)
        found, step = 0, width
        while True:
            key <<= bits
            key |= places
            key.sort()
            suffix = key & mask  # equal suffixes in text order, as terminators are ordered by text
            key >>= bits
            new = np.append(True, key[1:] != key[:-1])
            rank = np.empty(total, np.int64)
            rank[suffix] = np.cumsum(new) - 1
            if step <= LENGTH:
                lead = (rank << bits) | ahead(rank, LENGTH - step)
            if step >= int(size.max()) or found == int(new.sum()):  # the same ranks again: longer prefixes tell no more apart
                break
            found = int(new.sum())
            key = (rank << bits) | ahead(rank, step)
            step *= 2
        before = np.append(symbols[-1:], symbols[:-1])[suffix]
        # runs of the transform: begin, symbol, and where its first row goes by LF; the directory gives each row's run
        mark = np.append(True, before[1:] != before[:-1])
        begin = np.flatnonzero(mark)
        run = np.diff(np.append(begin, total))
        by_symbol = np.argsort(before[begin], kind="stable")
        base = np.empty(len(begin), np.int64)
        base[by_symbol] = np.cumsum(run[by_symbol]) - run[by_symbol]
        # rows of symbol 0 (whole texts) go to no row that is used; they are as many as the suffixes that begin with 0
        self.jump = (base - begin).astype(np.int32)
        self.run = np.cumsum(mark, dtype=np.int32) - 1
        # borders of intervals with LENGTH common symbols, each with its smallest document
        lead = lead[suffix]
        mark = np.append(True, lead[1:] != lead[:-1])
        self.interval = np.cumsum(mark, dtype=np.int32) - 1
        self.least = np.minimum.reduceat(np.repeat(doc, size)[suffix], np.flatnonzero(mark))

    def covered(self, lengths: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Bit w of a text's number: its window w also stands in a text of a smaller document."""
        longest = np.argsort(-lengths)
        row = longest.astype(np.int32)  # terminators are the smallest suffixes, in text order
        lengths, doc = lengths[longest], doc[longest]
        found = np.zeros(len(lengths), np.uint64)
        alive = np.cumsum(np.bincount(lengths)[::-1])[::-1]
        for back in range(1, len(alive)):
            live = int(alive[back])
            row = row[:live]
            row = row + self.jump[self.run[row]]
            if back >= LENGTH:
                hit = self.least[self.interval[row]] < doc[:live]
                found[:live] |= hit.astype(np.uint64) << (lengths[:live] - back).astype(np.uint64)
        out = np.empty_like(found)
        out[longest] = found
        return out


_ANSWERS = "bucket int, block long, n int, answer binary"


def _answers(bucket: int, blocks: list[int], kept: list[int], answer: list[bytes]) -> pa.Table:
    return pa.table({"bucket": pa.array([bucket] * len(blocks), pa.int32()), "block": pa.array(blocks, pa.int64()),
                     "n": pa.array(kept, pa.int32()), "answer": pa.array(answer, pa.binary())})


def _match_windows(table: pa.Table) -> pa.Table:
    """For each block: its windows that a smaller document of another block holds, and the names it sent with them."""
    blocks, counts = table.column("block").to_pylist(), table.column("n").to_pylist()
    raws = [_unzip(x) for x in table.column("payload").to_pylist()]
    content = np.concatenate([np.frombuffer(r, np.uint64, n) for r, n in zip(raws, counts, strict=True)])
    doc = np.concatenate([np.frombuffer(r, np.int64, n, 8 * n) for r, n in zip(raws, counts, strict=True)])
    hit = doc > _least_by(content, doc)
    out, kept, at = [], [], 0
    for n, raw in zip(counts, raws, strict=True):
        some = at + np.flatnonzero(hit[at:at + n])
        out.append(_zip(content[some].tobytes() + raw[16 * n:]))
        kept.append(len(some))
        at += n
    return _answers(table.column("bucket")[0].as_py(), blocks, kept, out)


def _least_by(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The smallest document of each key's rows, at every row."""
    order, begin, size = _groups(key)
    least = np.empty(len(order), np.int64)
    if len(order):
        least[order] = np.repeat(np.minimum.reduceat(doc[order], begin), size)
    return least


def _match(table: pa.Table) -> pa.Table:
    return (_match_windows if table.column("bucket")[0].as_py() < 0 else _index_bucket)(table)


def _index_bucket(table: pa.Table) -> pa.Table:
    """For each block: its segments' content, first document and covered windows."""
    blocks, counts = table.column("block").to_pylist(), table.column("n").to_pylist()
    parts = []
    for n, payload in zip(counts, table.column("payload").to_pylist(), strict=True):
        raw = _unzip(payload)
        parts.append((np.frombuffer(raw, np.uint32, n), np.frombuffer(raw, np.uint64, n, 4 * n), np.frombuffer(raw, np.int64, n, 12 * n),
                      np.frombuffer(raw, np.uint8, n, 20 * n).astype(np.int64), np.frombuffer(raw, np.uint8, offset=21 * n)))
    minimizer, content, doc, windows = (np.concatenate([p[k] for p in parts]) for k in range(4))
    raw = np.concatenate([p[4] for p in parts])
    size = windows + LENGTH - 1
    start = np.cumsum(size) - size
    order, begin, same = _groups(content)
    one, least = order[begin], np.minimum.reduceat(doc[order], begin)  # each distinct segment with its first document
    which = np.empty(len(content), np.int64)
    which[order] = np.repeat(np.arange(len(one)), same)
    mask = np.zeros(len(one), np.uint64)
    # minimizers with two distinct segments or more
    by = np.argsort(minimizer[one], kind="stable")
    m = minimizer[one][by]
    several = np.zeros(len(m), bool)
    several[1:] = m[1:] == m[:-1]
    several[:-1] |= several[1:]
    text = by[several]
    if len(text):
        # groups of one minimizer stay together, none has more than PART; so the index takes under twice PART
        group = np.cumsum(np.append(True, m[several][1:] != m[several][:-1]))
        sizes = np.bincount(group)[1:]
        part = (np.cumsum(sizes) - sizes) // PART
        for q in np.unique(part).tolist():
            chosen = text[part[group - 1] == q]
            lengths = size[one[chosen]]
            width = int(lengths.max()) + 1
            inside = np.arange(width)[None, :] < lengths[:, None]
            rows = np.zeros((len(chosen), width), np.int16)
            rows[inside] = raw[np.repeat(start[one[chosen]] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())].astype(np.int16) + 1
            docs = least[chosen]
            mask[chosen] = RunIndex(rows, lengths, docs).covered(lengths, docs)
    # a block hears of segments that an earlier document holds whole, or in part
    answer = np.where(least[which] < doc, _WHOLE, mask[which])
    out, kept, at = [], [], 0
    for n in counts:
        some = at + np.flatnonzero(answer[at:at + n])
        out.append(_zip(content[some].tobytes() + answer[some].tobytes()))
        kept.append(len(some))
        at += n
    return _answers(table.column("bucket")[0].as_py(), blocks, kept, out)


def _covered_windows(s: Segments, answers: list[dict], buckets: int) -> np.ndarray:
    """First bytes of the windows with a hot minimizer that a smaller document also holds."""
    raws = [(a["n"], _unzip(a["answer"])) for a in answers if a["bucket"] < 0]
    if not raws:
        return np.zeros(0, np.int64)
    hot = np.concatenate([np.frombuffer(r, np.int64, offset=8 * n) if len(r) > 8 * n else np.zeros(0, np.int64) for n, r in raws])
    place, content, doc = s.each_window(np.flatnonzero(np.isin(s.names(buckets)[1], hot)))
    told = np.concatenate([np.frombuffer(r, np.uint64, n) if n else np.zeros(0, np.uint64) for n, r in raws])
    return place[(doc > _least_by(content, doc)) | np.isin(content, told)]


def _cut(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _cut_batches(batches, buckets)
    return run


def _cut_batches(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, offsets, data, answers in zip(*[batch.column(i).to_pylist() for i in range(1, 5)], strict=True):
            s = Segments(ids, offsets, data)
            step = np.zeros(len(s.raw) + 1, np.int32)
            # within the block, the smallest document with a segment covers the others
            mask = np.where(s.doc > _least_by(s.content, s.doc), _WHOLE, np.uint64(0))
            if answers:
                at = _covered_windows(s, answers, buckets)
                np.add.at(step, at, 1)
                np.add.at(step, at + LENGTH, -1)
                parts = [(np.frombuffer(r, np.uint64, a["n"]), np.frombuffer(r, np.uint64, a["n"], 8 * a["n"]))
                         for a in answers if a["n"] and a["bucket"] >= 0 for r in [_unzip(a["answer"])]]
                if parts:
                    content, told = (np.concatenate([p[k] for p in parts]) for k in range(2))
                    order = np.argsort(content)
                    content, told = content[order], told[order]
                    order, begin, size = _groups(s.content)
                    mine = s.content[order[begin]]
                    at = np.minimum(np.searchsorted(content, mine), len(content) - 1)
                    mask[order] |= np.repeat(np.where(content[at] == mine, told[at], np.uint64(0)), size)
            whole = mask == _WHOLE
            np.add.at(step, s.start[whole], 1)
            np.add.at(step, s.start[whole] + s.windows[whole] + LENGTH - 1, -1)
            some = np.flatnonzero(~whole & (mask != 0))
            for c in range(0, len(some), _CHUNK):
                part = some[c:c + _CHUNK]
                bits = np.unpackbits(mask[part].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                hit, w = np.nonzero(bits)
                at = s.start[part[hit]] + w
                np.add.at(step, at, 1)
                np.add.at(step, at + LENGTH, -1)
            gone = np.cumsum(step[:-1]) > 0
            rows = []
            for k, (a, b) in enumerate(zip(s.offsets[:-1].tolist(), s.offsets[1:].tolist(), strict=True)):
                g = gone[a:b]
                spans = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum())
                doc_id = int(s.ids[k])
                rows.append((None if doc_id == LAST else doc_id, b - a, int(g.sum()), spans,
                             hashlib.sha256(s.raw[a:b][~g].tobytes()).hexdigest()))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:4]], pa.array(columns[4], pa.string())],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each document."""
    blocks = materialize(id_and_text(docs).mapInArrow(_to_blocks, _BLOCKS), "llm-repeat-blocks")
    total = blocks.agg(F.count("*")).first()[0] * BLOCK
    buckets = _buckets(total)
    held = blocks.mapInArrow(_send_minimizers(buckets), "bucket int, block long, held binary, more binary")
    shared = held.groupBy("bucket").applyInArrow(_shared, "bucket int, block long, held binary, hot binary")
    told = shared.groupBy("block").agg(F.collect_list(F.struct("bucket", "held", "hot")).alias("got"))
    segments = blocks.join(told, "block", "left").select("block", "ids", "offsets", "data", "got").mapInArrow(
        _send_segments(buckets), "bucket int, block long, n int, payload binary")
    answers = materialize(segments.groupBy("bucket").applyInArrow(_match, _ANSWERS), "llm-repeat-answers")
    gathered = answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "n", "answer")).alias("answers"))
    return blocks.join(gathered, "block", "left").select("block", "ids", "offsets", "data", "answers").mapInArrow(
        _cut(buckets), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(documents(spark, sf_dir))
