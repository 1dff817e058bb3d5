"""Operator 8, packing: bounded-space online packing into sequences of at most ``SEQ_LEN`` tokens.

Each partition keeps at most ``OPEN`` open windows. A document's full windows leave at once; its rest
goes best-fit into the open window with the least space that holds it, or opens a window. When
neither is possible, the fullest window is filled up with the head of the rest and emitted, and the tail is placed
again, so an emitted window holds no padding. Windows still open at the end of a partition are
leftovers: at most ``OPEN * SEQ_LEN`` tokens a partition. They are merged by the same rule, ``FAN``
partitions a group, level by level until one group is left; its last window is cut into powers of
two, which need no padding. No row is shuffled but these leftovers.

Defined results: null and empty texts hold the end token alone; rows that repeat a doc_id are packed
one by one; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pvlake.llm.common import documents, id_and_text
from pvlake.llm.encoding import byte_bpe_bytes
from pvlake.session import materialize

SEQ_LEN = 1024
OPEN = 32
FAN = 64
END = b"\0\0\0\0"
_SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
           "ids binary, origin long")
_ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
                   + [("ids", pa.binary()), ("origin", pa.int64())])


class Packer:
    """Open windows of one partition; ``rows`` collects emitted pieces."""

    def __init__(self, level: int, part: int):
        self.base = (level << 56) | (part << 32)
        self.part = part
        self.count = 0
        self.open: list[list] = []  # [free tokens, pieces]
        self.rows: list[tuple] = []

    def emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc_id, start, n, zlib.crc32(ids), total, self.base | self.count, offset, None, self.part))
            offset += n
        self.count += 1

    def add(self, doc_id: int | None, start: int, ids: bytes, total: int) -> None:
        whole = 4 * SEQ_LEN
        while len(ids) >= whole:
            self.emit([(doc_id, start, ids[:whole], total)])
            start, ids = start + SEQ_LEN, ids[whole:]
        while ids:
            n = len(ids) // 4
            fits = [w for w in self.open if w[0] >= n]
            if fits:
                window = min(fits, key=lambda w: w[0])
                take = n
            elif len(self.open) < OPEN:
                window = [SEQ_LEN, []]
                self.open.append(window)
                take = n
            else:
                window = min(self.open, key=lambda w: w[0])
                take = window[0]
            window[0] -= take
            window[1].append((doc_id, start, ids[:4 * take], total))
            start, ids = start + take, ids[4 * take:]
            if window[0] == 0:
                self.open.remove(window)
                self.emit(window[1])

    def leftovers(self) -> None:
        for _, pieces in self.open:
            for doc_id, start, ids, total in pieces:
                self.rows.append((doc_id, start, len(ids) // 4, 0, total, None, 0, ids, self.part))
        self.open = []

    def finish(self) -> None:
        """Last group: fill windows one after another, then cut the rest into powers of two."""
        pieces = [p for _, ps in sorted(self.open, key=lambda w: w[0]) for p in ps]
        self.open = []
        tokens = sum(len(p[2]) // 4 for p in pieces)
        while tokens:
            room = SEQ_LEN if tokens >= SEQ_LEN else 1 << (tokens.bit_length() - 1)
            tokens -= room
            window = []
            while room:
                doc_id, start, ids, total = pieces.pop(0)
                take = min(room, len(ids) // 4)
                window.append((doc_id, start, ids[:4 * take], total))
                if 4 * take < len(ids):
                    pieces.insert(0, (doc_id, start + take, ids[4 * take:], total))
                room -= take
            self.emit(window)

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) if self.rows else [[]] * len(_ARROW)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def _pack_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = Packer(0, TaskContext.get().partitionId())
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = byte_bpe_bytes(text.as_py() or "") + END
            packer.add(doc_id, 0, ids, len(ids) // 4)
        yield packer.take()
    packer.leftovers()
    yield packer.take()


def _merge_group(level: int, last: bool):
    def merge(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*[table.column(n).to_pylist() for n in ("group", "origin", "doc_id", "start", "ids", "doc_tokens")], strict=True),
                      key=lambda r: (-len(r[4]), r[1], r[2] is None, r[2] or 0, r[3]))
        packer = Packer(level, rows[0][0])
        for _, _, doc_id, start, ids, total in rows:
            packer.add(doc_id, start, ids, total)
        if last:
            packer.finish()
        else:
            packer.leftovers()
        return pa.Table.from_batches([packer.take()])
    return merge


def pack(docs: DataFrame) -> DataFrame:
    """One row per piece, see the module's text."""
    done = materialize(id_and_text(docs).mapInArrow(_pack_partition, _SCHEMA), "llm-pack")
    out = done.where("ids is null")
    level, left = 1, done.where("ids is not null")
    parts = (left.agg(F.max("origin")).first()[0] or 0) + 1
    while True:
        groups = -(-parts // FAN)
        merged = materialize(
            left.withColumn("group", F.floor(F.col("origin") / FAN).cast("long")).groupBy("group")
            .applyInArrow(_merge_group(level, groups == 1), _SCHEMA), f"llm-pack-{level}")
        out = out.unionByName(merged.where("ids is null"))
        if groups == 1:
            return out.drop("ids", "origin")
        level, left, parts = level + 1, merged.where("ids is not null"), groups


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
