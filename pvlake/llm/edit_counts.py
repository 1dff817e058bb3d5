"""Operator 6, edit-aware token counts with a segment tree of pre-tokens per document.

A tree's leaves hold about ``LEAF`` characters and end where a blank stands between two other
characters, which is always a boundary of pre-tokens. Every node holds the characters and tokens
below it. An edit finds the leaves it touches by characters, joins them with a neighbour where the
edit made the place between them no boundary any more, encodes that text alone, and adds the
difference to the nodes above. The other leaves are never encoded again.

The query counts each document, then applies its edits: every base personal-data span is replaced
by its kind's name, from the last to the first, so that earlier offsets stay valid.

Defined results: null and empty texts have no tokens and no edits; rows that repeat a doc_id are
counted one by one; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pvlake.llm.common import documents, id_and_text
from pvlake.llm.encoding import byte_bpe, slices
from pvlake.llm.pii import KINDS, base_spans

LEAF = 256
_SCHEMA = "doc_id long, n_tokens long, n_leaves long, n_edits long, n_tokens_after long, n_chars_encoded_again long"


def count(text: str) -> int:
    return sum(len(byte_bpe().encode(s, allowed_special="all")) for s in slices(text)) if text else 0


class CountTree:
    """Token count of one text that follows its edits."""

    def __init__(self, text: str):
        self.leaves = list(slices(text, LEAF)) if text else [""]
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        self.chars = [0] * (2 * self.width)
        self.tokens = [0] * (2 * self.width)
        for i, leaf in enumerate(self.leaves):
            self.chars[self.width + i], self.tokens[self.width + i] = len(leaf), count(leaf)
        for node in range(self.width - 1, 0, -1):
            self._add(node)
        self.encoded_again = 0

    def _add(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(self.leaves)

    def find(self, at: int) -> tuple[int, int]:
        """(leaf, characters before it) of a character; the end of the text belongs to the last leaf."""
        node, before = 1, 0
        at = min(at, self.chars[1] - 1) if self.chars[1] else 0
        while node < self.width:
            left = self.chars[2 * node]
            node = 2 * node
            if at - before >= left:
                before += left
                node += 1
        return min(node - self.width, len(self.leaves) - 1), before

    @staticmethod
    def _boundary(left: str, right: str) -> bool:
        return not left[-1:].isspace() and right[:1] == " " and len(right) > 1 and not right[1].isspace()

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace characters ``start`` to ``end`` by ``new``."""
        first, before = self.find(start)
        last, _ = self.find(max(start, end - 1))
        text = "".join(self.leaves[first:last + 1])
        text = text[:start - before] + new + text[end - before:]
        # boundary context: neighbours join in until both ends are boundaries again
        while first > 0 and not (text and self.leaves[first - 1] and self._boundary(self.leaves[first - 1], text)):
            first -= 1
            text = self.leaves[first] + text
        while last < len(self.leaves) - 1 and not (text and self.leaves[last + 1] and self._boundary(text, self.leaves[last + 1])):
            last += 1
            text += self.leaves[last]
        self.encoded_again += len(text)
        for i in range(first, last + 1):
            self.leaves[i] = text if i == first else ""
            self.chars[self.width + i] = len(self.leaves[i])
            self.tokens[self.width + i] = count(text) if i == first else 0
        low, high = (self.width + first) >> 1, (self.width + last) >> 1
        while low:
            for node in range(low, high + 1):
                self._add(node)
            low, high = low >> 1, high >> 1


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(1):
            text = text.as_py() or ""
            tree = CountTree(text)
            before, edits = tree.total, 0
            floor = len(text) + 1
            for a, k, b in reversed(base_spans(text)):
                if b <= floor:  # of overlapping spans the later one is replaced
                    tree.edit(a, b, f"<{KINDS[k].upper()}>")
                    floor, edits = a, edits + 1
            rows.append((before, sum(map(bool, tree.leaves)), edits, tree.total, tree.encoded_again))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in columns]],
                                         names=[c.split()[0] for c in _SCHEMA.split(", ")])


def edit_counts(docs: DataFrame) -> DataFrame:
    """Token counts of each document before and after its edits."""
    return id_and_text(docs).mapInArrow(_counted, _SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_counts(documents(spark, sf_dir))
