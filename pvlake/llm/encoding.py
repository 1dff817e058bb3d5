"""Byte-level BPE ids of whole texts, in slices for long ones.

A blank between two characters that are not white space is always a boundary of pre-tokens (the
blank starts the next one), so a text may be cut there and the slices encoded one by one.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

#: Characters a slice holds before the next place where it may end.
SLICE = 1 << 20
SPECIAL = "<|endoftext|>"
SPECIAL_ID = 50256

_encoding = None


def byte_bpe():
    """The worker's encoder; the vocabulary file is read once."""
    global _encoding
    if _encoding is None:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoding = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                      special_tokens={SPECIAL: SPECIAL_ID})
    return _encoding


def slices(text: str, limit: int = SLICE) -> Iterator[str]:
    start, n = 0, len(text)
    while n - start > limit:
        stop = text.find(" ", start + limit)
        while 0 <= stop < n - 1 and (text[stop - 1].isspace() or text[stop + 1].isspace()):
            stop = text.find(" ", stop + 1)
        if stop < 0 or stop >= n - 1:
            break
        yield text[start:stop]
        start = stop
    yield text[start:]


def byte_bpe_bytes(text: str) -> bytes:
    """Little-endian unsigned 32-bit ids of ``byte_bpe_50k.json``; its special string is one id wherever it stands."""
    encode = byte_bpe().encode_to_numpy
    return b"".join(encode(s, allowed_special="all").astype("<u4", copy=False).tobytes() for s in slices(text))
