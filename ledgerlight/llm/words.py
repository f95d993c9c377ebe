"""Words of many texts at once: runs of bytes of one kind, found by numpy and told apart by Arrow's dictionary encoding."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: What a byte is: part of a word, blank between words, or a break between pieces.
WORD, BLANK, BREAK = 0, 1, 2
#: Bytes with A-Z in lower case.
LOWERED = np.frombuffer(bytes(range(256)).lower(), "u1")


def byte_kinds(blanks: bytes, breaks: bytes) -> np.ndarray:
    """The kind of each byte; both sets must be ASCII, so that no character of several bytes is cut."""
    kinds = np.full(256, WORD, "u1")
    kinds[np.frombuffer(blanks, "u1")] = BLANK
    kinds[np.frombuffer(breaks, "u1")] = BREAK
    return kinds


@dataclass(frozen=True)
class Words:
    """``codes`` of the words in order, in the ``distinct`` words; the ``text`` of each, and its ``piece`` (no piece spans two texts)."""

    distinct: pa.Array
    codes: np.ndarray
    text: np.ndarray
    piece: np.ndarray


def words_of(texts: pa.Array, kinds: np.ndarray) -> Words:
    """The words of an array of strings without nulls, A-Z in lower case."""
    texts = texts.cast(pa.large_string())
    sizes, buffer = texts.buffers()[1:]
    ends = np.frombuffer(sizes, "<i8")[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, "i8")
    data = LOWERED[np.frombuffer(buffer, "u1")[ends[0] : ends[-1]]] if ends[-1] > ends[0] else np.zeros(0, "u1")
    firsts = ends[:-1] - ends[0]
    kind = kinds[data]
    word = kind == WORD
    fresh = np.zeros(len(data) + 1, bool)  # where no word goes on from the byte before
    fresh[firsts] = True
    fresh[-1] = True
    fresh[1:] |= ~word
    starts = np.flatnonzero(word & fresh[:-1])
    fresh[:-1] |= ~word
    stops = np.flatnonzero(word & fresh[1:])
    offsets = np.zeros(len(starts) + 1, "<i4")
    np.cumsum(stops - starts + 1, out=offsets[1:])
    found = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[word])]).dictionary_encode()
    text = np.searchsorted(firsts, starts, side="right") - 1
    piece = np.searchsorted(np.flatnonzero(kind == BREAK), starts) + text
    return Words(found.dictionary, found.indices.to_numpy(zero_copy_only=False).astype("i4"), text, piece)
