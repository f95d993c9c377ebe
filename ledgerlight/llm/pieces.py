"""Texts encoded by pieces: each distinct piece of a batch is looked up, or encoded, once.

The bytes of a batch are cut where a pre-token always begins: before ASCII
white space that follows something else, and between ASCII letters, digits and
marks.  (An apostrophe may begin a contraction and other characters may be of
any kind, so nothing is cut beside them.)  The ids of a text are those of its
pieces in order.  A bounded memory of pieces changes time only.
"""

from __future__ import annotations

from itertools import compress, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces in each of the two generations of a worker's memory.
CACHE_ITEMS = 300_000
#: Longer pieces are not remembered.
LONGEST = 64
WHITE_BYTE, LETTER, DIGIT, MARK, OTHER = range(5)


def byte_kinds() -> np.ndarray:
    kinds = np.full(256, OTHER, "u1")
    for b in range(33, 127):
        c = chr(b)
        kinds[b] = LETTER if c.isalpha() else DIGIT if c.isdigit() else OTHER if c == "'" else MARK
    kinds[[9, 10, 11, 12, 13, 32]] = WHITE_BYTE
    return kinds


KINDS = byte_kinds()
#: BORDER[8 * kind + next kind]: whether a pre-token always begins between the two.
BORDER = np.zeros(40, bool)
for _a in (LETTER, DIGIT, MARK):
    for _b in (LETTER, DIGIT, MARK):
        BORDER[8 * _a + _b] = _a != _b
    BORDER[8 * _a + WHITE_BYTE] = True
BORDER[8 * OTHER + WHITE_BYTE] = True


def wide_white(texts: pa.Array) -> pa.Array:
    """Which texts have white space beyond ASCII."""
    return pc.match_substring_regex(texts, "[\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]")


class Memory:
    """Pieces seen of late: a young generation, and the one before it; what the old one still serves moves to the young one."""

    def __init__(self, items: int | None = None):
        self.items = items or CACHE_ITEMS
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def __len__(self) -> int:
        return len(self.young) + len(self.old)

    def find(self, keys: list[str]) -> list[bytes | None]:
        """What is known of distinct keys."""
        got = list(map(self.young.get, keys))
        gaps = [i for i, g in enumerate(got) if g is None]
        if gaps and self.old:
            served = [(i, v) for i, v in zip(gaps, map(self.old.get, [keys[i] for i in gaps]), strict=True) if v is not None]
            for i, value in served:
                got[i] = value
            self.keep([keys[i] for i, _ in served], [v for _, v in served])
        return got

    def keep(self, keys: list[str], values: list[bytes]) -> None:
        if keys and max(map(len, keys)) > LONGEST:
            short = [len(k) <= LONGEST for k in keys]
            keys, values = list(compress(keys, short)), list(compress(values, short))
        if len(self.young) + len(keys) > self.items:
            self.old, self.young = self.young, {}
        self.young.update(islice(zip(keys, values, strict=True), self.items))


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The pieces of all texts (no nulls) one after another, and where each text's pieces begin among them."""
    n = len(texts)
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], "<i8" if wide else "<i4", n + 1, texts.offset * (8 if wide else 4)).astype("i8")
    base, size = int(offsets[0]), int(offsets[-1] - offsets[0])
    offsets = offsets - base
    if not size:
        return pa.array([], pa.string()), np.zeros(n + 1, "i8")
    data = texts.buffers()[2].slice(base, size)
    kinds = KINDS[np.frombuffer(data, "u1")]
    begins = np.ones(size + 1, bool)
    begins[1:-1] = BORDER[(kinds[:-1] << 3) + kinds[1:]]
    begins[offsets] = True
    places = np.flatnonzero(begins)
    pieces = pa.StringArray.from_buffers(len(places) - 1, pa.py_buffer(places.astype("<i4").tobytes()), data)
    return pieces, np.searchsorted(places, offsets)


class PieceEncoder:
    """Encodes batches of texts; what a vocabulary adds is how to encode pieces, and which texts must be read as a whole."""

    #: Literal special tokens; a text with one of them is read as a whole.
    special: list[str] = []

    def __init__(self) -> None:
        self.memory = Memory()

    def fresh(self, keys: list[str]) -> list[bytes]:
        """The ids of distinct pieces that are not remembered."""
        raise NotImplementedError

    def whole(self, text: str) -> bytes:
        """The ids of a text whose pieces do not tell."""
        raise NotImplementedError

    def uncut(self, texts: pa.Array) -> pa.Array:
        """Which texts must be read as a whole."""
        found = pa.scalar(False)
        for s in self.special:
            found = pc.or_(found, pc.match_substring(texts, s))
        return found

    def folded(self, texts: pa.Array) -> pa.Array:
        """Texts with the same ids and fewer distinct pieces."""
        return texts

    def known(self, keys: list[str]) -> list[bytes]:
        """The ids of distinct pieces as little-endian unsigned 32-bit integers."""
        got = self.memory.find(keys)
        gaps = [i for i, g in enumerate(got) if g is None]
        if gaps:
            new = [keys[i] for i in gaps]
            ids = self.fresh(new)
            for i, value in zip(gaps, ids, strict=True):
                got[i] = value
            self.memory.keep(new, ids)
        return got

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (no nulls) one after another, and where each text's begin."""
        n = len(texts)
        apart = self.uncut(texts)
        apart = np.full(n, apart.as_py()) if isinstance(apart, pa.Scalar) else np.asarray(apart)
        odd = np.flatnonzero(apart).tolist()
        if odd:
            whole = [np.frombuffer(self.whole(texts[i].as_py()), "<u4") for i in odd]
            texts = pc.if_else(pa.array(apart), pa.scalar("", texts.type), texts)
        pieces, bounds = cut(self.folded(texts))
        coded = pieces.dictionary_encode()
        index = np.asarray(coded.indices)
        found = self.known(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, found), "i8", len(found)) >> 2
        table = np.frombuffer(b"".join(found), "<u4")
        each = sizes[index]
        ends = np.concatenate([[0], np.cumsum(each)])
        flat = table[np.repeat((np.cumsum(sizes) - sizes)[index] - ends[:-1], each) + np.arange(ends[-1])]
        starts = ends[bounds]
        if odd:
            parts, at = [], 0
            more = np.zeros(n + 1, "i8")
            for i, ids in zip(odd, whole, strict=True):
                parts += [flat[at : starts[i]], ids]
                at = starts[i]
                more[i + 1] = len(ids)
            flat = np.concatenate([*parts, flat[at:]])
            starts = starts + np.cumsum(more)
        return flat, starts

    def encode_each(self, texts: pa.Array) -> list[bytes]:
        flat, starts = self.encode(texts)
        data, at = flat.tobytes(), (4 * starts).tolist()
        return [data[a:b] for a, b in zip(at, at[1:], strict=False)]
