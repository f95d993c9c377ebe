"""Byte-pair encoding by backtracking over longest matches, and decoding by an offset table.

Aho-Corasick finds the longest token that starts at each byte of a piece.  The
encoder takes them from the left, keeps a token only if the pair with the one
before it can stand side by side in merged text, and else tries the next
shorter token or goes a token back.  Positions from which no way led on are
never tried again, so the time is linear and the result is that of the merges.

Null text counts as empty and has no ids; texts of any length are encoded
whole; rows that repeat are encoded each for itself; other columns of the input
do not matter, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import slices, whole_text
from .pieces import PieceEncoder, wide_white

#: White space as Unicode defines it (Python's own notion has four more control characters).
WHITE = r"\p{White_Space}"
#: The pre-tokenizer of byte-level BPE files.
PRETOKENS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|{WHITE}+(?!\P{{White_Space}})|{WHITE}+"
def byte_alphabet() -> list[str]:
    """The printable character by which vocabulary files write each byte: itself where printable, else one from 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class ByteBpe(PieceEncoder):
    """A byte-level vocabulary with its merges; tokens are numbered by merge order inside and by the file's ids outside."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        to_byte = {c: b for b, c in enumerate(alphabet)}
        vocab = spec["model"]["vocab"]
        raw = lambda s: bytes(to_byte[c] for c in s)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.tokens = [bytes([b]) for b in range(256)] + [raw(a) + raw(b) for a, b in pairs]
        self.ids = [vocab[alphabet[b]] for b in range(256)] + [vocab[a + b] for a, b in pairs]
        own = {t: i for i, t in enumerate(self.tokens)}
        self.halves = [(i, i) for i in range(256)]
        self.merged: dict[int, int] = {}
        for i, (a, b) in enumerate(pairs, 256):
            left, right = own[raw(a)], own[raw(b)]
            self.halves.append((left, right))
            self.merged[left << 20 | right] = i
        self.lengths = [len(t) for t in self.tokens]
        self.shorter = [next((own[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in own), -1) for t in self.tokens]
        self.machine = ahocorasick.Automaton()
        for i, t in enumerate(self.tokens):
            self.machine.add_word(t.decode("latin-1"), (i, len(t)))
        self.machine.make_automaton()
        self.special_ids = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special = by_length = sorted(self.special_ids, key=len, reverse=True)
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, by_length)) + ")") if by_length else None
        self.pretokens = regex.compile(PRETOKENS)
        self.beside: dict[int, bool] = {}
        self.packed = [i.to_bytes(4, "little") for i in self.ids]
        most = max([*self.ids, *self.special_ids.values()]) + 1
        texts = [b""] * most
        for i, t in zip(self.ids, self.tokens, strict=True):
            texts[i] = t
        for s, i in self.special_ids.items():
            texts[i] = s.encode()
        self.blob = np.frombuffer(b"".join(texts), "u1")
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype("i8")

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens stay apart when their joined bytes are merged.

        Both are undone from the latest merge on; if at some moment the parts
        that touch could have merged before the later of their own merges, the
        border between the tokens would not have survived.
        """
        key = left << 20 | right
        known = self.beside.get(key)
        if known is not None:
            return known
        merged, halves = self.merged, self.halves
        a, b, limit, good = left, right, len(self.tokens), True
        while True:
            if merged.get(a << 20 | b, limit) < limit:
                good = False
                break
            undo_left = a > b and a > 255 or b < 256
            if undo_left and a < 256:
                break
            if undo_left:
                limit = a
                a = halves[a][1]
            else:
                limit = b + 1
                b = halves[b][0]
        if len(self.beside) >= 1 << 20:
            self.beside.clear()
        self.beside[key] = good
        return good

    def piece(self, data: bytes) -> list[int]:
        """The tokens of a piece of text without special tokens, numbered by merge order."""
        n = len(data)
        longest = [0] * n
        for end, (token, length) in self.machine.iter(data.decode("latin-1")):
            longest[end - length + 1] = token
        lengths, shorter, compatible = self.lengths, self.shorter, self.compatible
        open_at = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0] if n else 0
        while at < n:
            end = at + lengths[token]
            if open_at[end] and (not out or compatible(out[-1], token)):
                out.append(token)
                at = end
                if at < n:
                    token = longest[at]
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                open_at[at] = 0
                token = out.pop()
                at -= lengths[token]
        return out

    def fresh(self, keys: list[str]) -> list[bytes]:
        parts = [[k] if k.isalpha() else self.pretokens.findall(k) for k in keys]
        words = list(dict.fromkeys(w for own in parts for w in own))
        packed = self.packed
        ids = {w: b"".join([packed[t] for t in self.piece(w.encode())]) for w in words}
        return [b"".join([ids[w] for w in own]) for own in parts]

    def uncut(self, texts: pa.Array) -> pa.Array:
        return pc.or_(super().uncut(texts), wide_white(texts))

    def whole(self, text: str) -> bytes:
        parts = self.special_pattern.split(text) if self.special_pattern else [text]
        return b"".join([np.array([self.special_ids[p]], "<u4").tobytes() if i % 2 else self.fresh([p])[0] for i, p in enumerate(parts) if p])

    def decode(self, ids: bytes) -> bytes:
        """The bytes of the tokens, gathered through the offset table."""
        numbers = np.frombuffer(ids, "<u4").astype("i8")
        starts = self.offsets[numbers]
        sizes = self.offsets[numbers + 1] - starts
        before = np.cumsum(sizes) - sizes
        return self.blob[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))].tobytes()


@lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id, ids (binary, little-endian unsigned 32-bit) and n_tokens."""

    def run(batches):
        bpe = load(path)
        for batch in batches:
            for part in slices(batch):
                ids = bpe.encode_each(part.column("text"))
                yield pa.record_batch([part.column("doc_id"), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], ["doc_id", "ids", "n_tokens"])

    return docs.select("doc_id", whole_text(docs).alias("text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids binary, n_tokens long")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: its number of tokens and digests of its ids and of the text they decode to."""

    def run(batches):
        bpe = load(path)
        for batch in batches:
            for part in slices(batch):
                counts, id_digests, text_digests = [], [], []
                for ids in bpe.encode_each(part.column("text")):
                    back = bpe.decode(ids).decode("utf-8", "replace").encode()
                    counts.append(len(ids) // 4)
                    id_digests.append(hashlib.sha256(ids).hexdigest())
                    text_digests.append(hashlib.sha256(back).hexdigest())
                columns = [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(id_digests, pa.string()), pa.array(text_digests, pa.string())]
                yield pa.record_batch(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", whole_text(docs).alias("text")).mapInArrow(run, schema)
