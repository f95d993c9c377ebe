"""Ids as the tokenizers library gives them, each distinct piece of text encoded once.

New pieces are merged by tiktoken, which takes the same vocabulary as ranks and
gives the same ids in less time.  Texts with special tokens, and those in which
a piece is not safe, go to the library as they are.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .bpe import PRETOKENS, WHITE, byte_alphabet
from .pieces import PieceEncoder, wide_white

#: White space at the end of a piece.
ENDING = re.compile(r"\s\x00")


class LibraryEncoder(PieceEncoder):
    """What both kinds of vocabulary share: the library itself."""

    def __init__(self, path: str, spec: dict):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.special = [t["content"] for t in spec.get("added_tokens", [])]

    @property
    def size(self) -> int:
        return self.tokenizer.get_vocab_size()

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


class ByteEncoder(LibraryEncoder):
    """Byte-level BPE without normalizer."""

    def __init__(self, path: str, spec: dict):
        super().__init__(path, spec)
        import tiktoken

        to_byte = {c: b for b, c in enumerate(byte_alphabet())}
        special = set(self.special)
        ranks = {bytes(to_byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.border = ranks[b"\0"]
        pattern = r"\x00|" + PRETOKENS.replace(r"\p{N}]+", r"\p{N}\x00]+")
        self.ordinary = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def uncut(self, texts: pa.Array) -> pa.Array:
        return pc.or_(super().uncut(texts), wide_white(texts))

    def fresh(self, keys: list[str]) -> list[bytes]:
        """All pieces encoded as one text with NULs between them, save those with a NUL or white space at their end."""
        joined = "\0".join([*keys, ""])
        if joined.count("\0") > len(keys) or ENDING.search(joined):
            odd = ["\0" in k or k[-1].isspace() for k in keys]
            plain = iter(self.fresh([k for k, o in zip(keys, odd, strict=True) if not o]))
            return [self.whole(k) if o else next(plain) for k, o in zip(keys, odd, strict=True)]
        flat = np.array(self.ordinary(joined), "<u4")
        data, ends = flat.tobytes(), (4 * np.flatnonzero(flat == self.border)).tolist()
        return [data[a:b] for a, b in zip([0, *[e + 4 for e in ends]], ends, strict=False)]


class WordEncoder(LibraryEncoder):
    """BPE with word ends, in which white space only parts words.

    tiktoken knows no word ends: words end in a NUL there, and the merges of a
    last byte with it come before all others.
    """

    def __init__(self, path: str, spec: dict):
        super().__init__(path, spec)
        import regex
        import tiktoken

        self.normalize = self.tokenizer.normalizer.normalize_str
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", WHITE))
        end = spec["model"]["end_of_word_suffix"]
        vocab = spec["model"]["vocab"]
        to_byte = {c: b for b, c in enumerate(byte_alphabet())}

        def raw(token: str) -> bytes:
            body, last = (token[: -len(end)], b"\0") if token.endswith(end) else (token, b"")
            return bytes(to_byte[c] for c in body) + last

        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        tokens = [(bytes([b]), vocab[c]) for b, c in enumerate(byte_alphabet())]
        tokens += [(bytes([b, 0]), vocab[c + end]) for b, c in enumerate(byte_alphabet())]
        tokens += [(raw(a + b), vocab[a + b]) for a, b in pairs]
        self.ids = np.array([i for _, i in tokens], "<u4")
        self.ends = np.array([t[-1:] == b"\0" and len(t) > 1 for t, _ in tokens])
        ranks = {t: r for r, (t, _) in enumerate(tokens)}
        self.ordinary = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def folded(self, texts: pa.Array) -> pa.Array:
        """A-Z in lower case, save in texts with combining marks, which may join only one of the two."""
        return pc.if_else(pc.match_substring_regex(texts, r"[\x{300}-\x{36F}]"), texts, pc.ascii_lower(texts))

    def fresh(self, keys: list[str]) -> list[bytes]:
        parts = [self._words(k.lower() if k.isascii() else self.normalize(k)) for k in keys]
        words = list(dict.fromkeys([w for own in parts for w in own]))
        ids = dict(zip(words, self._apart(words), strict=True))
        return [ids[own[0]] if len(own) == 1 else b"".join([ids[w] for w in own]) for own in parts]

    def _words(self, piece: str) -> list[str]:
        """The pre-tokens of a normal piece; most are letters."""
        word = piece[1:] if piece[:1] == " " else piece
        return [word] if word.isalpha() else self.pattern.findall(piece)

    def _apart(self, words: list[str]) -> list[bytes]:
        """Words encoded as one text and parted after each token that ends a word."""
        joined = "\0".join([*words, ""])
        if joined.count("\0") > len(words):
            plain = iter(self._apart([w for w in words if "\0" not in w]))
            return [self.whole(w) if "\0" in w else next(plain) for w in words]
        flat = np.array(self.ordinary(joined), "i8")
        data, bounds = self.ids[flat].tobytes(), [0, *(4 * np.flatnonzero(self.ends[flat]) + 4).tolist()]
        return [data[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


@lru_cache(maxsize=2)
def load(path: str) -> LibraryEncoder:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return (ByteEncoder if spec["pre_tokenizer"]["type"] == "ByteLevel" else WordEncoder)(path, spec)
