"""Encoding, packing and token files against the tokenizers library and plain versions."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from ledgerlight.llm import bpe, packing, pieces, tokenfile, tokenizing

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
R = random.Random(7)
TEXTS = [None, "", " ", "\n", "a  b", "\n\nx", " x", "x ", "a<|endoftext|>b  <|endoftext|>", "\x1cq\x1c \x85 z", "it's I'LL we'd", "日本語 🙂", "\0ab c", "\x01x y", "a  b　c", "é ́x ΣΑΣ", "İx ﬁ x² ½", "J̌ T̈ ǰ ẗ İ Å", "a\r\n\n b\t \tc  ", "x,***y 'sx '9a('re9)it'rest 3a,'s"]
TEXTS += ["".join(R.choice("abe Tho  n\n.'s12é日") for _ in range(R.randint(1, 90))) for _ in range(150)]
TEXTS += ["".join(R.choice("aeionthrs") for _ in range(9000)), "ab" * 6000, "to be or not " * 900, "to be or not " * 900]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string, piece int").repartition(3)


def library(path, text):
    return tokenizers.Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def expected():
    out = {}
    for path in (BYTE, WORD):
        t = tokenizers.Tokenizer.from_file(path)
        out[path] = [t.encode(x or "", add_special_tokens=False).ids for x in TEXTS]
    return out


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def test_piece_encoders(expected):
    texts = pa.array([t or "" for t in TEXTS])
    for path, encoder in ((BYTE, tokenizing.load(BYTE)), (WORD, tokenizing.load(WORD)), (BYTE, bpe.load(BYTE))):
        for rows in (texts, texts, texts.cast(pa.large_string()), texts[5:90]):
            at = 5 if len(rows) == 85 else 0
            for got, ids, text in zip(encoder.encode_each(rows), expected[path][at:], TEXTS[at:], strict=False):
                assert np.frombuffer(got, "<u4").tolist() == ids, text
        assert encoder.encode_each(pa.array([], pa.string())) == []


def test_memory_is_bounded_and_keeps_what_is_used():
    known = pieces.Memory(5)
    known.keep(["often"], [b"x"])
    for i in range(100):
        known.keep([str(i), "long" * 99], [b"", b""])
        assert len(known) <= 10 and known.find(["often", "never"]) == [b"x", None]


def test_tokens_of_words_encode_as_in_the_library():
    import json

    with open(WORD, encoding="utf-8") as f:
        words = [w.removesuffix("</w>") for w in json.load(f)["model"]["vocab"] if w.isascii()]
    text = " ".join(words)
    assert np.frombuffer(tokenizing.load(WORD).encode_each(pa.array([text]))[0], "<u4").tolist() == library(WORD, text)


def test_bpe_round_trip(spark, docs, expected):
    t = tokenizers.Tokenizer.from_file(BYTE)
    got = {r.doc_id: r for r in bpe.round_trip(docs, BYTE).collect()}
    assert len(got) == len(TEXTS)
    for i, ids in enumerate(expected[BYTE]):
        back = t.decode(ids, skip_special_tokens=False).encode()
        assert tuple(got[i])[1:] == (len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256(back).hexdigest()), TEXTS[i]
    assert bpe.round_trip(docs.limit(0), BYTE).count() == 0


def test_repeated_rows_encode_alike(spark, docs):
    twice = docs.union(docs.select("doc_id", "text", "ids", "piece"))
    rows = bpe.encode_documents(twice, BYTE).collect()
    assert len(rows) == 2 * len(TEXTS) and len({(r.doc_id, bytes(r.ids)) for r in rows}) == len(TEXTS)


def test_every_token_encodes_to_itself():
    b = bpe.load(BYTE)
    assert all(b.piece(t) == [i] for i, t in enumerate(b.tokens))


def test_packing(spark, docs, expected):
    rows = packing.pack_documents(docs.union(docs.filter("doc_id < 40")), BYTE).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, ids in enumerate(expected[BYTE]):
        ids = [*ids, 2]
        pieces = sorted(by_doc[i], key=lambda r: (r.piece, r.sequence_id))
        if i < 40:
            assert len(pieces) == 2
            pieces = pieces[::2]
        assert [p.piece for p in pieces] == list(range(len(pieces)))
        at = 0
        for p in pieces:
            assert p.start == at and p.ids_crc32 == zlib.crc32(packed(ids[at : at + p.length]))
            at += p.length
        assert at == len(ids) and all(p.length == 1024 for p in pieces[1:]) and (len(pieces) == 1 or len(ids) > 1024)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by_sequence) <= sum(r.length for r in rows) // 1024 + 2
    assert packing.pack_documents(docs.limit(0), BYTE).count() == 0


def test_plan_is_best_fit_decreasing():
    for _ in range(60):
        capacity = R.randint(4, 40)
        counts = [0] + [R.choice([0, 0, 1, 2, 5, 30]) for _ in range(capacity)]
        runs = packing.plan_best_fit(counts, capacity)
        fill, seen = {}, dict.fromkeys(range(capacity + 1), 0)
        for length, rank, n, first, offset in runs.tolist():
            assert rank == seen[length]
            seen[length] += n
            for s in range(first, first + n):
                fill.setdefault(s, []).append((offset, length))
        assert [seen[n] for n in range(capacity + 1)] == counts
        for places in fill.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= capacity
        rooms = []
        for length in range(capacity, 0, -1):
            for _ in range(counts[length]):
                fits = [r for r in rooms if r >= length]
                r = min(fits) if fits else capacity
                if fits:
                    rooms.remove(r)
                rooms.append(r - length)
        assert len(fill) == len(rooms)


def test_plan_does_not_grow_with_the_number_of_pieces():
    counts = [0] + [1000 + 7 * n for n in range(256)]
    small, large = packing.plan_best_fit(counts, 256), packing.plan_best_fit([c * 1000 for c in counts], 256)
    assert len(large) < 3 * len(small)


def test_shared_files_of_a_store_that_is_not_local(tmp_path):
    from ledgerlight.llm.common import SharedFiles
    from pyarrow import fs

    files = SharedFiles(str(tmp_path / "x"))
    files.local, files._remote = None, lambda: (fs.LocalFileSystem(), str(tmp_path / "x"))
    files.write("a", [b"abc", b"def"])
    files.write("empty", [])
    assert files.map("a")[:] == b"abcdef" and files.map("a") is files.map("a") and files.map("empty") == b""
    assert sorted(x.name for x in (tmp_path / "x").iterdir()) == ["a", "empty"]


def test_bit_widths():
    for width in (1, 3, 8, 13, 16, 17, 31, 32):
        ids = np.array([R.randrange(1 << width) for _ in range(10_001)], "u4")
        w = tokenfile.Writer(width)
        data = b""
        for i in range(0, 10_001, 997):
            w.add(i, ids[i : i + 997].astype("<u4").tobytes())
            data += b"".join(w.blocks())
        data += b"".join(w.end())
        r = tokenfile.Reader(data)
        assert (r.ids(0, 10_001) == ids).all() and (r.ids(4090, 4100) == ids[4090:4100]).all() and (r.document(3) == ids[2991:3988]).all()
        assert len(data) < 10_001 * width / 8 + 1000
    assert tokenfile.width_of(49408) == 16 and tokenfile.width_of(2) == 1 and tokenfile.width_of(65537) == 17


def test_token_files(spark, docs, expected):
    got = sorted(tokenfile.token_file_round_trip(docs, WORD).collect())
    at = 0
    assert len(got) == len(TEXTS)
    for r, ids in zip(got, expected[WORD], strict=True):
        ids = [*ids, 1]
        assert tuple(r)[1:] == (at, len(ids), zlib.crc32(packed(ids)))
        at += len(ids)
    nulls = spark.createDataFrame([(None, "a b"), (None, "c"), (5, None)], "doc_id long, text string")
    assert sorted((r.start, r.n_tokens, r.doc_id) for r in tokenfile.token_file_round_trip(nulls, WORD).collect())[-1][2] == 5
    assert tokenfile.token_file_round_trip(docs.limit(0), WORD).count() == 0
