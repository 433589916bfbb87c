import random
from hashlib import sha256

import pytest
import sentencepiece

from notespark.llm import piece_encoding as pe
from notespark.llm.queries import op13_sentencepiece

SYMBOLS = (
    *" \t\n\r.,(){}=01aeth",
    *("  ", "in", "er", "ing", "tion", "the", "'s", ";\r", "é", "ß", "中", "国", "😀", "́", " ", "​", "\x00"),
    *(pe.SPACE, "<0x0A>", "<s>", "</s>", "<unk>"),
)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pe.model_path())


@pytest.fixture(scope="module")
def coder():
    return pe.PieceCoder(pe.Pieces.load(pe.model_path()))


def expected(library, text):
    ids = library.encode(text) + [library.eos_id()]
    return ids, library.decode(ids)


def test_random_texts_agree_with_the_library(coder, library):
    import numpy as np

    rng = random.Random(7)
    texts = ["".join(rng.choices(SYMBOLS, k=rng.randint(0, 60))) for _ in range(4000)]
    texts += [s * n for s in (" ", pe.SPACE, "a", "\n", " a") for n in (1, 2, 3, 14, 15, 16, 17, 31, 500)]
    for text in texts:
        runs = coder.encode(text)
        ids, decoded = expected(library, text)
        assert np.frombuffer(b"".join(runs), np.int32).tolist() == ids, repr(text)
        assert coder.decode(runs) == decoded, repr(text)


def test_uncut_texts_give_the_same(coder):
    rng = random.Random(8)
    for _ in range(300):
        text = "".join(rng.choices(SYMBOLS, k=40))
        whole = coder.table.ids(pe.SPACE + text.replace(" ", pe.SPACE))
        assert whole + [coder.pieces.end] == [i for run in coder.encode(text) for i in memoryview(run).cast("i")]


@pytest.mark.parametrize("runs", ["(?s).+", f"[ {pe.SPACE}]+[^ {pe.SPACE}]*"])
def test_other_cuts_give_the_same(coder, runs):
    from dataclasses import replace

    other, rng = pe.PieceCoder(replace(coder.pieces, runs=runs)), random.Random(9)
    for _ in range(500):
        text = "".join(rng.choices(SYMBOLS, k=30))
        assert b"".join(other.encode(text)) == b"".join(coder.encode(text))


def test_cuts_follow_the_pieces():
    import re

    def cut(pieces):
        return re.findall(pe.runs_of(pieces), " see e.g. (a»b)  c")

    assert cut(["▁the", "».", "▁("]) == [" see", " e", ".", "g", ".", " (", "a", "»", "b", ")", "  c"]
    assert cut(["▁the", "e.g"]) == [" s", "ee", " e.g.", " (", "a»b", ")", "  c"]
    assert cut(["of▁the"]) == [" see e.g. (a»b)  c"]


def test_memory_that_starts_anew_changes_nothing(coder, monkeypatch, library):
    monkeypatch.setattr(pe, "REMEMBERED", 5)
    small = pe.PieceCoder(coder.pieces)
    text = " ".join(f"word{i % 23} and{i % 7}" for i in range(300))
    assert [i for run in small.encode(text) for i in memoryview(run).cast("i")] == expected(library, text)[0]


def test_ids_that_are_no_text_decode_like_the_library(coder, library):
    byte = {b: i for i, b in coder.pieces.bytes_from.items()}
    for ids in ([byte[0xC3]], [byte[0xE4], byte[0xB8], byte[0x41]], [1, byte[0xC3], byte[0xA9], 2], []):
        assert coder.table.text(ids).removeprefix(" ") == library.decode(ids)


def test_odd_rows(documents, odd_rows, library):
    found = pe.encode(documents(odd_rows)).collect()
    want = sorted((str(d), *expected(library, t or "")) for d, t, *_ in odd_rows)
    assert sorted((str(r.doc_id), r.ids, r.decoded) for r in found) == want
    assert pe.encode(documents([])).count() == 0


def test_text_keys_stay(spark):
    rows = pe.encode(spark.createDataFrame([("x1", "a b")], "doc_id string, text string")).first()
    assert rows.doc_id == "x1" and rows.decoded == "a b"


def test_query(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for row in op13_sentencepiece(spark, "/root/testdata/sf0.001").collect():
        ids, decoded = expected(library, texts.pop(row.doc_id))
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == sha256(decoded.encode()).hexdigest()
    assert not texts
