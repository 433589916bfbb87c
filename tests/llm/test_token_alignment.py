import random
from collections import Counter
from hashlib import sha256

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from notespark.llm import token_alignment as ta
from notespark.llm.queries import op11_alignment


@pytest.fixture(scope="module")
def plain():
    """Alignment of whole texts, by the sets of bytes that tokens cover."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    code = ta.byte_level()

    def spans(lengths):
        ends = [0]
        for n in lengths:
            ends.append(ends[-1] + n)
        return list(zip(ends, ends[1:]))

    def align(text):
        if not text:
            return None
        whole = (" " + text).encode()
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(code[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [
            bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in ((i, b.id_to_piece(i)) for i in ids_b)
        ]
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            return None
        spans_a, spans_b = spans(map(len, bytes_a)), spans(map(len, bytes_b))
        links = [
            (i, j) for i, (s, e) in zip(ids_a, spans_a) for j, (u, v) in zip(ids_b, spans_b) if max(s, u) < min(e, v)
        ]
        common = [0, *sorted({e for _, e in spans_a} & {e for _, e in spans_b})]
        groups = [
            ",".join(str(i) for i, (s, e) in zip(ids_a, spans_a) if x <= s and e <= y)
            + "|"
            + ",".join(str(j) for j, (s, e) in zip(ids_b, spans_b) if x <= s and e <= y)
            for x, y in zip(common, common[1:])
        ]
        return ids_a, ids_b, groups, links

    return align


def expected(plain, rows):
    found = [(key, plain(text)) for key, text in rows]
    counts = Counter(pair for _, f in found if f for pair in set(f[3]))
    most = {}
    for (a, _), n in counts.items():
        most[a] = max(most.get(a, 0), n)
    out = []
    for key, f in found:
        if f is None:
            out.append((str(key), 0, 0, 0, 0, 0, 0, ""))
            continue
        ids_a, ids_b, groups, links = f
        n_best = sum(counts[p] == most[p[0]] for p in links)
        sums = (len(ids_a), len(ids_b), len(groups), len(links), n_best, sum(counts[p] for p in links))
        out.append((str(key), *sums, ";".join(groups)))
    return sorted(out)


def result(df):
    return sorted((str(r.doc_id), *(r[c] for c in ta.MEASURES), r.groups) for r in df.collect())


def test_random_texts_agree_with_whole_text_alignment(plain):
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as first, open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as second:
        aligner = ta.Aligner(first.read(), second.read())
    rng = random.Random(5)
    symbols = [*" \t\n.,'0aeth", "  ", "ing", "'s", " the", "é", "中", "😀", "́", " ", "▁", "\x00", "\x1c", "\x85", "<|endoftext|>", "<0x0A>", "</s>"]
    for _ in range(3000):
        text = "".join(rng.choices(symbols, k=rng.randint(1, 25)))
        found, want = aligner.align(text), plain(text)
        if want is None:
            assert found is None
            continue
        assert (found.n_a, found.n_b, found.groups) == (len(want[0]), len(want[1]), ";".join(want[2])), repr(text)
        links = memoryview(found.links).cast("q").tolist()
        assert sorted(divmod(x, aligner.width) for x in links) == sorted(want[3])


def test_odd_rows(documents, odd_rows, plain):
    rows = [r for r in odd_rows if len(r[1] or "") < 10_000] + [(21, "<|endoftext|> </s>", "en", "a"), (22, "a▁b", "en", "a")]
    assert result(ta.align(documents(rows))) == expected(plain, [r[:2] for r in rows])
    assert ta.align(documents([])).count() == 0


def test_very_long_text(documents, odd_rows):
    (row,) = [r for r in odd_rows if len(r[1] or "") > 100_000]
    found = ta.align(documents([row])).first()
    assert found.n_groups == found.groups.count(";") + 1 and found.n_links == found.n_a + found.n_b - found.n_groups
    assert found.n_best > 0


def test_small_blocks_and_hot_texts(documents, plain, monkeypatch):
    from notespark.operators import skew

    rng = random.Random(6)
    words = ["the", "of", "naïve", "Straße", "tion", "2024", "x=1;"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(60)] + [(100 + i, "the hot text") for i in range(60)]
    rows += [(7, "the hot text")] * 5
    want = expected(plain, rows)
    assert result(ta.align(documents(rows))) == want
    monkeypatch.setattr(ta, "BLOCK_TEXTS", 3)
    monkeypatch.setattr(ta, "BLOCK_PAIRS", 20)
    assert result(ta.align(documents(rows))) == want
    monkeypatch.setattr(skew, "MAX_HOT_KEYS", 4)
    assert result(ta.align(documents(rows))) == want


def test_query(spark, plain):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(F.length("text") < 3000)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert result(ta.align(docs)) == expected(plain, rows)
    texts = {r.doc_id: r.groups for r in ta.align(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()}
    for row in op11_alignment(spark, "/root/testdata/sf0.001").collect():
        groups = texts.pop(row.doc_id)
        assert row.groups_sha256 == (sha256(groups.encode()).hexdigest() if groups else "")
    assert not texts
