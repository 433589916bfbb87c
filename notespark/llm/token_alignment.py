"""Alignment of two tokenizers: which of their tokens cover the same bytes, and how often two ids meet.

Equal texts are one row: texts are shuffled in full, each different one is tokenised and aligned once, its pairs of ids
count once for each copy, and the measures are joined back to all documents that have the text.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notespark.llm.common import text_or_empty
from notespark.llm.piece_encoding import SPACE, Remembered, marks_of, sha256
from notespark.operators.skew import lookup
from notespark.session import cut_lineage, ensure_checkpoint_dir

BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
# Texts, and pairs of ids of all of them together, in a block whose counts are looked up at once.
BLOCK_TEXTS, BLOCK_PAIRS = 1024, 1 << 18
# Where no token of either tokenizer goes on: before a single space between two characters that are none, and, with the
# marks of the pieces, between a Latin letter or a digit and a mark. The letter stands before a mark of its own.
CUT = r"(?<=\S)(?= \S)|(?<=[0-9A-Za-zÀ-ÖØ-öø-ɏ])(?<![%s])(?=[%s])"
LETTER = "x"


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others, in
    order, for the characters from 256 on."""
    own = {b for first, last in ("!~", "¡¬", "®ÿ") for b in range(ord(first), ord(last) + 1)}
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(others)}


@dataclass
class Aligned:
    """A text's tokens in both vocabularies. ``groups`` lists ids between common ends, ``links`` all pairs that overlap."""

    n_a: int
    n_b: int
    n_groups: int
    groups: str
    links: bytes


class Aligner:
    """Tokenises with both vocabularies and aligns. Texts are cut where no token of either vocabulary goes on; equal runs
    are worked out once."""

    def __init__(self, byte_bpe: str, piece_bpe: bytes) -> None:
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_bpe)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=piece_bpe)
        code = byte_level()
        self.a_bytes = {
            i: bytes(code[c] for c in token) if all(c in code for c in token) else token.encode()
            for token, i in self.a.get_vocab(with_added_tokens=False).items()
        }
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)
        ]
        plain = [p for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        marks, before = marks_of(plain), self.b.encode(LETTER)
        self.cut = re.compile(CUT % (marks, marks)).split if marks and pieces[before[0]] == SPACE + LETTER else lambda text: [text]
        self.run = Remembered(self.align_run)
        self.width = len(pieces)

    def align_run(self, run: str) -> tuple[int, int, int, str, bytes] | None:
        """Of one run of a text; None if the bytes of either side are not those of the run.

        B puts a space first. A run that begins with a mark has a letter put before it, which stays a piece of its own.
        """
        a = self.a.encode(run, add_special_tokens=False).ids
        b = self.b.encode(run[1:]) if run[0] == " " else self.b.encode(LETTER + run)[1:]
        a_bytes, b_bytes, width = self.a_bytes, self.b_bytes, self.width
        whole = run.encode()
        if b"".join([a_bytes[i] for i in a]) != whole or b"".join([b_bytes[i] for i in b]) != whole:
            return None
        links, groups = [], []
        rest, own = iter(b), []
        a_end, b_end, left, now = 0, 0, "", -1
        for i in a:
            a_end += len(a_bytes[i])
            left = f"{left},{i}" if left else str(i)
            if own and b_end > a_end - len(a_bytes[i]):
                links.append(i * width + now)  # the token of B that began before
            while b_end < a_end:
                now = next(rest)
                b_end += len(b_bytes[now])
                own.append(now)
                links.append(i * width + now)
            if a_end == b_end:
                groups.append(left + "|" + ",".join(map(str, own)))
                left, own = "", []
        return len(a), len(b), len(groups), ";".join(groups), array("q", links).tobytes()

    def align(self, text: str) -> Aligned | None:
        found = [*map(self.run.__getitem__, self.cut(" " + text))] if text else [None]
        if None in found:
            return None
        n_a, n_b, n_groups, groups, links = zip(*found)
        return Aligned(sum(n_a), sum(n_b), sum(n_groups), ";".join(groups), b"".join(links))


SCHEMA = (
    "digest string, copies long, n_a long, n_b long, n_groups long, n_links long, groups string, "
    "pairs array<long>, times array<int>, block string"
)
MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def _lists(arrays: list[np.ndarray], kind: type) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*arrays, np.zeros(0, kind)]).astype(kind)))


def aligned_texts(docs: DataFrame, text: str, byte_bpe: str, piece_bpe: str, whole_groups: bool) -> DataFrame:
    """One row per different text that both tokenizers cover: measures of its own, its different pairs of ids and how
    often it has each, and the block it belongs to."""
    with open(byte_bpe, encoding="utf-8") as first, open(piece_bpe, "rb") as second:
        files = docs.sparkSession.sparkContext.broadcast((first.read(), second.read()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, task = Aligner(*files.value), TaskContext.get()
        block, texts, held = 0, 0, 0
        for batch in batches:
            rows, pairs, times = [], [], []
            for digest, body, copies in zip(*(c.to_pylist() for c in batch.columns)):
                found = aligner.align(body)
                if found is None:
                    continue
                links = np.frombuffer(found.links, np.int64)
                own, often = np.unique(links, return_counts=True)
                if texts and (texts >= BLOCK_TEXTS or held + len(own) > BLOCK_PAIRS):
                    block, texts, held = block + 1, 0, 0
                texts, held = texts + 1, held + len(own)
                groups = found.groups if whole_groups else hashlib.sha256(found.groups.encode()).hexdigest()
                name = f"{task.partitionId()}-{task.attemptNumber()}-{block}"
                rows.append((digest, copies, found.n_a, found.n_b, found.n_groups, len(links), groups, name))
                pairs.append(own)
                times.append(often)
            kinds = [pa.string(), *[pa.int64()] * 5, pa.string(), pa.string()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 8, kinds)]
            columns[7:7] = [_lists(pairs, np.int64), _lists(times, np.int32)]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in SCHEMA.split(", ")])

    value = text_or_empty(text)
    texts = docs.select(value.alias("text")).where("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    return texts.select(sha256(F.col("text")).alias("digest"), "text", "copies").mapInArrow(work, SCHEMA)


def pair_counts(texts: DataFrame, width: int) -> DataFrame:
    """Pairs of ids with the number of documents that have them linked, and whether no pair of the same A id has more."""
    counts = cut_lineage(
        texts.select(F.explode("pairs").alias("pair"), "copies").groupBy("pair").agg(F.sum("copies").alias("count"))
    )
    a = F.floor(F.col("pair") / F.lit(width)).cast("long").alias("a")
    most = counts.groupBy(a).agg(F.max("count").alias("most"))
    return counts.withColumn("a", a).join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def _measured(key: tuple, texts: pa.Table, counts: pa.Table) -> pa.Table:
    pairs, count = counts["pair"].to_numpy(), counts["count"].to_numpy()
    best, order = counts["best"].to_numpy(zero_copy_only=False), np.argsort(pairs)
    lists = texts["pairs"].combine_chunks()
    place = order[np.searchsorted(pairs, lists.flatten().to_numpy(), sorter=order)]
    times = texts["times"].combine_chunks().flatten().to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    sums = [np.zeros(len(texts), np.int64) for _ in range(2)]
    np.add.at(sums[0], row, times * best[place])
    np.add.at(sums[1], row, times * count[place])
    kept = texts.select(["digest", "n_a", "n_b", "n_groups", "n_links", "groups"])
    return kept.append_column("n_best", pa.array(sums[0])).append_column("count_sum", pa.array(sums[1]))


def align(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    byte_bpe: str | None = None,
    piece_bpe: str | None = None,
    whole_groups: bool = True,
) -> DataFrame:
    """One row per input row: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    ``groups`` is the alignment, ``a1,a2|b1;a3|b2,b3`` in ids, or its SHA-256 without ``whole_groups`` (it is several times
    as long as the text). Tokens of A cover a space and the text, and those of B as well, which puts that space itself.

    Runs jobs. The aligned texts are written to the shared checkpoint folder: pairs of ids are counted over them, and each
    block of at most ``BLOCK_TEXTS`` texts is then joined with the counts of its own pairs, so counts are neither broadcast
    nor looked up once for each text. Rows find their text by SHA-256, hot texts dealt over salts.

    Null or empty text, and texts that either tokenizer doesn't give back byte by byte: zeros and ''. Texts of any length
    are tokenised whole; null keys and repeated rows stay, and each row counts as a document; empty table: no rows. Other
    columns are not read.
    """
    import public_tokenizers

    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    byte_bpe, piece_bpe = byte_bpe or public_tokenizers.path(BYTE_BPE), piece_bpe or public_tokenizers.path(PIECE_BPE)
    folder = f"{spark.sparkContext.getCheckpointDir()}/alignment-{uuid4().hex}"
    aligned_texts(docs, text, byte_bpe, piece_bpe, whole_groups).write.parquet(folder)
    texts = spark.read.parquet(folder)
    counts = pair_counts(texts, _pieces(piece_bpe))
    needed = texts.select(F.col("block").alias("at"), F.explode("pairs").alias("pair")).distinct().join(counts, "pair")
    measured = (
        texts.groupBy("block")
        .cogroup(needed.groupBy("at"))
        .applyInArrow(_measured, "digest string, n_a long, n_b long, n_groups long, n_links long, groups string, n_best long, count_sum long")
    )
    rows = docs.select(
        F.col(key).alias("key"), sha256(text_or_empty(text)).alias("digest"), F.monotonically_increasing_id().alias("row")
    )
    copies = texts.select("digest", F.col("copies").alias("_n"))
    found = lookup(rows, measured, ["digest"], ["row"], "left", counts=copies)
    return found.select(
        F.col("key").alias(key),
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in MEASURES],
        F.coalesce("groups", F.lit("")).alias("groups"),
    )


def _pieces(path: str) -> int:
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path).vocab_size()
