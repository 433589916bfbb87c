"""SentencePiece encoding and decoding of merge-type (BPE) models through a table of prefixes.

Every prefix of a text has one encoding, so one last token. The last token of a prefix is the one piece ending there that
can stand behind the last token of the prefix before it; an automaton lists the pieces ending at each place, and a test
of two neighbours tells whether merging would have joined them otherwise. Ids are then read backwards from the end.
"""

from __future__ import annotations

import codecs
import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notespark.llm.common import text_or_empty

MODEL = "piece_bpe_32k.model"
# The mark that stands for a space inside pieces.
SPACE = "▁"
# Runs remembered by a task; the memory starts anew when it is full, which changes no result.
REMEMBERED = 800_000
NEVER = 1 << 60


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@dataclass
class Pieces:
    """What encoding needs of a model: pieces by id, and how each piece comes about by merging.

    ``rank`` orders merges, 0 first. A piece of several characters is the merge of ``halves``; pieces that merging never
    makes have none and are left out of ``ids``.
    """

    text: list[str]
    ids: dict[str, int]
    rank: dict[str, int]
    halves: dict[str, tuple[str, str]]
    bytes_from: dict[int, int]
    silent: set[int]
    unknown: int
    end: int
    runs: str

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(model.vocab_size())
        text = [model.id_to_piece(i) for i in every]
        plain = [i for i in every if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i))]
        scores = {text[i]: model.get_score(i) for i in plain}
        places = {s: n for n, s in enumerate(sorted({*scores.values()}, reverse=True))}
        rank = {p: places[s] for p, s in scores.items()}
        merged = {p: merge_slowly(p, rank) for p in scores if len(p) > 1}
        halves = {p: last for p, (parts, last) in merged.items() if len(parts) == 1}
        return cls(
            text,
            {text[i]: i for i in plain if len(text[i]) == 1 or text[i] in halves},
            rank,
            halves,
            {i: int(text[i][3:5], 16) for i in every if model.is_byte(i)},
            {i for i in every if model.is_control(i)},
            model.unk_id(),
            model.eos_id(),
            runs_of(scores),
        )


def _marked(error: UnicodeDecodeError) -> tuple[str, int]:
    return "\ufffd" * (error.end - error.start), error.end


def text_of_bytes(raw: bytes) -> str:
    """UTF-8, with one replacement mark for each byte that belongs to no character."""
    codecs.register_error("each-byte", _marked)
    return raw.decode("utf-8", "each-byte")


def marks_of(pieces: Iterable[str]) -> str | None:
    """Marks of punctuation, for a character class: those of ASCII and every character that stands beside a mark in some
    piece, so that no piece has a mark beside any other character but a space. None if pieces have spaces inside."""
    near: dict[str, set[str]] = {}
    for piece in pieces:
        for x, y in pairwise(piece):
            if y == SPACE and x != SPACE:
                return None
            if x != SPACE:
                near.setdefault(x, set()).add(y)
                near.setdefault(y, set()).add(x)
    marks = {c for c in map(chr, range(128)) if not c.isalnum() and c != " "}
    more = [*marks]
    while more:
        new = near.get(more.pop(), set()) - marks
        marks |= new
        more += new
    return "".join(map(re.escape, sorted(marks)))


def runs_of(pieces: Iterable[str]) -> str:
    """Pattern of the runs into which a text can be cut because no piece goes on from one into the next: marks and all else,
    each with the spaces before it; the whole text if pieces have spaces inside."""
    marks = marks_of(pieces)
    if marks is None:
        return "(?s).+"
    return f"[ {SPACE}]*(?:[{marks}]+|[^ {SPACE}{marks}]+)|[ {SPACE}]+"


def merge_slowly(text: str, rank: dict[str, int]) -> tuple[list[str], tuple[str, str]]:
    """Parts and last merge of a short text: always the best pair next, the leftmost of equals."""
    parts, last = list(text), ("", "")
    while True:
        pairs = [(rank[a + b], i) for i, (a, b) in enumerate(pairwise(parts)) if a + b in rank]
        if not pairs:
            return parts, last
        i = min(pairs)[1]
        last = (parts[i], parts[i + 1])
        parts[i : i + 2] = ["".join(last)]


class PrefixTable:
    """Encoder and decoder over ``Pieces``."""

    def __init__(self, pieces: Pieces) -> None:
        import ahocorasick

        self.pieces = pieces
        self.automaton = ahocorasick.Automaton()
        for piece in pieces.halves:
            self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.byte_ids = {b: i for i, b in pieces.bytes_from.items()}
        self.surface = [
            None if i in pieces.bytes_from else "" if i in pieces.silent else p.replace(SPACE, " ")
            for i, p in enumerate(pieces.text)
        ]
        self.fits: dict[tuple[str, str], bool] = {}
        self.edges: dict[tuple[str, int], list[tuple[str, int]]] = {}

    def _edge(self, piece: str, side: int) -> list[tuple[str, int]]:
        """The symbols that stood at an edge of a piece while it was made, each with the rank of the merge it ended in."""
        found = self.edges.get((piece, side))
        if found is None:
            found, part, until = [], piece, NEVER
            while True:
                found.append((part, until))
                if part not in self.pieces.halves:
                    break
                until, part = self.pieces.rank[part], self.pieces.halves[part][side]
            self.edges[piece, side] = found
        return found

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging leaves both pieces as neighbours: no symbols at their common edge would have been merged
        with one another before the merges that made the pieces. Of equal ranks the one more to the left is first."""
        rank = self.pieces.rank
        fit = not any(
            (r := rank.get(a + b)) is not None and r < a_until and r <= b_until
            for a, a_until in self._edge(left, 1)
            for b, b_until in self._edge(right, 0)
        )
        if len(self.fits) >= REMEMBERED:
            self.fits.clear()
        self.fits[left, right] = fit
        return fit

    def parts(self, text: str) -> list[str]:
        """Pieces of a text with marks for spaces; a character that is no piece is a part of its own.

        Just one piece fits behind each prefix, so a character stands alone where no longer piece fits."""
        if text in self.pieces.halves:
            return [text]
        last, fits, fixed = list(text), self.fits, -1  # the last part of the prefix that ends with each character
        for end, piece in self.automaton.iter(text):
            if end != fixed:
                start = end - len(piece)
                if start >= 0:
                    fit = fits.get((last[start], piece))
                    if fit is None:
                        fit = self.compatible(last[start], piece)
                    if not fit:
                        continue
                last[end], fixed = piece, end
        out, end = [], len(text) - 1
        while end >= 0:
            out.append(last[end])
            end -= len(last[end])
        return out[::-1]

    def ids(self, text: str) -> list[int]:
        out = []
        for part in self.parts(text):
            number = self.pieces.ids.get(part)
            if number is not None:
                out.append(number)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in part.encode("utf-8", "replace")]
            else:
                out.append(self.pieces.unknown)
        return out

    def text(self, ids: list[int]) -> str:
        """Text of ids, marks as spaces; the space that encoding puts first is still there."""
        parts = [self.surface[i] for i in ids]
        if None in parts:
            raw = b"".join(bytes([self.pieces.bytes_from[i]]) if p is None else p.encode() for i, p in zip(ids, parts))
            return text_of_bytes(raw)
        return "".join(parts)


class Remembered(dict):
    """A function of one argument with its results, forgotten all at once when there are too many."""

    def __init__(self, work) -> None:
        self.work = work

    def __missing__(self, key):
        if len(self) >= REMEMBERED:
            self.clear()
        self[key] = value = self.work(key)
        return value


class PieceCoder:
    """Whole texts to ids and back, as the model's own library does with an end id.

    Texts are cut where no piece of the model goes on, so no merge is lost, and equal runs are encoded once.
    """

    def __init__(self, pieces: Pieces) -> None:
        self.pieces, self.table = pieces, PrefixTable(pieces)
        self.cut = re.compile(pieces.runs).findall
        self.ids_of = Remembered(lambda run: array("i", self.table.ids(run.replace(" ", SPACE))).tobytes())
        self.text_of = Remembered(lambda packed: self.table.text(array("i", packed).tolist()))
        self.end = array("i", [pieces.end]).tobytes()

    def encode(self, text: str) -> list[bytes]:
        """Ids of the runs of a text, packed as 32-bit numbers, the end id last."""
        return [*map(self.ids_of.__getitem__, self.cut(" " + text) if text else ()), self.end]

    def decode(self, runs: list[bytes]) -> str:
        """Text of ids given in runs, cut only where pieces begin."""
        return "".join(map(self.text_of.__getitem__, runs)).removeprefix(" ")


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str | None = None) -> DataFrame:
    """One row per input row: key, ids (the end id included) and the text decoded from these ids.

    The driver reads the model, whose size is fixed, and works out how its pieces merge; tasks get this by broadcast. Rows
    are handled on their own, without a shuffle, so a lost task is simply run again.

    Null text counts as empty and has the end id alone; a text of any length is encoded whole; null keys and repeated rows
    stay; empty table: no rows. Other columns are not read. The model must be of the merge type, without normalisation
    other than the leading space and the marks for spaces.
    """
    pieces = docs.sparkSession.sparkContext.broadcast(Pieces.load(model or model_path()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = PieceCoder(pieces.value)
        for batch in batches:
            ids, ends, texts = [], [0], []
            for body in batch.column(1):
                runs = coder.encode(body.as_py())
                ids.append(b"".join(runs))
                ends.append(ends[-1] + len(ids[-1]) // 4)
                texts.append(coder.decode(runs))
            values = pa.array(np.frombuffer(b"".join(ids), np.int32))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(texts, pa.string())], ["key", "ids", "decoded"])

    rows = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(work, f"key {kind}, ids array<int>, decoded string").withColumnRenamed("key", key)


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def digests(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """Number of ids, and SHA-256 of the ids in decimal and of the decoded text."""
    return encoded.select(
        key,
        F.size("ids").cast("long").alias("n_tokens"),
        sha256(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"),
        sha256(F.col("decoded")).alias("decoded_sha256"),
    )
