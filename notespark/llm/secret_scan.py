"""Secrets: known shapes, and random strings shown by how badly a tokenizer compresses them."""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notespark.llm.common import text_or_empty

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MOST_CHARS_PER_TOKEN = 2.2
LEAST_CHARS = 16

# The known shapes, in the order in which kinds are listed.
ASSIGN = r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_CHARS = 12
ACCESS = r"AKIA[A-Z0-9]+"
ACCESS_CHARS = 18
HEX = r"[0-9a-f]+"
HEX_CHARS = 16
KINDS = ("assign", "access", "hex", "random")
DIGEST_CHARS = (32, 40, 56, 64, 96, 128)
# How the vocabulary's text is cut before its merges apply.
CUT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# A random string has a digit, or capitals within; identifiers are words joined by marks or capitals, numbers, dates,
# addresses and UUIDs.
CANDIDATE = r"[A-Za-z0-9+/_=-]{%d,}"
IDENTIFIERS = (
    r"[0-9+/_=-]+",
    r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}",
    r"[+/_=-]*+(?:(?:[A-Z]{2,}+|[A-Z]?[a-z]{2,}+)[0-9]{0,4}+[+/_=-]*+)++",
    r"[a-zA-Z]+[0-9]{1,8}",
)

Span = tuple[int, int, str]


def known_spans(text: str) -> list[Span]:
    """(start, end, kind) of the known shapes: leftmost, not overlapping within a kind; too short ones are dropped."""
    found = []
    if "=" in text or ":" in text:
        found += [(*m.span(), "assign") for m in re.finditer(ASSIGN, text) if len(m[1]) >= ASSIGN_CHARS]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in re.finditer(ACCESS, text) if len(m[0]) >= ACCESS_CHARS]
    # Runs are taken whole, so asking for the length at once finds the same.
    found += [(*m.span(), "hex") for m in re.finditer(r"[0-9a-f]{%d,}" % HEX_CHARS, text)]
    return found


def is_digest(s: str) -> bool:
    return len(s) in DIGEST_CHARS and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s) is not None


def is_identifier(s: str) -> bool:
    return any(re.fullmatch(p, s) for p in IDENTIFIERS)


class TokenEfficiency:
    """Characters per token of strings under a vocabulary."""

    def __init__(self, ranks: bytes) -> None:
        import tiktoken

        pairs = (line.split() for line in ranks.splitlines() if line)
        merges = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.encoding = tiktoken.Encoding("own", pat_str=CUT, mergeable_ranks=merges, special_tokens={})

    def chars_per_token(self, s: str) -> float:
        return len(s) / max(1, len(self.encoding.encode_ordinary(s)))


def random_spans(text: str, efficiency: TokenEfficiency, taken: list[Span], most: float, least: int) -> list[Span]:
    """Strings outside the spans taken that the vocabulary compresses to under `most` characters per token."""
    taken = sorted(taken)
    starts, ends = [s[0] for s in taken], list(accumulate((s[1] for s in taken), max))
    out = []
    for m in re.finditer(CANDIDATE % least, text):
        s = m[0]
        if s.isalpha() and (s[1:].islower() or s.isupper()) or is_digest(s) or is_identifier(s):
            continue
        a, b = m.span()
        before = bisect_left(starts, b)  # spans that start before this one ends
        if (not before or ends[before - 1] <= a) and efficiency.chars_per_token(s) < most:
            out.append((a, b, "random"))
    return out


def joined(spans: list[Span]) -> str:
    ordered = sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in ordered)


SCHEMA = "key long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"


def find_secrets(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    vocabulary: str = VOCABULARY,
    most_chars_per_token: float = MOST_CHARS_PER_TOKEN,
    least_chars: int = LEAST_CHARS,
) -> DataFrame:
    """One row per input row: key, counts by kind, base_sha256 and spans (kind:start:end, in code points, end exclusive).

    Kinds are the known shapes and `random`: runs of at least `least_chars` letters, digits and + / _ = - that are no
    digest, no identifier and no plain word, and give under `most_chars_per_token` characters per token. The driver
    reads the vocabulary, which has a fixed size, and tasks get it by broadcast; rows are handled on their own, without
    a shuffle.

    Null or empty text: no spans; null keys and repeated rows stay; a text of any length is scanned whole; empty table:
    no rows. Other columns are not read.
    """
    with open(vocabulary, "rb") as file:
        ranks = docs.sparkSession.sparkContext.broadcast(file.read())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        efficiency = TokenEfficiency(ranks.value)
        for batch in batches:
            rows = []
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                value = body.as_py()
                base = known_spans(value)
                more = random_spans(value, efficiency, base, most_chars_per_token, least_chars)
                counts = [sum(s[2] == kind for s in base) for kind in KINDS[:3]]
                digest = hashlib.sha256(joined(base).encode()).hexdigest()
                rows.append((doc, *counts, len(more), digest, joined(base + more)))
            columns = zip(*rows) if rows else [()] * 7
            types = [pa.int64()] * 5 + [pa.string()] * 2
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in SCHEMA.split(", ")])

    found = docs.select(F.col(key).cast("long").alias("key"), text_or_empty(text).alias("text")).mapInArrow(work, SCHEMA)
    return found.withColumnRenamed("key", key)


def redact(text: str, spans: str, mark: str = "[secret]") -> str:
    """The text with every span replaced; overlapping spans become one mark."""
    out, at = [], 0
    for a, b in sorted((int(x.split(":")[1]), int(x.split(":")[2])) for x in spans.split(",") if x):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])
