"""Language identification by interpolated Kneser-Ney models of characters."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notespark.llm.common import remainder_of_id, text_or_empty, uniform_bits
from notespark.session import cut_lineage

ORDER = 4
SAMPLE_PER_LANGUAGE = 400
MAX_GRAMS = 200_000
FOLDS = 5
ACCEPTED_QUANTILE = 0.999
ACCEPTED_MARGIN = 1.1
PIECE = 1 << 20
UNKNOWN = "und"
TABLED = 0x3000


def letter_table() -> np.ndarray:
    """Lower-case letter of every code point below TABLED; 0 for all that is no letter."""
    chars = (chr(c) for c in range(TABLED))
    return np.array([ord(c.lower()[0]) if c.isalpha() else 0 for c in chars], np.uint32)


def symbols(text: str, letters: np.ndarray) -> np.ndarray:
    """Letters in lower case, a 0 for every run of other characters after a letter and at the end; empty without letters."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = letters[np.minimum(codes, TABLED - 1)]
    high = codes >= TABLED
    if high.any():
        kinds, at = np.unique(codes[high], return_inverse=True)
        out[high] = np.array([ord(chr(c).lower()[0]) if chr(c).isalpha() else 0 for c in kinds.tolist()], np.uint32)[at]
    if not out.any():
        return np.zeros(0, np.uint64)
    out = np.concatenate(([0], out, [0])).astype(np.uint64)
    keep = out > 0
    keep[1:] |= out[:-1] > 0
    return out[keep]


def gram_hash(columns: list[np.ndarray]) -> np.ndarray:
    """64-bit polynomial hash of n-grams given as columns of symbols."""
    base = np.uint64(0x9E3779B97F4A7C15)
    out = columns[0] + np.uint64(1)
    for column in columns[1:]:
        out = out * base + column + np.uint64(1)
    return out


def pieces(text: str, letters: np.ndarray, order: int) -> Iterator[np.ndarray]:
    """A text's symbols in slices that bound memory, each led by the order - 1 symbols before it."""
    s = np.concatenate((np.zeros(order - 1, np.uint64), symbols(text, letters)))
    for at in range(order - 1, len(s), PIECE):
        yield s[at - order + 1 : at + PIECE]


def windows(piece: np.ndarray, order: int) -> list[np.ndarray]:
    n = len(piece) - order + 1
    return [piece[i : i + n] for i in range(order)]


@dataclass
class Model:
    """For each order the sorted hashes of n-grams, and log probabilities by language; likewise contexts and back-offs."""

    languages: list[str]
    grams: list[np.ndarray] = field(default_factory=list)
    log_p: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    log_backoff: list[np.ndarray] = field(default_factory=list)
    floor: np.ndarray | None = None
    accepted: list[float] = field(default_factory=list)

    def lookup(self, columns: list[np.ndarray]) -> np.ndarray:
        """Log probability of the last symbol after the others, by language. columns: one per symbol, oldest first."""
        n = len(columns)
        if n == 0:
            return self.floor[None, :]
        hashes, known = gram_hash(columns), self.grams[n - 1]
        at = np.minimum(np.searchsorted(known, hashes), max(0, len(known) - 1))
        out = self.log_p[n - 1][at]
        missing = np.nonzero(known[at] != hashes)[0]
        if len(missing):
            rest = [c[missing] for c in columns]
            lower = self.lookup(rest[1:]) if n > 1 else np.repeat(self.floor[None, :], len(missing), 0)
            if n > 1:
                ctx, all_ctx = gram_hash(rest[:-1]), self.contexts[n - 1]
                there = np.minimum(np.searchsorted(all_ctx, ctx), len(all_ctx) - 1)
                lower = lower + np.where((all_ctx[there] == ctx)[:, None], self.log_backoff[n - 1][there], 0)
            out[missing] = lower
        return out


def build(languages: list[str], tables: list[tuple[np.ndarray, np.ndarray]]) -> Model:
    """Interpolated Kneser-Ney from each language's n-grams of the highest order (rows of symbols) and their counts.

    Lower orders count the different symbols before an n-gram. Each order has one discount, n1 / (n1 + 2 n2). The
    n-grams of all languages share one table; where a language lacks one, its backed-off value is filled in.
    """
    order = tables[0][0].shape[1]
    model = Model(languages)
    alphabet = len(np.unique(np.concatenate([g[:, -1] for g, _ in tables]))) + 1
    levels: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(order)]
    for grams, counts in tables:
        now, n = grams, counts.astype(np.float64)
        for k in range(order - 1, -1, -1):
            levels[k].append((now, n))
            if k:
                now, n = np.unique(now[:, 1:], axis=0, return_counts=True)
                n = n.astype(np.float64)
    lower = np.full(len(languages), -np.log(alphabet))
    model.floor = lower
    for k in range(order):
        every = np.unique(np.concatenate([g for g, _ in levels[k]]), axis=0)
        hashes = gram_hash(list(every.T))
        order_of = np.argsort(hashes)
        every, hashes = every[order_of], hashes[order_of]
        ctx_all = np.unique(gram_hash(list(every[:, :-1].T))) if k else np.zeros(1, np.uint64)
        log_p, log_b = np.zeros((len(every), len(languages))), np.zeros((len(ctx_all), len(languages)))
        below = model.lookup(list(every[:, 1:].T)) if k else np.repeat(lower[None, :], len(every), 0)
        for j, (grams, n) in enumerate(levels[k]):
            n1, n2 = (n == 1).sum(), (n == 2).sum()
            discount = min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 else 0.5
            ctx = gram_hash(list(grams[:, :-1].T)) if k else np.zeros(len(grams), np.uint64)
            kinds, at = np.unique(ctx, return_inverse=True)
            total, kinds_after = np.bincount(at, n), np.bincount(at)
            log_b[np.searchsorted(ctx_all, kinds), j] = np.log(discount * kinds_after / total)
            mine = np.searchsorted(hashes, gram_hash(list(grams.T)))
            if k:
                there = np.minimum(np.searchsorted(ctx_all, gram_hash(list(every[:, :-1].T))), len(ctx_all) - 1)
            else:
                there = np.zeros(len(every), np.int64)
            p = np.exp(log_b[there, j] + below[:, j])
            p[mine] += np.maximum(n - discount, 0) / total[at]
            log_p[:, j] = np.log(p)
        if not k:
            model.floor = lower + log_b[0]
        model.grams.append(hashes)
        model.log_p.append(log_p.astype(np.float32))
        model.contexts.append(ctx_all)
        model.log_backoff.append(log_b.astype(np.float32))
    return model


def cross_entropies(texts: list[str], model: Model, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Negative log probability per symbol of each text by language, and the number of symbols."""
    order = len(model.grams)
    sums, sizes = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts), np.int64)
    waiting: list[tuple[int, list[np.ndarray]]] = []

    def flush() -> None:
        if waiting:
            lengths = [len(w[1][0]) for w in waiting]
            columns = [np.concatenate([w[1][i] for w in waiting]) for i in range(order)]
            each = np.add.reduceat(model.lookup(columns), np.concatenate(([0], np.cumsum(lengths)[:-1])), axis=0, dtype=np.float64)
            np.add.at(sums, [w[0] for w in waiting], each)
            waiting.clear()

    held = 0
    for i, text in enumerate(texts):
        for piece in pieces(text, letters, order):
            columns = windows(piece, order)
            if not len(columns[0]):
                continue
            sizes[i] += len(columns[0])
            waiting.append((i, columns))
            held += len(columns[0])
            if held >= PIECE // 4:
                flush()
                held = 0
    flush()
    return -sums / np.maximum(sizes, 1)[:, None], sizes


def learn(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    order: int = ORDER,
    sample_per_language: int = SAMPLE_PER_LANGUAGE,
    max_grams: int = MAX_GRAMS,
    folds: int = FOLDS,
) -> Model:
    """A model from at most `sample_per_language` whole documents of each language.

    Only documents with a language whose crc32 of the id is no multiple of `folds` teach: the first by a hash of the id.
    n-grams are counted by Spark; the driver takes at most `max_grams` of each language, the most frequent ones.
    A text is accepted as a language if its cross-entropy is at most that of nearly all documents of the sample.
    """
    first = Window.partitionBy("lang").orderBy(uniform_bits(F.coalesce(F.col("id").cast("string"), F.lit(""))), "id")
    known = docs.select(F.col(key).alias("id"), F.col(lang).alias("lang")).where(
        F.col("lang").isNotNull() & (remainder_of_id("id", folds) != 0)
    )
    picked = known.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= sample_per_language).select("id", "lang")
    texts = docs.select(F.col(key).alias("id"), F.col(lang).alias("lang"), text_or_empty(text).alias("text"))
    sample = cut_lineage(texts.join(F.broadcast(picked.distinct()), ["id", "lang"]).select("lang", "text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_table()
        for batch in batches:
            langs, bodies = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for name in dict.fromkeys(langs):
                cut = [windows(p, order) for b, l in zip(bodies, langs) if l == name for p in pieces(b, letters, order)]
                if cut:
                    rows = np.stack([np.concatenate(c) for c in zip(*cut)], axis=1)
                    grams, n = np.unique(rows, axis=0, return_counts=True)
                    columns = [pa.array([name] * len(n)), pa.array(grams.astype(np.int64).tolist(), pa.list_(pa.int64())), pa.array(n)]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "gram", "n"])

    frequent = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    grams = (
        sample.mapInArrow(count, "lang string, gram array<long>, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
        .withColumn("nth", F.row_number().over(frequent))
        .where(F.col("nth") <= max_grams)
    )
    rows = grams.select("lang", "gram", "n").toPandas()
    if not len(rows):
        return Model([])
    languages = sorted(rows.lang.unique())
    per = [rows[rows.lang == name].sort_values("gram", key=lambda g: g.map(tuple)) for name in languages]
    model = build(languages, [(np.array(p.gram.tolist(), np.uint64), p.n.to_numpy()) for p in per])
    checked = _entropies(sample.select(F.lit(0).cast("long").alias("id"), "text"), model).where("size > 0").toPandas()
    for j in range(len(languages)):
        own = checked.entropy[checked.best == j]
        model.accepted.append(float(own.quantile(ACCEPTED_QUANTILE) * ACCEPTED_MARGIN) if len(own) else np.inf)
    return model


def _entropies(rows: DataFrame, model: Model) -> DataFrame:
    """id, best (index of the language; -1 without letters), entropy, confidence, size."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_table()
        for batch in batches:
            entropy, size = cross_entropies(batch.column(1).to_pylist(), model, letters)
            best = np.argmin(entropy, axis=1)
            least = entropy[np.arange(len(best)), best]
            odds = np.exp(-np.clip((entropy - least[:, None]) * np.minimum(size, 50)[:, None], 0, 50))
            arrays = [
                batch.column(0),
                pa.array(np.where(size > 0, best, -1)),
                pa.array(least),
                pa.array(np.where(size > 0, 1 / odds.sum(axis=1), 0.0)),
                pa.array(size),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "best", "entropy", "confidence", "size"])

    return rows.mapInArrow(work, "id long, best long, entropy double, confidence double, size long")


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", folds: int = FOLDS) -> DataFrame:
    """One row per input row: key, held_out, lang_pred, score, entropy, accepted.

    The language is that of the least cross-entropy per symbol; equal ones: the first by name. The score is the best
    language's share of likelihood over at most 50 symbols. `accepted` is false where the text is less likely than
    nearly all texts that taught; a caller who wants rejection takes `und` there. Null text and text without letters:
    `und`, score 0, not accepted; null keys and repeated rows stay; empty table: no rows. Other columns are not read.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), text_or_empty(text).alias("text"))
    if not model.languages:
        none = F.lit(None).cast("double")
        found = rows.select("id", F.lit(-1).cast("long").alias("best"), none.alias("entropy"), F.lit(0.0).alias("confidence"))
    else:
        found = _entropies(rows, model)
    names, limits = F.array(*map(F.lit, [UNKNOWN, *model.languages])), F.array(*map(F.lit, [-1.0, *model.accepted]))
    at = (F.col("best") + 2).cast("int")
    return found.select(
        F.col("id").alias(key),
        (remainder_of_id("id", folds) == 0).alias("held_out"),
        F.element_at(names, at).alias("lang_pred"),
        F.col("confidence").alias("score"),
        F.when(F.col("best") >= 0, F.col("entropy")).alias("entropy"),
        F.coalesce(F.col("entropy") <= F.element_at(limits, at), F.lit(False)).alias("accepted"),
    )
