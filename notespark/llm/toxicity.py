"""Toxicity: a lexicon trie intersected with Levenshtein automata, and the context of each term found."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notespark.llm.common import first_by_hash, remainder_of_id, text_or_empty
from notespark.session import cut_lineage

SAMPLE_PER_CLASS = 4000
MAX_TERMS = 300
LEAST_DOCS = 5
LEAST_LOG_ODDS = 2.0
LEAST_CHARS = 1
STEM_CHARS = (4, 5, 6, 7, 8)
FUZZY_FROM_CHARS = 5
CONTEXT_WORDS = 6
FOLDS = 5
CACHED = 300_000

TOKEN = re.compile(r"[^\W_]+")
QUOTES = "\"'`“”„‟«»‹›‘’"
# Words near a term that report it, and words that address somebody.
REPORTING = frozenset(
    "said says say called calls word words term quote quoted quotes wrote writes sagte nannte wort zitat schrieb "
    "dijo llamó palabra cita escribió dit appelé mot citation écrit".split()
)
ADDRESSING = frozenset("you your youre u du dich dir dein deine ihr euch tú te ti tu usted ustedes vous toi ton ta tes".split())

PLAIN, REPORTED, ADDRESSED = range(3)


class Lexicon:
    """A trie of terms. A term that ends in * is a stem: it matches every word that starts with it.

    `find` runs the word through the product of the trie with the Levenshtein automaton of one edit. A state holds
    the trie's nodes that are reachable and the edits that each took; transitions are worked out once and kept.
    """

    def __init__(self, terms: dict[str, float], fuzzy_from: int = FUZZY_FROM_CHARS) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.whole: dict[int, tuple[float, int]] = {}  # node: weight, edits allowed
        self.stem: dict[int, tuple[float, int]] = {}
        for term, weight in sorted(terms.items()):
            letters, node = term.removesuffix("*"), 0
            for c in letters:
                node = self.children[node].setdefault(c, len(self.children))
                if node == len(self.children):
                    self.children.append({})
            (self.stem if term.endswith("*") else self.whole)[node] = (weight, int(len(letters) >= fuzzy_from))
        self.states: dict[frozenset, dict] = {}
        self.cache: dict[str, tuple[float, bool] | None] = {}
        self.start = self._state({0: 0})

    def _state(self, reached: dict[int, int]) -> dict:
        for node, edits in list(reached.items()):  # a letter of the term left out
            if edits == 0:
                for child in self.children[node].values():
                    reached[child] = min(reached.get(child, 1), 1)
        key = frozenset(reached.items())
        state = self.states.get(key)
        if state is None:
            state = self.states[key] = {
                None: reached,
                "whole": self._best(self.whole, reached),
                "stem": self._best(self.stem, reached),
            }
        return state

    @staticmethod
    def _best(ends: dict[int, tuple[float, int]], reached: dict[int, int]) -> tuple[float, bool] | None:
        hits = [(edits == 0, ends[node][0]) for node, edits in reached.items() if node in ends and edits <= ends[node][1]]
        if not hits:
            return None
        exact, weight = max(hits)
        return weight, exact

    def _step(self, state: dict, c: str) -> dict:
        after: dict[int, int] = {}
        for node, edits in state[None].items():
            for letter, child in self.children[node].items():
                cost = edits + (letter != c)
                if cost <= 1:
                    after[child] = min(after.get(child, cost), cost)
            if edits == 0:  # a letter too many
                after[node] = min(after.get(node, 1), 1)
        return self._state(after)

    def find(self, word: str) -> tuple[float, bool] | None:
        """Weight of the best term, exact ones first, and whether it is exact; None without a term."""
        if len(self.states) > CACHED:
            self.states = {}
            self.start = self._state({0: 0})
        state, best = self.start, None
        for c in word:
            after = state.get(c)
            if after is None:
                after = state[c] = self._step(state, c)
            state = after
            if not state[None]:
                break
            stem = state["stem"]
            if stem and (best is None or (stem[1], stem[0]) > (best[1], best[0])):
                best = stem
        else:
            whole = state["whole"]
            if whole and (best is None or (whole[1], whole[0]) > (best[1], best[0])):
                best = whole
        return best

    def __getitem__(self, word: str) -> tuple[float, bool] | None:
        try:
            return self.cache[word]
        except KeyError:
            if len(self.cache) > CACHED:
                self.cache.clear()
            found = self.cache[word] = self.find(word)
            return found


def context(text: str, spans: list[tuple[int, int]], words: list[str], i: int, around: int = CONTEXT_WORDS) -> int:
    """Whether the i-th word is quoted or reported, addressed to somebody, or plain."""
    first, last = max(0, i - around), min(len(words), i + around + 1)
    left, right = text[spans[first][0] : spans[i][0]], text[spans[i][1] : spans[last - 1][1] + 1]
    near = words[first:last]
    opened = any(q in left for q in QUOTES) and any(q in right for q in QUOTES)
    if opened or any(w in REPORTING for w in near):
        return REPORTED
    return ADDRESSED if any(w in ADDRESSING for w in near) else PLAIN


def features(text: str, lexicon: Lexicon) -> list[float]:
    """Terms by exactness and context (logarithms of counts), weights of exact and inexact ones, rate, length."""
    low = text.lower()
    words = TOKEN.findall(low)
    hits = [(i, hit) for i, w in enumerate(words) if (hit := lexicon[w])]
    counts, weights = np.zeros(6), [0.0, 0.0]
    if hits:
        spans = [m.span() for m in TOKEN.finditer(low)]
        for i, (weight, exact) in hits:
            counts[3 * (not exact) + context(low, spans, words, i)] += 1
            weights[not exact] = max(weights[not exact], weight)
    rate = len(hits) / (len(words) + 10)
    return [1.0, *np.log1p(counts).tolist(), *weights, rate * 10, float(np.log1p(len(words)) / 10)]


@dataclass(frozen=True)
class Model:
    terms: dict[str, float]
    weights: list[float]

    def score(self, x: list[float]) -> float:
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.weights, x), -30, 30))))


def fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weighted logistic regression by Newton's method."""
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (p - y)) + ridge * beta
        hess = (x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(hess, grad)
        beta -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return beta


def _terms(sample: DataFrame, counts: dict[int, int], max_terms: int, least_chars: int = LEAST_CHARS) -> dict[str, float]:
    """Words and stems that toxic documents of the sample have far more often than others, with their log odds."""
    words = sample.select(
        "toxic", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), 1)).alias("words")
    )
    def stems(n: int):
        long = F.filter("words", lambda w: F.length(w) > n)
        return F.array_distinct(F.transform(long, lambda w: F.concat(F.substring(w, 1, n), F.lit("*"))))

    named = words.select("toxic", F.explode(F.flatten(F.array("words", *[stems(n) for n in STEM_CHARS]))).alias("term"))
    toxic, clean = (F.sum((F.col("toxic") == k).cast("long")) for k in (1, 0))
    odds = F.ln((F.col("t") + 0.5) / (counts[1] + 1.0)) - F.ln((F.col("c") + 0.5) / (counts[0] + 1.0))
    best = (
        named.where(F.length("term") >= least_chars)
        .groupBy("term")
        .agg(toxic.alias("t"), clean.alias("c"))
        .where(F.col("t") >= LEAST_DOCS)
        .withColumn("odds", odds)
        .where(F.col("odds") >= LEAST_LOG_ODDS)
        .orderBy(F.desc(F.col("odds") * F.sqrt("t")), "term")
        .limit(max_terms)
    )
    found = best.collect()
    whole = [(r.term, r.t) for r in found if not r.term.endswith("*")]
    # A stem says more than a word only if several words share it.
    return {
        r.term: float(r.odds)
        for r in found
        if not r.term.endswith("*") or not any(w.startswith(r.term[:-1]) and t > 0.7 * r.t for w, t in whole)
    }


def _sample(docs: DataFrame, labels: DataFrame, key: str, text: str, per_class: int, folds: int) -> tuple[DataFrame, dict[int, int]]:
    known = (
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .where(remainder_of_id("doc_id", folds) != 0)
    )
    sizes = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    picks = [first_by_hash(known.where(F.col("toxic") == k), F.col("doc_id"), per_class, "doc_id") for k in (0, 1)]
    picked = picks[0].unionByName(picks[1]).select(F.col("doc_id").alias("id"), "toxic")
    texts = docs.select(F.col(key).alias("id"), text_or_empty(text).alias("text"))
    return texts.join(F.broadcast(picked), "id"), sizes


def learn(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    sample_per_class: int = SAMPLE_PER_CLASS,
    max_terms: int = MAX_TERMS,
    folds: int = FOLDS,
    least_chars: int = LEAST_CHARS,
) -> Model:
    """Terms and weights from at most `sample_per_class` labelled documents of each class.

    Only documents whose crc32 of the id is no multiple of `folds` teach; the sample is the first of them by a hash of
    the id, and rows are weighted back to the sizes of the classes. Null labels and ids teach nothing; a document
    labelled twice counts as toxic if one label says so. Whole words of `least_chars` characters or more may be terms,
    those under FUZZY_FROM_CHARS in exactly that spelling; stems have STEM_CHARS. Without documents of both classes the score is constant.
    """
    sample, sizes = _sample(docs, labels, key, text, sample_per_class, folds)
    sample = cut_lineage(sample.select("id", "text", "toxic"))
    counts = {0: 0, 1: 0} | {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not counts[0] or not counts[1]:
        return Model({}, [-5.0 if not counts[1] else 5.0] + [0.0] * 10)
    terms = _terms(sample, counts, max_terms, least_chars)
    rows = _features(sample.select("id", "text"), terms).join(sample.select("id", "toxic").distinct(), "id").collect()
    x, y = np.array([r.x for r in rows]), np.array([float(r.toxic) for r in rows])
    w = np.where(y == 1, sizes.get(1, 1) / counts[1], sizes.get(0, 1) / counts[0])
    return Model(terms, fit(x, y, w * len(w) / w.sum()).tolist())


def _features(rows: DataFrame, terms: dict[str, float]) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(terms)
        for batch in batches:
            x = [features(t.as_py(), lexicon) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["id", "x"])

    return rows.mapInArrow(work, "id long, x array<double>")


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", folds: int = FOLDS) -> DataFrame:
    """One row per input row: key, held_out, score, predicted, n_terms, n_reported.

    Rows are scored on their own, over their whole text. Null or empty text: the score of a text without terms; null
    keys and repeated rows stay; empty table: no rows. Other columns are not read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(model.terms)
        for batch in batches:
            x = [features(t.as_py(), lexicon) for t in batch.column(1)]
            counts = [np.rint(np.expm1(v[1:7])) for v in x]
            arrays = [
                batch.column(0),
                pa.array([model.score(v) for v in x], pa.float64()),
                pa.array([int(c.sum()) for c in counts], pa.int64()),
                pa.array([int(c[REPORTED] + c[3 + REPORTED]) for c in counts], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "score", "n_terms", "n_reported"])

    rows = docs.select(F.col(key).cast("long").alias("id"), text_or_empty(text).alias("text"))
    found = rows.mapInArrow(work, "id long, score double, n_terms long, n_reported long")
    return found.select(
        F.col("id").alias(key),
        (remainder_of_id("id", folds) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "n_terms",
        "n_reported",
    )


def keep_clean(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that the model doesn't call toxic, with all their columns."""
    names = docs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, at = Lexicon(model.terms), [n.lower() for n in names].index(text.lower())
        for batch in batches:
            clean = [model.score(features(t.as_py() or "", lexicon)) < 0.5 for t in batch.column(at)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(work, docs.schema)
