"""Benchmark decontamination by latent semantic retrieval, then longest common subsequence and answer checks."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notespark.llm.common import text_or_empty
from notespark.session import cut_lineage

RANK = 192
OVERSAMPLED = 10
POWER_ROUNDS = 3
STRIDE = 16
WINDOW = 2  # strides
MIN_COSINE = 0.45
LEAST_IDF = 0.01
MIN_LCS = 0.8
MIN_LCS_WITH_ANSWER = 0.6
MIN_ANSWER = 0.9
MIN_ANSWER_WORDS = 3
PASSAGE_WORDS = 64
BLOCK_ITEMS = 200
BLOCKS_AT_ONCE = 16
SLICE_CHARS = 1 << 20
GROUP_WORDS = 1 << 16

_PUNCTUATION = bytes(i if i > 127 or chr(i).isalnum() else 32 for i in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-case words without ASCII punctuation."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_PUNCTUATION).split()


def lcs(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence, a row of the table in the bits of one number."""
    where: dict[bytes, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full, row = (1 << len(a)) - 1, (1 << len(a)) - 1
    for w in b:
        hit = row & where.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def answer_of(text: str) -> str:
    """The last sentence, where a benchmark names no answer."""
    parts = [p for p in re.split(r"[.!?\n]+", text) if p.strip()]
    return parts[-1] if parts else ""


def passages(words: list[bytes]) -> list[list[bytes]]:
    """The words in even passages of at most PASSAGE_WORDS, so that a window of a document can hold much of one."""
    n = math.ceil(len(words) / PASSAGE_WORDS)
    return [words[len(words) * i // n : len(words) * (i + 1) // n] for i in range(n)]


def slices(text: str, size: int, overlap: int) -> Iterator[str]:
    """The text in slices of about `size` characters that share `overlap` characters, so that memory is bounded."""
    for at in range(0, max(1, len(text) - overlap), size):
        yield text[at : at + size + overlap] if len(text) > size + overlap else text
        if len(text) <= size + overlap:
            return


@dataclass
class Index:
    """A block of passages of benchmark items in the latent space of the TF-IDF passages."""

    owners: np.ndarray  # number of each passage's item
    vocabulary: dict[bytes, int]
    idf: np.ndarray | None = None
    terms: np.ndarray | None = None  # terms x rank: idf times right singular vectors
    vectors: np.ndarray | None = None  # rank x passages, of length one

    def strides(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each stretch of STRIDE words the sum of their term vectors, and of their squared idf.

        ids: number of each word in the vocabulary, or -1.
        """
        count = math.ceil(len(ids) / STRIDE)
        sums, energy = np.zeros((count, self.terms.shape[1]), np.float32), np.zeros(count, np.float32)
        at = np.nonzero(ids >= 0)[0]
        if len(at):
            stretch, known = at // STRIDE, ids[at]
            first = np.concatenate(([0], np.nonzero(np.diff(stretch))[0] + 1))
            sums[stretch[first]] = np.add.reduceat(self.terms[known], first, axis=0)
            energy[stretch[first]] = np.add.reduceat(self.idf[known] ** 2, first)
        return sums, energy


def document_frequencies(docs: DataFrame, vocabulary: dict[bytes, int], text: str) -> np.ndarray:
    """In how many documents each word of the vocabulary occurs; the last entry is the number of documents."""
    size = len(vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size + 1, np.int64)
        known = vocabulary.keys()
        for batch in batches:
            for body in batch.column(0):
                found: set[bytes] = set()
                for part in slices(body.as_py(), SLICE_CHARS, 0):
                    found |= known & set(words_of(part))
                counts[[vocabulary[w] for w in found]] += 1
                counts[size] += 1
        at = np.nonzero(counts)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["term", "n"])

    partial = docs.select(text_or_empty(text).alias("text")).mapInArrow(work, "term long, n long")
    out = np.zeros(size + 1, np.int64)
    for row in partial.groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[row.term] = row.n
    return out


def _gram_product(rows: DataFrame, basis: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """A'A times basis, A being the TF-IDF passages in rows: each task multiplies its own, sums go by term."""
    terms, rank = basis.shape

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((terms, rank))
        for batch in batches:
            for ids in batch.column(0):
                term, tf = np.unique(ids.values.to_numpy(), return_counts=True)
                x = tf * idf[term]
                x /= np.linalg.norm(x)
                out[term] += x[:, None] * (x @ basis[term])[None, :]
        at = np.nonzero(np.any(out != 0, axis=1))[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at].tolist(), pa.list_(pa.float64()))], ["term", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for term, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[term] = sums.get(term, 0) + v.values.to_numpy()
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["term", "v"]
            )

    schema = "term long, v array<double>"
    total = rows.mapInArrow(multiply, schema).repartition("term").mapInArrow(add, schema)
    out = np.zeros((terms, rank))
    for row in total.collect():
        out[row.term] = row.v
    return out


def right_vectors(rows: DataFrame, idf: np.ndarray, rank: int, power_rounds: int = POWER_ROUNDS, seed: int = 0) -> np.ndarray:
    """The leading right singular vectors of the passages (rows: ids array<long>), by randomised subspace iteration."""
    wide = min(len(idf), rank + OVERSAMPLED)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(idf), wide)))[0]
    for _ in range(power_rounds):
        basis = np.linalg.qr(_gram_product(rows, basis, idf))[0]
    image = basis.T @ _gram_product(rows, basis, idf)
    values, turn = np.linalg.eigh((image + image.T) / 2)
    return basis @ turn[:, np.argsort(values)[::-1][:rank]]


def build(spark: SparkSession, parts: list[tuple[int, list[bytes]]], frequency: dict[bytes, int], n_docs: int, rank: int) -> Index:
    """Index of a block of passages (number of the item, words). The decomposition is theirs, weighed by the whole corpus."""
    vocabulary = {w: i for i, w in enumerate(sorted({w for _, p in parts for w in p}))}
    index = Index(np.array([i for i, _ in parts]), vocabulary)
    n = np.array([frequency.get(w, 0) for w in vocabulary])
    index.idf = (np.log((n_docs + 1) / (n + 1)) + LEAST_IDF).astype(np.float32)
    numbers = [[vocabulary[w] for w in p] for _, p in parts]
    rows = cut_lineage(spark.createDataFrame([(i,) for i in numbers], "ids array<long>").repartition(4))
    index.terms = (index.idf[:, None] * right_vectors(rows, index.idf, rank)).astype(np.float32)
    made = np.stack([index.terms[i].sum(axis=0) for i in numbers])
    index.vectors = (made / np.maximum(np.linalg.norm(made, axis=1), 1e-9)[:, None]).T.astype(np.float32).copy()
    return index


def candidates(found: list[bytes], index: Index, min_cosine: float) -> list[tuple[int, int]]:
    """(item, first word) of every passage that an item is near enough to, in order; found: the words of a text.

    The cosine is that of the item's latent vector with the passage's TF-IDF vector in full, over the vocabulary, so
    that a passage of which little lies in the latent space is near to nothing.
    """
    near: set[tuple[int, int]] = set()
    get, step = index.vocabulary.get, GROUP_WORDS - GROUP_WORDS % STRIDE
    for at in range(0, len(found), step):
        ids = np.array([get(w, -1) for w in found[at : at + step + STRIDE * (WINDOW - 1)]], np.int64)
        sums, energy = index.strides(ids)
        places = max(1, len(sums) - WINDOW + 1)
        sums = sum(sums[i : i + places] for i in range(1, min(WINDOW, len(sums)))) + sums[:places]
        energy = sum(energy[i : i + places] for i in range(1, min(WINDOW, len(energy)))) + energy[:places]
        sums /= np.sqrt(np.maximum(energy, 1e-9))[:, None]
        cosine = sums @ index.vectors
        place, part = np.nonzero(cosine >= min_cosine)
        near.update(zip(index.owners[part].tolist(), (at + place * STRIDE).tolist()))
    return sorted(near)


def regions(near: list[tuple[int, int]], items: list[list[bytes]]) -> Iterator[tuple[int, int, int]]:
    """(item, first word, last passage's first word): passages within a quarter of the item's words are one region."""
    at = 0
    while at < len(near):
        item, first = near[at]
        upto = at + 1
        while upto < len(near) and near[upto][0] == item and near[upto][1] - first <= len(items[item]) // 4:
            upto += 1
        yield item, first, near[upto - 1][1]
        at = upto


def check(found: list[bytes], first: int, last: int, item: list[bytes], answer: list[bytes], least: float) -> tuple[float, bool]:
    """Share of the item's words in its longest common subsequence with the region, and whether the answer is there.

    Where even the words in common are fewer than `least` of the item's, the subsequence needn't be looked for.
    """
    region = found[max(0, first - len(item)) : last + STRIDE * WINDOW + len(item)]
    there = set(region)
    if sum(w in there for w in item) < least * len(item):
        return 0.0, False
    share = lcs(item, region) / max(1, len(item))
    return share, len(answer) >= MIN_ANSWER_WORDS and lcs(answer, region) >= MIN_ANSWER * len(answer)


SCHEMA = "id long, item_id long, lcs double, answer_found boolean"


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    rank: int = RANK,
    min_cosine: float = MIN_COSINE,
    min_lcs: float = MIN_LCS,
    min_lcs_with_answer: float = MIN_LCS_WITH_ANSWER,
    block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """One row per document and benchmark item found in it: key, item_id, lcs, answer_found.

    The benchmark is the stated query set. Items of over PASSAGE_WORDS words are cut into passages, and near to any of
    them is near to the item. It is taken in blocks of about `block_items` passages by a hash of the item, so that a
    latent space of `rank` dimensions tells the passages of a block apart; up to BLOCKS_AT_ONCE blocks share a pass over
    the documents, and more take further passes. The terms are the words of the items; how many documents have each is
    counted over all documents. Every passage of every document (32 words, 16 apart) is projected; for every item with
    a cosine of at least `min_cosine` each such passage and its surroundings are compared word by word: it is a leak
    with a common subsequence of `min_lcs` of the item's words, or of `min_lcs_with_answer` if the answer (column
    `answer`, else the last sentence) is there too.

    Null and empty texts leak nothing; null items and items without words are found nowhere; null ids, repeated rows
    and repeated items stay as they are; an empty table on either side gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    known = benchmark.select(F.col("item_id").cast("long"), F.col("text"), answer.alias("answer"))
    known = known.where(F.col("text").isNotNull() & (F.trim("text") != ""))
    about = F.ceil(F.size(F.split(F.trim("text"), r"\s+")) / F.lit(PASSAGE_WORDS))
    blocks = math.ceil((known.agg(F.sum(about)).first()[0] or 0) / block_items)
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, blocks)))
    out = spark.createDataFrame([], SCHEMA)
    for b in range(0, blocks, BLOCKS_AT_ONCE):
        # A bounded number of items, whatever the size of the benchmark.
        some = known.withColumn("block", block).where(F.col("block").between(b, b + BLOCKS_AT_ONCE - 1))
        items = [r for r in some.orderBy("block", "item_id", "text").collect() if words_of(r.text)]
        if items:
            terms = sorted({w for r in items for w in words_of(r.text)})
            counts = document_frequencies(docs, {w: i for i, w in enumerate(terms)}, text)
            frequency = dict(zip(terms, counts[:-1].tolist()))
            bodies = [words_of(r.text) for r in items]
            indexes = []
            for k in sorted({r.block for r in items}):
                parts = [(i, p) for i, r in enumerate(items) if r.block == k for p in passages(bodies[i])]
                n = max(1, round(len(parts) / block_items))  # over 1 where long items share a block
                cuts = [len(parts) * j // n for j in range(n + 1)]
                indexes += [build(spark, parts[i:j], frequency, int(counts[-1]), rank) for i, j in zip(cuts, cuts[1:])]
            answers = [words_of(r.answer if r.answer is not None else answer_of(r.text)) for r in items]
            held = ([r.item_id for r in items], bodies, answers, [vars(i) for i in indexes])
            out = out.unionByName(_search(docs, held, key, text, min_cosine, min_lcs, min_lcs_with_answer))
    return out.withColumnRenamed("id", key)


def _search(docs: DataFrame, some: tuple, key: str, text: str, min_cosine: float, min_lcs: float, with_answer: float) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(some)  # a bounded number of passages
    overlap = 2 * max(sum(len(w) + 1 for w in i) for i in some[1]) + 16 * STRIDE * WINDOW

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item_ids, items, answers, made = held.value
        indexes = [Index(**i) for i in made]
        least = min(min_lcs, with_answer)
        for batch in batches:
            rows = []
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                best: dict[int, tuple[float, bool]] = {}
                for part in slices(body.as_py(), SLICE_CHARS, overlap):
                    found = words_of(part)
                    for index in indexes:
                        for item, first, last in regions(candidates(found, index, min_cosine), items):
                            if best.get(item) == (1.0, True):
                                continue
                            share, there = check(found, first, last, items[item], answers[item], least)
                            if share >= min_lcs or there and share >= with_answer:
                                best[item] = max(best.get(item, (0.0, False)), (share, there))
                rows += [(doc, item_ids[i], share, there) for i, (share, there) in best.items()]
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(NAMES, r)) for r in rows], schema=TYPES)

    rows = docs.select(F.col(key).cast("long").alias("id"), text_or_empty(text).alias("text"))
    return rows.mapInArrow(work, SCHEMA)


NAMES = [f.split()[0] for f in SCHEMA.split(", ")]
TYPES = pa.schema(list(zip(NAMES, [pa.int64(), pa.int64(), pa.float64(), pa.bool_()])))


def without_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents in which no benchmark item was found; documents with a null id are judged by their own rows' text."""
    found = leaks(docs, benchmark, key, text, **options).select(F.col(key).alias("__leaking")).distinct()
    return docs.join(found, F.col(key).eqNullSafe(F.col("__leaking")), "left_anti")
