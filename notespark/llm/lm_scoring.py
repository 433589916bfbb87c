"""Language-model scoring by logistic mixing of hashed-context bit predictors, beside a unigram base."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notespark.llm.common import remainder_of_id, text_or_empty
from notespark.session import cut_lineage

ORDERS = (1, 2, 3, 4)
TABLE_BITS = (16, 18, 20, 22)
BLOCK_SLOTS = 1 << 16
MERGERS = 64  # the tables have some 170 blocks, whatever the input
FOLDS, HELD_OUT = 7, 2
FIRST_STEPS = 5
STEP_BITS = 1 << 14
RIDGE = 50.0  # bits that speak for the weights of Mixer.fresh()
ROUND_BYTES = 256
GROUP_BYTES = 1 << 20
FITTED_BYTES = 1 << 16, 1 << 21
SIDE_BY_SIDE = 32  # arrays of a round of so many texts stay near a core's cache
RATE = 0.01
PRIOR = 0.4
HEAD_WORDS = 100_000
COUNTED_WORDS = 300_000
EMITTED_ROWS = 100_000
CUT_BYTES = 1 << 22  # texts whose words are held at once
END = 256  # the symbol after the last byte
GATES = len(ORDERS) + 1
LEAST = np.float32(1e-6)  # the least probability of a bit
MAP_CELLS = 48
CELLS_PER_NAT = 3
TOP = MAP_CELLS / 2 / CELLS_PER_NAT - 1e-3  # the largest log odds
TOP32 = np.float32(TOP)


# --- the code: each symbol is a path through a Huffman tree, each node of which is a binary prediction ----------------


@dataclass
class Code:
    """Paths of all symbols, one after the other: nodes and bits, and each symbol's first entry and length."""

    first: np.ndarray
    length: np.ndarray
    nodes: np.ndarray
    bits: np.ndarray


def huffman(counts: np.ndarray) -> Code:
    """A tree in which every symbol has a leaf; a count of one is added to each."""
    heap = [(int(n) + 1, s, s) for s, n in enumerate(counts)]
    heapq.heapify(heap)
    parent: dict[int, tuple[int, int]] = {}
    made = len(counts)
    while len(heap) > 1:
        (n, _, a), (m, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        parent[a], parent[b] = (made, 0), (made, 1)
        heapq.heappush(heap, (n + m, made, made))
        made += 1
    paths = []
    for s in range(len(counts)):
        path = []
        while s in parent:
            s, bit = parent[s]
            path.append((s - len(counts), bit))
        paths.append(path[::-1])
    length = np.array([len(p) for p in paths])
    flat = np.array([e for p in paths for e in p])
    return Code(np.cumsum(length) - length, length, flat[:, 0].astype(np.uint32), flat[:, 1].astype(np.uint8))


def symbols(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return np.append(data.astype(np.uint16), np.uint16(END))


def grams(syms: np.ndarray) -> np.ndarray:
    """For each place its symbol with those before it, as one number; places before the text count as END."""
    longest = max(ORDERS)
    padded = np.full(longest + len(syms), END, np.uint64)
    padded[longest:] = syms
    out = padded[: len(syms)].copy()
    for at in range(1, longest + 1):
        out *= np.uint64(END + 1)
        out += padded[at : at + len(syms)]
    return out


def expand(syms: np.ndarray, code: Code) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every bit: the place of its symbol, the node and the bit."""
    length = code.length[syms]
    place = np.repeat(np.arange(len(syms)), length)
    ends = np.cumsum(length)
    entry = np.arange(len(place)) + np.repeat(code.first[syms] - (ends - length), length)
    return place, code.nodes[entry], code.bits[entry]


def slots(some: np.ndarray, code: Code) -> tuple[np.ndarray, np.ndarray, Iterator[np.ndarray]]:
    """For the bits of different grams: place of the gram, the bit, and order by order the slot of context and node."""
    place, nodes, bits = expand((some % np.uint64(END + 1)).astype(np.int64), code)

    def each() -> Iterator[np.ndarray]:
        hashed = (nodes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
        for order, width in zip(ORDERS, TABLE_BITS):
            context = some // np.uint64(END + 1) % np.uint64((END + 1) ** order)
            context = (context + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (context ^ (context >> np.uint64(31)))[place]
            mixed ^= hashed
            mixed *= np.uint64(0xD6E8FEB86659FD93)
            mixed >>= np.uint64(64 - width)
            yield mixed.view(np.int64)

    return place, bits, each()


# --- learning: how often each slot was followed by 0 and by 1 -----------------------------------------------------


def count_slots(texts: Iterator[str], code: Code) -> list[np.ndarray]:
    """Counts by slot and bit (slot * 2 + bit) for each order. Equal grams are counted before they are looked up."""
    totals = [np.zeros(2 << bits, np.uint32) for bits in TABLE_BITS]
    held: list[np.ndarray] = []
    size = 0

    def flush() -> None:
        if held:
            some, many = np.unique(np.concatenate(held), return_counts=True)
            place, bits, at = slots(some, code)
            many = many.astype(np.uint32)[place]
            for total, slot in zip(totals, at):
                np.add.at(total, slot * 2 + bits, many)
            held.clear()

    for text in texts:
        for piece in _pieces(symbols(text)):
            held.append(grams(piece))
            size += len(piece)
            if size >= GROUP_BYTES:
                flush()
                size = 0
    flush()
    return totals


def _pieces(syms: np.ndarray) -> Iterator[np.ndarray]:
    for at in range(0, len(syms), 1 << 20):
        yield syms[at : at + (1 << 20)]


def learn_counts(docs: DataFrame, code: Code) -> list[np.ndarray]:
    """Counts over all texts given. Tasks send what they have counted by block of slots; blocks are summed by Spark.

    The driver gets the summed tables, whose size is fixed by TABLE_BITS.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = count_slots((t.as_py() for b in batches for t in b.column(0)), code)
        for k, total in enumerate(totals):
            for block in range(0, len(total), BLOCK_SLOTS):
                part = total[block : block + BLOCK_SLOTS]
                at = np.nonzero(part)[0]
                if len(at):
                    cells = [[k], [block], [at.astype(np.uint16).tobytes()], [part[at].tobytes()]]
                    types = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types)], ["k", "block", "at", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for k, block, at, n in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if (k, block) not in sums:
                    sums[k, block] = np.zeros(min(BLOCK_SLOTS, 2 << TABLE_BITS[k]), np.int64)
                sums[k, block][np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.uint32)
        for (k, block), total in sums.items():
            cells = [[k], [block], [np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()]]
            types = [pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types)], ["k", "block", "n"])

    counted = docs.mapInArrow(count, "k int, block long, at binary, n binary").repartition(MERGERS, "k", "block")
    tables = [np.zeros(2 << bits, np.uint32) for bits in TABLE_BITS]
    for row in counted.mapInArrow(add, "k int, block long, n binary").toLocalIterator():
        got = np.frombuffer(row.n, np.uint32)
        tables[row.k][row.block : row.block + len(got)] = got
    return tables


def stretched(counts: np.ndarray) -> np.ndarray:
    """Log odds of each slot; exactly 0 only where nothing was counted."""
    zeros, ones = counts[0::2].astype(np.float32), counts[1::2].astype(np.float32)
    odds = np.log((ones + np.float32(PRIOR)) / (zeros + np.float32(PRIOR)))
    return np.where((odds == 0) & (ones > 0), np.float32(1e-6), odds).astype(np.float32)


# --- mixing -------------------------------------------------------------------------------------------------------


@dataclass
class Mixer:
    """Weights of the predictors and bias for each gate, and the refining map, as documents start with them."""

    weights: np.ndarray
    bias: np.ndarray
    refine: np.ndarray

    @staticmethod
    def fresh() -> Mixer:
        odds = (np.arange(MAP_CELLS) - MAP_CELLS / 2 + 0.5) / CELLS_PER_NAT
        return Mixer(np.full((GATES, len(ORDERS)), 0.3), np.zeros(GATES), 1 / (1 + np.exp(-odds)))


def different(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys, and for each key which of them it is; some may come up twice.

    Each key's hash names a place that holds one key with that hash; a key that isn't the one held there stands alone.
    """
    place = (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - 20)).astype(np.int64)
    each = np.arange(len(keys))
    held = np.empty(1 << 20, np.int32)
    held[place] = each
    first = held.take(place).astype(np.int64)
    first = np.where(keys.take(first) == keys, first, each)
    own = np.flatnonzero(first == each)
    number = np.empty(len(keys), np.int64)
    number[own] = each[: len(own)]
    return keys.take(own), number.take(first)


ROW = 8  # columns of a bit's row: predictors, bias and three more
BIAS = len(ORDERS)
ODD = 1 << 16  # more than any path has bits


def bit_rows(some: np.ndarray, code: Code, tables: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A row for each bit of different grams, and for each gram how many bits it has, plus ODD if any has an unknown context.

    A row holds what the predictors say and a one for the bias, all with the sign of the bit (so their weighted sum are
    log odds of the bit that came), the number of predictors that don't know their context, the sign times CELLS_PER_NAT,
    and where the bit's half of a refining map begins.
    """
    place, bits, at = slots(some, code)
    sign = bits.astype(np.float32) * 2 - 1
    rows, known = np.empty((len(place), ROW), np.float32), np.zeros(len(place), np.uint8)
    for k, (table, slot) in enumerate(zip(tables, at)):
        said = table.take(slot)
        known += said != 0
        np.multiply(said, sign, out=rows[:, k])
    rows[:, BIAS] = sign
    rows[:, BIAS + 1] = len(ORDERS) - known
    rows[:, BIAS + 2] = sign * CELLS_PER_NAT
    rows[:, BIAS + 3] = bits * np.float32(MAP_CELLS)
    odd = np.bincount(place, known < len(ORDERS), len(some)) > 0
    return rows, np.bincount(place, minlength=len(some)) + odd * ODD


def mix(docs: list[np.ndarray], code: Code, tables: list[np.ndarray], start: Mixer, rate: float = RATE) -> tuple[np.ndarray, Mixer]:
    """Nats that each text costs, and the mean of what the mixers have become.

    The number of predictors that know their context gates which weights combine them. A text's bits are predicted in
    rounds of ROUND_BYTES; after each, its weights and its refining map follow the errors made, so only what came
    before in the text changes a prediction. Predictors are asked once for each different gram of the group.
    """
    some, which = different(np.concatenate([grams(d) for d in docs]))
    rows, length = bit_rows(some, code, tables)
    many = length % ODD
    begin = np.cumsum(many) - many
    sizes = np.array([len(d) for d in docs])
    starts, by_size = np.cumsum(sizes) - sizes, np.argsort(sizes, kind="stable")
    costs, ends = np.zeros(len(docs)), []
    for at in range(0, len(docs), SIDE_BY_SIDE):
        part = by_size[at : at + SIDE_BY_SIDE]
        costs[part], end = _mix_share(starts[part], sizes[part], which, begin, length, rows, start, rate)
        ends.append(end)
    mean = [sum(e[k] for e in ends) / len(docs) for k in range(3)]
    return costs, Mixer(*mean)


def _mix_share(
    starts: np.ndarray, sizes: np.ndarray, which: np.ndarray, begin: np.ndarray, length: np.ndarray, rows: np.ndarray, start: Mixer, rate: float
) -> tuple[np.ndarray, list[np.ndarray]]:
    """Nats of some texts of a group, shorter ones first, and sums of what their mixers have become. For each text where
    its symbols begin and how many they are; for each symbol its gram; for each gram where its rows begin and its length."""
    n = len(sizes)
    all_weights, all_maps, cost = np.zeros((n, GATES, ROW), np.float32), np.tile(start.refine, (n, 1)), np.zeros(n)
    all_weights[:, :, :BIAS], all_weights[:, :, BIAS] = start.weights, start.bias
    for done in range(0, int(sizes[-1]), ROUND_BYTES):
        over = int(np.searchsorted(sizes, done, "right"))
        weights, maps = all_weights[over:], all_maps[over:]
        alive, taken = n - over, np.minimum(sizes[over:] - done, ROUND_BYTES)
        firsts = (starts[over:] + done).tolist()
        grams_ = np.concatenate([which[a : a + b] for a, b in zip(firsts, taken.tolist())])
        marked = length.take(grams_)
        lens = marked % ODD
        ends = np.cumsum(lens)
        entry = np.repeat(begin.take(grams_) - ends + lens, lens)
        entry += np.arange(len(entry))
        x = rows.take(entry, axis=0)
        last = ends.take(np.cumsum(taken) - 1)
        bits = np.diff(last, prepend=0)
        stretches = list(zip((last - bits).tolist(), last.tolist()))
        # Nearly all bits have the last gate, all predictors knowing their context; the others are seen to one by one.
        z = np.empty(len(x), np.float32)
        for own, (a, b) in zip(weights[:, -1], stretches):
            np.dot(x[a:b], own, out=z[a:b])
        rest = np.flatnonzero(marked >= ODD)
        few = lens[rest]
        upto = np.cumsum(few)
        rest = np.repeat(ends[rest] - upto, few) + np.arange(upto[-1] if len(upto) else 0)
        rest = rest[x[:, BIAS + 1].take(rest) > 0]
        odd, others = x.take(rest, axis=0), np.diff(np.searchsorted(rest, last), prepend=0)
        cell = np.repeat(np.arange(1, alive + 1) * GATES - 1, others) - odd[:, BIAS + 1].astype(np.int64)
        z[rest] = np.einsum("ij,ij->i", odd, weights.reshape(-1, ROW).take(cell, axis=0))
        np.minimum(z, TOP32, out=z)
        np.maximum(z, -TOP32, out=z)
        # The cell of a map is that of the log odds of a one. A map has two halves, for bits of 0 and of 1.
        spot = z * x[:, BIAS + 2]
        spot += np.float32(MAP_CELLS / 2)
        np.trunc(spot, out=spot)
        spot += x[:, BIAS + 3]
        spot += np.repeat(np.arange(alive, dtype=np.float32) * (2 * MAP_CELLS), bits)
        spot = spot.astype(np.int64)
        error = np.exp(z, out=z)  # 1 - p, p that of the bit that came
        error += 1
        np.reciprocal(error, out=error)
        halves = np.stack([1 - maps, maps], axis=1)
        # p + q, twice the probability; as both are over 1e-4, it needs no least value.
        final = halves.astype(np.float32).take(spot)
        final -= error
        final += 1
        np.log(final, out=final)
        cost[over:] += bits * np.log(2) - np.add.reduceat(final, last - bits, dtype=np.float64)
        off, pulls = error[rest], np.empty((alive, ROW), np.float32)
        error[rest] = 0
        for pull, (a, b) in zip(pulls, stretches):
            np.dot(error[a:b], x[a:b], out=pull)
        weights[:, -1, : BIAS + 1] += (rate / np.sqrt(bits - others + 1))[:, None] * pulls[:, : BIAS + 1]
        if len(rest):
            by = (cell[:, None] * ROW + np.arange(BIAS + 1)).ravel()
            sums = np.bincount(by, (odd[:, : BIAS + 1] * off[:, None]).ravel(), alive * GATES * ROW).reshape(alive, GATES, ROW)
            scale = rate / np.sqrt(np.bincount(cell, minlength=alive * GATES) + 1)
            weights += scale.reshape(alive, GATES, 1) * sums
        seen = np.bincount(spot, minlength=halves.size).reshape(halves.shape)
        maps += rate * (seen[:, 1] * halves[:, 0] - seen[:, 0] * maps)
        np.clip(maps, 1e-4, 1 - 1e-4, out=maps)
    return cost, [v.sum(axis=0) for v in (all_weights[:, :, :BIAS], all_weights[:, :, BIAS], all_maps)]


# --- what documents start mixing with: a logistic regression for each gate over all teaching texts --------------------

WIDTH = len(ORDERS) + 1  # predictors and bias
SUMS = (GATES * WIDTH * WIDTH, GATES * WIDTH, MAP_CELLS * 2)


def _parts(sums: np.ndarray) -> list[np.ndarray]:
    """Curvature and target by gate, and by cell of the map the number of bits and of ones."""
    shapes = ((GATES, WIDTH, WIDTH), (GATES, WIDTH), (MAP_CELLS, 2))
    return [part.reshape(shape) for part, shape in zip(np.split(sums, np.cumsum(SUMS)[:-1]), shapes)]


def _weights(sums: np.ndarray) -> np.ndarray:
    """Weights and bias by gate to which the steps of all groups lead together."""
    curve, target, _ = _parts(sums)
    fresh = np.append(Mixer.fresh().weights, np.zeros((GATES, 1)), axis=1)
    return np.linalg.solve(curve + RIDGE * np.eye(WIDTH), (target + RIDGE * fresh)[:, :, None])[:, :, 0]


def _step(x: np.ndarray, cuts: np.ndarray, y: np.ndarray, many: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sums of one step of reweighted least squares over bits that come up `many` times. Gate by gate, of which each has
    the bits from its cut to the next one, in blocks that stay in a core's cache."""
    curve, target, cells = _parts(np.zeros(sum(SUMS)))
    for g, (first, last) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
        for at in range(first, last, STEP_BITS):
            part = slice(at, min(at + STEP_BITS, last))
            own, ones, times = x[part].astype(np.float64), y[part], many[part]
            z = np.clip(own @ weights[g], -TOP, TOP)
            p = 1 / (1 + np.exp(-z))
            heavy = times * p * (1 - p)
            curve[g] += (own * heavy[:, None]).T @ own
            target[g] += (heavy * z + times * (ones - p)) @ own
            spot = (z * CELLS_PER_NAT + MAP_CELLS / 2).astype(np.int64)
            cells[:, 0] += np.bincount(spot, times, MAP_CELLS)
            cells[:, 1] += np.bincount(spot, times * ones, MAP_CELLS)
    return np.concatenate([curve.ravel(), target.ravel(), cells.ravel()])


def mixer_sums(texts: Iterator[str], code: Code, counts: list[np.ndarray]) -> np.ndarray:
    """Sums over all texts, group by group, each at the weights that those before it lead to; the first finds its own.

    The counts that a group of texts gave itself are taken off while it is predicted, as a new text has given none. Equal
    grams of a group are predicted alike, so they are looked up and weighed once.
    """
    sums, own = np.zeros(sum(SUMS)), [np.zeros(len(c), np.uint32) for c in counts]
    least, most = FITTED_BYTES
    # About a hundredth of all symbols, so that what a group takes off is little beside what is left.
    group = min(max(int(counts[0].sum(dtype=np.int64)) // 512, least), most)
    held: list[np.ndarray] = []
    size = 0

    def flush() -> None:
        nonlocal sums
        some, many = np.unique(np.concatenate(held), return_counts=True)
        place, bits, at = slots(some, code)
        many = many[place]
        x = np.ones((len(place), WIDTH), np.float32)
        for k, (total, mine, slot) in enumerate(zip(counts, own, at)):
            cell = slot * 2 + bits
            np.add.at(mine, cell, many.astype(np.uint32))
            left, gone = (c.view(np.uint64).take(slot).view(np.uint32) for c in (total, mine))  # both counts of a slot at once
            x[:, k] = stretched(left - np.minimum(left, gone))
            mine[cell] = 0
        gate = np.count_nonzero(x[:, :-1], axis=1).astype(np.uint8)
        order, cuts = np.argsort(gate, kind="stable"), np.cumsum([0, *np.bincount(gate, minlength=GATES)])
        x, y, many = x.take(order, axis=0), bits[order].astype(np.float64), many[order].astype(np.float64)
        found = sums
        for _ in range(1 if sums.any() else FIRST_STEPS):
            found = _step(x, cuts, y, many, _weights(found))
        sums = sums + found
        held.clear()

    for text in texts:
        for piece in _pieces(symbols(text)):
            held.append(grams(piece))
            size += len(piece)
            if size >= group:
                flush()
                size = 0
    if held:
        flush()
    return sums


def mixer_of(sums: np.ndarray) -> Mixer:
    """What the sums over all teaching texts say; that of no text is Mixer.fresh()."""
    weights, (bits, ones) = _weights(sums), _parts(sums)[2].T
    refine = (ones + RIDGE * Mixer.fresh().refine) / (bits + RIDGE)
    return Mixer(weights[:, :-1], weights[:, -1], np.clip(refine, 1e-4, 1 - 1e-4))


def fit_mixer(texts: list[str], code: Code, counts: list[np.ndarray]) -> Mixer:
    """What documents should start with, from texts at hand."""
    return mixer_of(mixer_sums(iter(texts), code, counts))


def learn_mixer(docs: DataFrame, code: Code, counts: list[np.ndarray]) -> Mixer:
    """What documents should start with, from all texts given. The driver gets some 250 numbers of each task."""
    held = docs.sparkSession.sparkContext.broadcast((vars(code), counts))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, counts = held.value
        sums = mixer_sums((t.as_py() for b in batches for t in b.column(0)), Code(**code), counts)
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], ["sums"])

    found = [np.frombuffer(r.sums) for r in docs.mapInArrow(gather, "sums binary").collect()]
    held.unpersist()
    return mixer_of(sum(found, np.zeros(sum(SUMS))))


@dataclass
class Model:
    code: Code
    tables: list[np.ndarray]
    mixer: Mixer


def score_texts(texts: list[str], model: Model) -> list[float]:
    """log10 probability of each text, its end included. A text of over 2^20 symbols is scored in pieces of that size.

    Equal texts are scored once, and texts of like length together, whose rounds end together; no text's score depends
    on the others.
    """
    different_texts = sorted(set(texts), key=len)
    nats, held, owners, size = np.zeros(len(different_texts)), [], [], 0

    def flush() -> None:
        if held:
            np.add.at(nats, owners, mix(held, model.code, model.tables, model.mixer)[0])
            held.clear()
            owners.clear()

    for i, text in enumerate(different_texts):
        for piece in _pieces(symbols(text)):
            if held and size + len(piece) > GROUP_BYTES:
                flush()
                size = 0
            held.append(piece)
            owners.append(i)
            size += len(piece)
    flush()
    score_of = dict(zip(different_texts, (-nats / np.log(10)).tolist()))
    return [score_of[t] for t in texts]


# --- the base: words -------------------------------------------------------------------------------------------------


def _shares(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Texts in turn in shares of about CUT_BYTES, each with the place of its first."""
    upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + CUT_BYTES, "right")))
        yield first, texts.slice(first, last - first)
        first = last


def words_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, A-Z in lower case, cut at the contract's blanks; and the place of each one's text."""
    cut = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, place = cut.flatten(), pc.list_parent_indices(cut).to_numpy()
    some = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # blanks at the ends leave empty ones
    return (words, place) if some.all() else (words.filter(pa.array(some)), place[some])


def corpus_counts(texts: DataFrame) -> DataFrame:
    """kind, token, n: counts over all texts of words (kind 0; the empty token: ends) and of symbols (kind 1)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(END + 1, np.int64)
        held: list[pa.Table] = []

        def emit(kind: int, tokens: pa.Array, n: pa.Array) -> pa.RecordBatch:
            columns = [pa.array(np.full(len(n), kind, np.int32)), tokens.cast(pa.binary()), n.cast(pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["kind", "token", "n"])

        def merged() -> pa.Table:
            return pa.concat_tables(held).group_by("token", use_threads=False).aggregate([("n", "sum")]).rename_columns(["token", "n"])

        for batch in batches:
            for _, share in _shares(batch.column(0)):
                found = words_in(share)[0].value_counts()
                words = found.field("values").cast(pa.binary())
                held.append(pa.table({"token": words, "n": found.field("counts")}))
                data = np.frombuffer(b"".join(t.as_buffer() for t in share), np.uint8)
                for at in range(0, len(data), GROUP_BYTES):
                    seen[:END] += np.bincount(data[at : at + GROUP_BYTES], minlength=END)
                seen[END] += len(share)
                if sum(map(len, held)) > COUNTED_WORDS:
                    held = [merged()]
                    if len(held[0]) > COUNTED_WORDS / 2:
                        yield from (emit(0, b["token"], b["n"]) for b in held.pop().to_batches())
        if held:
            yield from (emit(0, b["token"], b["n"]) for b in merged().to_batches())
        yield emit(0, pa.array([b""]), pa.array(seen[END:]))
        yield emit(1, pa.array([str(i).encode() for i in range(END + 1)]), pa.array(seen))

    return texts.mapInArrow(count, "kind int, token binary, n long").groupBy("kind", "token").agg(F.sum("n").alias("n"))


def _least_count(vocabulary: DataFrame, words: int) -> int:
    """A count that at most so many words reach. Counts are grouped by 32 steps to a doubling, so the driver gets a
    number of rows that depends on the largest count only, as a logarithm."""
    step = F.floor(F.log2("n") * 32)
    left = words
    least = 2**62
    for row in vocabulary.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("n")).orderBy(F.desc("step")).collect():
        left -= row.words
        if left < 0:
            break
        least = row.n
    return least


def base_scores(rows: DataFrame, vocabulary: DataFrame, head_words: int = HEAD_WORDS) -> DataFrame:
    """id, mark, n_tokens, n_known, logs (sum of log10(c + 1) over the tokens), for each different id and mark.

    rows: id, mark, text. The most frequent words are looked up in the tasks, from a list of at most `head_words`;
    so no word that is left for the join has more than a small share of the rows.
    """
    spark = rows.sparkSession
    frequent = vocabulary.where(F.col("n") >= _least_count(vocabulary, head_words)).collect()
    ends = vocabulary.where(F.col("token") == F.lit(b"")).select("n").first()
    listed = [(bytes(r.token), float(np.log10(r.n + 1))) for r in frequent if len(r.token)]
    head = spark.sparkContext.broadcast(([t for t, _ in listed], np.array([v for _, v in listed] + [0.0])))
    end_known, end_log = (1, float(np.log10(ends.n + 1))) if ends else (0, 0.0)
    names = ["id", "mark", "token", "n", "texts", "total", "known", "logs"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, values = head.value
        frequent = pa.array(tokens, pa.binary())

        def emit(batch: pa.RecordBatch, places: np.ndarray, tokens: pa.Array, *columns: np.ndarray) -> pa.RecordBatch:
            columns = [*(batch.column(k).take(pa.array(places)) for k in range(2)), tokens, *map(pa.array, columns)]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for first, share in _shares(batch.column(2)):
                words, place = words_in(share)
                coded = words.dictionary_encode()
                different, code = coded.dictionary.cast(pa.binary()), coded.indices.to_numpy()
                at = pc.index_in(different, value_set=frequent).fill_null(len(frequent)).to_numpy(zero_copy_only=False)
                pairs, many = np.unique(place.astype(np.int64) * len(different) + code, return_counts=True)
                which, word = np.divmod(pairs, max(1, len(different)))
                at = at[word]  # the word's place in the list, that of a rare one the place after
                texts, rare = len(share), np.flatnonzero(at == len(frequent))
                total = np.bincount(place, minlength=texts)
                known = total - np.bincount(which[rare], many[rare], texts).astype(np.int64) + end_known
                logs = np.bincount(which, many * values[at], texts) + end_log
                # The row of the text itself has a token that no word can be, another one for each row.
                rows, marks = np.arange(first, first + texts), batch.column(1).slice(first, texts).to_pylist()
                own = pa.array([b" %d %d" % pair for pair in zip(rows.tolist(), marks)], pa.binary())
                zero, one = np.zeros(texts, np.int64), np.ones(texts, np.int64)
                yield emit(batch, rows, own, zero, one, total + 1, known, logs)
                for k in range(0, len(rare), EMITTED_ROWS):
                    some = rare[k : k + EMITTED_ROWS]
                    none = np.zeros(len(some), np.int64)
                    yield emit(batch, which[some] + first, different.take(pa.array(word[some])), many[some], none, none, none, none.astype(float))

    schema = "id long, mark long, token binary, n long, texts long, total long, known long, logs double"
    parts = rows.select("id", "mark", "text").mapInArrow(cut, schema)
    counted = parts.join(vocabulary.select("token", F.col("n").alias("c")), "token", "left")
    more = F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)
    sums = counted.groupBy("id", "mark").agg(
        F.sum("texts").alias("texts"),
        F.sum("total").alias("total"),
        F.sum(F.col("known") + more).alias("known"),
        F.sum(F.col("logs") + F.coalesce(F.col("n") * F.log10(F.col("c") + 1), F.lit(0.0))).alias("logs"),
    )
    # Equal rows were summed; each has its share.
    each = [(F.col(c) / F.col("texts")) for c in ("total", "known", "logs")]
    return sums.select("id", "mark", each[0].cast("long").alias("n_tokens"), each[1].cast("long").alias("n_known"), each[2].alias("logs"))


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """One row per input row: key, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Documents teach whose crc32 of the id modulo `folds` isn't `held_out`. From all of them come the counts of words,
    of symbols, and of what followed each hashed context; the tables of contexts have a fixed size, the counts of words
    grow with the corpus and stay distributed. What a text starts mixing with is fitted to all of them too, in tasks.

    Null text counts as empty, which is one end; null ids teach and are scored as any other; repeated rows stay; an
    empty table gives no rows; where nothing teaches, all bits are even. Other columns are not read.
    """
    spark = docs.sparkSession
    body = text_or_empty(text)
    out = remainder_of_id("id", folds) == held_out
    rows = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(body).alias("mark"), body.alias("text"))
    teaching = rows.where(~out)
    counts = cut_lineage(corpus_counts(teaching.select("text")))
    vocabulary = counts.where("kind = 0").select("token", "n")
    size = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    seen = np.zeros(END + 1, np.int64)
    for r in counts.where("kind = 1").collect():
        seen[int(bytes(r.token))] = r.n
    code = huffman(seen)
    learned = learn_counts(teaching.select("text"), code)
    mixer = learn_mixer(teaching.select("text"), code, learned)
    held = spark.sparkContext.broadcast((vars(code), [stretched(t) for t in learned], vars(mixer)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, tables, mixer = held.value
        model = Model(Code(**code), tables, Mixer(**mixer))
        for batch in batches:
            texts = batch.column(2).to_pylist()
            sizes = pc.binary_length(batch.column(2)).cast(pa.int64())
            columns = [batch.column(0), batch.column(1), sizes, pa.array(score_texts(texts, model), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "mark", "bytes", "score"])

    scored = rows.mapInArrow(work, "id long, mark long, bytes long, score double").alias("s")
    base = base_scores(rows, vocabulary).alias("b")
    both = scored.join(base, F.col("s.id").eqNullSafe(F.col("b.id")) & (F.col("s.mark") == F.col("b.mark")), "left")
    level = float(np.log10(size.n + size.v + 1))
    return both.select(
        F.col("s.id").alias(key),
        (F.crc32(F.coalesce(F.col("s.id").cast("string"), F.lit("")).cast("binary")) % folds == held_out).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(size.n).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.lit(level)).alias("base_score"),
        "score",
        F.when(F.col("bytes") > 0, -F.col("score") * F.lit(float(np.log2(10))) / F.col("bytes")).alias("bits_per_byte"),
    )
