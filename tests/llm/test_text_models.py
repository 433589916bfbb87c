import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from notespark.llm import langid, lm_scoring, secret_scan, toxicity


def crc(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode())


# --- secrets ---------------------------------------------------------------------------------------------------------


def plain_spans(text):
    """The known shapes by a scan that tries each place in turn."""
    out = []
    for kind, pattern, long_enough in (
        ("assign", secret_scan.ASSIGN, lambda m: len(m[1]) >= 12),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
    ):
        at, p = 0, re.compile(pattern)
        while at <= len(text):
            m = p.match(text, at)
            if m:
                out += [(*m.span(), kind)] if long_enough(m) else []
                at = max(m.end(), at + 1)
            else:
                at += 1
    return sorted(out)


def test_known_shapes_against_a_plain_scan():
    rnd = random.Random(5)
    bits = ["token", "Secret", "api_key", "APIKEY", "toſen", "pasſword", "=", ": ", '"', " ", "AKIA", "AKIAABCDEFGHIJKLMN", "0a1b2c3d4e5f6a7b", "abcdef", "é", "XYZ/+=._-", "\n"]
    for _ in range(3000):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randint(1, 14)))
        assert sorted(secret_scan.known_spans(text)) == plain_spans(text), text


@pytest.fixture(scope="module")
def efficiency():
    with open(secret_scan.VOCABULARY, "rb") as f:
        return secret_scan.TokenEfficiency(f.read())


def randoms(text, efficiency):
    base = secret_scan.known_spans(text)
    return [text[a:b] for a, b, _ in secret_scan.random_spans(text, efficiency, base, secret_scan.MOST_CHARS_PER_TOKEN, 16)]


def test_random_strings_stand_out(efficiency):
    rnd = random.Random(1)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    found = sum(bool(randoms("see " + "".join(rnd.choice(letters) for _ in range(32)) + " here", efficiency)) for _ in range(200))
    assert found >= 198
    for plain in (
        "internationalization",
        "getUserAccountByIdentifier",
        "snake_case_identifier_42",
        "550e8400-e29b-41d4-a716-446655440000",
        "2024-01-31_12-00-00",
        "9807915762804490",
        hashlib.sha1(b"x").hexdigest(),
        hashlib.md5(b"x").hexdigest().upper(),
        "path/to/some/module/file",
    ):
        assert randoms(f"a {plain} b", efficiency) == [], plain


def test_identifiers_are_recognised_in_linear_time():
    assert not secret_scan.is_identifier("a" * 200_000 + "!")
    assert not secret_scan.is_identifier("aB" * 100_000 + "!")


def test_secrets_of_odd_rows(documents, odd_rows):
    rows = [*odd_rows, (20, 'é token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "en", "a")]
    got = secret_scan.find_secrets(documents(rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((d is None, d or 0) for d, *_ in rows)
    r = next(r for r in got if r.doc_id == 20)
    assert (r.n_assign, r.n_access, r.n_hex, r.n_random) == (1, 0, 1, 0)
    assert r.spans == "assign:2:51,hex:11:51" and r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest()
    assert all(r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in got if not r.spans)


def test_redaction_merges_spans():
    assert secret_scan.redact("ab 0123456789 cd", "assign:0:8,hex:3:13") == "[secret] cd"


# --- toxicity --------------------------------------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_lexicon_against_edit_distances():
    rnd = random.Random(3)
    terms = {"".join(rnd.choice("abc") for _ in range(rnd.randint(3, 7))): 1.0 for _ in range(25)}
    stems = {"".join(rnd.choice("abc") for _ in range(rnd.randint(4, 6))) + "*": 2.0 for _ in range(4)}
    lexicon = toxicity.Lexicon(terms | stems)
    for _ in range(4000):
        word = "".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 9)))
        allowed = lambda t: int(len(t.rstrip("*")) >= toxicity.FUZZY_FROM_CHARS)
        hits = [(d == 0, w) for t, w in terms.items() if (d := distance(word, t)) <= allowed(t)]
        hits += [(d == 0, w) for t, w in stems.items() if (d := min(distance(word[:n], t[:-1]) for n in range(len(word) + 1))) <= allowed(t)]
        best = max(hits, default=None)
        assert lexicon[word] == (best and (best[1], best[0])), word


def test_context_separates_quotation_from_abuse():
    def where(text):
        low = text.lower()
        words = toxicity.TOKEN.findall(low)
        return toxicity.context(low, [m.span() for m in toxicity.TOKEN.finditer(low)], words, words.index("idiot"))

    assert where('they called him "an idiot" once') == toxicity.REPORTED
    assert where("the word idiot is old") == toxicity.REPORTED
    assert where("oh you idiot go away") == toxicity.ADDRESSED
    assert where("some idiot over there") == toxicity.PLAIN


def test_toxicity_learns_and_holds_out(documents, spark):
    rnd = random.Random(2)
    calm = "the of and river mountain stone window paper garden letter music".split()
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        words = [rnd.choice(calm) for _ in range(30)]
        if bad:
            for _ in range(3):
                words.insert(rnd.randrange(30), rnd.choice(["grumbel", "snorkwit", "snorkwat"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 0, int(bad)))
    docs, marks = documents(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, marks)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all(got[i].held_out == (crc(i) % 5 == 0) for i in got)
    held = [i for i in got if got[i].held_out]
    assert sum(got[i].predicted == (i % 4 == 0) for i in held) >= 0.97 * len(held)
    typo = toxicity.score(documents([(1, "the river grumbl and stone grumbell window garden grumbel")]), model).first()
    assert typo.n_terms == 3
    kept = {r.doc_id for r in toxicity.keep_clean(docs, model).collect()}
    assert kept == {i for i in got if not got[i].predicted}


def test_short_words_may_be_toxic_terms(documents, spark):
    rnd = random.Random(16)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(300)]
    rows = []
    for i in range(400):
        words = [rnd.choice(vocabulary) for _ in range(40)]
        if i % 4 == 1:
            words[7] = words[20] = "zot" if i % 8 == 1 else "死ね"
        rows.append((i, " ".join(words)))
    labels = spark.createDataFrame([(i, int(i % 4 == 1)) for i in range(400)], "doc_id long, toxic int")
    model = toxicity.learn(documents(rows), labels)
    assert {"zot", "死ね"} <= model.terms.keys()
    got = {r.doc_id: r.predicted for r in toxicity.score(documents(rows), model).collect()}
    assert got == {i: int(i % 4 == 1) for i in range(400)}


def test_toxicity_of_odd_rows(documents, odd_rows, spark):
    docs = documents(odd_rows)
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (6, None), (99, 1)], "doc_id long, toxic int")
    for marks in (labels, labels.where("doc_id > 100")):
        model = toxicity.learn(docs, marks)
        got = toxicity.score(docs, model).collect()
        assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
        assert toxicity.keep_clean(docs, model).columns == docs.columns
        assert toxicity.score(docs.where("doc_id > 100"), model).count() == 0


# --- language --------------------------------------------------------------------------------------------------------


def test_kneser_ney_probabilities_sum_to_one():
    rnd = random.Random(4)
    tables = []
    for _ in range(2):
        seen = Counter(tuple(rnd.choice([0, 97, 98, 99]) for _ in range(3)) for _ in range(200))
        tables.append((np.array(sorted(seen), np.uint64), np.array([seen[g] for g in sorted(seen)])))
    model = langid.build(["x", "y"], tables)
    for ctx in ((97, 98), (0, 0), (99, 50), (60, 61)):
        rows = [np.array([c] * 4, np.uint64) for c in ctx] + [np.array([0, 97, 98, 99], np.uint64)]
        total = np.exp(model.lookup(rows).astype(float)).sum(axis=0)
        unseen = np.exp(model.lookup([np.array([c], np.uint64) for c in (*ctx, 77)]).astype(float))[0]
        assert np.allclose(total + unseen, 1, atol=1e-4)


def test_symbols_fold_case_and_runs():
    letters = langid.letter_table()
    assert langid.symbols("¡Aé!! 12 ß", letters).tolist() == [97, 0xE9, 0, 0xDF, 0]
    assert langid.symbols("12 !", letters).tolist() == []
    assert langid.symbols("漢字x", letters).tolist() == [0x6F22, 0x5B57, 120, 0]


def test_pieces_of_a_long_text_give_the_same(monkeypatch):
    seen = Counter(tuple(g) for g in np.lib.stride_tricks.sliding_window_view(np.array([0, 97, 98, 97, 99, 0, 97, 98, 0], np.uint64), 3))
    table = (np.array(sorted(seen), np.uint64), np.array([seen[g] for g in sorted(seen)]))
    model, letters, texts = langid.build(["x"], [table]), langid.letter_table(), ["abac ab " * 50, "", "q"]
    whole = langid.cross_entropies(texts, model, letters)
    monkeypatch.setattr(langid, "PIECE", 16)
    cut = langid.cross_entropies(texts, model, letters)
    assert np.allclose(whole[0], cut[0]) and (whole[1] == cut[1]).all()


def test_languages(documents, odd_rows):
    rnd = random.Random(6)
    kinds = {"aa": "ka lo mi ne".split(), "bb": "stra gru plo wen".split()}
    rows = [(i, " ".join("".join(rnd.choices(kinds[k], k=3)) for _ in range(20)), k, "s") for i in range(200) for k in [("aa", "bb")[i % 2]]]
    docs = documents(rows)
    model = langid.learn(docs)
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert all(got[i].held_out == (crc(i) % 5 == 0) and got[i].lang_pred == k for i, _, k, _ in rows)
    odd = langid.identify(documents(odd_rows), model).collect()
    assert len(odd) == len(odd_rows)
    none = [r for r in odd if r.doc_id in (3, 4, 5, 8)]
    assert len(none) == 4 and all((r.lang_pred, r.score, r.accepted) == ("und", 0.0, False) for r in none)
    assert all(r.lang_pred in ("aa", "bb", "und") and 0 <= r.score <= 1 for r in odd)
    assert not next(r for r in odd if r.doc_id == 6).accepted
    assert langid.identify(docs.where("doc_id < 0"), model).count() == 0
    untaught = langid.learn(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in langid.identify(docs, untaught).collect()} == {"und"}


# --- language-model scoring ------------------------------------------------------------------------------------------


def tokens(text):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", folded), None]


def check_scores(rows, got):
    counts = Counter(t for d, x in rows if crc(d) % 7 != 2 for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for d, x in rows:
        found = tokens(x)
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in found)
        want[d, crc(d) % 7 == 2, len(found), sum(counts[t] > 0 for t in found), n, round(base, 6)] += 1
    have = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)
    assert have == want


def test_scores_of_odd_rows(documents, odd_rows, monkeypatch):
    rows = [(d, x) for d, x, *_ in odd_rows]
    got = lm_scoring.score(documents(odd_rows)).collect()
    check_scores(rows, got)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert lm_scoring.score(documents(odd_rows).where("doc_id > 100")).count() == 0


def test_joined_words_give_the_same_as_listed_ones(documents, odd_rows):
    docs = documents(odd_rows, clash=False)
    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"), F.coalesce("text", F.lit("")).alias("text"))
    vocabulary = lm_scoring.corpus_counts(rows.select("text")).where("kind = 0").select("token", "n")
    key = lambda r: (r.id is None, r.id or 0, r.mark)
    few, many = (sorted(lm_scoring.base_scores(rows, vocabulary, k).collect(), key=key) for k in (2, 100_000))
    assert [(r.id, r.mark, r.n_tokens, r.n_known, round(r.logs, 8)) for r in few] == [(r.id, r.mark, r.n_tokens, r.n_known, round(r.logs, 8)) for r in many]


def test_probabilities_of_all_next_symbols_sum_to_one():
    code = lm_scoring.huffman(np.arange(257))
    counts = lm_scoring.count_slots(iter(["abcabcabd" * 20]), code)
    tables, start = [lm_scoring.stretched(c) for c in counts], lm_scoring.Mixer.fresh()
    for prefix in (b"", b"abc", b"ab" * 200):
        head = np.frombuffer(prefix, np.uint8).astype(np.uint16)
        costs = [lm_scoring.mix([np.append(head, np.uint16(s))], code, tables, start)[0][0] for s in range(257)]
        # Only the first symbol of a round has costs of its own to compare: rounds change weights between symbols.
        alone = lm_scoring.mix([head], code, tables, start)[0][0] if len(head) else 0.0
        assert abs(sum(math.exp(alone - c) for c in costs) - 1) < 1e-3


def test_learning_helps_and_groups_dont_matter():
    rnd = random.Random(7)
    words = ["".join(rnd.choice("etaoinshr") for _ in range(5)) for _ in range(50)]
    make = lambda: " ".join(rnd.choice(words) for _ in range(200))
    teach, new = [make() for _ in range(40)], [make() for _ in range(3)]
    code = lm_scoring.huffman(sum(np.bincount(lm_scoring.symbols(t), minlength=257) for t in teach))
    counts = lm_scoring.count_slots(iter(teach), code)
    mixer = lm_scoring.fit_mixer(teach[:20], code, counts)
    taught = lm_scoring.Model(code, [lm_scoring.stretched(c) for c in counts], mixer)
    blank = lm_scoring.Model(code, [np.zeros_like(t) for t in taught.tables], mixer)
    scores = lm_scoring.score_texts(new, taught)
    assert sum(scores) > 0.6 * sum(lm_scoring.score_texts(new, blank))
    assert np.allclose(scores, [lm_scoring.score_texts([t], taught)[0] for t in new], rtol=1e-5)


def test_texts_start_mixing_with_what_all_teaching_texts_say(documents):
    """Long and late documents teach too; they used to be left out of a sample of 200 short ones."""
    rnd = random.Random(5)
    say = lambda n: " ".join(rnd.choice(["red", "green", "blue", "grey"]) for _ in range(n))
    rows = [(i, say(15_000) if i == 3 else say(20), "en", "a") for i in range(260)]
    texts = [r[1] for r in rows]
    code = lm_scoring.huffman(sum(np.bincount(lm_scoring.symbols(t), minlength=257) for t in texts))
    counts = lm_scoring.count_slots(iter(texts), code)
    docs = documents(rows, clash=False).select("text").repartition(3)
    learned = lm_scoring.learn_mixer(docs, code, counts)
    short = lm_scoring.learn_mixer(docs.where("length(text) < 65536"), code, counts)
    assert not np.allclose(learned.weights, short.weights, atol=1e-3)
    bits = lambda found: lm_scoring._parts(found)[2][:, 0].sum()
    assert bits(lm_scoring.mixer_sums(iter(texts), code, counts)) == sum(code.length[lm_scoring.symbols(t)].sum() for t in texts)
    none = lm_scoring.learn_mixer(docs.limit(0), code, counts)
    fresh = lm_scoring.Mixer.fresh()
    assert all(np.allclose(vars(none)[f], vars(fresh)[f]) for f in vars(fresh))


def test_scores_use_the_mixer_of_all_teaching_texts(documents, odd_rows, monkeypatch):
    seen = []
    real = lm_scoring.learn_mixer
    monkeypatch.setattr(lm_scoring, "learn_mixer", lambda docs, *rest: seen.append(docs.count()) or real(docs, *rest))
    docs = documents(odd_rows)
    lm_scoring.score(docs)
    assert seen == [docs.where(~(lm_scoring.remainder_of_id("doc_id", 7) == 2)).count()]


def test_a_round_of_known_contexts_only_moves_weights_by_its_own_errors():
    """Sums of such a round were cut to whole numbers unless another text of the group had an unknown context."""
    rnd = random.Random(9)
    known = " ".join(rnd.choice(["tea", "oats", "rain"]) for _ in range(300))
    code = lm_scoring.huffman(np.bincount(lm_scoring.symbols(known), minlength=257))
    tables = [lm_scoring.stretched(c) for c in lm_scoring.count_slots(iter([known]), code)]
    model = lm_scoring.Model(code, tables, lm_scoring.Mixer.fresh())
    alone = lm_scoring.score_texts([known], model)[0]
    assert np.isclose(lm_scoring.score_texts([known, "zebra " * 200], model)[0], alone, rtol=1e-7)


def mixed_bit_by_bit(text, model):
    """log10 probability of a text by the mixer's definition: one bit after the other, sums by gate, a step each round."""
    syms = lm_scoring.symbols(text)
    place, bits, at = lm_scoring.slots(lm_scoring.grams(syms), model.code)
    x = np.stack([table[slot] for table, slot in zip(model.tables, at)], axis=1).astype(float)
    weights, bias, refine = (np.array(v, float) for v in (model.mixer.weights, model.mixer.bias, model.mixer.refine))
    nats = 0.0
    for done in range(0, len(syms), lm_scoring.ROUND_BYTES):
        many, pull, shift, moved = Counter(), Counter(), Counter(), Counter()
        for i in np.flatnonzero((place >= done) & (place < done + lm_scoring.ROUND_BYTES)):
            gate = np.count_nonzero(x[i])
            z = min(max(bias[gate] + weights[gate] @ x[i], -lm_scoring.TOP), lm_scoring.TOP)
            p, cell = 1 / (1 + math.exp(-z)), int(z * lm_scoring.CELLS_PER_NAT + lm_scoring.MAP_CELLS / 2)
            final = (p + refine[cell]) / 2
            nats -= math.log(final if bits[i] else 1 - final)
            many[gate] += 1
            shift[gate] += bits[i] - p
            pull[gate] = pull[gate] + (bits[i] - p) * x[i]
            moved[cell] += bits[i] - refine[cell]
        for gate, n in many.items():
            bias[gate] += lm_scoring.RATE / math.sqrt(n + 1) * shift[gate]
            weights[gate] += lm_scoring.RATE / math.sqrt(n + 1) * pull[gate]
        for cell, by in moved.items():
            refine[cell] = min(max(refine[cell] + lm_scoring.RATE * by, 1e-4), 1 - 1e-4)
    return -nats / math.log(10)


def test_texts_mixed_side_by_side_cost_what_they_do_bit_by_bit():
    """Known and unknown contexts, texts of under and over one round, more texts than are mixed at a time."""
    rnd = random.Random(11)
    say = lambda words, n: " ".join(rnd.choice(words) for _ in range(n))
    known, other = ["tea", "oats", "rain", "salt"], ["zebra", "ümlaut", "QUIZ", "0451"]
    teach = [say(known, 60) for _ in range(30)]
    code = lm_scoring.huffman(sum(np.bincount(lm_scoring.symbols(t), minlength=257) for t in teach))
    counts = lm_scoring.count_slots(iter(teach), code)
    tables = [lm_scoring.stretched(c) for c in counts]
    texts = ["", "x", say(known, 300), say(other, 150), say(known + other, 250), *(say(known + other, n) for n in range(1, 40))]
    for mixer in (lm_scoring.Mixer.fresh(), lm_scoring.fit_mixer(teach, code, counts)):
        model = lm_scoring.Model(code, tables, mixer)
        assert np.allclose(lm_scoring.score_texts(texts, model), [mixed_bit_by_bit(t, model) for t in texts], rtol=1e-4)


def test_words_are_counted_in_less_time_than_one_by_one(spark):
    """Every word used to be an object and a key of a Counter; the task took longer than the plain loop of this test."""

    class Task:
        def mapInArrow(self, task, schema):
            self.run = task
            return self

        def groupBy(self, *_):
            return self

        agg = groupBy

    def least_seconds(work):
        spent = []
        for _ in range(5):
            begun = time.process_time()
            work()
            spent.append(time.process_time() - begun)
        return min(spent)

    rnd = random.Random(3)
    words = [f"W{i}x{rnd.random():.4f}" for i in range(30_000)]
    texts = [" ".join(rnd.choices(words, k=400)) + rnd.choice(["", " ", "\n"]) for _ in range(1500)] + ["", " \t"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    task = Task()
    lm_scoring.corpus_counts(task)

    def one_by_one():
        found = Counter()
        for text in batch.column(0):
            found.update(text.as_py().encode().lower().split())
        return found

    have = Counter()
    for kind, token, n in zip(*(sum((b.column(k).to_pylist() for b in task.run(iter([batch]))), []) for k in range(3))):
        have[kind, token] += n
    want = one_by_one() + Counter({b"": len(texts)})
    assert {token: n for (kind, token), n in have.items() if kind == 0} == want
    assert least_seconds(lambda: list(task.run(iter([batch])))) < 0.8 * least_seconds(one_by_one)
