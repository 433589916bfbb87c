import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from notespark.llm import decontamination, mixing, sharding, shingle_sets, simhash
from notespark.llm.components import components

# --- near duplicates -------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, distance=4):
    """fps: list of (key, fingerprint); the component of each fingerprint by comparing all pairs."""
    classes = sorted({f for _, f in fps})
    least = {f: min((k for k, g in fps if g == f and k is not None), default=None) for f in classes}
    root = {f: f for f in classes}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, f in enumerate(classes):
        for g in classes[i + 1 :]:
            if (f ^ g).bit_count() <= distance and least[f] is not None and least[g] is not None:
                root[find(f)] = find(g)
    best = defaultdict(list)
    for f in classes:
        best[find(f)].append(least[f])
    return {f: min((k for k in best[find(f)] if k is not None), default=None) for f in classes}


@pytest.mark.parametrize("parts", [2, 3])
def test_anchors_lose_no_link(spark, parts):
    rnd = random.Random(parts)
    centres = [rnd.getrandbits(64) for _ in range(40)]
    fps = set(centres)
    for c in centres:
        for _ in range(rnd.choice([0, 3, 40])):
            f = c
            for b in rnd.sample(range(64), rnd.choice([1, 2, 4, 4, 5, 8])):
                f ^= 1 << b
            fps.add(f)
            c = rnd.choice([c, f])
    rows = [(i, f) for i, f in enumerate(sorted(fps))]
    classes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in rows], "fp long, rep long")
    for cell_rows in (50_000, 7):
        placed = simhash.placements(classes, parts, 4)
        linked = simhash.links(placed, 4, cell_rows)
        got = {r.node: r.component for r in components(linked).collect()}
        want = plain_components(rows)
        assert {i: got.get(i, i) for i, _ in rows} == {i: want[f] for i, f in rows}


def test_home_covers_within_one_bit():
    nearest = simhash.nearest_codewords()
    words = np.arange(1 << 15)
    assert np.bitwise_count((nearest ^ words).astype(np.uint64)).max() == 1 and len(np.unique(nearest)) == 1 << 11


def test_near_duplicates_of_odd_rows(documents, odd_rows):
    rows = [(d, t) for d, t, *_ in odd_rows]
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(documents(odd_rows)).collect())
    fps = [(d, plain_fingerprint(t)) for d, t in rows]
    want = plain_components(fps)
    assert got == Counter((d, f"{f:016x}", want[f]) for d, f in fps)
    kept = simhash.representatives(documents(odd_rows))
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[1] == 1 and ids[2] == 0 and ids[None] == 2 and set(kept.columns) >= {"key", "fp"}
    assert simhash.near_duplicates(documents(odd_rows).where("doc_id > 100")).count() == 0


def test_shingles_beyond_a_block(monkeypatch):
    text = " ".join(f"w{i % 37}" for i in range(200))
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "BLOCK", 16)
    assert simhash.fingerprint(text.encode()) == whole
    assert whole & (1 << 64) - 1 == plain_fingerprint(text)


def test_components_of_paths_and_stars(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 400)] + [(500, 501), (501, 500), (502, 502)]
    edges = [(a, b) if rnd.random() < 0.5 else (b, a) for a, b in edges]
    rnd.shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 400), 100), 500: 500, 501: 500}


# --- shingle sets ----------------------------------------------------------------------------------------------------


def plain_shingles(text, words=5):
    found = text.lower().split()
    return {tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


def near_copies(rnd, vocabulary, n):
    """Texts of which some are others with a few words changed."""
    texts = []
    for _ in range(n):
        words = rnd.choice(texts).split() if texts and rnd.random() < 0.6 else [rnd.choice(vocabulary) for _ in range(rnd.randint(4, 200))]
        for _ in range(rnd.randint(0, 1 + len(words) // 40)):
            words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("tile", [shingle_sets.TILE_SHINGLES, 150])
def test_shingle_links_against_all_pairs(documents, monkeypatch, tile):
    monkeypatch.setattr(shingle_sets.links, "__defaults__", (tile,))
    rnd = random.Random(12)
    texts = near_copies(rnd, [f"w{i}" for i in range(500)], 250)
    sets, label = [plain_shingles(t) for t in texts], list(range(250))
    for i in range(250):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    got = {r.doc_id: r.component_id for r in shingle_sets.near_duplicates(documents(list(enumerate(texts)))).collect()}
    assert got == dict(enumerate(label))


def test_shingle_sets_of_odd_rows(documents, odd_rows):
    got = Counter((r.doc_id, r.component_id) for r in shingle_sets.near_duplicates(documents(odd_rows)).collect())
    assert got[1, 1] == 1 and got[2, 1] == 2 and got[None, 1] == 1
    assert got[None, 3] == got[3, 3] == got[4, 3] == got[5, 3] == 1 and got[9, 9] == 2
    assert sum(got.values()) == len(odd_rows)
    assert shingle_sets.representatives(documents(odd_rows).limit(0)).count() == 0


def test_the_pipeline_drops_copies_with_some_words_changed(spark, documents):
    rnd = random.Random(13)
    vocabulary = [f"w{i}" for i in range(2000)]
    base = [rnd.choice(vocabulary) for _ in range(400)]
    rows = [(i, " ".join(rnd.choice(vocabulary) for _ in range(400)), "en", "a") for i in range(20)]
    for i in range(20, 40):
        words = list(base)
        for at in rnd.sample(range(0, 400, 10), 4 * (i > 20)):  # up to 20 of 396 shingles
            words[at] = "changed"
        rows.append((i, " ".join(words), "en", "a"))
    kept = corpus_pipeline.drop_near_duplicates(spark, documents(rows, clash=False), "")
    assert sorted(r.doc_id for r in kept.collect()) == list(range(21))


def test_the_pipeline_drops_texts_with_near_fingerprints(spark, documents):
    """Two texts that are one phrase many times, with other ends: four bits apart at most, their shingle sets far apart."""
    rnd = random.Random(14)
    word = lambda: f"w{rnd.randrange(5000)}"
    phrase = " ".join(word() for _ in range(9))
    texts = [" ".join([phrase] * 60 + [word() for _ in range(30)]) for _ in range(2)]
    sets = [plain_shingles(t) for t in texts]
    assert len(sets[0] & sets[1]) < 0.5 * len(sets[0] | sets[1])
    assert (simhash.fingerprint(texts[0].encode()) ^ simhash.fingerprint(texts[1].encode())).bit_count() <= 4
    words = texts[1].split()
    close = " ".join([*words[:-1], "other", *words[:20]])  # alike to the second by shingles
    rows = [(i, t, "en", "a") for i, t in enumerate([texts[0], texts[1], close, "another text of its own", None, ""])]
    rows += [(7, "one of two texts of an id", "en", "a"), (7, texts[0], "en", "a"), (None, texts[0], "en", "a")]
    kept = corpus_pipeline.drop_near_duplicates(spark, documents(rows, clash=False), "").collect()
    assert Counter(r.doc_id for r in kept) == Counter({0: 1, 3: 1, 4: 1, 7: 2, None: 1})


# --- decontamination -------------------------------------------------------------------------------------------------


def test_longest_common_subsequence():
    rnd = random.Random(2)
    for _ in range(300):
        a, b = ([rnd.choice([b"x", b"y", b"z"]) for _ in range(rnd.randint(0, 9))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontamination.lcs(a, b) == table[-1][-1]


def test_singular_vectors_against_numpy(spark):
    rnd = random.Random(3)
    rows = [[rnd.randrange(12) for _ in range(rnd.randint(1, 8))] for _ in range(60)]
    idf = np.linspace(1, 2, 12)
    dense = np.zeros((60, 12))
    for i, ids in enumerate(rows):
        for t in ids:
            dense[i, t] += idf[t]
    dense /= np.linalg.norm(dense, axis=1)[:, None]
    got = decontamination.right_vectors(spark.createDataFrame([(r,) for r in rows], "ids array<long>"), idf, 4, 4)
    want = np.linalg.svd(dense)[2][:4].T
    assert np.allclose(np.abs((got * want).sum(axis=0)), 1, atol=1e-3)


def test_leaks_are_found_and_clean_documents_left(documents, spark):
    rnd = random.Random(4)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 6))) for _ in range(600)]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = {i: text(rnd.randint(15, 70)) + "." for i in range(30)}
    rows, want = [], set()
    for i in range(200):
        body = text(rnd.choice([5, 60, 400]))
        if i % 3 == 0:
            item = rnd.randrange(30)
            words = items[item].split()
            if i % 2:  # a paraphrase: a word in seven is another one
                words = [rnd.choice(vocabulary) if k % 7 == 3 else w for k, w in enumerate(words)]
            body = f"{body} {' '.join(words).upper()} {text(20)}"
            want.add((i, item))
        rows.append((i, body))
    benchmark = spark.createDataFrame([*items.items(), (90, None), (91, " .! "), (3, items[3])], "item_id long, text string")
    docs = documents(rows)
    for block_items in (200, 8):
        got = {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, benchmark, block_items=block_items).collect()}
        assert got == want
    clean = {r.doc_id for r in decontamination.without_leaks(docs, benchmark).collect()}
    assert clean == {i for i, _ in rows} - {i for i, _ in want}


def test_leaks_across_slices_and_odd_rows(documents, odd_rows, spark, monkeypatch):
    benchmark = spark.createDataFrame([(1, "w5x5 marks the very start of one odd item that no other text has")], "item_id long, text string")
    item = benchmark.first().text
    rows = [*odd_rows, (30, ("filler words " * 300) + item + (" more filler" * 300), "en", "a")]
    for size in (decontamination.SLICE_CHARS, 500):
        monkeypatch.setattr(decontamination, "SLICE_CHARS", size)
        got = decontamination.leaks(documents(rows), benchmark).collect()
        assert [(r.doc_id, r.item_id, r.lcs) for r in got] == [(30, 1, 1.0)]
    docs = documents(odd_rows)
    assert decontamination.leaks(docs, benchmark.where("item_id > 5")).count() == 0
    assert decontamination.leaks(docs.where("doc_id > 100"), benchmark).count() == 0
    assert decontamination.without_leaks(docs, benchmark).count() == len(odd_rows)


@pytest.mark.parametrize("block_items", [200, 4])
def test_long_items_are_found(documents, spark, block_items):
    rnd = random.Random(14)
    vocabulary = [f"w{i}" for i in range(3000)]
    text = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = {i: text(n) for i, n in enumerate([20, 60, 200, 300, 500, 1000])}
    rows = [(i, " ".join(text(300) + words + text(300))) for i, words in items.items()]
    for i, words in items.items():
        some = [rnd.choice(vocabulary) if k % 9 == 4 else w for k, w in enumerate(words)]
        rows.append((10 + i, " ".join(text(100) + some + text(400))))
    rows += [(20 + i, " ".join(text(1500))) for i in range(5)]
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in decontamination.leaks(documents(rows), benchmark, block_items=block_items).collect()]
    assert sorted(got) == [(k + i, i) for k in (0, 10) for i in range(6)]


def test_a_nearer_quotation_does_not_hide_a_leak(documents, spark):
    rnd = random.Random(15)
    vocabulary = [f"w{i}" for i in range(3000)]
    text = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    item = text(50)
    rest = [w if k % 8 else rnd.choice(vocabulary) for k, w in enumerate(item)]
    rows = [(1, " ".join(item[:32] + text(480) + rest + text(200))), (2, " ".join(text(64) + item[:32] + text(480)))]
    benchmark = spark.createDataFrame([(1, " ".join(item)), *((i, " ".join(text(50))) for i in range(2, 40))], "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in decontamination.leaks(documents(rows), benchmark).collect()]
    assert got == [(1, 1)]


# --- mixing ----------------------------------------------------------------------------------------------------------


def plain_targets(sizes, weights=(1.0, 2.0, 3.0)):
    """sizes: words by source, None for the null source; the sharing is done round by round."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_ = {}, set(names)
    left = sum(sizes.values())
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * unit > 3 * sizes[s]}
        if not over:
            target |= {s: weight[s] * unit for s in open_}
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= 3 * sizes[s]
        open_ -= over
    return target


def count_words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


@pytest.mark.parametrize("seed", range(4))
def test_targets_against_round_by_round_sharing(spark, seed):
    rnd = random.Random(seed)
    sizes = {f"s{i}": int(10 ** rnd.uniform(0, 5)) for i in range(15)} | {None: 50, "zero": 0, "Ü": 7}
    rows = [("" if s is None else "=" + s, n) for s, n in sizes.items()]
    got = {r.src: r.target for r in mixing.with_targets(spark.createDataFrame(rows, "src string, source_size long")).collect()}
    for s, t in plain_targets(sizes).items():
        assert got["" if s is None else "=" + s] == pytest.approx(t)


def test_permutations():
    for n in (1, 2, 3, 5, 64, 1000):
        for key in (0, 17, 2**63 - 1):
            image = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, key))
            assert sorted(image.tolist()) == list(range(n))


def mixed_rows():
    rnd = random.Random(9)
    rows = []
    for i in range(400):
        source = rnd.choice(["big"] * 6 + ["b", "c", None, "é"])
        rows.append((i, " ".join(f"d{i}w{k}" for k in range(rnd.choice([0, 1, 10, 100, 700]))), "en", source))
    return rows + rows[:5]


def test_the_mix_meets_its_targets(documents):
    rows = mixed_rows()
    mix = mixing.Mix(documents(rows))
    got = mix.taken().collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((d, count_words(t)) for d, t, *_ in rows)
    source = {d: s for d, _, _, s in rows}
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[source[r.doc_id]] += r["size"]
        taken[source[r.doc_id]] += r.taken
        assert r.taken <= 3 * r["size"]
    for r in got:
        assert r.source_size == sizes[source[r.doc_id]]
        assert r.target == pytest.approx(plain_targets(sizes)[source[r.doc_id]])
    for s, t in plain_targets(sizes).items():
        assert abs(taken[s] - t) <= 0.02 * t + 4
    again = mixing.Mix(documents(rows[::-1])).taken().collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_the_mix_as_documents_has_what_was_taken(documents):
    rows = mixed_rows()
    docs = documents(rows)
    mix = mixing.Mix(docs)
    out = mix.documents()
    assert out.columns == docs.columns
    text, words = dict((r[0], r[1].split()) for r in rows), Counter()
    for r in out.collect():
        found = r.text.split()
        words[r.doc_id] += len(found)
        assert [w for w in text[r.doc_id] if w in set(found)] == found and r.n_chars == len(r.text)
    taken = Counter()
    for r in mix.taken().collect():
        taken[r.doc_id] += r.taken
    assert +words == +taken


def test_shards_of_the_mix_draw_whole_passes(documents):
    mix = mixing.Mix(documents(mixed_rows()))
    slots = mix.slots().toPandas()
    plan = {r.src: r for r in mix.sources.collect()}
    for src, part in slots.groupby("src"):
        times = part["index"].value_counts()
        assert len(part) == plan[src].draws and times.max() <= plan[src].passes + 1 <= 4
        assert part["index"].between(0, plan[src].blocks - 1).all()
    for _, part in slots.groupby(["shard", "src"]):
        assert sorted(part.slot) == list(range(len(part)))


def test_the_mix_of_odd_rows(documents, odd_rows):
    mix = mixing.Mix(documents(odd_rows))
    got = mix.taken().collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((d, count_words(t)) for d, t, *_ in odd_rows)
    assert all(r.taken <= 3 * r["size"] for r in got)
    assert mix.documents().count() > 0
    none = mixing.Mix(documents(odd_rows).where("doc_id > 100"))
    assert none.taken().count() == 0 and none.documents().count() == 0
    blank = mixing.Mix(documents([(1, ""), (2, None)]))
    assert [(r["size"], r.target, r.taken) for r in blank.taken().collect()] == [(0, 0.0, 0)] * 2


# --- pipeline --------------------------------------------------------------------------------------------------------


def test_pipeline_stages_on_a_planted_corpus(spark, documents, tmp_path):
    rnd = random.Random(11)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(800)]
    text = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    item = " ".join(text(40))
    rows, toxic, copies, leaking = [], set(), set(), set()
    base = text(300)
    for i in range(300):
        words = text(rnd.randint(30, 200))
        if i % 5 == 1:
            toxic.add(i)
            for _ in range(4):
                words.insert(3, rnd.choice(["grumbel", "snorkwit"]))
        elif i % 5 == 2:
            copies.add(i)
            words = list(base)
        elif i % 25 == 3:
            leaking.add(i)
            words += item.split()
        rows.append((i, " ".join(words), "en", f"s{i % 4}"))
    folder = str(tmp_path / "tables")
    documents(rows, clash=False).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 0, int(i in toxic)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    everything = set(range(300))
    assert kept[0] == everything - toxic
    assert kept[1] == kept[0] - (copies - {min(copies)})
    assert kept[2] == kept[1] - leaking
    assert kept[3] <= kept[2]
    out = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in out} == kept[3]
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign(docs).where(F.col("law") != "key").count() == 0
