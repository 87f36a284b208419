"""SimHash links and components against comparing all pairs."""

import random

import numpy as np
import xxhash

from forgeclock.llm import simhash
from forgeclock.llm.components import components
from forgeclock.shared import materialise

SCHEMA = "doc_id long, text string, anchor string"


def plain_print(text, words=3):
    parts = (text or "").encode().lower().split()
    runs = [b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))] if parts else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(items, linked):
    label = list(range(len(items)))
    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return label


def edited(rng, text, edits):
    words = text.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def test_query_against_all_pairs(spark):
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(300)]
    base = [" ".join(rng.choices(vocabulary, k=rng.choice([40, 200, 600]))) for _ in range(25)]
    texts = [edited(rng, b, e) for b in base for e in (0, 1, 1, 2, 4)] + ["", None, " \n", "One", "ONE", "a b", "Öl ÖL"]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "x"), (3, base[9], "y"), (None, "one", "z")]
    out = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    prints = [plain_print(t) for _, t, _ in rows]
    label = plain_components(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for (doc, _, _), g in zip(rows, label):
        least[g] = min((x for x in (least.get(g), doc) if x is not None), default=None)
    want = sorted((str(d), f"{p:016x}", least[g]) for (d, _, _), p, g in zip(rows, prints, label))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in out) == want


def test_links_with_sliced_anchors(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    prints = [int(c) for c in centre for _ in range(60)]
    prints = sorted({p ^ sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 5))) for p in prints})
    prints = [int(np.uint64(p).view(np.int64)) for p in prints]
    monkeypatch.setattr(simhash, "SLICE", 7)
    for threshold in (1, 2, 3, 4):
        nodes = materialise(spark.createDataFrame([(i, p) for i, p in enumerate(prints)], "id long, fp long"), "nodes")
        got = sorted(tuple(sorted((r.a, r.b))) for r in simhash.links(nodes, threshold).collect())
        want = [
            (i, j) for j in range(len(prints)) for i in range(j)
            if ((prints[i] ^ prints[j]) & (1 << 64) - 1).bit_count() <= threshold
        ]
        assert got == sorted(want)


def test_code_is_perfect():
    code = simhash.Covering(2)
    words = np.arange(1 << 12, dtype=np.uint64) * np.uint64(1777) % np.uint64(1 << 23)
    assert len(code.near(words, 0)[0]) == len(words)


def test_components_of_a_long_chain(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 150), (7, 7)]
    links = materialise(spark.createDataFrame(chain, "a long, b long"), "chain")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 150: 100, 200: 100}
    assert {r.node: r.root for r in components(links, chunk=20).collect()} == got
    none = materialise(spark.createDataFrame([], "a long, b long"), "none")
    assert components(none).count() == 0


def test_keep_one(spark):
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(2000)]
    base = [" ".join(rng.choices(vocabulary, k=400)) for _ in range(12)]
    rows = [(10 * i + e, edited(rng, b, e), "k") for i, b in enumerate(base) for e in (0, 1, 2)]
    rows += [(0, rows[0][1], "k"), (0, rows[0][1], "k"), (None, rows[5][1], "n"), (500, None, "e"), (501, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, root string")
    out = simhash.keep_one(docs)
    assert out.columns == docs.columns
    kept = [(r.doc_id, r.root) for r in out.collect()]
    assert sorted(kept) == [(10 * i, "k") for i in range(12)] + [(500, "e")]
    assert simhash.keep_one(docs.limit(0)).count() == 0
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_keep_one_misses_no_pair(spark):
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(400)]
    passage = " ".join(rng.choices(vocabulary, k=30))
    texts = []
    for k in [3, 5, 12, 25, 30, 40, 60, 100, 250] * 6:
        base = " ".join(rng.choices(vocabulary, k=k))
        middle = base.split(" ")
        middle[k // 2] = "other"
        texts += [base, base + " two more", " ".join(middle), f"{passage} {base}", base.upper()]
    chain = rng.choices(vocabulary, k=130)
    texts += [" ".join(chain[i : i + 70]) for i in range(0, 60, 6)]
    rows = list(enumerate(texts))
    sets = [simhash.shingle_set(t.encode(), 5) for t in texts]

    def near(a, b):
        both = len(np.intersect1d(a, b))
        return both >= 0.8 * (len(a) + len(b) - both) - 1e-9

    label, want = plain_components(sets, near), {}
    for i, g in enumerate(label):
        want.setdefault(g, i)
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))
    assert sorted(r.doc_id for r in got.collect()) == sorted(want.values())
    assert len(want) < len(rows) * 0.8


def test_keep_one_goes_by_fingerprints(spark, monkeypatch):
    """Fingerprints within the threshold link copies without any shingle join, and the shingle join gets no pair that they settled."""
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(3000)]
    base = [" ".join(rng.choices(vocabulary, k=500)) for _ in range(10)]
    texts = [edited(rng, b, e) for b in base for e in (0, 1, 3)] + [base[0].upper(), f"{base[1]} end", "a b", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = [simhash.word_print((t or "").encode()) for t in texts]
    sets = [simhash.shingle_set((t or "").encode(), 5) for t in texts]

    def linked(i, j):
        both = len(np.intersect1d(sets[i], sets[j]))
        similar = both >= 0.8 * (len(sets[i]) + len(sets[j]) - both)
        return similar and (prints[i] ^ prints[j]).bit_count() <= 4

    label = plain_components(range(len(texts)), linked)
    want = sorted({g: i for i, g in reversed(list(enumerate(label)))}.values())
    given = []

    def nothing_later(keyed, near, tried, *_):
        given.extend(keyed.select("id", "root").collect())
        return near.limit(0)

    monkeypatch.setattr(simhash, "still_apart", nothing_later)
    assert sorted(r.doc_id for r in simhash.keep_one(docs, threshold=4).collect()) == want
    assert len(want) < 25 and len({r.root for r in given}) == len(want)


def test_keep_one_fetches_no_sets_that_sketches_rule_out(spark, monkeypatch):
    """Texts that share a passage only are paired by it, but their shingles aren't fetched; those of near copies are."""
    rng = random.Random(10)
    vocabulary = [f"v{i}" for i in range(5000)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    texts = [f"{passage} {' '.join(rng.choices(vocabulary, k=60 + i))}" for i in range(30)]
    texts += [" ".join(rng.choices(vocabulary, k=150))]
    texts += [edited(rng, texts[-1], 2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    named, fetched, all_pairs, filtered = [], [], simhash._pairs, simhash.key_filter

    def pairs(met, similarity):
        out = all_pairs(met, similarity)
        named.append(out.count())
        return out

    def key_filter(keys):
        fetched.append(keys.count())
        return filtered(keys)

    monkeypatch.setattr(simhash, "COMMON", 0)  # else the passage, known as frequent, comes last in each text
    monkeypatch.setattr(simhash, "_pairs", pairs)
    monkeypatch.setattr(simhash, "key_filter", key_filter)
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == list(range(31))
    assert sum(named) >= 30 and sum(fetched[:-1]) == 2  # the last filter is that of the rows which don't surely stay


def test_sketches_rule_out_no_similar_pair(spark):
    rng = np.random.default_rng(6)
    sets, pairs = [], []
    for n in [0, 1, 2, 9, 60, 63, 64, 65, 100, 128, 129, 500, 1025, 4000]:
        for alike in (1.0, 0.95, 0.9, 0.8, 0.5, 0.0):
            one = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
            kept = one[: int(np.ceil(n * alike))]
            for more in (0, round(n * (1 - alike)), n // 5):
                pairs.append((len(sets), len(sets) + 1))
                sets += [one, np.unique(np.concatenate([kept, rng.integers(0, 1 << 64, more, dtype=np.uint64)]))]
    rows = [(i, len(s), simhash.parity_sketch(s).astype(np.int64).tolist()) for i, s in enumerate(sets)]
    prints = spark.createDataFrame(rows, "id long, n int, sketch array<long>")
    candidates = spark.createDataFrame(pairs, "a long, b long")
    for similarity in (0.3, 0.5, 0.8, 1.0):
        left = {(r.a, r.b) for r in simhash.possible(candidates, prints, similarity).collect()}
        for a, b in pairs:
            both, total = len(np.intersect1d(sets[a], sets[b])), len(np.union1d(sets[a], sets[b]))
            assert (a, b) in left or both < similarity * total
            assert (a, b) not in left or similarity < 0.8 or len(sets[a]) < 100 or both > 0.65 * total
