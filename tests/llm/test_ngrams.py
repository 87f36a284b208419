"""Elias-Fano sequences against sorted lists; trie scores against a plain back-off model; small files, so levels are cut."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from forgeclock.llm import eliasfano, ngrams

D = 0.75


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 1 << 60)), max_size=400), st.lists(st.integers(0, 1 << 61), max_size=20))
def test_sequence(tmp_path_factory, values, more):
    values = sorted(values)
    path = str(tmp_path_factory.mktemp("ef") / "x")
    eliasfano.store(path, eliasfano.named("a", eliasfano.encode(np.array(values, np.uint64))))
    s = eliasfano.sequence(eliasfano.load(path), "a")
    assert s.at(np.arange(len(values))).tolist() == values
    if len(values) > 1:
        a, b = s.between(np.arange(len(values) - 1))
        assert a.tolist() == values[:-1] and b.tolist() == values[1:]
    asked = [*values, *(v + 1 for v in values), *more, 0]
    place, same = s.successor(np.array(asked, np.uint64))
    assert place.tolist() == [np.searchsorted(np.array(values, np.uint64), np.uint64(x)) for x in asked]
    assert same.tolist() == [x in set(values) for x in asked]


def test_sequence_with_long_runs_and_gaps():
    values = np.array([*[7] * 500, *range(1000, 1900), *[1 << 40] * 200, *((1 << 40) + 3 * np.arange(70))], np.uint64)
    s = eliasfano.Sequence(eliasfano.encode(values))
    asked = np.unique(np.concatenate([values, values + np.uint64(1), [0]]).astype(np.uint64))
    place, same = s.successor(asked)
    assert (place == np.searchsorted(values, asked)).all() and (same == np.isin(asked, values)).all()
    assert (s.at(np.arange(len(values))) == values).all()


def test_tokens():
    texts = ["", " a\tB\x0ba ", "b" * 70_000, "é\x00 \x00é \u00a0", "a", "\n\n"]
    chunk = ngrams.tokens([t.encode() for t in texts])
    names, ids = {}, []
    for t in texts:
        ids += [names.setdefault(w, len(names)) for w in words_of(t)]
    pairs = set(zip(ids, chunk.hashes[chunk.at].tolist()))
    assert len(pairs) == len(names) == len(chunk.hashes)
    assert chunk.begin.tolist() == np.cumsum([0, *(len(words_of(t)) for t in texts)]).tolist()


def words_of(text):
    return [*(text or "").encode().lower().split(), b"\n"]


class Plain:
    """Back-off model over dictionaries, without quantising."""

    def __init__(self, texts):
        self.uni, self.after = Counter(), defaultdict(Counter)
        for t in texts:
            w = words_of(t)
            self.uni.update(w)
            for i, x in enumerate(w):
                self.after[(w[i - 1] if i else None,)][x] += 1
                if i > 1:
                    self.after[w[i - 2], w[i - 1]][x] += 1
                elif i == 1:
                    self.after[None, w[0]][x] += 1
        self.n, self.v = sum(self.uni.values()), len(self.uni)

    def p(self, context, word):
        if not context:
            return (self.uni[word] + 1) / (self.n + self.v + 1)
        seen = self.after.get(context)
        if seen is None:
            return self.p(context[1:], word)
        total = sum(seen.values())
        if word in seen:
            return (seen[word] - D) / total
        left = 1 - sum(self.p(context[1:], w) for w in seen)
        return D * len(seen) / total / left * self.p(context[1:], word)

    def score(self, text):
        w = words_of(text)
        return sum(math.log10(self.p(((None, *w)[max(0, i - 1) : i + 1]), x)) for i, x in enumerate(w))


@pytest.mark.parametrize("sizes", [(), (8, 40, 5)])
def test_scores(spark, monkeypatch, sizes):
    rng = random.Random(3)
    pool = [f"w{int(rng.paretovariate(0.6)) % 60}" for _ in range(900)] + ["ÄÖ", "The", "the"]
    text = lambda: " ".join(rng.choices(pool, k=rng.choice([0, 1, 2, 9, 60])))
    train = [text() for _ in range(70)] + [None, "", "same text twice", "same text twice", " ".join(rng.choices(pool, k=3000))]
    plain = Plain(train)
    trie = ngrams.train(spark.createDataFrame([(t, 1) for t in train], "text string, h int").repartition(3), D, *sizes)
    assert (trie.n, trie.v) == (plain.n, plain.v)
    asked = train[:20] + [text() for _ in range(30)] + [None, "unheard of", "the unheard w1 w2", "THE\x0bthe \xa0 Äö", " ".join(rng.choices(pool, k=2000))]
    docs = spark.createDataFrame([(i if i else None, t, 0.5) for i, t in enumerate(asked)], "doc_id long, text string, score double")
    out = ngrams.scored(docs, trie).collect()
    assert len(out) == len(asked)
    for r in out:
        words = words_of(r.row.text)
        assert (r.n_tokens, r.n_known) == (len(words), sum(plain.uni[w] > 0 for w in words))
        base = sum(math.log10((plain.uni[w] + 1) / (plain.n + plain.v + 1)) for w in words)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score == pytest.approx(plain.score(r.row.text), abs=len(words) * 1.01 / ngrams.STEPS * 1.5 + 1e-6)
    monkeypatch.setattr(ngrams, "CHUNK", 500)
    texts = [(t or "").encode() for t in asked]
    small = [x for c in ngrams.chunks(texts) for x in trie.score(c)[3].tolist()]
    assert small == pytest.approx([r.score for r in out])
    chances = [sum(plain.p(c, w) for w in [*plain.uni, b"unheard"]) for c in list(plain.after)[:40]]
    assert chances == pytest.approx([1.0] * len(chances))
    ngrams.delete(trie)


def test_nothing_learnt(spark):
    trie = ngrams.train(spark.createDataFrame([], "text string"))
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [(r.n_tokens, r.n_known, r.base_score, r.score) for r in ngrams.scored(docs, trie).collect()] == [(3, 0, 0.0, 0.0)]
    assert ngrams.scored(docs.limit(0), trie).count() == 0


def test_folder_must_be_mounted():
    assert ngrams.mounted("file:///a/b") == "/a/b" and ngrams.mounted("/a/b") == "/a/b"
    with pytest.raises(RuntimeError):
        ngrams.mounted("hdfs://name/a")
