"""Spelling variants: the index against all pairs, blocks cut into slices, the query against a plain loop."""

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from forgeclock.llm import variants


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abà", min_size=4, max_size=6), max_size=40), st.integers(4, 5))
def test_blocks_find_each_pair_once(words, l):
    met = Counter()
    for ends in (False, True):
        blocks = {}
        for w in words:
            if len(w) in (l, l + 1):
                blocks.setdefault(w[len(w) - (l - l // 2) :] if ends else w[: l // 2], []).append(w)
        for block in blocks.values():
            for word, many, _, best in variants.block_answers([(w, 1) for w in block], block, l, ends):
                met[word] += many
                assert one_edit(word, best)
    alike = lambda a, b: one_edit(a, b) and l == min(len(a), len(b))
    assert met == Counter({w: k for w in words if (k := sum(alike(w, v) for v in words))})


@pytest.mark.parametrize("most", [3, 1000])
def test_slices(spark, most):
    rng = random.Random(most)
    words = {"".join(rng.choices("abc", k=rng.choice([4, 5, 6]))): rng.choice([1, 2, 30]) for _ in range(300)}
    rows = spark.createDataFrame(list(words.items()), "word string, n long")
    many, best = Counter(), {}
    for r in variants.near_words(rows, 4, most).collect():
        many[r.word] += r.n_near
        best[r.word] = min(best.get(r.word, (1, "")), (-r.best_n, r.best))
    pairs = {w: [v for v in words if one_edit(w, v)] for w in words}
    assert many == Counter({w: len(v) for w, v in pairs.items() if v})
    assert best == {w: min((-words[v], v) for v in p) for w, p in pairs.items() if p}


def plain(rows, factor):
    n = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            at = h % len(run)
            n[run[:at] + run[at + 1 :] if h % 31 == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    form = {}
    for w in n:
        near = [v for v in n if one_edit(w, v)]
        top = min(near, key=lambda v: (-n[v], v), default=None)
        form[w] = (top if top and n[top] >= factor * n[w] else None, len(near))

    def root(w):
        while form[w][0]:
            w = form[w][0]
        return w

    return sorted((w, str(f), root(w), n[w], k, str(n.get(f))) for w, (f, k) in form.items())


def test_against_plain_loop(spark):
    rng = random.Random(5)
    pool = ["Straßenbahn", "Élevée", "élevées", "élevéée", "different", "diferent", "differant", "diferant", "zzzzzzz", "x" * 5000]
    rows = [(d, " ".join(rng.choices(pool, [30, 2, 9, 1, 400, 30, 3, 1, 1, 1], k=200))) for d in range(20)]
    rows += [(None, "different " * 9 + "DIFFERENT"), (30, None), (31, ""), rows[0], rows[0], (32, "short 1234567 a"), (33, "different" * 9000)]
    docs = spark.createDataFrame([(d, t, "w", 1) for d, t in rows], "doc_id long, text string, word string, n int")
    got = variants.variant_groups(docs).collect()
    assert sorted((r.word, str(r.form), r.root, r.n, r.n_near, str(r.form_n)) for r in got) == plain(rows, 10)
    assert any(r.form not in (None, r.root) for r in got)


def test_empty_table(spark):
    assert variants.variant_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
