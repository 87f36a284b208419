"""Packing against best-fit decreasing document by document, and against the tokens themselves."""

import random
import zlib
from bisect import bisect_left, insort

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from forgeclock.llm import packing
from forgeclock.llm.tokens import encoder


def plain_best_fit(lengths, capacity):
    gaps, opened = [], 0
    for n in sorted(lengths, reverse=True):
        at = bisect_left(gaps, n)
        gap = gaps.pop(at) if at < len(gaps) else capacity
        opened += gap == capacity
        if gap > n:
            insort(gaps, gap - n)
    return opened


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=120))
def test_sweep_equals_best_fit(lengths):
    lengths = sorted(lengths, reverse=True)
    runs = packing.sweep({n: lengths.count(n) for n in lengths}, 60)
    filled = {}
    for number, n in enumerate(lengths):
        first, each, sequence, offset, length = runs[np.searchsorted(runs[:, 0], number, "right") - 1]
        rank = number - first
        assert length == n
        filled.setdefault(sequence + rank // each, []).append((offset + rank % each * length, n))
    for parts in filled.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 60
    assert len(filled) == plain_best_fit(lengths, 60)


def test_pack(spark):
    from tokenizers import Tokenizer

    import public_tokenizers

    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(["alpha", "Öl", "x9", "\n", "bébé"], k=rng.choice([1, 20, 90, 400])))) for i in range(60)]
    rows += [(None, None), (7, ""), rows[4], rows[4], (99, "a <|endoftext|> b"), (100, "wort" * 900)]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, sequence_id int")
    out = packing.pack(docs, capacity=64).collect()
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for d, t in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 64 or 64
        cuts = [0, *range(first, len(ids), 64)]
        for p, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(ids)])):
            want.append((str(d), p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(want)
    filled = {}
    for r in out:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in filled.values():
        ends = [a + n for a, n in sorted(parts)]
        assert [a for a, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 64
    assert len(filled) == plain_best_fit([w[3] for w in want], 64)
    assert packing.pack(docs.limit(0)).count() == 0


def test_sequences_hold_the_tokens(spark):
    rows = [(i, f"some words {'of text ' * (i % 40)} {i}") for i in range(40)] + [(41, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    packed = packing.pack(docs, capacity=32)
    ids = {r.sequence_id: r.ids for r in packing.sequences(docs, packed, 32).collect()}
    for r in packed.collect():
        part = ids[r.sequence_id][r.offset : r.offset + r.length]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_both_libraries_agree(text):
    from tokenizers import Tokenizer

    import public_tokenizers

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")) if not hasattr(test_both_libraries_agree, "slow") else test_both_libraries_agree.slow
    test_both_libraries_agree.slow = slow
    assert list(encoder()(text)) == slow.encode(text, add_special_tokens=False).ids
