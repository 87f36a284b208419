"""Feistel sharding: a permutation, its inverse, and the shard rules on rows with ties."""

import zlib
from collections import Counter

import numpy as np
import pytest

from forgeclock.llm import sharding


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 1000, 4097])
def test_permutation_and_inverse(n):
    x = np.arange(n)
    y = sharding.Feistel(n, 5).walk(x)
    assert sorted(y.tolist()) == x.tolist()
    assert (sharding.Feistel(n, 5).walk(y, back=True) == x).all()
    shard, slot = sharding.place(x, n, 3, 5)
    assert (sharding.row_at(shard, slot, n, 3, 5) == x).all()
    assert n < 1000 or (y != sharding.Feistel(n, 6).walk(x)).any()


def test_shards(spark):
    rows = [(i % 37, f"text {i % 50}é", "c") for i in range(300)] + [(1, "same", "c")] * 200 + [(None, None, "c"), (5, "", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, number string")
    out = sharding.shard_rows(docs, shards=8).collect()
    plain = lambda d, t: (str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert Counter((str(r.doc_id), r.size, r.text_crc32) for r in out) == Counter(plain(d, t) for d, t, _ in rows)
    sizes = Counter(r.shard for r in out)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(8))
    for s in range(8):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sizes[s]))
    assert sorted(r.number for r in out) == list(range(len(rows)))
    key = lambda r: (str(r.doc_id), r.size, r.text_crc32, r.shard, r.slot)
    again = sharding.shard_rows(docs.repartition(5), shards=8).collect()
    assert sorted(map(key, out)) == sorted(map(key, again))
    assert sharding.shard_rows(docs.limit(0)).count() == 0
