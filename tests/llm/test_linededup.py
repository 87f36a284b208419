"""Line dedup against a plain loop, with small batches and buckets so that runs are merged and settled keys are met."""

import random
from collections import defaultdict

import pytest

from forgeclock.llm import linededup

WHITE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WHITE))


def plain(rows, min_chars, min_docs):
    holders = defaultdict(set)
    order = lambda d: -(1 << 63) if d is None else d
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(order(d))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(holders[key(x)]) < min_docs or max(holders[key(x)]) == order(d)]
        out.append((str(d), "\n".join(stay), len(lines), len(lines) - len(stay)))
    return sorted(out)


@pytest.mark.parametrize("batches,fanout", [(1, 2), (5, 2), (7, 3)])
def test_against_plain_loop(spark, batches, fanout):
    rng = random.Random(batches)
    pool = [f"{'Äß' * (i % 3)} shared line number {i} of the pool" for i in range(12)] + ["short", "", "x" * 300]
    rows = []
    for d in range(60):
        text = "\n".join(rng.choice([" ", "", "\t"]) + rng.choice([x, x.upper()]) + "\x0b" for x in rng.choices(pool, k=6))
        rows.append((d, text + f"\nown line of document {d} and nothing else"))
    rows += [(None, pool[0]), (None, pool[1] + "\n" + pool[0]), (70, None), (71, ""), rows[3], rows[3], (3, pool[2]), (72, "\n\n")]
    docs = spark.createDataFrame([(d, t, "k") for d, t in rows], "doc_id long, text string, drop string")
    out = linededup.dedup_lines(docs, min_chars=20, min_docs=4, batches=batches, buckets=3, fanout=fanout)
    got = sorted((str(r.row.doc_id), r.text, r.n_lines, r.n_dropped) for r in out.collect())
    assert got == plain(rows, 20, 4)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert linededup.dedup_lines(docs).count() == 0


def test_key_length_counts_code_points():
    assert linededup._key("é".encode() * 39, 40) is None
    assert linededup._key("é".encode() * 40, 40) is not None
    assert linededup._key(b"  " + b"a" * 39 + b" ", 40) is None
    assert linededup._key(b"A" * 40, 40) == linededup._key(b" " + b"a" * 40 + b"\r", 40)
