"""Merkle manifest against a plain tree, with null and repeated rows, one-row groups and clashing names."""

import hashlib

import pytest
from pyspark.sql import functions as F

from forgeclock.llm import merkle

FIELDS = ["doc_id", "source", "text"]


def H(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


def climb(digests):
    """Root, and for each leaf its siblings level by level as (before, after)."""
    paths, at = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        for i, k in enumerate(at):
            low = k // 16 * 16
            paths[i].append(("".join(digests[low:k]), "".join(digests[k + 1 : low + 16])))
            at[i] = k // 16
        digests = [H(digests[k : k + 16]) for k in range(0, len(digests), 16)]
    return digests[0], paths


def plain(rows, changed):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    tops, found = [], []
    for name in names:
        own = sorted(groups[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        root, paths = climb([leaf(r) for r in own])
        tops.append(root)
        found.append(list(zip(own, paths)))
    root, above = climb(tops)
    out = []
    for subroot, group, up in zip(tops, found, above):
        for row, path in group:
            fold = leaf(changed(row))
            for before, after in path + up:
                fold = H([before, fold, after])
            proof = H(b + a for b, a in path + up)
            out.append((str(row[0]), leaf(row), subroot, root, proof, fold, fold == root))
    return sorted(out)


def run(spark, rows, claims=None):
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, source string, text string, tree string, inbox string")
    out = merkle.checked(docs, FIELDS, claims=claims)
    return sorted((str(r.id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in out.collect())


def test_against_plain_tree(spark):
    rows = [(i, f"s{i % 3}", f"Text {i} é" * (i % 4)) for i in range(150)]
    rows += [(i, "hot", None if i % 7 else "") for i in range(200, 500)]
    rows += [(i, f"own{i}", "one") for i in range(600, 620)] + [(None, None, None), (None, "s1", "a"), (700, "", "Ab" * 40_000), (5, None, "Z")]
    claims = {"text": F.when(F.col("doc_id") % 10 == 0, F.upper("text")).otherwise(F.col("text"))}
    up = lambda r: (r[0], r[1], r[2].upper()) if r[2] is not None and r[0] is not None and r[0] % 10 == 0 else r
    got = run(spark, rows, claims)
    assert got == plain(rows, up)
    assert 0 < sum(not r[-1] for r in got) < len(got)


def test_repeated_rows_are_interchangeable(spark):
    rows = [(1, "s", "a")] * 40 + [(1, "s", "b")] * 3
    got = run(spark, rows)
    assert len(got) == 43 and all(r[-1] for r in got) and {r[3] for r in got} == {plain(rows, lambda r: r)[0][3]}


@pytest.mark.parametrize("rows", [[], [(4, "s", "t")], [(i, "s", "t") for i in range(17)]])
def test_small_tables(spark, rows):
    assert run(spark, rows) == (plain(rows, lambda r: r) if rows else [])


def test_other_copy_is_noticed_in_any_field(spark):
    docs = spark.createDataFrame([(i, "s", "t") for i in range(20)], "doc_id long, source string, text string")
    moved = merkle.checked(docs, FIELDS, claims={"source": F.when(F.col("doc_id") == 3, F.lit(None)).otherwise(F.col("source"))})
    assert [r.id for r in moved.where("NOT verified").collect()] == [3]
