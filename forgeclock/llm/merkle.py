"""Merkle manifest of a dataset with inclusion proofs, by time-forward processing (operator 13).

Every row is a leaf.  The leaves of a group form a tree in the order of their ids, and the groups' roots, in the order of the groups,
form the tree above.  A node's label is (level, tree, place).  Nodes are worked off in the order of their labels: a node sends its
digest to its parent's label, into a queue, and a parent is due when its label comes up, with all its children's digests.  The
queue is a stored table that Spark's external sort orders by label; since parents lie one level up, a round takes all messages
of a level at once, and the messages sent meanwhile are a sixteenth of them.  The sweep back works the labels off from the top: every
node receives the proof of its parent's place once and sends each child that proof with the child's siblings before it.  Only the
last step, which no longer shuffles, has a proof for each leaf.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgeclock.llm.sharding import numbered
from forgeclock.shared import materialise

#: Children of a node, at most.
FAN = 16
#: The tree above the groups' trees.
TOP = -1


def hashed(parts: Column) -> Column:
    """Digest of an array of texts one after the other; none: of the empty text."""
    return F.sha2(F.array_join(parts, "").cast("binary"), 256)


def leaf(fields: list[Column]) -> Column:
    """Digest of a row: every field as its length in bytes, a colon and its value; ``-`` for null."""

    def written(field: Column) -> Column:
        value = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return hashed(F.array(*map(written, fields)))


@dataclass
class Manifest:
    """Stored tables of both sweeps' way up.

    ``rows``: (tree, at, n, digest, row) for each leaf; ``levels``: for each level (tree, at, n, digest, inbox), ``inbox`` being the
    messages of the children in order; ``trees``: (tree, group, digest) with each group's root; ``above``: levels of the tree of
    groups; ``root``: the digest of everything, None for an empty table.
    """

    rows: DataFrame
    levels: list[DataFrame]
    trees: DataFrame
    above: list[DataFrame]
    root: str | None


def _forward(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Levels above ``nodes`` (tree, at, n, digest, ...) and the roots (tree, digest); ``n`` nodes of a tree share a level."""
    levels, roots, due = [], [], nodes
    while True:
        roots.append(due.where("n = 1").select("tree", "digest"))
        due = due.where("n > 1")
        if due.isEmpty():
            break
        more = [c for c in due.columns if c not in ("tree", "at", "n")]
        sent = due.select("tree", F.expr(f"at div {FAN}").alias("to"), "n", F.struct("at", *more).alias("message"))
        queue = sent.repartitionByRange("tree", "to")
        met = queue.groupBy("tree", "to").agg(F.max("n").alias("n"), F.sort_array(F.collect_list("message")).alias("inbox"))
        digest = hashed(F.transform("inbox", lambda m: m["digest"]))
        level = met.select("tree", F.col("to").alias("at"), F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"), digest.alias("digest"), "inbox")
        levels.append(materialise(level, f"level{len(levels)}"))
        due = levels[-1].select("tree", "at", "n", "digest")
    out = roots[0]
    for more in roots[1:]:
        out = out.unionByName(more)
    return levels, out


def manifest(docs: DataFrame, fields: list[str], group: str = "source", order: str = "doc_id", claims: dict[str, Column] | None = None) -> Manifest:
    """Digests of all rows of ``docs``, of every group and of the whole.

    Leaves are made of ``fields``.  ``claims`` replaces fields by what another copy of the rows has there: the row's ``claim`` is the leaf
    that copy would have; null where a claim gives back the field itself.  A null group is a group of its own, the first one; a null id
    comes first in its group.  Ties go by the leaf's digest, so repeated rows are interchangeable.  Columns that aren't named are
    ignored, whatever their names.
    """
    own = [F.col(f) for f in fields]
    claimed = [(claims or {}).get(f, F.col(f)) for f in fields]
    same = F.lit(True)
    for a, b in zip(own, claimed):
        same = same & a.eqNullSafe(b)
    digests = docs.select(
        F.col(group).cast("string").alias("group"), F.col(order).alias("id"), leaf(own).alias("digest"),
        F.when(~same, leaf(claimed)).alias("claim"),
    )
    ordered = materialise(numbered(digests, ["group", "id", "digest"], "number"), "leaves")
    groups = ordered.groupBy("group").agg(F.min("number").alias("tree"), F.count("*").alias("n"))
    groups = materialise(groups, "groups").alias("g")
    met = ordered.alias("o").join(groups, F.col("o.group").eqNullSafe(F.col("g.group")))
    rows = met.select("tree", (F.col("number") - F.col("tree")).alias("at"), "n", "digest", F.struct("id", "claim").alias("row"))
    rows = materialise(rows, "rows")
    levels, roots = _forward(rows)
    trees = materialise(roots.join(groups, "tree").select("tree", "group", "digest"), "trees")
    placed = numbered(trees.select("tree", "digest"), ["tree"], "at").select(
        F.lit(TOP).cast("long").alias("tree"), "at", F.lit(trees.count()).cast("long").alias("n"), "digest", F.col("tree").alias("of")
    )
    above, top = _forward(materialise(placed, "placed"))
    first = top.first()
    return Manifest(rows, levels, trees, above, first and first["digest"])


def _siblings() -> Column:
    """Digests beside place ``i`` of an inbox: (before, after)."""
    said = F.transform("inbox", lambda m: m["digest"])
    place, size = F.col("i") + 1, F.size("inbox")
    return F.struct(
        F.array_join(F.slice(said, F.lit(1), place - 1), "").alias("before"),
        F.array_join(F.slice(said, place + 1, size), "").alias("after"),
    )


def _backward(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(tree, message, path): the lowest level's messages with their proofs, from ``tops`` (tree, path) of the trees' roots.

    A proof lists the siblings (before, after) on each level from the bottom up.
    """
    arrived = None
    for k in reversed(range(len(levels))):
        level = levels[k]
        met = level.where("n = 1").join(tops, "tree").select("tree", "at", "inbox", "path")
        if arrived is not None:
            met = met.unionByName(level.where("n > 1").join(arrived, ["tree", "at"]).select("tree", "at", "inbox", "path"))
        spread = met.select("tree", "inbox", "path", F.posexplode("inbox").alias("i", "message"))
        path = F.concat(F.array(_siblings()), F.col("path")).alias("path")
        if not k:
            return spread.select("tree", "message", path)
        arrived = materialise(spread.select("tree", F.col("message.at").alias("at"), path), f"proofs{k}")


def proofs(made: Manifest) -> DataFrame:
    """(id, leaf, claim, subroot, path) for each row of the manifest; ``path`` leads from its leaf to the root."""
    none = F.array().cast("array<struct<before: string, after: string>>")
    whole = made.trees.select("tree", F.col("digest").alias("subroot"))
    if made.above:
        start = made.trees.limit(1).select(F.lit(TOP).cast("long").alias("tree"), none.alias("path"))
        tops = _backward(made.above, start).select(F.col("message.of").alias("tree"), "path")
    else:
        tops = made.trees.select("tree", none.alias("path"))
    tops = materialise(tops, "tops")
    out = made.rows.where("n = 1").join(tops, "tree").select("tree", F.struct("digest", "row").alias("message"), "path")
    if made.levels:
        more = _backward(made.levels, tops)
        out = out.unionByName(more.select("tree", F.struct("message.digest", "message.row").alias("message"), "path"))
    return out.join(whole, "tree").select("message.row.id", F.col("message.digest").alias("leaf"), "message.row.claim", "subroot", "path")


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a proof, left to right, level by level."""
    return hashed(F.transform(path, lambda s: F.concat(s["before"], s["after"])))


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(path, start, lambda digest, s: F.sha2(F.concat(s["before"], digest, s["after"]).cast("binary"), 256))


def checked(docs: DataFrame, fields: list[str], group: str = "source", order: str = "doc_id", claims: dict[str, Column] | None = None) -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root, verified: every row's proof, tried on the claimed leaf where there is one.

    See :func:`manifest` for nulls, ties and repeated rows.  Empty and very long texts are leaves like any other.  Empty table: no rows.
    """
    made = manifest(docs, fields, group, order, claims)
    found, root = proofs(made), F.lit(made.root).cast("string")
    out = found.select(
        "id", "leaf", "subroot", root.alias("root"), proof_digest(F.col("path")).alias("proof_sha256"),
        folded(F.coalesce("claim", "leaf"), F.col("path")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
