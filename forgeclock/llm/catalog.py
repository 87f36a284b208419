"""Registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forgeclock.llm import (
    fertility, linededup, merkle, ngrams, packing, pii, quality, secrets, severity, sharding, simhash, templates, variants,
)
from forgeclock.llm.common import lowered, reachable, table
from forgeclock.llm.sql import merkle_sql, variants_sql
from forgeclock.shared import materialise

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = reachable(fn)
    return QUERIES[fn.__name__]


@query
def op1_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = templates.leaks(docs, table(spark, sf_dir, "benchmark"), size=8, lexical=4, coverage=0.5)
    counts = "matched", "n_windows", "changed_slots"
    return found.select("doc_id", "item_id", *counts, "coverage", F.lit(True).alias("contaminated"))


@query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), capacity=1024)


@query
def op3_forest_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.findings(docs, secrets.train(docs))


@query
def op4_positive_unlabelled_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model, threshold=0.3).select("row.doc_id", "held_out", "score", "predicted")


@query
def op5_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.ruled(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


@query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


#: ``{documents}`` is the table; white space and letters are spelled out since SQL's own classes are wider.
LINES_SQL = r"""
lines AS (
  SELECT doc_id, u.line, u.pos, translate(trim(u.line, E' \t\n\x0b\x0c\r'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM {documents}, unnest(string_split(coalesce(text, ''), E'\n')) WITH ORDINALITY AS u(line, pos)),
frequent AS (
  SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT l.*, f.k IS NOT NULL AND l.doc_id <> f.keeper AS gone FROM lines l LEFT JOIN frequent f ON f.k = l.k),
cut AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
         coalesce(string_agg(line, E'\n' ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept
  FROM marked GROUP BY doc_id)
"""

ORACLES["op6_line_dedup"] = "WITH " + LINES_SQL.format(documents="documents") + """
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM cut"""


@query
def op7_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = severity.train(docs, table(spark, sf_dir, "labels"))
    out = severity.scored(docs, model)
    return out.select("row.doc_id", F.col("severity").alias("expected_severity"), "grade", "p_toxic", "toxic")


@query
def op8_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pii.found(docs, pii.train(docs))
    joined = {"base_sha256": F.sha2(F.array_join("base", ","), 256), "spans": F.array_join("spans", ",")}
    return out.select("row.doc_id", *(f"n_{k}" for k in pii.KINDS), *(c.alias(n) for n, c in joined.items()))


@query
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), words=3, threshold=2)


@query
def op10_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_rows(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=8)
    law, grown = F.lit("rows").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return out.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown, F.col("number").alias("row_number"))


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return variants.variant_groups(docs, min_chars=7, min_count=2, every=31, factor=10)


ORACLES["op11_spelling_variants"] = variants_sql(min_chars=7, min_count=2, every=31, factor=10)

@query
def op12_lm_trie_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held.alias("held_out"))
    trie = ngrams.train(docs.where("NOT held_out").select("text"))
    out = ngrams.scored(docs, trie)
    size = F.lit(trie.n).cast("long").alias("train_tokens")
    out = materialise(out.select("row.doc_id", "row.held_out", "n_tokens", "n_known", size, "base_score", "score"), "scores")
    ngrams.delete(trie)
    return out


LEAF_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*LEAF_FIELDS)
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    claims = {"text": F.when(chosen, lowered(F.col("text"))).otherwise(F.col("text"))}
    return merkle.checked(docs, LEAF_FIELDS, claims=claims).withColumnRenamed("id", "doc_id")


ORACLES["op13_merkle_manifest"] = merkle_sql(LEAF_FIELDS, levels=4, above=3)
