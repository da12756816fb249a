"""Registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from steepgrid.llm import (
    extraction, hyperdim, language_model, line_dedup, manifest, mixing, ngram_join, packing, periodic, quality_model,
    quality_rules, sharding, topk,
)
from steepgrid.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]


def op1_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, "documents", sf_dir))


def op3_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(read_table(spark, "documents", sf_dir))


def op4_rff_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score_quality(read_table(spark, "documents", sf_dir), read_table(spark, "labels", sf_dir))


def op5_risk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.filter_by_rules(read_table(spark, "documents", sf_dir), read_table(spark, "labels", sf_dir))


def op10_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_by_shingles(read_table(spark, "documents", sf_dir))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, "documents", sf_dir).select("doc_id", "text")
    return line_dedup.drop_near_lines(docs, exact_words=line_dedup.EXACT_WORDS)


def op9_attention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_texts(read_table(spark, "documents", sf_dir))


def op2_cover_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_products(read_table(spark, "embeddings", sf_dir))


def op6_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_rates(read_table(spark, "documents", sf_dir), read_table(spark, "labels", sf_dir))


def op8_block_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract_main_text(read_table(spark, "pages", sf_dir))


CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of all documents, against documents of which one in five has its capital letters lowered."""
    docs = read_table(spark, "documents", sf_dir)
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    changed = F.when(chosen, F.translate("text", CAPITALS, CAPITALS.lower())).otherwise(F.col("text"))
    proven = manifest.build_manifest(docs, observed={"text": changed}, paths=False)
    return proven.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.col("proof").alias("proof_sha256"),
        F.col("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )


def op12_hyperdim_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperdim.predict_language(read_table(spark, "documents", sf_dir))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's runs and collapsed text, repetitions planted in one document of ten."""
    found = periodic.periodic_runs(periodic.planted(read_table(spark, "documents", sf_dir)))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", periodic.strongest_run()).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_bm25_packing, op2_cover_tree_topk, op3_byte_shards, op4_rff_quality, op5_risk_rules, op6_soft_mixing, op7_line_dedup,
        op8_block_labels, op9_attention_scores, op10_shingle_join, op11_merkle_manifest, op12_hyperdim_language, op13_periodic_runs,
    )
}

# CRC-32 of the id's digits, then a tree per source and one over the sources, level by level.
MERKLE_SQL = """
WITH RECURSIVE docs AS (
  SELECT doc_id, source, list_reduce(
      list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT)),
      lambda crc, byte: list_reduce(
          list_concat([xor(crc, byte)], range(8)),
          lambda c, k: xor(c >> 1, (c & 1) * 3988292384)),
      4294967295) AS crc, lang, n_chars, text
  FROM documents),
leaves AS (
  SELECT doc_id, source,
    sha256(concat(
      coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-'),
      coalesce(octet_length(encode(source)) || ':' || source, '-'),
      coalesce(octet_length(encode(lang)) || ':' || lang, '-'),
      coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-'),
      coalesce(octet_length(encode(text)) || ':' || text, '-'))) AS leaf,
    sha256(concat(
      coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-'),
      coalesce(octet_length(encode(source)) || ':' || source, '-'),
      coalesce(octet_length(encode(lang)) || ':' || lang, '-'),
      coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-'),
      coalesce(octet_length(encode(text)) || ':' || CASE WHEN xor(crc, 4294967295) % 5 = 0
        THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END, '-'))) AS found
  FROM docs),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves),
tree AS (
  SELECT source, 0 AS level, place, leaf AS digest, count(*) OVER (PARTITION BY source) AS width FROM placed
  UNION ALL
  SELECT source, level, place, digest, count(*) OVER (PARTITION BY source) FROM (
    SELECT source, level + 1 AS level, place // 16 AS place, sha256(string_agg(digest, '' ORDER BY place)) AS digest
    FROM tree WHERE width > 1 GROUP BY source, level, place // 16)),
sides AS (
  SELECT source, level, place,
    coalesce(string_agg(digest, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(digest, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM tree WHERE width > 1 WINDOW run AS (PARTITION BY source, level, place // 16 ORDER BY place)),
subroots AS (
  SELECT source, digest AS subroot, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS place
  FROM tree WHERE width = 1),
top AS (
  SELECT 0 AS level, place, subroot AS digest, count(*) OVER () AS width FROM subroots
  UNION ALL
  SELECT level, place, digest, count(*) OVER () FROM (
    SELECT level + 1 AS level, place // 16 AS place, sha256(string_agg(digest, '' ORDER BY place)) AS digest
    FROM top WHERE width > 1 GROUP BY level, place // 16)),
top_sides AS (
  SELECT level, place,
    coalesce(string_agg(digest, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(digest, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM top WHERE width > 1 WINDOW run AS (PARTITION BY level, place // 16 ORDER BY place)),
steps AS (
  SELECT p.source, p.place, s.level, s.before, s.after
  FROM placed p JOIN sides s ON p.source IS NOT DISTINCT FROM s.source AND s.place = p.place // CAST(power(16, s.level) AS BIGINT)
  UNION ALL
  SELECT p.source, p.place, 1000 + t.level, t.before, t.after
  FROM placed p JOIN subroots r ON p.source IS NOT DISTINCT FROM r.source
  JOIN top_sides t ON t.place = r.place // CAST(power(16, t.level) AS BIGINT)),
paths AS (
  SELECT source, place, string_agg(before || after, '' ORDER BY level) AS proof,
    list({'b': before, 'a': after} ORDER BY level) AS path
  FROM steps GROUP BY source, place),
proven AS (
  SELECT p.doc_id, p.leaf, r.subroot, (SELECT digest FROM top WHERE width = 1) AS root,
    sha256(coalesce(h.proof, '')) AS proof_sha256,
    list_reduce(coalesce(h.path, []), lambda node, s: {'b': sha256(s.b || node.b || s.a), 'a': ''}, {'b': p.found, 'a': ''}).b
      AS folded_root
  FROM placed p JOIN subroots r ON p.source IS NOT DISTINCT FROM r.source
  LEFT JOIN paths h ON p.source IS NOT DISTINCT FROM h.source AND p.place = h.place)
SELECT *, folded_root = root AS verified FROM proven
"""

ORACLES: dict[str, str] = {"op11_merkle_manifest": MERKLE_SQL}
