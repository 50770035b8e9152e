"""The registered queries of the corpus operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, common, conversations, decontaminate, jaccard, language, line_quality, line_runs, mixing, oracles, pitman_yor, private_data, rules, secrets, token_files


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(common.documents(spark, sf_dir).select("doc_id", "text", "source"))
    return plan.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_copies") * F.col("_size")).alias("taken"))


def op2_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_data.find_private(common.documents(spark, sf_dir))


def op3_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.score_quality(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_language(common.documents(spark, sf_dir))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.encode_to_files(common.documents(spark, sf_dir), tokenizer_path())


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return rules.quality_rules(common.documents(spark, sf_dir), labels.where("quality = 1"), junk=labels.where("quality = 0"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_components(common.documents(spark, sf_dir))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(common.documents(spark, sf_dir))


def op9_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_runs.delete_repeated_runs(common.documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_deleted").alias("n_deleted"), F.col("_runs").alias("deleted_lines"), "text")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", "similarity", "start", F.col("size").alias("n_words"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return conversations.repair(conversations.damaged(rows), rows)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(common.documents(spark, sf_dir))


def op13_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.lm_scores(common.documents(spark, sf_dir))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


#: The final level is the share left by the capped sources, by weight, for the first number of capped sources (in
#: order of cap by weight) at which no other source is above its cap.
OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(text, '')) AS digest,
    row_number() OVER (PARTITION BY doc_id, md5(coalesce(text, '')) ORDER BY source) AS number FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM s
), o AS (
  SELECT *, row_number() OVER (ORDER BY source_size * 2.0 / weight, source NULLS LAST) AS place FROM w
), c AS (
  SELECT n.k, (SELECT sum(source_size) * 1.5::DOUBLE FROM o) - coalesce(sum(CASE WHEN place <= k THEN source_size * 2.0::DOUBLE END), 0) AS room,
    sum(CASE WHEN place > k THEN weight END) AS free
  FROM o, (SELECT unnest(range((SELECT count(*) FROM o)))AS k) n GROUP BY n.k
), level AS (
  SELECT c.k, c.room, c.free FROM c
  WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.place > c.k AND o.source_size * 2.0 < o.weight * (c.room / c.free))
  ORDER BY c.k LIMIT 1
), t AS (
  SELECT source, source_size, (CASE WHEN source_size = 0 THEN 0 WHEN place <= k THEN source_size * 2.0
    ELSE least(room * weight / free, source_size * 2.0) END)::DOUBLE AS target
  FROM o, level
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('17:' || coalesce(d.doc_id::VARCHAR, '') || ':' || digest || ':' || number), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": OP1_SQL, "op11_conversation_repair": oracles.structure_sql(), "op12_collocations": oracles.COLLOCATIONS}
