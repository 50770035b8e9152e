"""A training corpus from documents: filtered, without near copies and benchmark items, mixed, and written as ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read again as
the next one's docs. All but the last return the columns of documents.

Defined cases are those of the operators. Rows that repeat doc_id and text share every decision, but for
the join of near copies, which keeps one of them (any, if their other columns differ), and the mix, which draws row by row.
Extra columns of any type and name pass all stages but the last and are never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import common, decontaminate, jaccard, line_quality, mixing, queries as registered, token_files

#: Score of the quality classifier from which a document stays.
LEAST_QUALITY = 0.7


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    name = f"{common.prefix_for(docs.columns)}score"
    scored = line_quality.with_score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), docs.columns, name)
    return scored.where(F.col(name) >= LEAST_QUALITY).select(*docs.columns)


def join_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: the one of least doc_id, and of equal doc_ids of least hash; nulls come last. Texts without shingles stay."""
    name = common.prefix_for(docs.columns)
    key, place = f"{name}key", f"{name}row"
    # Only the list of rows that go away is needed after this; the tables of the join are not left to the stages that follow.
    with common.temporary(spark) as keep:
        rows = jaccard.join_components(docs, by_row=True)
        parts = rows.where("component is not null")
        least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash"))
        first = parts.groupBy("component").agg(least.alias("first"))
        own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
        # The row that stays goes by doc_id and hash as well; where it is there several times, one is kept.
        named = parts.join(first, "component").groupBy("doc_id", "text_hash").agg(F.every(own).alias("stays"), F.count("*").alias("rows"))
        away = keep(common.written(named.where("not stays or rows > 1").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "stays"), "near-copies"))
    n_away = away.count()

    def match(side):
        return docs["doc_id"].cast("long").eqNullSafe(side["_id"]) & (F.xxhash64(docs["text"]) == side["_hash"])

    repeated = away.where("stays")
    once = docs.join(common.broadcast_if(away, n_away, jaccard.BROADCAST_IDS), match(away), "left_anti")
    again = docs.join(common.broadcast_if(repeated, n_away, jaccard.BROADCAST_IDS), match(repeated), "left_semi")
    # Any of them: columns that can't be ordered, such as maps, may be among the others.
    one_each = again.groupBy(F.col("doc_id"), F.xxhash64("text").alias(key)).agg(F.first(F.struct(*docs.columns)).alias(place)).select(f"{place}.*")
    return once.unionByName(one_each)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, read back: doc_id, start, n_tokens, ids_crc32."""
    return token_files.encode_to_files(docs, registered.tokenizer_path())


STAGES = [
    ("quality classifier", classify),
    ("n-gram Jaccard join", join_near),
    ("benchmark decontamination", decontaminated),
    ("mixing sources to target weights", mixed),
    ("token-ID / binary output", encoded),
]

#: SQL cannot express the classifier's field; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, from documents."""
    docs = common.documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES[:-1]):
        after = common.written(stage(spark, docs, sf_dir), "stage")
        if k:
            common.removed(spark, docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
