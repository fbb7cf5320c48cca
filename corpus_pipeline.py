"""Corpus pipeline: toxic documents go, one document of each near-duplicate group stays, contaminated documents go,
secrets are masked, and what is left is packed into training sequences.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps with the columns of ``documents``; the last
one returns the packing. The caller writes each result as Parquet and hands what it reads back to the next stage.

Every stage reads COLUMNS only, so further columns of any name are ignored, and the empty table gives the empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timedtext.llm import common, decontamination, near_dedup, packing, secrets, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Least similarity of near copies, and bands enough that a pair of just that is missed with probability 7e-6.
NEAR_PERCENT, NEAR_BANDS = 80, 30


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 by the classifier, learnt from the labels.

    Null and empty texts are scored as texts without words; a score of just 0.5 goes. Repeated rows share one score, so
    all of them stay or go. Rows with a null doc_id are scored and never learnt from. Without labels all stay.
    """
    scored = toxicity.score_toxicity(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.filter("score < 0.5").select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: that with the least doc_id. Of equal rows one stays; rows with a null
    doc_id can not be told apart, so all different ones stay if one does."""
    kept = near_dedup.near_duplicates(docs, bands=NEAR_BANDS, percent=NEAR_PERCENT).filter("kept").select("doc_id").distinct()
    rows = docs.select(*COLUMNS, F.xxhash64("text").alias("text_hash"))
    return rows.join(kept, rows["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi").dropDuplicates(["doc_id", "text_hash"]).select(COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window. Rows are told apart by a hash of id and text, so null ids are no matter."""
    keyed = docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("key"))
    given = keyed.select(F.col("key").alias("doc_id"), "text")
    hits = decontamination.contamination(given, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter(F.size("hit") > 0)
    return keyed.join(hits.select(F.col("doc_id").alias("key")), "key", "left_anti").select(COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, each secret replaced by a mark; n_chars follows the text where it changes.

    Null and empty texts stay as they are, with their n_chars; repeated rows are masked alike. Secrets of two kinds that
    overlap become one mark.
    """
    found = secrets.findings(docs.select(COLUMNS))
    text = secrets.redacted(F.col("text"), F.col("spans"))
    return found.select("doc_id", text.alias("text"), "lang", "source", F.when(F.size("spans") > 0, F.length(text).cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece: all rows packed into sequences of 1024 tokens. Null and empty texts are pieces of their end alone;
    repeated rows are packed as often as they stand there; long texts are cut; of equal fits any may be taken."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", pack_documents),
]

#: Packing and the learnt scores are beyond SQL; tests hold the stages against plain models.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.written(docs)
    return docs
