"""n-best lists in long form: scoring, ranking and picking one hypothesis per segment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timedtext.functions.text import cosine


def best_hypothesis_by_score(hyps: DataFrame, score: str = "score") -> DataFrame:
    """segment_id, text, score, hypothesis_id of the first maximum."""
    key = F.struct(F.col(score), -F.col("hypothesis_id"))
    best = hyps.groupBy("segment_id").agg(F.max_by(F.struct("text", F.col(score).alias("score"), "hypothesis_id"), key).alias("x"))
    return best.select("segment_id", "x.*")


def match_source_to_hypotheses(sources: DataFrame, hyps: DataFrame) -> DataFrame:
    """hyps with the cosine of their vector to their segment's source vector (sources: segment_id, source_embedding)."""
    return hyps.join(sources, "segment_id").withColumn("similarity", cosine(F.col("source_embedding"), F.col("embedding"))).drop("source_embedding")


def best_hypothesis_by_similarity(sources: DataFrame, hyps: DataFrame) -> DataFrame:
    """segment_id, text, similarity, hypothesis_id: the first arg-max of the similarity to the source; where the source
    is empty, of the score, with similarity 0. Segment ids that are no integers are skipped; a blank score is 0.

    sources: segment_id, source_text, source_embedding; hyps: segment_id, hypothesis_id, text, score, embedding.
    """
    rows = hyps.withColumn("segment_id", F.col("segment_id").cast("string").try_cast("long")).filter("segment_id is not null")
    rows = rows.join(sources, "segment_id").withColumn("score", F.coalesce(F.col("score").cast("string").try_cast("double"), F.lit(0.0)))
    empty = F.trim(F.coalesce("source_text", F.lit(""))) == ""
    rows = rows.withColumn("similarity", F.when(empty, 0.0).otherwise(cosine(F.col("source_embedding"), F.col("embedding"))))
    key = F.struct(F.coalesce(F.when(empty, F.col("score")).otherwise(F.col("similarity")), F.lit(float("-inf"))), -F.col("hypothesis_id"))
    best = rows.groupBy("segment_id").agg(F.max_by(F.struct("text", "similarity", "hypothesis_id"), key).alias("x"))
    return best.select("segment_id", "x.*")


def combined_hypothesis_score(hyps: DataFrame, alpha: float, similarity: str | None = "similarity") -> DataFrame:
    """hyps with beam_norm, the combined score and is_best. beam_norm is the raw score by token, scaled to 0..1 in the
    segment; score = alpha * beam + (1 - alpha) * similarity scaled likewise; without similarity, the beam alone.

    Rows without tokens rank last and don't take part in the scaling.
    """
    one = Window.partitionBy("segment_id")

    def scaled(c):
        low, high = F.min(c).over(one), F.max(c).over(one)
        return (c - low) / F.when(high > low, high - low).otherwise(1.0)

    rows = hyps.withColumn("beam_norm", F.when(F.col("num_tokens") > 0, F.col("beam_score_raw") / F.col("num_tokens")))
    beam = scaled(F.col("beam_norm"))
    rows = rows.withColumn("score", beam if similarity is None else alpha * beam + (1 - alpha) * scaled(F.when(F.col("num_tokens") > 0, F.col(similarity))))
    first = Window.partitionBy("segment_id").orderBy(F.desc_nulls_last("score"), "hypothesis_id")
    return rows.withColumn("is_best", F.row_number().over(first) == 1)


def ranked_hypotheses(hyps: DataFrame, by: str = "similarity") -> DataFrame:
    return hyps.withColumn("rank", F.row_number().over(Window.partitionBy("segment_id").orderBy(F.desc_nulls_last(by), "hypothesis_id")))


def top_bottom_segments(rows: DataFrame, n: int = 3, by: str = "similarity") -> DataFrame:
    """The n highest and the n lowest, with kind top or bottom."""
    top = rows.orderBy(F.desc(by), "segment_id").limit(n).withColumn("kind", F.lit("top"))
    return top.unionByName(rows.orderBy(by, "segment_id").limit(n).withColumn("kind", F.lit("bottom")))


def apply_best(segments: DataFrame, best: DataFrame) -> DataFrame:
    """Texts replaced where the segment has a best hypothesis (best: segment_id, text)."""
    b = best.select("segment_id", F.col("text").alias("__best"))
    return segments.join(b, "segment_id", "left").withColumn("text", F.coalesce("__best", "text")).drop("__best")
