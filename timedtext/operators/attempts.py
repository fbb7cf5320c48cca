"""Choosing among ordered attempts at a segment: translations, corrections and polished versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timedtext.functions.text import is_refusal
from timedtext.functions.timecodes import max_chars_for_duration


def first_acceptable_attempt(attempts: DataFrame, sources: DataFrame, threshold: float) -> DataFrame:
    """segment_id, text, similarity, attempt: the first attempt that reaches the threshold, else the best up to the end.

    attempts: segment_id, attempt, text, similarity; sources: segment_id, source_text. Refusals and similarities that
    are not positive don't count; a refusal at the last attempt makes the source text the result, as does having none.
    """
    one = Window.partitionBy("segment_id")
    refused = is_refusal(F.col("text"))
    rows = attempts.withColumn("refused", refused).withColumn("last", F.max("attempt").over(one))
    stop = F.min(F.when(~F.col("refused") & (F.col("similarity") >= threshold), F.col("attempt"))).over(one)
    rows = rows.withColumn("stop", F.coalesce(stop, F.col("last"))).withColumn("reached", stop.isNotNull()).filter("attempt <= stop")
    counts = ~F.col("refused") & (F.col("similarity") > 0)
    best = rows.groupBy("segment_id").agg(
        F.max_by(F.struct("text", "similarity", "attempt"), F.when(counts, F.struct("similarity", -F.col("attempt")))).alias("best"),
        F.bool_or(F.col("refused") & (F.col("attempt") == F.col("last")) & ~F.col("reached")).alias("refused"),
    )
    out = sources.join(best, "segment_id", "left")
    takes = F.col("best").isNotNull() & ~F.coalesce("refused", F.lit(False))
    return out.select("segment_id", F.when(takes, F.col("best.text")).otherwise(F.col("source_text")).alias("text"), F.when(takes, F.col("best.similarity")).otherwise(F.lit(0.0)).alias("similarity"), F.when(takes, F.col("best.attempt")).alias("attempt"))


def best_correction(pairs: DataFrame, attempts: DataFrame, threshold: float, least_gain: float = 0.002) -> DataFrame:
    """Per segment below the threshold the correction kept: in order, one replaces the best when it gains more than
    least_gain; it is accepted if the best beats the original. pairs: segment_id, text, similarity."""
    low = pairs.filter(F.col("similarity") < threshold)
    tried = attempts.groupBy("segment_id").agg(F.sort_array(F.collect_list(F.struct("attempt", "text", "similarity"))).alias("tries"))
    rows = low.join(tried, "segment_id", "left")
    start = F.struct(F.col("similarity").cast("double").alias("similarity"), F.col("text").alias("text"), F.lit(None).cast("int").alias("attempt"))

    def step(acc, t):
        better = (t["similarity"] > acc["similarity"] + least_gain) & ~is_refusal(t["text"])
        return F.when(better, F.struct(t["similarity"].cast("double").alias("similarity"), t["text"].alias("text"), t["attempt"].cast("int").alias("attempt"))).otherwise(acc)

    best = F.aggregate(F.coalesce("tries", F.array().cast("array<struct<attempt:int,text:string,similarity:double>>")), start, step)
    rows = rows.withColumn("best", best)
    accepted = F.col("best.similarity") > F.col("similarity")
    return rows.select("segment_id", F.col("similarity").alias("original_similarity"), F.col("best.similarity").alias("similarity"), F.col("best.text").alias("text"), F.col("best.attempt").alias("attempt"), F.when(accepted, "AUTO-CORRECTED").otherwise("CHECK MANUALLY").alias("flag"))


def polish_decision(pairs: DataFrame, attempts: DataFrame, skip_threshold: float = 0.9, slack: float = 0.1) -> DataFrame:
    """status, text and similarities of each segment: SKIPPED, UNCHANGED, REJECTED (too long to be read and longer than
    before) or POLISHED. pairs: segment_id, text, similarity, duration; attempts below original - slack don't count."""
    tried = attempts.select("segment_id", "attempt", F.col("text").alias("try_text"), F.col("similarity").alias("try_similarity"))
    rows = pairs.join(tried, "segment_id", "left")
    ok = (F.col("try_similarity") >= F.col("similarity") - slack) & ~is_refusal(F.col("try_text"))
    better = ok & (F.col("try_similarity") > F.col("similarity"))
    best = rows.groupBy("segment_id", "text", "similarity", "duration").agg(F.max_by(F.struct("try_text", "try_similarity"), F.when(better, F.struct("try_similarity", -F.col("attempt")))).alias("best"))
    new = F.col("best.try_text")
    limit = max_chars_for_duration(F.col("duration"))
    skipped = F.col("similarity") > skip_threshold
    long = (F.length(new) > limit) & (F.length(new) > F.length("text"))
    status = F.when(skipped, "SKIPPED").when(new.isNull() | (new == F.col("text")), "UNCHANGED").when(long, "REJECTED").otherwise("POLISHED")
    rows = best.withColumn("status", status)
    polished = F.col("status") == "POLISHED"
    return rows.select("segment_id", "status", F.when(polished, new).otherwise(F.col("text")).alias("text"), F.col("similarity").alias("before"), F.when(polished, F.col("best.try_similarity")).otherwise(F.col("similarity")).alias("after"))
