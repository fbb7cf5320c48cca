"""Reports and statistics: one pass of partial and final aggregation each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timedtext.sources.segment_io import settled
from timedtext.sources.shared import shared_folder


def completion_status(expected: DataFrame, output: DataFrame) -> DataFrame:
    """media_id, complete, current, expected. expected has media_id and expected (null: unknown, then complete)."""
    now = output.groupBy("media_id").agg(F.count(F.lit(1)).alias("current"))
    rows = expected.join(now, "media_id", "left").withColumn("current_rows", F.coalesce("current", F.lit(0)))
    complete = F.when(F.col("current").isNull(), False).when(F.col("expected").isNull(), True).otherwise(F.col("current") >= F.col("expected"))
    return rows.select("media_id", complete.alias("complete"), F.col("current_rows").alias("current"), "expected")


#: Ranges into which a round of exact_median deals its values, and values that are few enough to be looked at themselves.
RANGES, FEW = 4096, 4096
#: What infinite values count as while ranges are told.
_LARGEST = 1.7976931348623157e308


def exact_median(df: DataFrame, column: str) -> float | None:
    """The median of a column of numbers, null and NaN left out; the mean of the two in the middle if they are two.

    A round deals the values to ranges between the least and the greatest and counts them (RANGES rows for any table); the
    next goes on with the range in which the middle lies, until its values are all equal or few. No task or driver
    ever holds more than that; each round reads the column once.
    """
    rows = df.select(F.col(column).cast("double").alias("v")).filter("v is not null and not isnan(v)")
    rows = rows.select(F.greatest(F.least("v", F.lit(_LARGEST)), F.lit(-_LARGEST)).alias("v"))
    n, low, high = rows.agg(F.count(F.lit(1)), F.min("v"), F.max("v")).first()
    if not n:
        return None

    def ranked(rank: int, low: float, high: float) -> float:
        """The value of a rank, from 0, among those from low to high."""
        while low < high:
            here = rows.filter(F.col("v").between(low, high))
            width = high / 2 - low / 2
            at = F.least(F.floor((F.col("v") / 2 - F.lit(low / 2)) / F.lit(width) * RANGES), F.lit(RANGES - 1)) if width else (F.col("v") > low).cast("long")
            counts = here.groupBy(at.alias("at")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
            for r in sorted(counts, key=lambda r: r["at"]):
                if rank < r["n"]:
                    low, high = r["low"], r["high"]
                    break
                rank -= r["n"]
            if low < high and r["n"] <= FEW:
                return sorted(x["v"] for x in rows.filter(F.col("v").between(low, high)).collect())[rank]
        return low

    told = [ranked(k, low, high) for k in sorted({(n - 1) // 2, n // 2})]
    told = [v if abs(v) < _LARGEST else v * 2 for v in told]
    return told[0] if len(told) == 1 else told[0] / 2 + told[1] / 2


def selection_report(hyps: DataFrame, chosen: DataFrame) -> DataFrame:
    """Counts, statistics of all scores (unparsable ones left out), and of the chosen similarities; medians are exact."""
    spark, folder = hyps.sparkSession, shared_folder(hyps.sparkSession, "scores")
    score = F.col("score").cast("string").try_cast("double")
    hyps = settled(hyps.select("segment_id", F.when(~F.isnan(score), score).alias("score")), f"{folder}/all")
    chosen = settled(chosen.select(F.col("similarity").cast("double").alias("similarity")), f"{folder}/chosen")
    a = hyps.agg(F.count_distinct("segment_id").alias("segments"), F.count(F.lit(1)).alias("hypotheses"), F.avg("score").alias("score_mean"), F.stddev_pop("score").alias("score_std"))
    b = chosen.agg(F.avg("similarity").alias("similarity_mean"), F.max("similarity").alias("similarity_max"), F.min("similarity").alias("similarity_min"))
    medians = spark.createDataFrame([(exact_median(hyps, "score"), exact_median(chosen, "similarity"))], "score_median double, similarity_median double")
    every = a.unionByName(b, allowMissingColumns=True).unionByName(medians, allowMissingColumns=True)  # one row each
    return every.agg(*(F.max(c).alias(c) for c in every.columns)).withColumn("hypotheses_per_segment", F.col("hypotheses") / F.col("segments"))


def quality_summary(report: DataFrame, threshold: float) -> DataFrame:
    """report: similarity and corrected_similarity (null: not corrected)."""
    after = F.coalesce("corrected_similarity", "similarity")
    rows = report.agg(F.count(F.lit(1)).alias("segments"), F.count_if(F.col("similarity") < threshold).alias("issues"), F.count_if(F.col("corrected_similarity") > F.col("similarity")).alias("corrected"), F.avg("similarity").alias("mean_before"), F.avg(after).alias("mean_after"))
    gain = F.when(F.coalesce(F.col("mean_before"), F.lit(0.0)) == 0, 0.0).otherwise((F.col("mean_after") - F.col("mean_before")) / F.col("mean_before") * 100)
    return rows.withColumn("improvement_percent", gain)


def polish_summary(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.avg("before").alias("mean_before"), F.avg("after").alias("mean_after"))


def merge_stats(raw: DataFrame, merged: DataFrame) -> DataFrame:
    """Per medium: rows read, rows with valid times, rows after merging."""
    valid = (F.col("start_sec") <= F.col("end_sec")) & F.col("start_sec").isNotNull()
    a = raw.groupBy("media_id").agg(F.count(F.lit(1)).alias("rows_read"), F.count_if(valid).alias("rows_valid"))
    b = merged.groupBy("media_id").agg(F.count(F.lit(1)).alias("rows_final"))
    return a.join(b, "media_id", "left").na.fill(0, ["rows_final"])


def entity_count(segments: DataFrame) -> DataFrame:
    return segments.agg(F.coalesce(F.sum(F.size("entity_map")), F.lit(0)).alias("entities"))


def grammar_change_count(rows: DataFrame, before: str, after: str) -> DataFrame:
    return rows.agg(F.count_if(~F.col(before).eqNullSafe(F.col(after))).alias("changed"), F.count(F.lit(1)).alias("total"))


def overlap_stats(plan: DataFrame) -> DataFrame:
    """Per medium: clips, clips that overlapped, clips that failed (no length)."""
    failed = F.count_if(F.col("actual_sec").isNull() | (F.col("actual_sec") <= 0)) if "actual_sec" in plan.columns else F.lit(0).cast("long")
    return plan.groupBy("media_id").agg(F.count(F.lit(1)).alias("clips"), F.count_if("had_overlap").alias("overlaps"), failed.alias("failed"))


def limit_excess_stats(pieces: DataFrame, limit: int) -> DataFrame:
    """pieces: media_id, seq, piece, text. Pieces over the limit, and segments that were split."""
    by_segment = pieces.groupBy("media_id", "seq").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.length("text") > limit).alias("over"))
    return by_segment.agg(F.coalesce(F.sum("over"), F.lit(0)).alias("over_limit"), F.count_if(F.col("n") > 1).alias("segments_split"))
