"""Row filters, repairs and projections of segment tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timedtext.functions import text as tx


def drop_invalid_times(df: DataFrame) -> DataFrame:
    """Times must be there and start must not be after end."""
    return df.filter("start_sec is not null and end_sec is not null and start_sec <= end_sec")


def drop_empty_spans(df: DataFrame) -> DataFrame:
    return df.filter((F.col("start_sec") < F.col("end_sec")) & (F.trim(F.coalesce("text", F.lit(""))) != ""))


def valid_segments(df: DataFrame) -> DataFrame:
    return df.filter(tx.valid_segment(F.col("start_sec"), F.col("end_sec"), F.col("text")))


def min_tts_length(df: DataFrame, least: int = 5) -> DataFrame:
    return df.filter(F.length(F.trim(F.coalesce("text", F.lit("")))) >= least)


def repair_times(df: DataFrame) -> DataFrame:
    """Null times are 0; where start is not before end, or a time is negative, the end is a second after the start."""
    df = df.withColumn("start_sec", F.coalesce("start_sec", F.lit(0.0))).withColumn("end_sec", F.coalesce("end_sec", F.lit(0.0)))
    bad = (F.col("start_sec") >= F.col("end_sec")) | (F.col("start_sec") < 0) | (F.col("end_sec") < 0)
    start = F.greatest("start_sec", F.lit(0.0))
    return df.withColumn("end_sec", F.when(bad, start + 1).otherwise(F.col("end_sec"))).withColumn("start_sec", start)


def reorder_core_columns(df: DataFrame, text: str | None = None) -> DataFrame:
    """Core columns first, the text replaced by another column if given; other columns keep their order."""
    if text:
        df = df.withColumn("text", F.col(text)).drop(text)
    core = ["media_id", "seq", "start_sec", "end_sec", "text"]
    return df.select(*(c for c in core if c in df.columns), *(c for c in df.columns if c not in core))


def explode_sentences(df: DataFrame, sentences: str = "sentences") -> DataFrame:
    """One row per sentence; piece counts from 0."""
    kept = [c for c in df.columns if c not in (sentences, "text")]
    return df.select(*kept, F.posexplode(sentences).alias("piece", "text"))
