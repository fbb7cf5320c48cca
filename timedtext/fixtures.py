"""Segment tables derived from the given ones: in Spark, and as SQL text of the same rows for DuckDB.

One document is one medium and one line one segment; hypotheses come from vectors, attempts and speech from events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SEGMENTS = """
with line as (select d.doc_id as media_id, d.lang, p.pos as seq, p.col as text from {documents} d lateral view posexplode(split(d.text, '\\\\n')) p as pos, col),
dur as (select media_id, lang, seq, text, 1 + length(text) div 15 as d, case when (media_id * 7 + seq * 3) % 4 = 0 then 1 else 0 end as g from line where trim(text) <> '')
select media_id, lang, seq, cast(sum(d + g) over (partition by media_id order by seq rows unbounded preceding) - d as double) as start_sec,
cast(sum(d + g) over (partition by media_id order by seq rows unbounded preceding) as double) as end_sec, text from dur
"""


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_SEGMENTS, documents=_read(spark, sf_dir, "documents"))


def raw_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as H:MM:SS; some bad, some with start and end swapped."""
    clock = lambda c: F.format_string("%d:%02d:%02d", F.floor(F.col(c) / 3600), F.floor(F.col(c) % 3600 / 60), F.floor(F.col(c) % 60))
    s = segments(spark, sf_dir)
    start, end = clock("start_sec"), clock("end_sec")
    swap = F.col("seq") % 50 == 9
    return s.select("media_id", "seq", F.when(F.col("seq") % 50 == 7, "bad").when(swap, end).otherwise(start).alias("startzeit"), F.when(swap, start).otherwise(end).alias("endzeit"), "text")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    return s.select("media_id", "seq", "start_sec", "end_sec", "text", F.concat(F.lit("chunk"), F.col("seq"), F.lit(".wav")).alias("chunk_path"), ((F.col("end_sec") - F.col("start_sec")) * (0.5 + (F.col("seq") % 13) / 10.0)).alias("actual_sec"))


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).filter("(media_id + seq) % 3 = 0").select("media_id", "seq", "start_sec")


def entity_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first word of every fourth segment is a person."""
    first = F.regexp_extract("text", r"(?U)^\w+", 0)
    s = segments(spark, sf_dir).filter("seq % 4 = 0").withColumn("w", first).filter("w <> ''")
    return s.select("media_id", "seq", F.lit(0).alias("start"), F.length("w").alias("end"), F.lit("PERSON").alias("label"), F.col("w").alias("text"))


def hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "embeddings").selectExpr("vec_id div 5 as segment_id", "vec_id % 5 as hypothesis_id", "concat('h', vec_id) as text", "-((vec_id * 37) % 101) / 10.0D as beam_score_raw", "cast(1 + vec_id % 17 as int) as num_tokens", "embedding")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hypotheses(spark, sf_dir).filter("hypothesis_id = 0").select("segment_id", F.concat(F.lit("s"), F.col("segment_id")).alias("source_text"), F.col("embedding").alias("source_embedding"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").selectExpr("event_id div 3 as segment_id", "cast(event_id % 3 as int) as attempt", "concat(event_type, event_id) as text", "round(((event_id * 7919) % 1000) / 1000.0D, 3) as similarity")


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of the attempts with a text, a similarity and a duration of their own."""
    return attempts(spark, sf_dir).filter("attempt = 0").selectExpr("segment_id", "concat('t', segment_id) as text", "round(((segment_id * 104729) % 1000) / 1000.0D, 3) as similarity", "cast(1 + segment_id % 7 as double) as duration")


def speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").selectExpr("user_id as media_id", "event_id as seq", "unix_micros(timestamp(ts)) / 1000000.0D as start_sec", "unix_micros(timestamp(ts)) / 1000000.0D + 1 + event_id % 9 as end_sec", "event_type")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "conversations").selectExpr("conv_id as media_id", "cast(turn as int) as seq", "role", "text")


#: The same tables as common table expressions for DuckDB.
SQL = {
    "segments": """line as (select doc_id as media_id, lang, cast(unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) as int) as seq, unnest(string_split(text, chr(10))) as text from documents),
dur as (select media_id, lang, seq, text, 1 + length(text) // 15 as d, case when (media_id * 7 + seq * 3) % 4 = 0 then 1 else 0 end as g from line where trim(text) <> ''),
segments as (select media_id, lang, seq, (sum(d + g) over (partition by media_id order by seq rows unbounded preceding) - d)::double as start_sec,
(sum(d + g) over (partition by media_id order by seq rows unbounded preceding))::double as end_sec, text from dur)""",
    "manifest": "manifest as (select media_id, seq, start_sec, end_sec, text, 'chunk' || seq || '.wav' as chunk_path, (end_sec - start_sec) * (0.5::double + (seq % 13)::double / 10.0::double) as actual_sec from segments)",
    "progress": "progress as (select media_id, seq, start_sec from segments where (media_id + seq) % 3 = 0)",
    "hypotheses": "hypotheses as (select vec_id // 5 as segment_id, vec_id % 5 as hypothesis_id, 'h' || vec_id as text, (-((vec_id * 37) % 101))::double / 10.0 as beam_score_raw, cast(1 + vec_id % 17 as int) as num_tokens, embedding from embeddings)",
    "attempts": "attempts as (select event_id // 3 as segment_id, cast(event_id % 3 as int) as attempt, event_type || event_id as text, round(((event_id * 7919) % 1000)::double / 1000.0, 3) as similarity from events)",
    "judged": "judged as (select segment_id, 't' || segment_id as text, round(((segment_id * 104729) % 1000)::double / 1000.0, 3) as similarity, (1 + segment_id % 7)::double as duration from attempts where attempt = 0)",
    "speech": "speech as (select user_id as media_id, event_id as seq, epoch_us(ts)::double / 1000000.0 as start_sec, epoch_us(ts)::double / 1000000.0 + 1 + event_id % 9 as end_sec, event_type from events)",
    "turns": "turns as (select conv_id as media_id, cast(turn as int) as seq, role, text from conversations)",
}


def with_sql(*names: str) -> str:
    return "with " + ",\n".join(SQL[n] for n in names) + "\n"
