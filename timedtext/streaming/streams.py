"""Streaming forms of reading, resuming, merging, counting and part assignment.

Watermarks are on event time ``ts``; rows later than the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import LongType, StringType, StructField, StructType

from timedtext.sources.shared import importable


def stream_segments(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1000) -> DataFrame:
    """Parquet files as they come; the sink's checkpoint remembers which are done."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def stream_resume(segments: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each (media_id, seq) once."""
    return segments.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["media_id", "seq"])


def stream_parts(segments: DataFrame, length: int, overlap: int = 3, delay: str = "1 hour") -> DataFrame:
    """Rows per medium and overlapping range of event time."""
    ranges = F.window("ts", f"{length} seconds", f"{length - overlap} seconds")
    return segments.withWatermark("ts", delay).groupBy("media_id", ranges).agg(F.count(F.lit(1)).alias("n")).select("media_id", F.col("window.start").alias("part_start"), F.col("window.end").alias("part_end"), "n")


def stream_gap_sessions(segments: DataFrame, max_gap: str = "1 second", delay: str = "1 hour") -> DataFrame:
    """Sessions of a medium without limits of length: begin, end (the gap after the last row) and rows.

    In append mode a session goes out when the watermark has passed its end.
    """
    return segments.withWatermark("ts", delay).groupBy("media_id", F.session_window("ts", max_gap)).agg(F.count(F.lit(1)).alias("n")).select("media_id", F.col("session_window.start").alias("begin"), F.col("session_window.end").alias("end"), "n")


MERGED = "media_id long, seq long, start_sec double, end_sec double, text string, n_rows int"
#: A row that waits (ts in microseconds), and the present chunk with what ts is ahead of its times.
HELD = "ts long, seq long, start_sec double, end_sec double, text string"
CHUNK = "seq long, start_sec double, end_sec double, text string, n_rows int, ahead long"


class OrderedMerge(StatefulProcessor):
    """Rows of a medium wait until the watermark has passed them, and are then merged in order.

    State of a medium: the rows later than the watermark, as a list, and the present chunk. No row that is still to come
    can be before the watermark, so whatever passed it is in order, however files and micro-batches cut the stream.
    """

    def __init__(self, max_gap: float, max_dur: float, max_chars: int) -> None:
        self.max_gap, self.max_dur, self.max_chars = max_gap, max_dur, max_chars

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", HELD)
        self.chunk = handle.getValueState("chunk", CHUNK)

    def _wake(self, micros: float) -> None:
        self.handle.registerTimer(int(-(-micros // 1000)) + 1)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            micros = pdf["ts"].astype("datetime64[us]").astype("int64")
            text = pdf["text"].fillna("")
            self.held.appendList(list(zip(micros.tolist(), pdf["seq"].tolist(), pdf["start_sec"].astype(float).tolist(), pdf["end_sec"].astype(float).tolist(), text.tolist(), strict=True)))
            self._wake(micros.min())
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = list(self.held.get()) if self.held.exists() else []
        ready = sorted((tuple(r) for r in waiting if r[0] <= passed), key=lambda r: (r[2], r[1]))
        out: list[tuple] = []
        now = tuple(self.chunk.get()) if self.chunk.exists() else None
        for ts, seq, start, end, text in ready:
            text = text.strip(" ")
            joined = f"{now[3]} {text}" if now and now[3] and text else (now[3] if now else "") or text
            if now and 0 <= start - now[2] <= self.max_gap and end - now[1] <= self.max_dur and len(joined) <= self.max_chars:
                now = (now[0], now[1], end, joined, now[4] + 1, int(ts - start * 1e6))
            else:
                if now and now[3]:
                    out.append((key[0], *now[:5]))
                now = (seq, start, end, text, 1, int(ts - start * 1e6))
        if ready:
            rest = [tuple(r) for r in waiting if r[0] > passed]
            if rest:
                self.held.put(rest)
                self._wake(min(r[0] for r in rest))
            else:
                self.held.clear()
        if now and (now[2] + self.max_gap) * 1e6 + now[5] < passed:  # no row to come can join
            if now[3]:
                out.append((key[0], *now[:5]))
            self.chunk.clear()
        elif now:
            self.chunk.update(now)
            self._wake((now[2] + self.max_gap) * 1e6 + now[5])
        if out:
            yield pd.DataFrame(out, columns=["media_id", "seq", "start_sec", "end_sec", "text", "n_rows"]).astype({"n_rows": "int32"})

    def close(self) -> None:
        pass


def stream_gap_merge(segments: DataFrame, max_gap: float = 0.5, max_dur: float = 15.0, max_chars: int = 150, delay: str = "10 seconds") -> DataFrame:
    """The rows of gap_merge over arriving segments, for append mode, in whatever order they arrive within the delay.

    ts is the event time of start_sec: some time of the medium's beginning, and the seconds. Rows later than the watermark
    are dropped. A chunk goes out when a row that passed the watermark does not fit, or when the watermark has passed its
    end by the gap. Needs the RocksDB state store (with_rocksdb).
    """
    importable(segments.sparkSession)
    rows = segments.withWatermark("ts", delay).select("media_id", F.col("seq").cast("long").alias("seq"), "start_sec", "end_sec", "text", "ts")
    return rows.groupBy("media_id").transformWithStateInPandas(OrderedMerge(max_gap, max_dur, max_chars), MERGED, "append", "eventTime")


class Progress(StatefulProcessor):
    """Rows of a medium so far; forgotten when the watermark is a time to live past its last row."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.done = handle.getValueState("done", "done long, until long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        done, until = self.done.get() if self.done.exists() else (0, None)
        seen = until
        if until is not None and until <= timerValues.getCurrentWatermarkInMs():  # its time is over, though its timer comes after these rows
            done = 0
        for pdf in rows:
            done += len(pdf)
            last = int(pdf["ts"].max().timestamp() * 1000) + self.ttl_ms
            until = last if until is None else max(until, last)
        if until != seen:
            if seen is not None:
                self.handle.deleteTimer(seen)
            self.handle.registerTimer(until)
        self.done.update((done, until))
        yield pd.DataFrame({"media_id": [key[0]], "done": [done]})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.done.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_progress(segments: DataFrame, expected: DataFrame | None = None, delay: str = "1 hour", ttl: timedelta = timedelta(days=7)) -> DataFrame:
    """media_id, done, expected, complete of each medium that got rows, for update mode.

    expected (media_id, expected) is a table that is joined to the stream; a medium that it lacks, or has with null, counts
    as complete. A medium's count is kept until the watermark (the latest ts, less delay) is ttl past its last row. Rows that
    may arrive twice are to go through stream_resume first. Needs the RocksDB state store (with_rocksdb).
    """
    importable(segments.sparkSession)
    rows = segments.withWatermark("ts", delay).select("media_id", "ts").groupBy("media_id")
    done = rows.transformWithStateInPandas(Progress(int(ttl.total_seconds() * 1000)), "media_id long, done long", "update", "eventTime")
    if expected is None:
        return done.withColumn("expected", F.lit(None).cast("long")).withColumn("complete", F.lit(True))
    told = done.join(expected.select("media_id", F.col("expected").cast("long").alias("expected")), "media_id", "left")
    return told.select("media_id", "done", "expected", F.coalesce(F.col("done") >= F.col("expected"), F.lit(True)).alias("complete"))


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def with_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside keep their state in RocksDB, on disk, and go on to do so; the setting is put back at the end."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def append_batch(rows: DataFrame, batch_id: int, path: str, writer: str = "stream") -> None:
    """Appends a micro-batch to a Parquet table, once: if it is tried again, its rows replace what it has written before.

    The table is partitioned by writer and batch_id; only this batch's partition is replaced, when the job commits.
    """
    told = rows.withColumn("writer", F.lit(writer)).withColumn("batch_id", F.lit(batch_id).cast("long"))
    told.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("writer", "batch_id").parquet(path)


def stream_append(rows: DataFrame, path: str, checkpoint: str, writer: str = "stream", mode: str = "append") -> DataStreamWriter:
    """A stream whose finished rows are appended to a table exactly once, whatever fails in between; call start() on it.

    The checkpoint says which batches are committed; one that was written but not committed is written again under the
    same id. Several streams append to one table under different writers.
    """
    sink = rows.writeStream.option("checkpointLocation", checkpoint).outputMode(mode)
    return sink.foreachBatch(lambda batch, k: append_batch(batch, k, path, writer))


def read_appended(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of a table that stream_append has written (none where nothing came yet), with their writer and batch_id."""
    return spark.read.schema(StructType([*schema.fields, StructField("writer", StringType()), StructField("batch_id", LongType())])).parquet(path)
