"""Streams: order of arrival, state that ends, and appending exactly once."""

import random
from datetime import timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from timedtext.operators import windows
from timedtext.streaming import streams

SEGMENT = "media_id long, seq int, start_sec double, end_sec double, text string"


def arrive(spark, path, files):
    """Files of rows that arrive one after the other; ts is 1 700 000 000 s and start_sec."""
    for rows in files:
        df = spark.createDataFrame(rows, SEGMENT).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("start_sec")))
        df.coalesce(1).write.mode("append").parquet(path)
    return df.schema


def run(spark, df, path, mode="append"):
    """The rows of a stream that is run until its input ends, with their batch_id."""
    with streams.with_rocksdb(spark):
        streams.stream_append(df, f"{path}/rows", f"{path}/state", mode=mode).trigger(availableNow=True).start().awaitTermination()
    return streams.read_appended(spark, f"{path}/rows", df.schema).drop("writer").collect()


def spoken(seed, media=5, n=80):
    rng, rows = random.Random(seed), []
    for m in range(media):
        at = 0.0
        for k in range(n):
            at = round(at + rng.choice([0.0, 0.0, 0.3, 0.5, 0.75, -0.25 if k else 0.0]), 3)
            end = round(at + rng.choice([0.0, 0.5, 1.0, 2.0]), 3)
            rows.append((m, k, max(at, 0.0), end, rng.choice(["", " ", "Wort", "zwei Worte", "a longer text of words", None])))
            at = end
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_gap_merge_in_any_order_of_files(spark, tmp_path, seed):
    """Rows that arrive up to 40 seconds too late, in files of a few rows, give the rows of the batch operator."""
    rows, rng = spoken(seed), random.Random(seed)
    rows.sort(key=lambda r: r[2] + rng.uniform(0, 40))
    files = [rows[i : i + 70] for i in range(0, len(rows), 70)]
    for part in files:
        rng.shuffle(part)
    end = [(99, 0, 100_000.0, 100_001.0, "end")]
    schema = arrive(spark, f"{tmp_path}/in", [*files, end, [(0, 999, 3.0, 4.0, "too late")]])
    merged = streams.stream_gap_merge(streams.stream_segments(spark, f"{tmp_path}/in", schema, 1), 0.5, 10, 60, "45 seconds")
    got = [r for r in run(spark, merged, tmp_path) if r.media_id != 99]
    want = windows.gap_merge(spark.createDataFrame(rows, SEGMENT), 0.5, 10, 60).collect()
    key = lambda r: (r.media_id, r.seq, r.start_sec, r.end_sec, r.text, r.n_rows)
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert len({r.batch_id for r in got}) > 2  # chunks go out as the watermark moves, not only at the end


def test_gap_merge_goes_on_after_a_stop(spark, tmp_path):
    rows = spoken(7, media=2, n=40)
    rows.sort(key=lambda r: r[2])
    read = lambda schema: streams.stream_gap_merge(streams.stream_segments(spark, f"{tmp_path}/in", schema, 1), 0.5, 10, 60)
    schema = arrive(spark, f"{tmp_path}/in", [rows[:45]])
    run(spark, read(schema), tmp_path)
    arrive(spark, f"{tmp_path}/in", [rows[45:], [(99, 0, 100_000.0, 100_001.0, "end")]])
    got = [r for r in run(spark, read(schema), tmp_path) if r.media_id != 99]
    want = windows.gap_merge(spark.createDataFrame(rows, SEGMENT), 0.5, 10, 60).collect()
    assert sorted((r.media_id, r.seq, r.end_sec, r.text) for r in got) == sorted((r.media_id, r.seq, r.end_sec, r.text) for r in want)


def test_progress_against_what_is_expected(spark, tmp_path):
    files = [[(1, k, float(k), k + 1.0, "x") for k in range(3)], [(1, 3, 3.0, 4.0, "x"), (2, 0, 3.0, 4.0, "x")], [(3, 0, 4.0, 5.0, "x")]]
    schema = arrive(spark, f"{tmp_path}/in", files)
    expected = spark.createDataFrame([(1, 4), (2, 2), (4, 9), (3, None)], "media_id long, expected long")
    read = streams.stream_segments(spark, f"{tmp_path}/in", schema, 1)
    got = run(spark, streams.stream_progress(read, expected), tmp_path, "update")
    assert sorted((r.media_id, r.done, r.expected, r.complete) for r in got) == [(1, 3, 4, False), (1, 4, 4, True), (2, 1, 2, False), (3, 1, None, True)]


def test_progress_is_forgotten_in_time(spark, tmp_path):
    files = [[(1, 0, 0.0, 1.0, "x"), (2, 0, 0.0, 1.0, "x")], [(1, 1, 50.0, 51.0, "x")], [(9, 0, 100.0, 101.0, "x")], [(1, 2, 101.0, 102.0, "x"), (2, 1, 101.0, 102.0, "x")]]
    schema = arrive(spark, f"{tmp_path}/in", files)
    read = streams.stream_segments(spark, f"{tmp_path}/in", schema, 1)
    got = run(spark, streams.stream_progress(read, delay="0 seconds", ttl=timedelta(seconds=60)), tmp_path, "update")
    assert max(r.done for r in got if r.media_id == 1) == 3  # its last row was 50 seconds before
    assert max(r.done for r in got if r.media_id == 2) == 1  # forgotten, and begun anew


def test_batches_are_appended_once(spark, tmp_path):
    path = f"{tmp_path}/table"
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, t string")
    for k, part in ((0, rows), (1, rows), (0, rows), (1, rows.filter("k = 1"))):
        streams.append_batch(part, k, path, "one")
    streams.append_batch(rows, 0, path, "two")
    got = streams.read_appended(spark, path, rows.schema).collect()
    assert sorted((r.writer, r.batch_id, r.k) for r in got) == [("one", 0, 1), ("one", 0, 2), ("one", 1, 1), ("two", 0, 1), ("two", 0, 2)]


def test_an_uncommitted_batch_is_written_again_once(spark, tmp_path):
    schema = arrive(spark, f"{tmp_path}/in", [[(1, k, float(k), k + 1.0, "x")] for k in range(3)])

    def once():
        read = streams.stream_segments(spark, f"{tmp_path}/in", schema, 1)
        streams.stream_append(read, f"{tmp_path}/rows", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        return sorted(r.seq for r in streams.read_appended(spark, f"{tmp_path}/rows", schema).collect())

    assert once() == [0, 1, 2]
    for f in Path(f"{tmp_path}/state/commits").glob("*2*"):  # as if it had failed between writing and committing
        f.unlink()
    assert once() == [0, 1, 2]
    arrive(spark, f"{tmp_path}/in", [[(1, 3, 3.0, 4.0, "x")]])
    assert once() == [0, 1, 2, 3]


def test_other_streams(spark, tmp_path):
    rows = [(1, k % 5, float(k), k + 1.0, "x") for k in range(10)]
    schema = arrive(spark, f"{tmp_path}/in", [rows])
    read = lambda: streams.stream_segments(spark, f"{tmp_path}/in", schema)
    assert len(run(spark, streams.stream_resume(read()), f"{tmp_path}/resumed")) == 5
    parts = run(spark, streams.stream_parts(read(), 6), f"{tmp_path}/parts", "update")
    assert sum(r.n for r in parts) == 20
    sessions = run(spark, streams.stream_gap_sessions(read()), f"{tmp_path}/sessions", "complete")
    assert sum(r.n for r in sessions) == 10
