"""Operators over ordered segments against sequential models on random rows."""

import random
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from timedtext.operators import filters, windows
from timedtext.plans import composites

SEGMENT = "media_id long, seq int, start_sec double, end_sec double, text string"


def random_segments(seed, media=12, most=25, monotone=False):
    rng, rows = random.Random(seed), []
    words = ["und", "Aber", "gehe", "Haus", "running", "talked", "x", "Ende.", "so!", "Wort", "3", "langeswort" * 3]
    for m in range(media):
        at = 0.0
        for k in range(rng.randint(1, most)):
            start = at + rng.choice([0, 0, 0.25, 0.5, 1, -1 if not monotone and k else 0])
            end = start + rng.choice([0, 0.5, 1, 2, 4, 8])
            rows.append((m, k, max(start, 0.0), max(end, 0.0), " ".join(rng.choices(words, k=rng.choice([0, 1, 1, 2, 3, 6])))))
            at = end
    return rows


@pytest.fixture(scope="module", params=[1, 2])
def segments(spark, request):
    rows = random_segments(request.param)
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    return {m: sorted(x, key=lambda r: (r[2], r[1])) for m, x in by.items()}, spark.createDataFrame(rows, SEGMENT).repartition(3)


def compare(df, model, *columns):
    got = sorted(tuple(r[c] for c in columns) for r in df.collect())
    assert got == sorted(model)


def join(texts):
    return " ".join(t.strip() for t in texts if t.strip())


def test_gap_merge(segments):
    by, df = segments
    want = []
    for m, rows in by.items():
        now = None
        for _, s, a, b, t in rows:
            if now and 0 <= a - now[2] <= 0.5 and b - now[1] <= 10 and len(join([*now[3], t])) <= 60:
                now[2] = b
                now[3].append(t)
            else:
                if now:
                    want.append((m, now[0], now[1], now[2], join(now[3])))
                now = [s, a, b, [t]]
        want.append((m, now[0], now[1], now[2], join(now[3])))
    compare(windows.gap_merge(df, 0.5, 10, 60), [w for w in want if w[4]], "media_id", "seq", "start_sec", "end_sec", "text")


def test_force_merge_short(spark):
    rows = random_segments(5, monotone=True)
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(list(r))
    want = []
    for m, items in by.items():
        items, i = sorted(items, key=lambda r: (r[2], r[1])), 0
        while i < len(items):
            a, b, t = items[i][2:5]
            if (round(b - a, 3) < 3 or len(t.split()) < 3) and len(items) > 1:
                if i:
                    items[i - 1][3], items[i - 1][4] = b, join([items[i - 1][4], t])
                    del items[i]
                    continue
                if len(items) > 1:
                    items[0][3], items[0][4] = items[1][3], join([t, items[1][4]])
                    del items[1]
                    continue
            i += 1
        want += [(m, r[1], r[2], r[3], join([r[4]])) for r in items]
    compare(windows.force_merge_short(spark.createDataFrame(rows, SEGMENT), 3, 3), want, "media_id", "seq", "start_sec", "end_sec", "text")


@pytest.mark.parametrize("fn", ["close_context", "close_context_simple", "merge_lowercase"])
def test_close_context(segments, fn):
    by, df = segments
    want = []
    for m, rows in by.items():
        out = []
        for _, s, a, b, t in rows:
            t = t.strip()
            fragile = t[:1].islower() or (fn != "merge_lowercase" and t.split(" ")[0].lower() in windows.CONJUNCTIONS)
            if fn == "close_context":
                fragile = fragile and not (out and out[-1][3][-1].endswith((".", "!", "?")))
            if out and t and fragile:
                out[-1][2] = b
                out[-1][3].append(t)
            else:
                out.append([s, a, b, [t]])
        want += [(m, s, a, b, join(t)) for s, a, b, t in out]
    compare(getattr(windows, fn)(df), want, "media_id", "seq", "start_sec", "end_sec", "text")


def test_close_context_merges_maps(spark):
    rows = [(1, 0, 0.0, 1.0, "A b", {"k": ("x", "PERSON", 0, 1, "en")}), (1, 1, 1.0, 2.0, "und c", {"k": ("y", "PERSON", 0, 1, "en"), "j": ("z", "ORG", 0, 1, "en")})]
    df = spark.createDataFrame(rows, SEGMENT + ", entity_map map<string,struct<text:string,label:string,start:int,end:int,language:string>>")
    r = windows.close_context(df).collect()
    assert len(r) == 1 and r[0].text == "A b und c" and {k: v.text for k, v in r[0].entity_map.items()} == {"k": "y", "j": "z"}


def test_close_context_dedup(segments):
    by, df = segments
    want = []
    for m, rows in by.items():
        last = None
        for _, s, _, _, t in rows:
            t = t.strip()
            needs = t[:1].islower() or t.lower().startswith(tuple(windows.CONJUNCTIONS_LONG)) or not t.endswith((".", "!", "?"))
            if last is not None:
                if needs:
                    t = t.lstrip(" .")
                elif t.startswith(last):
                    t = t[len(last) :].lstrip(" .")
            if t and t[-1] not in ".!?":
                t += "."
            want.append((m, s, t))
            last = t
    compare(windows.close_context_dedup(df), want, "media_id", "seq", "text")


@pytest.mark.parametrize("mode", ["target", "actual"])
def test_timeline(segments, mode):
    by, df = segments
    want = []
    for m, rows in by.items():
        running = 0.0
        for _, s, a, b, _ in rows:
            eff = running + 0.2 if a < running else a
            gap = eff - running
            want.append((m, s, round(eff, 6), round(gap if gap > 0.02 else 0.0, 6), a < running))
            running = eff + (b - a if mode == "target" else (b - a) * 1.5)
    out = windows.timeline(df.withColumn("actual_sec", (F.col("end_sec") - F.col("start_sec")) * 1.5), mode=mode)
    out = out.withColumn("effective_start", F.round("effective_start", 6)).withColumn("silence", F.round("silence", 6))
    compare(out, want, "media_id", "seq", "effective_start", "silence", "had_overlap")
    order = sorted((r.media_id, r.effective_start, r.effective_end) for r in out.collect())
    assert all(x[0] != y[0] or y[1] >= x[1] for x, y in zip(order, order[1:], strict=False))


def test_timeline_of_clips_that_overlap_for_long(spark):
    """Islands are found by a bound on the running end: it must never open one too early."""
    rng, rows = random.Random(9), []
    for m in range(6):
        at = 0.0
        for k in range(300):
            at += rng.choice([0.0, 0.1, 0.3, 2.0]) * (m % 3 + 1)
            rows.append((m, k, round(at, 3), round(at + rng.choice([0.0, 0.05, 0.7, 1.3, -0.5]), 3), "x"))
    want = []
    for m in range(6):
        running = 0.0
        for r in sorted((r for r in rows if r[0] == m), key=lambda r: (r[2], r[1])):
            late = r[2] < running
            eff = running + 0.2 if late else r[2]
            want.append((m, r[1], round(eff, 6), late))
            running = eff + (r[3] - r[2])
    out = windows.timeline(spark.createDataFrame(rows, SEGMENT)).withColumn("effective_start", F.round("effective_start", 6))
    compare(out, want, "media_id", "seq", "effective_start", "had_overlap")


def test_folds_over_one_long_medium_are_linear(spark):
    """Twice the rows of a medium take about twice the time."""
    took = {}
    for n in (1_000, 15_000, 30_000):
        rows = spark.range(n).selectExpr("1L as media_id", "cast(id as int) as seq", "id * 1.0D as start_sec", "id * 1.0D + 1.3 as end_sec", "concat('Wort ', id) as text")
        began = time.time()
        for df in (windows.timeline(rows), windows.close_context_dedup(rows), windows.gap_merge(rows, 0.5, 1e9, 1 << 30)):
            df.write.format("noop").mode("overwrite").save()
        took[n] = time.time() - began
    assert took[30_000] < 3.2 * took[15_000]


def test_proportional_times_are_contiguous(spark):
    rows = [(1, 0, 10.0, 20.0, ["abcd", "ef", "ghijkl"]), (1, 1, 20.0, 26.0, ["", ""]), (1, 2, 30.0, 30.0, ["x"]), (2, 0, 0.0, 7.0, [])]
    df = spark.createDataFrame(rows, "media_id long, seq int, start_sec double, end_sec double, pieces array<string>")
    got = [(r.seq, r.piece, round(r.start_sec, 6), round(r.end_sec, 6)) for r in windows.proportional_times(df).orderBy("seq", "piece").collect()]
    assert got == [(0, 0, 10.0, round(10 + 40 / 12, 6)), (0, 1, round(10 + 40 / 12, 6), 15.0), (0, 2, 15.0, 20.0), (1, 0, 20.0, 23.0), (1, 1, 23.0, 26.0), (2, 0, 30.0, 30.0)]


def test_parts_and_samples(spark):
    media = spark.createDataFrame([(1, 100.0), (2, 27.0), (3, 0.0)], "media_id long, duration double")
    parts = windows.plan_parts(media, length=30.0).orderBy("media_id", "part").collect()
    assert [(r.media_id, r.start_sec, r.end_sec) for r in parts] == [(1, 0, 30), (1, 27, 57), (1, 54, 84), (1, 81, 100), (2, 0, 27)]
    equal = windows.plan_parts(media, parts=2).orderBy("media_id", "part").collect()
    assert [(r.media_id, r.start_sec, r.end_sec) for r in equal] == [(1, 0, 50), (1, 47, 100), (2, 0, 13.5), (2, 10.5, 27)]
    clips = spark.createDataFrame([(1, 0, 0.0, 2.0), (1, 1, 1.0, 0.05), (1, 2, 5.0, 1.0)], "media_id long, seq int, start_sec double, actual_sec double")
    plan = windows.overlap_crossfade_plan(clips, rate=100).orderBy("seq").collect()
    assert [(r.overlap, r.fade) for r in plan] == [(0, 0), (100, 5), (0, 0)]


def test_words_are_never_lost(segments):
    by, df = segments
    count = lambda d: sum(len(r.text.split()) for r in d.select("text").collect())
    valid = filters.drop_invalid_times(df)
    total = count(valid)
    assert count(composites.merge_transcript(df, max_chars=40, iterations=2)) == total
    assert count(composites.format_for_tts(df, 40, 3)) == total
    assert count(composites.format_for_tts_split(df, 40, 3)) == total

