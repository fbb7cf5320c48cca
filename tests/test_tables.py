"""Sources, joins, attempts, n-best selection, batches, streaming, and the entry points."""

import random
import re
import statistics
import time

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from timedtext import fixtures as fx
from timedtext import queries as segment_queries
from timedtext.operators import aggregates, attempts, batches, filters, hypotheses, joins, windows
from timedtext.plans import composites
from timedtext.sources import segment_io
from timedtext.sources.shared import shared_folder
from timedtext.streaming import streams

DATA = "/root/testdata/sf0.001"
SEGMENT = "media_id long, seq int, start_sec double, end_sec double, text string"


def test_sources(spark, tmp_path):
    f = tmp_path / "s.csv"
    f.write_text("Start Zeit|EndZeit |Text|path|id\n0:00:01|0:00:02|a|p1|7\nx|y\n0:00:03|0:00:04| b |p2|8\n0:00:01|0:00:02|a|p3|7\n0:00:09|0:00:10|c||9\n")
    df = segment_io.read_segments(spark, str(f))
    assert df.columns == ["startzeit", "endzeit", "text", "path", "id"] and df.count() == 5
    (tmp_path / "bad.csv").write_text("a|b\n1|2\n")
    with pytest.raises(ValueError):
        segment_io.read_segments(spark, str(tmp_path / "bad.csv"))
    m = {r.original_id: r.chunk_path for r in segment_io.read_manifest(spark, str(f)).collect()}
    assert m == {7: "p3", 8: "p2"}
    numbered = segment_io.read_segments_numbered(spark, str(f)).orderBy("id").collect()
    assert [(r.id, r.text) for r in numbered] == [(0, "a"), (1, "b"), (2, "a"), (3, "c")]
    (tmp_path / "t.csv").write_text("startzeit|endzeit|text\n0:01:01.5|62|x\n1|2|3|4\n")
    assert [tuple(r) for r in segment_io.read_segments_strict(spark, str(tmp_path / "t.csv")).collect()] == [(61.5, 62.0, "x")]


def test_lines_are_numbered_over_blocks(spark, tmp_path):
    """Files of many blocks, empty lines and line ends of two kinds."""
    for name, end in (("a", "\n"), ("b", "\r\n")):
        lines = ["Startzeit|Endzeit|Text"] + [f"0:00:0{i % 10}|0:01:00|{name} {i}" if i % 7 else ("" if i % 2 else "broken") for i in range(3000)]
        (tmp_path / f"{name}.csv").write_bytes(end.join(lines).encode())
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        got = segment_io.read_segments_numbered(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    for name in "ab":
        mine = sorted((r.id, r.text) for r in got if r.file.endswith(f"{name}.csv"))
        assert mine == list(enumerate(f"{name} {i}" for i in range(3000) if i % 7))


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("0:00:01", "0:00:02", 'a "quoted" text')], "startzeit string, endzeit string, text string")
    for _ in range(2):
        segment_io.write_segments(rows, f"{tmp_path}/out")
    assert segment_io.read_segments(spark, f"{tmp_path}/out").collect() == rows.collect()
    nested = spark.createDataFrame([(1, "s", [("a", 0.5), ("b", 0.4)]), (None, "s", [("c", 0.1)]), (2, "t", [])], "segment_id long, source_text string, hypotheses array<struct<text:string,score:double>>")
    segment_io.append_hypotheses(nested, f"{tmp_path}/h")
    segment_io.append_hypotheses(nested, f"{tmp_path}/h")
    assert spark.read.parquet(f"{tmp_path}/h").count() == 4
    segment_io.write_speech_intervals(spark.createDataFrame([(1, 0.5, 1.0)], "media_id long, start_sec double, end_sec double"), f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").select("start", "end").first() == (0.5, 1.0)


def test_hypotheses_of_old_and_new_runs(spark, tmp_path):
    path = f"{tmp_path}/h"
    old = spark.createDataFrame([(1, "s", [("a", 0.5)])], "segment_id int, source_text string, hypotheses array<struct<text:string,score:float>>")
    new = "segment_id long, source_text string, hypotheses array<struct<text:string,score:double,is_best:boolean,detail:struct<tokens:long,more:struct<x:int>>>>"
    wider = "segment_id long, source_text string, hypotheses array<struct<text:string,beam_score_raw:float,detail:struct<more:struct<y:int>,tokens:int>>>"
    segment_io.append_hypotheses(old, path)
    segment_io.append_hypotheses(spark.createDataFrame([(2, "t", [("b", 0.25, True, (7, (1,))), ("c", None, False, None)])], new), path)
    segment_io.append_hypotheses(spark.createDataFrame([(3, "u", [("d", -1.0, ((5,), 9))])], wider), path)
    segment_io.append_hypotheses(old, path)  # what has fewer columns than the table
    rows = segment_io.read_hypotheses(spark, path)
    assert rows.columns == [*segment_io.HYPOTHESIS, "detail"]
    told = rows.select("segment_id", "text", "score", "beam_score_raw", "is_best", "detail.tokens", "detail.more.x", "detail.more.y").collect()
    none = (None,) * 5
    assert sorted(map(tuple, told), key=str) == [(1, "a", 0.5, *none), (1, "a", 0.5, *none), (2, "b", 0.25, None, True, 7, 1, None), (2, "c", None, None, False, None, None, None), (3, "d", None, -1.0, None, 9, None, 5)]
    clash = spark.createDataFrame([(4, "v", [("e", "x")])], "segment_id long, source_text string, hypotheses array<struct<text:string,detail:string>>")
    with pytest.raises(ValueError, match="detail"):
        segment_io.append_hypotheses(clash, path)


def test_no_line_is_lost(spark, tmp_path):
    f = tmp_path / "s.csv"
    lines = ["0:00:01|0:00:02|a", "0:00:01|0:00:02", "x|0:00:02|b", "0:00:03|0:99:00|c", "0:00:03|0:00:04|d|e", '0:00:05|0:00:06|"q | r"', "0:00:07|0:00:08|", "|0:00:02|"]
    f.write_text("\n".join(["Start Zeit|EndZeit |Text", *lines]) + "\n")
    good, bad = segment_io.read_segments_checked(spark, str(f))
    assert sorted((r.start_sec, r.end_sec, r.text) for r in good.collect()) == [(1.0, 2.0, "a"), (5.0, 6.0, "q | r"), (7.0, 8.0, "")]
    assert sorted((r.reason, r.line) for r in bad.collect()) == sorted([("malformed", lines[1]), ("start does not parse", lines[2]), ("end does not parse", lines[3]), ("malformed", lines[4]), ("start does not parse", lines[7])])
    assert (good.count(), bad.count(), bad.select("reason").distinct().count()) == (3, 5, 3)  # whatever columns are asked for
    with pytest.raises(ValueError):
        segment_io.read_segments_checked(spark, str(f), ["a", "b", "text"])


def test_joins(spark):
    seg = spark.createDataFrame([(1, 0, 1.2, 2.0, "one text here"), (1, 1, 1.7, 3.0, "..."), (1, 2, 5.0, 6.0, "the end")], SEGMENT)
    done = seg.filter("seq = 0")
    assert [r.seq for r in joins.resume_by_start(seg, done).orderBy("seq").collect()] == [1, 2]
    assert [r.seq for r in joins.resume_by_start(seg, done, by_start=True).collect()] == [2]
    assert [r.seq for r in joins.resume_by_id(seg, done).collect()] == [2]
    hits = joins.glossary_hits(seg, spark.createDataFrame([("end", "Ende"), ("ex", "x"), ("THE", "der")], "term string, options string")).collect()
    assert [(r.seq, r.glossary) for r in hits] == [(2, "- THE: der\n- end: Ende")]


def test_word_lists_of_any_length(spark):
    """Lists beyond the bound are joined, with the same rows."""
    texts = ["one text here", "...", "the end", "The É of straße, ÉND", "a", "", None, "x.y (z) [q] \\E end", "one text here"]
    seg = spark.createDataFrame([(1, k, 0.0, 1.0, t) for k, t in enumerate(texts)], SEGMENT)
    words = spark.createDataFrame([(w,) for w in ["one", "text", "ext h", "the", "É", "e", "straße", "", "zzz", "(z)", "one", None]], "word string")
    terms = [("end", "Ende"), ("THE", "der"), ("É", "e"), ("x.y", "p"), ("text here", "t"), ("a", "b"), ("nd", "no"), ("E", "f"), (None, "n")]
    glossary = spark.createDataFrame(terms, "term string, options string")
    for hits, listed in ((joins.dictionary_hits, words), (joins.glossary_hits, glossary)):
        small, large = (sorted(map(repr, hits(seg, listed, **k).collect())) for k in ({}, {"most": 2}))
        assert small == large and len(small) >= 4
    got = {r.seq: r.words for r in joins.dictionary_hits(seg, words, most=3).collect()}
    assert got == {k: sorted((w for w in {"one", "text", "ext h", "the", "É", "e", "straße", "zzz", "(z)"} if w in t), key=lambda w: (-len(w), w)) for k, t in enumerate(texts) if t and any(w in t for w in ["one", "e", "É"])}
    assert joins.dictionary_hits(seg, words.limit(0)).count() == 0


def test_glossary_against_regular_expressions(spark):
    rng = random.Random(8)
    parts = ["end", "the", "É", "x.y", "a", "++", "c++", "New", "York", "new york", "it's", "_", "3", "\\E", "(z)", "straße"]
    terms = sorted({"".join(rng.choice(parts) + rng.choice(["", " ", "-"]) for _ in range(rng.randint(1, 3))).strip() for _ in range(120)} - {""})
    texts = ["".join(rng.choice(parts) + rng.choice([" ", "", ", ", "-"]) for _ in range(rng.randint(0, 12))) for _ in range(200)]
    seg = spark.createDataFrame([(1, k, 0.0, 1.0, t) for k, t in enumerate(texts)], SEGMENT)
    glossary = spark.createDataFrame([(t, f"o{k}") for k, t in enumerate(terms)], "term string, options string")
    want = {}
    for k, text in enumerate(texts):
        lines = [f"- {t}: o{j}" for j, t in enumerate(terms) if re.search(rf"\b{re.escape(t.lower())}\b", text.lower())]
        if lines:
            want[k] = "\n".join(sorted(lines))
    for most in (1000, 1):
        assert {r.seq: r.glossary for r in joins.glossary_hits(seg, glossary, most).collect()} == want
    assert any("++" in x for x in want.values())


def test_a_long_word_list_takes_one_pass(spark):
    """A hundred times the words do not take a multiple of the time."""
    seg = spark.range(20_000).selectExpr("id as media_id", "0 as seq", "concat(repeat('lorem ipsum dolor ', 20), id) as text")
    took = {}
    for n in (1_000, 100_000):
        words = spark.range(n).selectExpr("concat('w', id, 'x') as word").union(spark.createDataFrame([("dolor 77",)], "word string"))
        began = time.time()
        assert joins.dictionary_hits(seg, words).count() == seg.filter("text like '%dolor 77%'").count()
        took[n] = time.time() - began
    assert took[100_000] < 3 * took[1_000] + 3


@pytest.mark.parametrize("few", [0, 4096])
def test_exact_median(spark, monkeypatch, few):
    monkeypatch.setattr(aggregates, "FEW", few)
    monkeypatch.setattr(aggregates, "RANGES", 8)
    inf, rng = float("inf"), random.Random(2)
    cases = [[], [None, float("nan")], [3.0], [1.0, 2.0], [5.0] * 9 + [7.0] * 9, [1e-300, 1e300, 2e300], [-inf, inf, 4.0], [inf, inf], [-1.7e308, 1.7e308, 0.0, 5e-324], [rng.gauss(0, 1) for _ in range(501)], [rng.choice([0.1, 0.2, 1e9]) for _ in range(500)] + [None], [-0.0, 0.0, 5e-324, 1e-323]]
    for values in cases:
        got = aggregates.exact_median(spark.createDataFrame([(v,) for v in values], "x double"), "x")
        kept = [v for v in values if v is not None and v == v]
        assert got == (statistics.median(kept) if kept else None), values


def test_merging_goes_on_until_nothing_changes(spark):
    """Every medium as by rounds one after the other, though each stops by itself; and the rows that are counted on the way."""
    rng, rows = random.Random(4), []
    for m in range(12):
        at = 0.0
        for k in range(rng.randint(1, 30)):
            at = round(at + rng.choice([0.0, 0.0, 0.3, 0.6, 1.0]), 2)
            end = round(at + rng.choice([0.2, 0.7, 1.4, 3.0]), 2)
            rows.append((m, k, at, end, rng.choice(["", "ein Wort. Zwei Worte.", "noch eines, und mehr davon", "x" * 50, "kurz", "A b. C d. E f."])))
            at = end
    rows += [(20, 0, 1.0, 0.5, "falsch"), (20, 1, None, 1.0, "ohne Zeit")]
    df = spark.createDataFrame(rows, SEGMENT)
    plain = filters.drop_invalid_times(df).select(*composites.CORE)
    for _ in range(6):
        plain = segment_io.settled(composites._merge_round(plain, 5, 0.5, 40).select(*composites.CORE), shared_folder(spark, "plain"))
    want = plain
    for _ in range(8):
        want = segment_io.settled(windows.force_merge_short(want, 3, 3), shared_folder(spark, "plain"))
    got, report = composites.merge_report(df, 3, 5, 0.5, 40, 6)
    assert sorted(got.select(*composites.CORE).collect()) == sorted(want.select(*composites.CORE).collect())
    assert sorted(composites.merge_transcript(df, 3, 5, 0.5, 40, 6).select(*composites.CORE).collect()) == sorted(got.select(*composites.CORE).collect())
    r = report.first()
    assert (r.rows_read, r.rows_valid, r.rows_final) == (len(rows), len(rows) - 2, got.count()) and r.rows_protected > 0
    assert r.rows_protected == sum(len(x.text) > 40 and len(x.text.split()) < 3 for x in plain.collect())


def test_attempts(spark):
    tries = spark.createDataFrame([(1, 0, "a", 0.4), (1, 1, "b", 0.8), (1, 2, "c", 0.9), (2, 0, "d", 0.2), (2, 1, "i cannot", 0.9), (3, 0, "e", 0.0), (4, 0, "f", 0.5), (4, 1, "g", 0.5)], "segment_id long, attempt int, text string, similarity double")
    src = spark.createDataFrame([(i, f"s{i}") for i in range(1, 6)], "segment_id long, source_text string")
    got = {r.segment_id: (r.text, r.attempt) for r in attempts.first_acceptable_attempt(tries, src, 0.7).collect()}
    assert got == {1: ("b", 1), 2: ("s2", None), 3: ("s3", None), 4: ("f", 0), 5: ("s5", None)}
    pairs = spark.createDataFrame([(1, "x", 0.799), (4, "y", 0.6), (5, "z", 0.99)], "segment_id long, text string, similarity double")
    fixed = {r.segment_id: (r.text, r.flag) for r in attempts.best_correction(pairs, tries, 0.9).collect()}
    assert fixed == {1: ("c", "AUTO-CORRECTED"), 4: ("y", "CHECK MANUALLY")}


def test_combined_score(spark):
    rows = [(1, 0, "a", -1.0, 2, 0.5), (1, 1, "b", -4.0, 4, 0.9), (1, 2, "c", 0.0, 0, 1.0), (2, 0, "d", -1.0, 1, 0.1)]
    df = spark.createDataFrame(rows, "segment_id long, hypothesis_id int, text string, beam_score_raw double, num_tokens int, similarity double")
    got = {(r.segment_id, r.hypothesis_id): (r.score, r.is_best) for r in hypotheses.combined_hypothesis_score(df, 0.4).collect()}
    assert got == {(1, 0): (0.4, False), (1, 1): (0.6, True), (1, 2): (None, False), (2, 0): (0.0, True)}


def murmur3(data, seed=42):
    """The published 32-bit hash."""
    mask, h = (1 << 32) - 1, seed
    turn = lambda x, k: (x << k | x >> (32 - k)) & mask
    body = len(data) // 4 * 4
    for i in range(0, body, 4):
        k = turn(int.from_bytes(data[i : i + 4], "little") * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask
        h = (turn(h ^ k, 13) * 5 + 0xE6546B64) & mask
    if data[body:]:
        h ^= turn(int.from_bytes(data[body:], "little") * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask
    h ^= len(data)
    for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> shift) * by & mask
    return h ^ h >> 16


def test_text_vectors(spark):
    texts = ["One two one", "straße, É!", "", None, "a a a a"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for r in batches.text_vectors(df, 64).collect():
        words = re.findall(r"\w+", (texts[r.i] or "").lower())
        want = [0.0] * 64
        for w in words + [" ".join(p) for p in zip(words, words[1:], strict=False)]:
            h = murmur3(w.encode())
            want[(h - (1 << 32) if h >> 31 else h) % 64] += 1
        norm = sum(x * x for x in want) ** 0.5
        assert r.embedding == pytest.approx([x / norm if norm else 0.0 for x in want], abs=1e-6)


def test_map_batches_keeps_failing_rows(spark):
    def fussy(texts):
        if "bad" in texts:
            raise ValueError
        return [t.upper() for t in texts]

    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "c")], "i int, text string").coalesce(1)
    assert [r.text for r in batches.map_batches(df, fussy).orderBy("i").collect()] == ["A", "bad", "C"]
    with pytest.raises(Exception):
        batches.map_batches(df, fussy, on_error="raise").collect()


def test_registered_resume_keeps_files_out_of_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams.stream_segments, "__defaults__", (1,))
    for k, day in enumerate((9, 5, 1)):
        rows = [(k, 10 * k + i, f"2024-01-0{day} 00:00:0{i}", "x") for i in range(3)]
        spark.createDataFrame(rows, "user_id long, event_id long, ts string, event_type string").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/events.parquet")
    got = segment_queries.stream_resume(spark, f"file://{tmp_path}").collect()
    assert sorted((r.media_id, r.seq) for r in got) == [(k, 10 * k + i) for k in range(3) for i in range(3)]


def test_assembly_plan(spark):
    rows = [(1, 0, 0.0, 2.0, "a", "p0", 4.0), (1, 1, 2.0, 4.0, "b", "p1", 1.0)]
    plan = composites.assembly_plan(spark.createDataFrame(rows, SEGMENT + ", chunk_path string, actual_sec double")).orderBy("seq").collect()
    assert [(r.speed, r.capped, r.had_overlap) for r in plan] == [(1.3, True, False), (0.9, True, True)]


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert rows and {r.lang for r in rows} >= {"de", "en"}
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", [
    "close_context", "combined_hypothesis_score", "first_acceptable_attempt", "proportional_times", "quality_summary", "protect_spans",
    "split_text", "force_merge_short", "close_context_dedup", "merge_transcript", "format_for_tts", "refine_segments", "assembly_plan", "entity_issues",
])
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "events", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = __spark_entry__.queries()[name](spark, DATA)
    want = con.execute(__spark_entry__.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    clean = lambda row: tuple(round(float(v), 4) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in row)
    key = lambda row: tuple(map(str, row))
    assert sorted((clean(r) for r in got.select(names).collect()), key=key) == sorted(map(clean, want.fetchall()), key=key)


def in_both(spark, folder, name, **tables):
    """A query's rows and its SQL's, over tables of (columns, rows)."""
    con = duckdb.connect()
    for t, (columns, rows) in tables.items():
        spark.createDataFrame(rows, columns).coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet/*.parquet')")
    got = __spark_entry__.queries()[name](spark, str(folder))
    want = con.execute(__spark_entry__.oracle_sql()[name])
    return sorted(map(tuple, got.select([c[0] for c in want.description]).collect())), sorted(want.fetchall())


SHARP_S = [(k + 1, "de", f"{c}heit und mehr.\n{c} ist lang, {'wort ' * 90}. {c}ung ende") for k, c in enumerate("ßäaﬁŉᾳᾀǆdÿ")]


@pytest.mark.parametrize("name", ["finish_translation", "format_translation", "refine_segments"])
def test_capitals_are_those_of_sql(spark, tmp_path, name):
    got, want = in_both(spark, tmp_path, name, documents=("doc_id long, lang string, text string", SHARP_S))
    assert got == want and any("ẞheit" in str(r) for r in got)


def test_capitals_after_a_language_prefix(spark, tmp_path):
    rows = [(k, 0, "user", f"{p}{t}") for k, (_, _, t) in enumerate(SHARP_S) for p in ("", "de: ", ". ")]
    got, want = in_both(spark, tmp_path, "strip_lang_prefix", conversations=("conv_id long, turn long, role string, text string", rows))
    assert got == want and any(r[-1].startswith("ẞ") for r in got)


def test_halves_are_rounded_as_by_sql(spark):
    values = [27.068749999999998, 27.06875, 2.00005, 1.00015, 0.00005, 4.99999e-5, 123456.00005, 1e18, 1e305, 0.0, *((k * 7919 % 99991) / 13 * 39 / 160 for k in range(2000))]
    values = [*values, *(-v for v in values)]
    got = segment_queries._rounded(spark.createDataFrame([(v,) for v in values], "x double"), "x").collect()
    want = duckdb.connect().execute("select round(x, 4) from (select unnest(?::double[]) as x)", [values]).fetchall()
    assert list(map(str, (r.x for r in got))) == list(map(str, (x for x, in want)))
    assert segment_queries._rounded(spark.createDataFrame([(float("nan"),), (float("inf"),), (None,)], "x double"), "x").filter("x is null or isnan(x) or x > 1e300").count() == 3


def test_fixture_sql_equals_spark(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    want = con.execute(fx.with_sql("segments") + "select media_id, seq, start_sec, end_sec, text from segments").fetchall()
    assert sorted(map(tuple, fx.segments(spark, DATA).drop("lang").collect())) == sorted(want)
