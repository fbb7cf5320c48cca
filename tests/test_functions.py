"""Scalar functions on hand cases and against models."""

import random
import time

import pytest
from pyspark.sql import functions as F

from timedtext.functions import entities as en
from timedtext.functions import splitting as sp
from timedtext.functions import text as tx
from timedtext.functions import timecodes as tc
from timedtext.plans import composites


def each(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


def test_times(spark):
    given = ["1:02:03", "02:03", "45", "1:60:00", "bad", "", None, "1 day, 0:00:05", "2 days, 1:00:00", "100:00:01", " 0:00:07 s"]
    assert each(spark, given, tc.parse_time) == [3723, 123, 45, None, None, None, None, 86405, 176400, 360001, 7]
    assert each(spark, ["1:00:01,5", "1:02.25", "7.1", "7", "x:1", "00:00:00,0005"], tc.parse_time_ms) == [3601.5, 62.25, 7.1, 7.0, None, 0.005]
    assert each(spark, ["1:00:01.5", "1:2", "7.5", "", None, "a:b"], tc.to_seconds_lenient) == [3601.5, 62, 7.5, 0, 0, 0]
    assert each(spark, [0.0, 59.9, 3661.0, 360000.0, -1.0, None], tc.format_time, "double") == ["00:00:00", "00:00:59", "01:01:01", "100:00:00", "00:00:00", "00:00:00"]
    assert each(spark, [0.1, 2.0, 100.0], tc.max_chars_for_duration, "double") == [20, 40, 2000]


def tempo(f):
    if f <= 0:
        return "atempo=1.0"
    if 0.5 <= f <= 2:
        return f"atempo={f:.6f}"
    parts = []
    while f < 0.5:
        parts.append("atempo=0.5")
        f /= 0.5
    while f > 2:
        parts.append("atempo=2.0")
        f /= 2
    return ",".join(parts + ([f"atempo={f:.6f}"] if abs(f - 1) > 0.001 else []))


def test_tempo_chain(spark):
    values = [-1.0, 0.0, 0.01, 0.1, 0.125, 0.25, 0.3, 0.5, 0.75, 1.0, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0, 8.0, 9.9, 64.0, 100.0]
    assert each(spark, values, tc.tempo_chain, "double") == [tempo(v) for v in values]
    got = each(spark, [0.5, 1.0, 2.0, 0.001], lambda v: tc.capped_speed(v, F.lit(1.0)), "double")
    assert [(r.speed, r.capped) for r in got] == [(0.9, True), (1.0, False), (1.3, True), (1.0, False)]


def test_cleaning(spark):
    assert each(spark, ["hallo __ENTITY_PERSON_1__ welt..", "a | b", ", x", "<2de> ja ,, nein", None, "Ünï [MASK]"], tx.sanitize_text) == ["Hallo welt", "A , b", "X", "Ja. nein", "", "Ünï"]
    assert each(spark, ["hallo <extra_id_3> __NUM_1__"], tx.sanitize_keep_placeholders) == ["Hallo <extra_id_3>"]
    assert each(spark, ["<2de> derby", "en: text", ".! x", "es"], lambda v: tx.strip_lang_prefix(v, "de")) == ["Derby", "Text", "! x", ""]
    assert each(spark, ["Derby"], lambda v: tx.strip_lang_prefix(v, "de", compat=True)) == ["Rby"]
    assert each(spark, ["a b c a b c d", "x y x y z w", "a a a a", "one two three", "a b a b a b c d"], tx.collapse_repeats) == ["a b c d", "x y z w", "a a a a", "one two three", "a b c d"]
    assert each(spark, ["a.... b", "x - y", "-so", "well-known"], tx.clean_translation) == ["a b", "x y", "so", "well known"]
    assert each(spark, ["", "I cannot do", "Fine", "<extra_id_0> x", None], tx.is_refusal) == [True, True, False, True, True]
    assert each(spark, ["Ende", "Ende.", 'Ende."', ""], tx.complete_sentence) == ["Ende.", "Ende.", 'Ende."', ""]
    assert [r.reason for r in each(spark, ["", "...", "ab", "a b c", "a b c d"], lambda v: tx.tts_validity(v, True))] == ["empty", "no letters or digits", "too short", "too few words", "ok"]


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = [r.x for r in df.select(tx.cosine(F.col("a"), F.col("b")).alias("x")).collect()]
    assert got[0] == pytest.approx(0.5**0.5) and got[1] is None


def test_sentences(spark):
    simple = each(spark, ["Das ist. Nein! Gut?", "Dr. No war da.", "z.B. so", ""], sp.split_sentences_simple)
    assert simple == [["Das ist.", "Nein!", "Gut?"], ["Dr. No war da."], ["z.B. so"], [""]]
    german = ["Das ist z.B. Herr Meier. Er kam um 3.14 Uhr. Gut!", "Prof. Dr. Huber sprach. Dann Ende.", "Alles im Haus. Weiter geht es."]
    assert each(spark, german, lambda v: sp.split_sentences_abbrev(v, "de")) == [["Das ist z.B. Herr Meier.", "Er kam um 3.14 Uhr.", "Gut!"], ["Prof. Dr. Huber sprach.", "Dann Ende."], ["Alles im Haus.", "Weiter geht es."]]
    assert each(spark, german[2:], lambda v: sp.split_sentences_abbrev(v, "de", compat=True)) == [german[2:]]
    assert each(spark, ["Mr. Smith left. He ran, e.g. Fast ones."], lambda v: sp.split_sentences_abbrev(v, "en")) == [["Mr. Smith left.", "He ran, e.g. Fast ones."]]


def pack(text, limit, least):
    words = text.split()
    if len(words) <= least:
        return [text]
    out, now = [], ""
    for i, w in enumerate(words):
        if not now or len(now) + 1 + len(w) <= limit:
            now = f"{now} {w}".strip()
        elif len(words) - i < least:
            out.append(" ".join([now, *words[i:]]))
            return out
        else:
            out.append(now)
            now = w
    return [*out, now]


def test_packing(spark):
    rng = random.Random(4)
    texts = [" ".join("x" * rng.choice([1, 3, 5, 9, 40]) for _ in range(rng.randint(0, 30))) for _ in range(60)]
    assert each(spark, texts, lambda v: sp.pack_words(v, 20, 3)) == [pack(t, 20, 3) for t in texts]
    assert each(spark, ["a b. " * 9], lambda v: sp.pack_sentences(sp.split_sentences_simple(v), 12)) == [["a b. a b.", "a b. a b.", "a b. a b.", "a b. a b. a b."]]
    for t, pieces in zip(texts, each(spark, texts, lambda v: sp.split_text(v, 25, 4)), strict=True):
        assert " ".join(pieces).split() == t.split()
        assert all(len(p.split()) >= 4 for p in pieces[1:])
    assert each(spark, ["aaaa, bbbb; cccc. d"], lambda v: sp.split_clauses(v, 2, 2)) == [["aaaa,", "bbbb;", "cccc. d"]]


ENTITY = "struct<text:string,label:string,start:int,end:int,language:string>"


def test_protect_and_restore(spark):
    df = spark.createDataFrame([("Anna met Glitch and Glitch in Rome", [(0, 4, "PERSON"), (38, 42, "GPE"), (5, 8, "VERB")]), ("", None), ("no entities", None)], "t string, s array<struct<start:int,end:int,label:string>>")
    rows = df.select("t", en.protect(F.col("t"), ["Glitch"], F.col("s"), F.lit("en")).alias("p")).select("t", "p.*", en.restore_entities(F.col("p.text"), F.col("p.entity_map")).alias("back")).collect()
    assert rows[0].text.count("<extra_id_0>") == 2 and rows[0].text.startswith("<extra_id_2> met")
    assert rows[0].entity_map["<extra_id_2>"].text == "Anna" and len(rows[0].entity_map) == 3
    assert [r.back for r in rows] == [r.t for r in rows]


def test_protect_every_name_and_by_confidence(spark):
    df = spark.createDataFrame([("Anna met Bo. Anna and Bo left Rome", [(0, 4, "PER"), (9, 11, "PER"), (30, 34, "GPE")])], "t string, s array<struct<start:int,end:int,label:string>>")
    p = df.select("t", en.protect(F.col("t"), [], F.col("s"), F.lit("de"), style="name").alias("p")).select("t", "p.*")
    r = p.select("*", en.restore_entities(F.col("text"), F.col("entity_map")).alias("back")).first()
    assert r.text == "__NAME_0_4__ met __NAME_9_11__. __NAME_0_4__ and __NAME_9_11__ left Rome" and r.back == r.t
    seg = spark.createDataFrame([(1, 0, 0.0, 1.0, "Anna in Rome")], "media_id long, seq int, start_sec double, end_sec double, text string")
    spans = spark.createDataFrame([(1, 0, 0, 4, "PERSON", 0.84), (1, 0, 8, 12, "GPE", None)], "media_id long, seq int, start int, end int, label string, confidence double")
    assert composites.protect_spans(seg, spans, style="entity").first().text == "Anna in __ENTITY_GPE_0__"
    assert composites.protect_spans(seg, spans, style="entity", least_confidence=0.5).first().text == "__ENTITY_PERSON_1__ in __ENTITY_GPE_0__"
    flags = spark.createDataFrame([("PERSON",), ("DATE",), (None,)], "l string").select(en.should_translate(F.col("l")).alias("x")).collect()
    assert [r.x for r in flags] == [False, True, True]


def test_many_and_damaged_placeholders(spark):
    m = {f"<extra_id_{k}>": (f"E{k}", "ORG", 0, 1, "en") for k in range(12)}
    df = spark.createDataFrame([("<extra_id_1> <extra_id_10> < Extra ID 11 > &lt;extra_id_2&gt;  x", m)], f"t string, m map<string,{ENTITY}>")
    assert df.select(en.restore_entities(F.col("t"), F.col("m")).alias("x")).first().x == "E1 E10 E11 E2 x"


def test_entity_checks(spark):
    m = {"<extra_id_0>": ("Anna Bell", "PERSON", 0, 9, "en")}
    df = spark.createDataFrame([("Anna Bell runs", "<extra_id_0> runs", "runs", "Anna runs", m)], f"o string, p string, t string, r string, m map<string,{ENTITY}>")
    issues = df.select(en.entity_issues(F.col("o"), F.col("p"), F.col("t"), F.col("r"), F.col("m")).alias("x")).first().x
    assert issues == ["placeholder lost: <extra_id_0>", "missing: Anna Bell", "broken up: Anna Bell"]
    r = df.select(en.reapply_entities(F.col("o"), F.col("m")).alias("a"), en.rebase_entities(F.col("m"), F.lit(3), F.lit(5)).alias("b"), en.entity_map_from_json(F.lit("{bad")).alias("c")).first()
    assert r.a == "<extra_id_0> runs" and r.b["<extra_id_0>"].end == 9 and r.c == {}
    found = spark.createDataFrame([("see KittyK38 and bob12 ok",)], "t string").select(en.pattern_entities(F.col("t")).alias("x")).first().x
    assert [(s.start, s.end, s.text) for s in found] == [(4, 12, "KittyK38"), (17, 22, "bob12")]


def test_long_texts_take_time_in_proportion(spark):
    """Packing and entity search over texts of thousands of parts: twice the text, about twice the time."""
    took = {}
    for n in (200, 20_000, 40_000):
        text = "user7 goes. It is K12_K1 und nun, " * (n // 7)
        df = spark.createDataFrame([(text,)], "t string")
        began = time.time()
        for c in (sp.split_clauses(F.col("t"), 30, 5), sp.pack_sentences(sp.split_sentences_simple(F.col("t")), 120), en.pattern_entities(F.col("t"))):
            df.select(F.size(c)).collect()
        took[n] = time.time() - began
    assert took[40_000] < 3.5 * took[20_000]
