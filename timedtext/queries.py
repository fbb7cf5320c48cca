"""The registered queries of the segment operators, each over whole tables, with SQL of the same rows where SQL has it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timedtext import fixtures as fx
from timedtext import sqltext as st
from timedtext.functions import entities as en
from timedtext.functions import splitting as sp
from timedtext.functions import text as tx
from timedtext.functions import timecodes as tc
from timedtext.operators import aggregates, attempts, batches, filters, hypotheses, joins, windows
from timedtext.plans import composites
from timedtext.sources import segment_io
from timedtext.sources.shared import shared_folder
from timedtext.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
SEG = fx.with_sql("segments")
TRN = fx.with_sql("turns")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    """To 4 places, as SQL rounds doubles: the number times 10 000 to a whole one, halves away from zero."""
    def rounded(c: Column) -> Column:
        whole = F.round(c * 10000.0)
        return F.when(F.abs(whole) == float("inf"), c).when(whole == 0, c * 0.0).otherwise(whole / 10000.0)  # too large; -0.0 stays

    return df.withColumns({c: rounded(F.col(c)) if df.schema[c].dataType.typeName() == "double" else F.round(c, 4) for c in columns})


def _scalar(name: str, make: Callable, sql: str | None = None) -> None:
    """A text function over every conversation turn."""
    def run(spark: SparkSession, d: str) -> DataFrame:
        return fx.turns(spark, d).select("media_id", "seq", make(F.col("text")).alias("value"))

    run.__name__ = name
    query(TRN + f"select media_id, seq, {sql} as value from turns" if sql else None)(run)


SQUEEZE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
ENDED = "regexp_matches(trim(text), '[.!?][\"''”’»]?$')"
WORDS = r"len(list_filter(regexp_split_to_array({}, '\s+'), lambda w: w <> ''))"

def _without(text: str, patterns: list[str]) -> str:
    for p in patterns:
        text = f"regexp_replace({text}, '{p}', '', 'gi')"
    return text


def _sanitized(patterns: list[str]) -> str:
    t = rf"regexp_replace(regexp_replace({_without("coalesce(text, '')", patterns)}, '\s+', ' ', 'g'), '\s*[,.]\s*[,.]+', '.', 'g')"
    t = SQUEEZE.format(rf"regexp_replace({t}, '^[,.\s]+|[,.\s]+$', '', 'g')")
    return SQUEEZE.format(rf"replace(case when regexp_matches({t}, '^\p{{Ll}}') then upper(({t})[1]) || ({t})[2:] else {t} end, '|', ',')")


LED = rf"trim(regexp_replace({SQUEEZE.format('text')}, '^[.!?,:;]\s*', ''))"
LED = rf"case when regexp_matches({LED}, '(?i)^({'|'.join(tx.LANGUAGE_WORDS)})([^\p{{L}}\p{{M}}\p{{N}}_]|$)') then trim(regexp_replace({LED}, '(?i)^({'|'.join(tx.LANGUAGE_WORDS)})\s*[.:]?\s*', '')) else {LED} end"

_scalar("escape_fullwidth", tx.escape_fullwidth, "translate(text, '|\"''', '︱＂＇')")
_scalar("quote_to_apostrophe", tx.quote_to_apostrophe, "replace(text, '\"', '''')")
_scalar("strip_trailing_ellipsis", tx.strip_trailing_ellipsis, r"regexp_replace(text, '\.\.\.$', '')")
_scalar("final_dots_to_ellipsis", tx.final_dots_to_ellipsis, r"trim(regexp_replace(trim(text), '\.+$', '...'))")
_scalar("strip_html", tx.strip_html, "regexp_replace(text, '<.*?>', ' ', 'g')")
_scalar("is_refusal", tx.is_refusal, f"(trim(text) = '' or starts_with(lower(trim(text)), '<extra_id_') or regexp_matches(lower(trim(text)), '{'|'.join(x.replace(chr(39), chr(39) * 2) for x in tx.REFUSALS)}'))")
_scalar("is_complete_sentence", tx.is_complete_sentence, ENDED)
_scalar("complete_sentence", tx.complete_sentence, f"case when trim(text) = '' or {ENDED} then trim(text) else trim(text) || '.' end")
_scalar("token_estimate", lambda t: tx.token_estimate(t, 200), "least(length(text) // 4, 200)::int")
_scalar("word_count", tx.word_count, WORDS.format("text") + "::int")
_scalar("clean_translation", tx.clean_translation, SQUEEZE.format(r"regexp_replace(regexp_replace(text, '\.{2,}', '', 'g'), '\s*-\s*', ' ', 'g')"))
_scalar("sanitize_text", tx.sanitize_text, _sanitized(tx.PLACEHOLDERS_ALL))
_scalar("sanitize_keep_placeholders", tx.sanitize_keep_placeholders, _sanitized(tx.PLACEHOLDERS_KEPT_OUT))
_scalar("strip_lang_prefix", lambda t: tx.strip_lang_prefix(F.concat(F.lit("<2de> "), t), "de"), f"(select upper(v[1]) || v[2:] from (select {LED} as v))")
_scalar("collapse_repeats", tx.collapse_repeats, st.collapse_repeats("text"))
_scalar("split_sentences_simple", sp.split_sentences_simple, st.split_sentences_simple("text"))
_scalar("split_sentences_abbrev", lambda t: sp.split_sentences_abbrev(t, "en"), st.split_sentences_abbrev("text", "en"))
_scalar("pack_words", lambda t: sp.pack_words(t, 60), st.pack_words("text", 60, 3))
_scalar("pack_sentences", lambda t: sp.pack_sentences(sp.split_sentences_simple(t), 120), st.pack_sentences(st.split_sentences_simple("text"), 120, 3))
_scalar("split_text", lambda t: sp.split_text(t, 120), st.split_text("text", 120, 4, "de"))
_scalar("split_clauses", lambda t: sp.split_clauses(t, 30, 5), st.split_clauses("text", 30, 5))
_scalar("pattern_entities", lambda t: F.to_json(en.pattern_entities(F.concat(F.lit("user7 Nick_K12 "), t))), st.pattern_entities("('user7 Nick_K12 ' || text)"))
_scalar("tts_validity", lambda t: tx.tts_validity(t, True)["reason"], f"case when trim(text) = '' then 'empty' when not regexp_matches(text, '[\\p{{L}}\\p{{N}}]') then 'no letters or digits' when length(trim(text)) < 3 then 'too short' when {WORDS.format('text')} < 4 then 'too few words' else 'ok' end")


@query(SEG + "select media_id, seq, start_sec, end_sec, text from segments where start_sec is not null and end_sec is not null and start_sec <= end_sec")
def drop_invalid_times(spark, d):
    return filters.drop_invalid_times(fx.segments(spark, d)).drop("lang")


@query(SEG + "select media_id, seq, start_sec, end_sec from segments where start_sec < end_sec and trim(text) <> ''")
def drop_empty_spans(spark, d):
    return filters.drop_empty_spans(fx.segments(spark, d)).select("media_id", "seq", "start_sec", "end_sec")


@query(SEG + "select media_id, seq from segments where end_sec > start_sec and length(trim(text)) >= 3 and lower(trim(text)) not in ('de', 'en', 'fr', 'es', 'dt>', 'de.', 'en.')")
def valid_segment(spark, d):
    return filters.valid_segments(fx.segments(spark, d)).select("media_id", "seq")


@query(SEG + "select media_id, seq from segments where length(trim(text)) >= 5")
def min_tts_length(spark, d):
    return filters.min_tts_length(fx.segments(spark, d)).select("media_id", "seq")


@query(SEG + ", bad as (select media_id, seq, case when seq % 5 = 0 then null else start_sec end as s, case when seq % 7 = 0 then start_sec - 2 else end_sec end as e from segments), z as (select media_id, seq, coalesce(s, 0) as s, coalesce(e, 0) as e from bad) select media_id, seq, greatest(s, 0::double) as start_sec, case when s >= e or s < 0 or e < 0 then greatest(s, 0::double) + 1 else e end as end_sec from z")
def repair_times(spark, d):
    s = fx.segments(spark, d)
    bad = s.select("media_id", "seq", F.when(F.col("seq") % 5 != 0, F.col("start_sec")).alias("start_sec"), F.when(F.col("seq") % 7 == 0, F.col("start_sec") - 2).otherwise(F.col("end_sec")).alias("end_sec"))
    return filters.repair_times(bad)


@query(SEG + "select media_id, seq, start_sec, end_sec, text || '!' as text, lang from segments")
def reorder_core_columns(spark, d):
    return filters.reorder_core_columns(fx.segments(spark, d).withColumn("polished", F.concat("text", F.lit("!"))), "polished")


@query(SEG + "select media_id, seq, unnest(string_split(text, '. ')) as text, unnest(range(len(string_split(text, '. '))))::int as piece from segments")
def explode_sentences(spark, d):
    s = fx.segments(spark, d).select("media_id", "seq", "text", F.split("text", r"\. ").alias("sentences"))
    return filters.explode_sentences(s)


# times

@query(SEG + "select media_id, seq, case when seq % 50 = 7 then null else floor(case when seq % 50 = 9 then end_sec else start_sec end) end as start_sec, floor(case when seq % 50 = 9 then start_sec else end_sec end) as end_sec from segments")
def parse_time(spark, d):
    return segment_io.typed_segments(fx.raw_segments(spark, d)).select("media_id", "seq", "start_sec", "end_sec")


@query(SEG + "select media_id, seq, (start_sec + (seq % 10) / 10.0)::double as value from segments")
def parse_time_ms(spark, d):
    t = F.concat(tc.format_time(F.col("start_sec")), F.lit(","), (F.col("seq") % 10).cast("string"))
    return _rounded(fx.segments(spark, d).select("media_id", "seq", tc.parse_time_ms(t).alias("value")), "value")


@query(SEG + "select media_id, seq, case when seq % 50 = 7 then 0 else floor(case when seq % 50 = 9 then end_sec else start_sec end) end::double as value from segments")
def to_seconds_lenient(spark, d):
    return fx.raw_segments(spark, d).select("media_id", "seq", tc.to_seconds_lenient(F.col("startzeit")).alias("value"))


@query(SEG + "select media_id, seq, printf('%02d:%02d:%02d', (end_sec * 3)::bigint // 3600, (end_sec * 3)::bigint % 3600 // 60, (end_sec * 3)::bigint % 60) as value from segments")
def format_time(spark, d):
    return fx.segments(spark, d).select("media_id", "seq", tc.format_time(F.col("end_sec") * 3).alias("value"))


@query(SEG + "select media_id, seq, greatest(((end_sec - start_sec) * 20)::bigint, 20) as value from segments")
def max_chars_for_duration(spark, d):
    return fx.segments(spark, d).select("media_id", "seq", tc.max_chars_for_duration(F.col("end_sec") - F.col("start_sec")).alias("value"))


@query(fx.with_sql("segments", "manifest") + ", r as (select media_id, seq, case when actual_sec > 0.01 and end_sec - start_sec > 0.01 then actual_sec / (end_sec - start_sec) else 1 end as raw from manifest) select media_id, seq, round(greatest(0.9, least(1.3, raw)), 4) as speed, abs(greatest(0.9, least(1.3, raw)) - raw) > 0.01 as capped from r")
def capped_speed(spark, d):
    m = fx.manifest(spark, d).withColumn("s", tc.capped_speed(F.col("actual_sec"), F.col("end_sec") - F.col("start_sec")))
    return _rounded(m.select("media_id", "seq", "s.speed", "s.capped"), "speed")


@query(fx.with_sql("segments", "manifest") + f"select media_id, seq, {st.tempo('actual_sec / 4')} as value from manifest")
def tempo_chain(spark, d):
    return fx.manifest(spark, d).select("media_id", "seq", tc.tempo_chain(F.col("actual_sec") / 4).alias("value"))


# windows

#: Chunks by a walk over each medium's rows in order.
GAP_MERGE = SEG.replace("with ", "with recursive ", 1) + """, r as (select *, row_number() over (partition by media_id order by start_sec, seq) as rn, trim(coalesce(text, '')) as t from segments),
w as (select media_id, seq, rn, start_sec, end_sec, t, 1::bigint as k, start_sec as opened, length(t) as chars from r where rn = 1 union all
  select x.media_id, x.seq, x.rn, x.start_sec, x.end_sec, x.t, case when x.j then x.k else x.k + 1 end, case when x.j then x.opened else x.start_sec end, case when x.j then x.longer else length(x.t) end
  from (select y.*, coalesce(gap between 0 and 0.5 and end_sec - opened <= 60 and longer <= 400, false) as j
    from (select r.media_id, r.seq, r.rn, r.start_sec, r.end_sec, r.t, w.k, w.opened, r.start_sec - w.end_sec as gap, w.chars + length(r.t) + (case when w.chars > 0 and length(r.t) > 0 then 1 else 0 end) as longer
      from w join r on r.media_id = w.media_id and r.rn = w.rn + 1) y) x),
c as (select media_id, arg_min(seq, rn) as seq, arg_min(start_sec, rn) as start_sec, arg_max(end_sec, rn) as end_sec, coalesce(string_agg(case when t <> '' then t end, ' ' order by rn), '') as text, count(*)::int as n_rows from w group by media_id, k),
m as (select * from c where text <> '')
"""


@query(GAP_MERGE + "select * from m")
def gap_merge(spark, d):
    return windows.gap_merge(fx.segments(spark, d), 0.5, 60, 400)


@query(SEG + ", " + st.force_merged("segments", 10, 8, "f") + " select * from f")
def force_merge_short(spark, d):
    return windows.force_merge_short(fx.segments(spark, d).drop("lang"), 10, 8)


CLOSE = """, f as (select *, trim(text) as t, lag(trim(text)) over w as before from segments window w as (partition by media_id order by start_sec, seq)),
g as (select *, case when before is not null and ({fragile}) then 0 else 1 end as opens from f),
h as (select *, sum(opens) over (partition by media_id order by start_sec, seq rows unbounded preceding) as part from g)
select media_id, min(seq)::int as seq, min(start_sec) as start_sec, arg_max(end_sec, seq) as end_sec, string_agg(case when t <> '' then t end, ' ' order by seq) as text from h group by media_id, part"""


@query(SEG + CLOSE.format(fragile=r"(regexp_matches(t, '^\p{Ll}') or regexp_matches(t, '(?i)^(und|aber|oder|doch)($|[^\p{L}\p{N}_])')) and not regexp_matches(before, '[.!?]$')"))
def close_context(spark, d):
    return windows.close_context(fx.segments(spark, d).drop("lang"))


@query(SEG + CLOSE.format(fragile=r"regexp_matches(t, '^\p{Ll}') or regexp_matches(t, '(?i)^(und|aber|oder|doch)($|[^\p{L}\p{N}_])')"))
def close_context_simple(spark, d):
    return windows.close_context_simple(fx.segments(spark, d).drop("lang"))


@query(SEG + CLOSE.format(fragile=r"regexp_matches(text, '^\p{Ll}')"))
def merge_lowercase(spark, d):
    return windows.merge_lowercase(fx.segments(spark, d).drop("lang"))


@query(SEG + r", f as (select media_id, seq, text, lag(text) over (partition by media_id order by start_sec, seq) as before from segments) select media_id, seq, case when before is not null and regexp_matches(text, '(?i)^[\p{L}\p{N}_]+(ing|ed)($|[^\p{L}\p{N}_])') then substr(before || ' [CTX] ' || text, 1, 300) else text end as text from f")
def prepend_context(spark, d):
    return windows.prepend_context(fx.segments(spark, d)).select("media_id", "seq", "text")


def _dedup_sql() -> str:
    t = "trim(coalesce(x.r.text, ''))"
    needs = rf"(regexp_matches({t}, '^\p{{Ll}}') or regexp_matches({t}, '(?i)^({'|'.join(windows.CONJUNCTIONS_LONG)})') or not regexp_matches({t}, '[.!?]$'))"
    tidy = lambda v: f"regexp_replace({v}, '^[ .]+', '')"
    cut = tidy(f"substr({t}, length(a.last) + 1)")
    own = f"case when a.last is null then {t} when {needs} then {tidy(t)} when starts_with({t}, a.last) then {cut} else {t} end"
    ended = st.let(own, lambda v: f"case when {v} = '' or regexp_matches({v}, '[.!?]$') then {v} else {v} || '.' end", "own")
    texts = st.fold("rows", {"last": "null::varchar"}, "varchar", {"last": ended}, ended)
    rows = "select media_id, list({'seq': seq, 'start_sec': start_sec, 'end_sec': end_sec, 'text': text} order by start_sec, seq) as rows from segments group by media_id"
    each = f"select media_id, unnest(rows) as r, unnest({texts}) as text from l"
    return SEG + f", l as ({rows}) select media_id, r.seq, r.start_sec, r.end_sec, text from ({each})"


@query(_dedup_sql())
def close_context_dedup(spark, d):
    return windows.close_context_dedup(fx.segments(spark, d))


@query(fx.with_sql("segments", "manifest") + ", c as (select media_id, seq, floor(start_sec * 24000)::bigint as start_sample, floor(actual_sec * 24000)::bigint as clip from manifest), e as (select *, start_sample + clip as end_sample from c), o as (select *, coalesce(greatest(lag(end_sample) over (partition by media_id order by start_sample, seq) - start_sample, 0), 0) as overlap from e) select media_id, seq, start_sample, end_sample, overlap, least(overlap, 2400, clip) as fade from o")
def overlap_crossfade_plan(spark, d):
    return windows.overlap_crossfade_plan(fx.manifest(spark, d)).select("media_id", "seq", "start_sample", "end_sample", "overlap", "fade")


DURATIONS = ", m as (select media_id, max(end_sec) as duration from segments group by media_id)"


def _media(spark, d):
    return fx.segments(spark, d).groupBy("media_id").agg(F.max("end_sec").alias("duration"))


@query(SEG + DURATIONS + ", p as (select media_id, duration, unnest(range((duration // 27)::int + 1))::int as part from m) select media_id, part, (part * 27)::double as start_sec, least(duration, part * 27 + 30)::double as end_sec from p where part * 27 < duration")
def plan_parts(spark, d):
    return windows.plan_parts(_media(spark, d), length=30.0)


@query(SEG + DURATIONS + ", p as (select media_id, duration, unnest(range(4))::int as part from m) select media_id, part, round(greatest(0, part * duration / 4 - case when part > 0 then 3 else 0 end), 4)::double as start_sec, round(least(duration, (part + 1) * duration / 4), 4)::double as end_sec from p where greatest(0, part * duration / 4 - case when part > 0 then 3 else 0 end) < duration")
def plan_equal_parts(spark, d):
    return _rounded(windows.plan_parts(_media(spark, d), parts=4), "start_sec", "end_sec")


@query(fx.with_sql("speech") + ", l as (select *, lag(end_sec) over (partition by media_id order by start_sec, seq) as before from speech) select media_id, seq, round(case when start_sec - before > 2 then before + 2 else start_sec end, 1) as start_sec, round(end_sec, 1) as end_sec from l")
def clamp_silence(spark, d):
    return windows.clamp_silence(fx.speech(spark, d)).select("media_id", "seq", F.round("start_sec", 1).alias("start_sec"), F.round("end_sec", 1).alias("end_sec"))


@query(SEG + ", p as (select *, unnest(range(len(string_split(text, '. '))))::int as piece, unnest(string_split(text, '. ')) as t from segments), c as (select *, length(t) as n, sum(length(t)) over (partition by media_id, seq order by piece rows unbounded preceding) as upto, sum(length(t)) over (partition by media_id, seq) as total, count(*) over (partition by media_id, seq) as pieces from p) select media_id, seq, piece, t as text, round(start_sec + (end_sec - start_sec) * case when total > 0 then (upto - n) / total else piece / pieces end, 4) as start_sec, round(case when piece + 1 = pieces then end_sec else start_sec + (end_sec - start_sec) * case when total > 0 then upto / total else (piece + 1) / pieces end end, 4) as end_sec from c")
def proportional_times(spark, d):
    s = fx.segments(spark, d).drop("lang").withColumn("pieces", F.split("text", r"\. "))
    return _rounded(windows.proportional_times(s), "start_sec", "end_sec")


def _laid(source: str, length: str) -> str:
    """w: where each row of source is laid, by a walk over each medium's rows in order."""
    first = "case when start_sec < 0 then 0.2::double else start_sec end"
    late = "case when r.start_sec < w.running then w.running + 0.2::double else r.start_sec end"
    step = f"select r.*, w.running as before, r.start_sec < w.running as late, {late} as e from w join r on r.media_id = w.media_id and r.rn = w.rn + 1"
    return f""", r as (select *, row_number() over (partition by media_id order by start_sec, seq) as rn from {source}),
w as (select media_id, seq, rn, start_sec, end_sec, start_sec < 0 as had_overlap, {first} as e, {first} as gap, {first} + {length} as running from r where rn = 1 union all
  select media_id, seq, rn, start_sec, end_sec, late, e, e - before, e + {length} from ({step}) x)
"""


def _recursive(sql: str) -> str:
    return sql.replace("with ", "with recursive ", 1)


TIMELINE = _recursive(fx.with_sql("segments", "manifest")) + _laid("manifest", "actual_sec")


@query(TIMELINE + "select media_id, seq, start_sec, end_sec, round(e, 4) as effective_start, round(case when gap > 0.02 then gap else 0 end, 4) as silence, had_overlap, round(running, 4) as effective_end from w")
def timeline(spark, d):
    return _rounded(windows.timeline(fx.manifest(spark, d), mode="actual"), "effective_start", "silence", "effective_end")


@query(SEG + ", n as (select media_id, seq, row_number() over (partition by media_id order by start_sec, seq) - 1 as place from segments) select media_id, seq, place // 8 as batch, place::int as place from n")
def batch_ids(spark, d):
    return windows.batch_ids(fx.segments(spark, d), 8).select("media_id", "seq", "batch", "place")


@query(fx.with_sql("attempts") + ", s as (select *, min(case when similarity >= 0.7 then attempt end) over (partition by segment_id) as stop from attempts), k as (select * from s where similarity > 0 and attempt <= coalesce(stop, 99)), b as (select segment_id, first(text order by similarity desc, attempt) as text, first(similarity order by similarity desc, attempt) as similarity, first(attempt order by similarity desc, attempt) as attempt from k group by segment_id) select a.segment_id, coalesce(b.text, 's' || a.segment_id) as text, coalesce(b.similarity, 0)::double as similarity, b.attempt from (select distinct segment_id from attempts) a left join b using (segment_id)")
def first_acceptable_attempt(spark, d):
    a = fx.attempts(spark, d)
    src = a.select("segment_id").distinct().withColumn("source_text", F.concat(F.lit("s"), F.col("segment_id")))
    return attempts.first_acceptable_attempt(a, src, 0.7)


FOLD = """, p as (select j.segment_id, j.text as t0, j.similarity as s0, max(case when attempt = 0 then a.text end) as t1, max(case when attempt = 0 then a.similarity end) as s1, max(case when attempt = 1 then a.text end) as t2, max(case when attempt = 1 then a.similarity end) as s2, max(case when attempt = 2 then a.text end) as t3, max(case when attempt = 2 then a.similarity end) as s3 from judged j left join attempts a using (segment_id) where j.similarity < 0.6 group by 1, 2, 3),
a1 as (select *, case when s1 > s0 + 0.002 then s1 else s0 end as b1, case when s1 > s0 + 0.002 then 0 end as k1 from p),
a2 as (select *, case when s2 > b1 + 0.002 then s2 else b1 end as b2, case when s2 > b1 + 0.002 then 1 else k1 end as k2 from a1),
a3 as (select *, case when s3 > b2 + 0.002 then s3 else b2 end as b3, case when s3 > b2 + 0.002 then 2 else k2 end as k3 from a2)
select segment_id, s0 as original_similarity, b3 as similarity, case k3 when 0 then t1 when 1 then t2 when 2 then t3 else t0 end as text, k3::int as attempt, case when b3 > s0 then 'AUTO-CORRECTED' else 'CHECK MANUALLY' end as flag from a3"""


@query(fx.with_sql("attempts", "judged") + FOLD)
def best_correction(spark, d):
    return attempts.best_correction(fx.judged(spark, d), fx.attempts(spark, d), 0.6)


POLISH = """, b as (select j.segment_id, j.text, j.similarity, j.duration, first(a.text order by a.similarity desc, attempt) filter (a.similarity >= j.similarity - 0.1 and a.similarity > j.similarity) as new, max(a.similarity) filter (a.similarity > j.similarity) as best from judged j left join attempts a using (segment_id) group by 1, 2, 3, 4),
s as (select *, case when similarity > 0.9 then 'SKIPPED' when new is null or new = text then 'UNCHANGED' when length(new) > greatest((duration * 20)::bigint, 20) and length(new) > length(text) then 'REJECTED' else 'POLISHED' end as status from b)"""


@query(fx.with_sql("attempts", "judged") + POLISH + "select segment_id, status, case when status = 'POLISHED' then new else text end as text, similarity as before, case when status = 'POLISHED' then best else similarity end as after from s")
def polish_decision(spark, d):
    return attempts.polish_decision(fx.judged(spark, d), fx.attempts(spark, d))


# joins and sets

@query(fx.with_sql("segments", "progress") + "select media_id, seq from segments anti join progress using (media_id, seq)")
def resume_by_start(spark, d):
    return joins.resume_by_start(fx.segments(spark, d), fx.progress(spark, d)).select("media_id", "seq")


@query(fx.with_sql("segments", "progress") + r"select media_id, seq from segments anti join progress using (media_id, seq) where trim(text) <> '' and regexp_matches(text, '[\p{L}\p{N}]')")
def resume_by_id(spark, d):
    return joins.resume_by_id(fx.segments(spark, d), fx.progress(spark, d)).select("media_id", "seq")


@query(fx.with_sql("segments", "progress") + "select media_id, seq from segments anti join (select media_id, seq from progress where seq % 2 = 0) x using (media_id, seq)")
def resume_two_outputs(spark, d):
    p = fx.progress(spark, d)
    return joins.resume_two_outputs(fx.segments(spark, d), p, fx.segments(spark, d).filter("seq % 2 = 0")).select("media_id", "seq")


@query(fx.with_sql("segments", "progress") + "select media_id, seq from progress intersect select media_id, seq from segments where seq % 2 = 0")
def common_keys(spark, d):
    return joins.common_keys(fx.progress(spark, d), fx.segments(spark, d).filter("seq % 2 = 0"))


@query(fx.with_sql("segments") + "select media_id, seq, text, null::varchar as lang from segments where seq % 2 = 0 union all select media_id, seq, text, lang from segments where seq % 2 = 1")
def append_results(spark, d):
    s = fx.segments(spark, d).select("media_id", "seq", "text", "lang")
    return joins.append_results(s.filter("seq % 2 = 0").drop("lang"), s.filter("seq % 2 = 1"))


ALIGN = ", t as (select * from segments where not (media_id % 5 = 0 and seq = 0)), c as (select media_id, count(*) as n from segments group by 1), e as (select media_id, count(*) as n from t group by 1)"


@query(SEG + ALIGN + "select s.media_id, s.seq, s.start_sec, s.end_sec, s.text as source_text, s.text || '!' as target_text from segments s join c using (media_id) join e on s.media_id = e.media_id and c.n = e.n")
def align_pairs(spark, d):
    s = fx.segments(spark, d)
    return joins.align_pairs(s, s.filter("not (media_id % 5 = 0 and seq = 0)").withColumn("text", F.concat("text", F.lit("!"))))[0]


@query(SEG + ALIGN + "select media_id, c.n as n_source, coalesce(e.n, 0) as n_target from c left join e using (media_id) where c.n <> coalesce(e.n, 0)")
def align_rejects(spark, d):
    s = fx.segments(spark, d)
    return joins.align_pairs(s, s.filter("not (media_id % 5 = 0 and seq = 0)"))[1]


def _best(spark, d):
    return hypotheses.best_hypothesis_by_similarity(fx.sources(spark, d), fx.hypotheses(spark, d).withColumn("score", F.col("beam_score_raw")))


SIM = ", z as (select h.segment_id, h.hypothesis_id, h.text, h.beam_score_raw, h.num_tokens, list_dot_product(s.embedding::double[], h.embedding::double[]) / (sqrt(list_dot_product(s.embedding::double[], s.embedding::double[])) * sqrt(list_dot_product(h.embedding::double[], h.embedding::double[]))) as similarity from hypotheses h join hypotheses s on s.segment_id = h.segment_id and s.hypothesis_id = 0)"
HYP = fx.with_sql("hypotheses") + SIM


@query(fx.with_sql("segments", "hypotheses") + SIM + ", b as (select segment_id, arg_max(text, round(similarity, 9)) as best from z where hypothesis_id > 0 group by 1) select media_id, seq, segment_id, coalesce(best, text) as text from (select media_id, seq, media_id as segment_id, text from segments) s left join b using (segment_id)")
def apply_best(spark, d):
    best = hypotheses.best_hypothesis_by_similarity(fx.sources(spark, d), fx.hypotheses(spark, d).filter("hypothesis_id > 0").withColumn("score", F.col("beam_score_raw")))
    return hypotheses.apply_best(fx.segments(spark, d).select("media_id", "seq", F.col("media_id").alias("segment_id"), "text"), best)


@query(HYP + "select segment_id, hypothesis_id, text, round(similarity, 4) as similarity from z")
def match_source_to_hypotheses(spark, d):
    rows = hypotheses.match_source_to_hypotheses(fx.sources(spark, d).drop("source_text"), fx.hypotheses(spark, d))
    return _rounded(rows.select("segment_id", "hypothesis_id", "text", "similarity"), "similarity")


QUERIES["cosine"], ORACLE["cosine"] = match_source_to_hypotheses, ORACLE["match_source_to_hypotheses"]


@query(SEG + r", m as (select media_id, seq, text, length(regexp_extract(text, '^\p{L}+')) as n from segments), w as (select media_id, seq, n from m where n > 0) select media_id, seq, (x.n + 1)::int as start, (x.n + 4)::int as end from w x where not exists (select 1 from w s where s.media_id = x.media_id and s.seq = x.seq and s.seq % 4 = 0 and x.n + 1 < s.n + 3 and 0 < x.n + 4)")
def free_of_spans(spark, d):
    s = fx.segments(spark, d).select("media_id", "seq", F.length(F.regexp_extract("text", r"^\p{L}+", 0)).alias("n")).filter("n > 0")
    matches = s.select("media_id", "seq", (F.col("n") + 1).alias("start"), (F.col("n") + 4).alias("end"))
    spans = s.filter("seq % 4 = 0").select("media_id", "seq", F.lit(0).alias("start"), (F.col("n") + 3).alias("end"))
    return joins.free_of_spans(matches, spans)


TERMS = ["the", "and", "des", "que", "der", "Dr.", "z.B.", "una", "pas", "with"]


@query(SEG + ", d as (select unnest([" + ", ".join(f"'{t}'" for t in TERMS) + "]) as word) select media_id, seq, list(word order by length(word) desc, word) as words from segments join d on contains(text, word) group by media_id, seq")
def dictionary_hits(spark, d):
    words = spark.createDataFrame([(t,) for t in TERMS], "word string")
    return joins.dictionary_hits(fx.segments(spark, d), words)


def _glossary_sql() -> str:
    terms = [t for t in TERMS if "." not in t]
    lines = ", ".join(rf"case when regexp_matches(text, '(?i)(^|[^\p{{L}}\p{{N}}_]){t}($|[^\p{{L}}\p{{N}}_])') then '- {t}: {t.upper()}' end" for t in sorted(terms))
    return SEG + f"select * from (select media_id, seq, array_to_string(list_filter([{lines}], lambda x: x is not null), chr(10)) as glossary from segments) where glossary <> ''"


@query(_glossary_sql())
def glossary_hits(spark, d):
    g = spark.createDataFrame([(t, t.upper()) for t in TERMS if "." not in t], "term string, options string")
    return joins.glossary_hits(fx.segments(spark, d), g)


@query(SEG + ", p as (select media_id, seq, unnest(range(greatest(floor((start_sec - 30) / 27)::int + 1, 0), greatest(ceil(end_sec / 27)::int - 1, greatest(floor((start_sec - 30) / 27)::int + 1, 0)) + 1))::int as part from segments) select media_id, seq, part from p")
def assign_to_parts(spark, d):
    return joins.assign_to_parts(fx.segments(spark, d), 30.0).select("media_id", "seq", "part")


@query(SEG + "select media_id, seq, start_sec, end_sec, case when seq % 4 = 0 then text || '!' when seq % 3 = 0 then text || '?' else text end as text from segments")
def resolve_version(spark, d):
    s = fx.segments(spark, d).drop("lang")
    return segment_io.resolve_version(s, s.filter("seq % 4 = 0").withColumn("text", F.concat("text", F.lit("!"))), s.filter("seq % 3 = 0").withColumn("text", F.concat("text", F.lit("?"))))


# aggregations

@query(fx.with_sql("segments", "progress") + ", e as (select media_id, case when media_id % 4 = 0 then null else count(*) end as expected from segments group by media_id), n as (select media_id, count(*) as c from progress group by 1) select media_id, case when c is null then false when expected is null then true else c >= expected end as complete, coalesce(c, 0) as current, expected from e left join n using (media_id)")
def completion_status(spark, d):
    e = fx.segments(spark, d).groupBy("media_id").agg(F.count(F.lit(1)).alias("n"))
    return aggregates.completion_status(e.select("media_id", F.when(F.col("media_id") % 4 != 0, F.col("n")).alias("expected")), fx.progress(spark, d))


@query(fx.with_sql("hypotheses") + "select segment_id, first(text order by beam_score_raw desc, hypothesis_id) as text, max(beam_score_raw) as score, first(hypothesis_id order by beam_score_raw desc, hypothesis_id) as hypothesis_id from hypotheses group by segment_id")
def best_hypothesis_by_score(spark, d):
    return hypotheses.best_hypothesis_by_score(fx.hypotheses(spark, d), "beam_score_raw")


@query(HYP + "select segment_id, first(text order by round(similarity, 9) desc, hypothesis_id) as text, round(max(similarity), 4) as similarity, first(hypothesis_id order by round(similarity, 9) desc, hypothesis_id) as hypothesis_id from z group by segment_id")
def best_hypothesis_by_similarity(spark, d):
    return _rounded(_best(spark, d), "similarity")


COMBINED = """, n as (select *, beam_score_raw / num_tokens as b from z), m as (select *, min(b) over w as bl, max(b) over w as bh, min(similarity) over w as sl, max(similarity) over w as sh from n window w as (partition by segment_id)),
k as (select *, 0.4 * (b - bl) / (case when bh > bl then bh - bl else 1 end) + 0.6 * (similarity - sl) / (case when sh > sl then sh - sl else 1 end) as score from m)
select segment_id, hypothesis_id, round(b, 4) as beam_norm, round(score, 4) as score, row_number() over (partition by segment_id order by round(score, 9) desc, hypothesis_id) = 1 as is_best from k"""


@query(HYP + COMBINED)
def combined_hypothesis_score(spark, d):
    rows = hypotheses.match_source_to_hypotheses(fx.sources(spark, d).drop("source_text"), fx.hypotheses(spark, d))
    rows = hypotheses.combined_hypothesis_score(rows, 0.4)
    return _rounded(rows.select("segment_id", "hypothesis_id", "beam_norm", "score", "is_best"), "beam_norm", "score")


@query(HYP + ", b as (select segment_id, max(similarity) as s from z group by 1), a as (select count(distinct segment_id) as segments, count(*) as hypotheses, round(avg(beam_score_raw), 4) as score_mean, round(median(beam_score_raw), 4) as score_median, round(stddev_pop(beam_score_raw), 4) as score_std from hypotheses) select a.*, round(avg(s), 4) as similarity_mean, round(median(s), 4) as similarity_median, round(max(s), 4) as similarity_max, round(min(s), 4) as similarity_min, any_value(hypotheses) / any_value(segments) as hypotheses_per_segment from b, a group by all")
def selection_report(spark, d):
    r = aggregates.selection_report(fx.hypotheses(spark, d).withColumn("score", F.col("beam_score_raw")), _best(spark, d))
    return _rounded(r, "score_mean", "score_median", "score_std", "similarity_mean", "similarity_median", "similarity_max", "similarity_min")


@query(fx.with_sql("attempts", "judged") + ", r as (select j.segment_id, j.similarity, case when j.similarity < 0.6 and a.m > j.similarity then a.m end as c from judged j left join (select segment_id, max(similarity) as m from attempts group by 1) a using (segment_id)) select count(*) as segments, count_if(similarity < 0.6)::bigint as issues, count_if(c > similarity)::bigint as corrected, round(avg(similarity), 4) as mean_before, round(avg(coalesce(c, similarity)), 4) as mean_after, round(case when avg(similarity) = 0 then 0 else (avg(coalesce(c, similarity)) - avg(similarity)) / avg(similarity) * 100 end, 4) as improvement_percent from r")
def quality_summary(spark, d):
    best = fx.attempts(spark, d).groupBy("segment_id").agg(F.max("similarity").alias("m"))
    rows = fx.judged(spark, d).join(best, "segment_id", "left").withColumn("corrected_similarity", F.when((F.col("similarity") < 0.6) & (F.col("m") > F.col("similarity")), F.col("m")))
    return _rounded(aggregates.quality_summary(rows, 0.6), "mean_before", "mean_after", "improvement_percent")


@query(fx.with_sql("attempts", "judged") + POLISH + "select status, count(*) as n, round(avg(similarity), 4) as mean_before, round(avg(case when status = 'POLISHED' then best else similarity end), 4) as mean_after from s group by status")
def polish_summary(spark, d):
    return _rounded(aggregates.polish_summary(attempts.polish_decision(fx.judged(spark, d), fx.attempts(spark, d))), "mean_before", "mean_after")


@query(GAP_MERGE + ", a as (select media_id, count(*) as rows_read, count_if(start_sec <= end_sec)::bigint as rows_valid from segments group by 1), b as (select media_id, count(*) as rows_final from m group by 1) select media_id, rows_read, rows_valid, coalesce(rows_final, 0)::bigint as rows_final from a left join b using (media_id)")
def merge_stats(spark, d):
    s = fx.segments(spark, d)
    return aggregates.merge_stats(s, windows.gap_merge(s, 0.5, 60, 400))


@query(SEG + r"select count(*) as entities from segments where seq % 4 = 0 and regexp_matches(text, '^[\p{L}\p{N}_]')")
def entity_count(spark, d):
    return aggregates.entity_count(composites.protect_spans(fx.segments(spark, d), fx.entity_spans(spark, d)))


@query(TRN + "select count_if(trim(text) <> text)::bigint as changed, count(*) as total from turns")
def grammar_change_count(spark, d):
    return aggregates.grammar_change_count(fx.turns(spark, d).withColumn("corrected", F.trim("text")), "text", "corrected")


@query(TIMELINE + "select media_id, count(*) as clips, count_if(had_overlap)::bigint as overlaps, 0::bigint as failed from w group by 1")
def overlap_stats(spark, d):
    return aggregates.overlap_stats(windows.timeline(fx.manifest(spark, d), mode="actual"))


@query(SEG + ", p as (select media_id, seq, unnest(string_split(text, '. ')) as t from segments), g as (select media_id, seq, count(*) as n, count_if(length(t) > 120)::bigint as o from p group by 1, 2) select sum(o)::bigint as over_limit, count_if(n > 1)::bigint as segments_split from g")
def limit_excess_stats(spark, d):
    s = filters.explode_sentences(fx.segments(spark, d).withColumn("sentences", F.split("text", r"\. ")))
    return aggregates.limit_excess_stats(s, 120)


# order and ranks

@query(SEG + "select media_id, seq, row_number() over (partition by media_id order by start_sec, seq)::int as place from segments")
def sort_by_start(spark, d):
    return fx.segments(spark, d).select("media_id", "seq", F.row_number().over(windows.order()).alias("place"))


@query(fx.with_sql("attempts", "judged") + "select * from (select segment_id, similarity, 'top' as kind from judged order by similarity desc, segment_id limit 3) union all select * from (select segment_id, similarity, 'bottom' as kind from judged order by similarity, segment_id limit 3)")
def top_bottom_segments(spark, d):
    return hypotheses.top_bottom_segments(fx.judged(spark, d).select("segment_id", "similarity"))


@query(HYP + "select segment_id, hypothesis_id, row_number() over (partition by segment_id order by round(similarity, 9) desc, hypothesis_id)::int as rank from z")
def ranked_hypotheses(spark, d):
    rows = hypotheses.match_source_to_hypotheses(fx.sources(spark, d).drop("source_text"), fx.hypotheses(spark, d))
    return hypotheses.ranked_hypotheses(rows).select("segment_id", "hypothesis_id", "rank")


@query(fx.with_sql("attempts", "judged") + "select segment_id, case when similarity < 0.6 then 'Niedrig (' else 'OK (' end || printf('%.3f', similarity) || ')' as status, case when similarity < 0.6 then 'CHECK MANUALLY' else '' end as flag from judged")
def similarity_status(spark, d):
    return fx.judged(spark, d).withColumn("x", tx.similarity_status(F.col("similarity"), 0.6)).select("segment_id", "x.status", "x.flag")


# entities

def _protected(spark, d):
    return composites.protect_spans(fx.segments(spark, d), fx.entity_spans(spark, d), ["the", "und"])


@query(SEG + r", f as (select media_id, seq, text, regexp_extract(text, '^[\p{L}\p{N}_]+') as w from segments) select media_id, seq, case when seq % 4 = 0 and w <> '' then '<extra_id_0>' || substr(text, length(w) + 1) else text end as text from f")
def protect_spans(spark, d):
    return composites.protect_spans(fx.segments(spark, d), fx.entity_spans(spark, d)).select("media_id", "seq", "text")


def _json(entries: str) -> str:
    """The text of an entity map, of a list of structs with key, t, label, a, b, lang."""
    shown = """'"' || e.key || '":{"text":"' || e.t || '","label":"' || e.label || '","start":' || e.a || ',"end":' || e.b || ',"language":"' || e.lang || '"}'"""
    return f"'{{' || array_to_string(list_transform({entries}, lambda e: {shown}), ',') || '}}'"


def _key(k: str) -> str:
    return f"('<extra_id_' || {k} || '>')"


#: Segments with two words and, in every fourth, the first word behind placeholders: word by word, then the span.
PROTECTED = (
    SEG
    + r", p0 as (select media_id, seq, text as given, case when seq % 4 = 0 then regexp_extract(text, '^[\p{L}\p{N}_]+') else '' end as w from segments),"
    + f"""
p1 as (select *, strpos(given, 'the') as at1, replace(given, 'the', {_key('0')}) as text1 from p0),
p2 as (select *, strpos(text1, 'und') as at2, (at1 > 0)::int as k1, replace(text1, 'und', {_key('(at1 > 0)::int')}) as text2 from p1),
p3 as (select *, k1 + (at2 > 0)::int as k2, substr(text2, 1, length(w)) as found from p2),
p4 as (select *, case when w <> '' then {_key('k2')} || substr(text2, length(w) + 1) else text2 end as text,
  case when at1 > 0 then [{{'key': {_key('0')}, 't': 'the', 'label': 'CUSTOM', 'a': at1 - 1, 'b': at1 + 2, 'lang': 'en'}}] else [] end
  || case when at2 > 0 then [{{'key': {_key('k1')}, 't': 'und', 'label': 'CUSTOM', 'a': at2 - 1, 'b': at2 + 2, 'lang': 'en'}}] else [] end
  || case when w <> '' then [{{'key': {_key('k2')}, 't': found, 'label': 'PERSON', 'a': 0, 'b': length(w), 'lang': 'en'}}] else [] end as entries from p3),
protected as (select *, {_json('entries')} as map from p4)
"""
)


def _restored(text: str) -> str:
    mended = rf"regexp_replace({text}, '(?i)(?:&lt;|<)\s*extra[_\s-]*id[_\s-]*(\d+)\s*(?:&gt;|>)', '<extra_id_\1>', 'g')"
    each = "list_transform(entries, lambda e: {'v': '', 'key': e.key, 't': e.t})"
    out = f"(list_reduce({each}, lambda a, x: {{'v': replace(a.v, x.key, x.t), 'key': '', 't': ''}}, {{'v': {mended}, 'key': '', 't': ''}})).v"
    return f"case when len(entries) > 0 then {SQUEEZE.format(out)} else {text} end"


def _rebased_sql() -> str:
    moved = "list_transform(entries, lambda e: {'key': e.key, 't': e.t, 'label': e.label, 'a': greatest(e.a - 10, 0), 'b': greatest(e.a - 10, 0) + e.b - e.a, 'lang': e.lang})"
    return PROTECTED + f"select media_id, seq, {_json(f'list_filter({moved}, lambda e: e.a < 40)')} as entity_map from protected"


def _issues_sql() -> str:
    find = lambda t: f"regexp_extract_all({t}, '<extra_id_\\d+>')"
    text_of = lambda kind, xs: f"list_transform({xs}, lambda e: '{kind}: ' || e.t)"
    named = lambda kind, xs: f"list_transform({xs}, lambda v: '{kind}: ' || v)"
    labels = ", ".join(f"'{x}'" for x in en.IMPORTANT_LABELS)
    unprotected = "list_filter(entries, lambda e: contains(original, e.t) and not contains(text, e.key))"
    lost = f"list_sort(list_distinct(list_filter({find('text')}, lambda v: not list_contains({find('translated')}, v))))"
    missing = f"list_filter(entries, lambda e: e.label in ({labels}) and not contains(restored, e.t))"
    broken = f"list_filter({missing}, lambda e: contains(e.t, ' ') and len(list_filter(string_split(e.t, ' '), lambda v: contains(restored, v))) > 0)"
    every = " || ".join([text_of("not protected", unprotected), named("placeholder lost", lost), named("placeholder left", f"list_distinct({find('restored')})"), text_of("missing", missing), text_of("broken up", broken)])
    return (
        PROTECTED
        + f", q as (select *, {_restored('text')} as original, case when seq % 8 = 0 then replace(text, '<extra_id_0>', '') else text end as translated from protected)"
        + f", r as (select *, {_restored('translated')} as restored from q) select media_id, seq, unnest({every}) as issue from r"
    )


@query(PROTECTED + "select media_id, seq, text, map as entity_map from protected")
def protect_words(spark, d):
    return _protected(spark, d).select("media_id", "seq", "text", en.entity_map_to_json(F.col("entity_map")).alias("entity_map"))


@query(SEG + r", f as (select media_id, seq, text, regexp_extract(text, '^[\p{L}\p{N}_]+') as w from segments) select media_id, seq, case when seq % 4 = 0 and w <> '' then trim(regexp_replace(text, '\s+', ' ', 'g')) else text end as text from f")
def restore_entities(spark, d):
    p = composites.protect_spans(fx.segments(spark, d), fx.entity_spans(spark, d))
    return p.select("media_id", "seq", en.restore_entities(F.col("text"), F.col("entity_map")).alias("text"))


QUERIES["reapply_entities"], ORACLE["reapply_entities"] = None, ORACLE["protect_spans"]


def reapply_entities(spark, d):
    p = composites.protect_spans(fx.segments(spark, d).withColumn("original", F.col("text")), fx.entity_spans(spark, d))
    return p.select("media_id", "seq", en.reapply_entities(F.col("original"), F.col("entity_map")).alias("text"))


QUERIES["reapply_entities"] = reapply_entities


@query(_issues_sql())
def entity_issues(spark, d):
    p = _protected(spark, d).withColumn("original", en.restore_entities(F.col("text"), F.col("entity_map")))
    lost = F.when(F.col("seq") % 8 == 0, F.replace("text", F.lit("<extra_id_0>"), F.lit(""))).otherwise(F.col("text"))
    p = p.withColumn("translated", lost)
    issues = en.entity_issues(F.col("original"), F.col("text"), F.col("translated"), en.restore_entities(F.col("translated"), F.col("entity_map")), F.col("entity_map"))
    return p.select("media_id", "seq", F.explode(issues).alias("issue"))


@query(SEG + r"select media_id, seq, case when seq % 4 = 0 and seq % 8 = 0 and regexp_matches(text, '^[\p{L}\p{N}_]') then ['<extra_id_0>'] else []::varchar[] end as lost from segments")
def lost_placeholders(spark, d):
    p = composites.protect_spans(fx.segments(spark, d), fx.entity_spans(spark, d))
    translated = F.when(F.col("seq") % 8 == 0, F.replace("text", F.lit("<extra_id_0>"), F.lit(""))).otherwise(F.col("text"))
    return p.select("media_id", "seq", en.lost_placeholders(F.col("text"), translated).alias("lost"))


@query(PROTECTED + "select media_id, seq, map as entity_map from protected")
def entity_map_json(spark, d):
    there = en.entity_map_from_json(en.entity_map_to_json(F.col("entity_map")))
    return _protected(spark, d).select("media_id", "seq", en.entity_map_to_json(there).alias("entity_map"))


@query(_rebased_sql())
def rebase_entities(spark, d):
    p = _protected(spark, d)
    return p.select("media_id", "seq", en.entity_map_to_json(en.rebase_entities(F.col("entity_map"), F.lit(10), F.lit(40))).alias("entity_map"))


@query(SEG + ", d as (select unnest(['the', 'and', 'des', 'que', 'der', 'una', 'pas', 'with']) as term) select string_agg('- ' || term || ': ' || upper(term), chr(10) order by term) as glossary from (select distinct term from d join segments on contains(text, term))")
def glossary_text(spark, d):
    g = spark.createDataFrame([(t, t.upper()) for t in TERMS if "." not in t], "term string, options string")
    found = joins.dictionary_hits(fx.segments(spark, d), g.select(F.col("term").alias("word"))).select(F.explode("words").alias("term")).distinct()
    used = found.join(g, "term")
    return used.agg(joins.glossary_text().alias("glossary"))


# sources: typed rows of what the readers parse

@query(SEG + "select media_id, seq, 'chunk' || seq || '-2.wav' as chunk_path from segments where seq % 3 <> 1 union all select media_id, seq, 'chunk' || seq || '.wav' from segments where seq % 3 = 1")
def latest_manifest(spark, d):
    m = fx.manifest(spark, d).select("media_id", "seq", "chunk_path", F.lit(0).alias("line_no"))
    again = m.withColumn("chunk_path", F.when(F.col("seq") % 3 != 1, F.concat(F.lit("chunk"), F.col("seq"), F.lit("-2.wav"))).otherwise("")).withColumn("line_no", F.lit(1))
    return segment_io.latest_manifest(m.unionByName(again)).select("media_id", "seq", "chunk_path")


@query(fx.with_sql("hypotheses") + "select segment_id, hypothesis_id::int as hypothesis_id, text, beam_score_raw as score from hypotheses")
def flat_hypotheses(spark, d):
    h = fx.hypotheses(spark, d).groupBy("segment_id").agg(F.sort_array(F.collect_list(F.struct("hypothesis_id", "text", F.col("beam_score_raw").alias("score")))).alias("x"))
    nested = h.select("segment_id", F.lit("s").alias("source_text"), F.transform("x", lambda x: F.struct(x["text"].alias("text"), x["score"].alias("score"))).alias("hypotheses"))
    return segment_io.flat_hypotheses(nested).drop("source_text")


@query("select vec_id, len(embedding)::int as dim, list_transform(embedding, lambda x: round(x::double, 4) + 0.0) as numbers from embeddings")
def export_embeddings(spark, d):
    e = segment_io.export_embeddings(spark.read.parquet(f"{d}/embeddings.parquet"))
    back = F.from_json("embedding_text", "array<float>")
    return e.select("vec_id", F.size(back).alias("dim"), F.transform(back, lambda x: F.round(x.cast("double"), 4)).alias("numbers"))


@query(TRN + "select media_id, seq, text || '!' as text from turns")
def map_batches(spark, d):
    def marked(texts: list[str]) -> list[str]:
        return [f"{t}!" for t in texts]

    return batches.map_batches(fx.turns(spark, d).select("media_id", "seq", "text"), marked)


@query()
def text_vectors(spark, d):
    return batches.text_vectors(fx.turns(spark, d)).select("media_id", "seq", "embedding")


# sources and sinks: written to the shared folder and read back

RAW = ", raw as (select media_id, seq, case when seq % 50 = 7 then 'bad' else printf('%d:%02d:%02d', (case when seq % 50 = 9 then end_sec else start_sec end)::bigint // 3600, (case when seq % 50 = 9 then end_sec else start_sec end)::bigint % 3600 // 60, (case when seq % 50 = 9 then end_sec else start_sec end)::bigint % 60) end as startzeit, printf('%d:%02d:%02d', (case when seq % 50 = 9 then start_sec else end_sec end)::bigint // 3600, (case when seq % 50 = 9 then start_sec else end_sec end)::bigint % 3600 // 60, (case when seq % 50 = 9 then start_sec else end_sec end)::bigint % 60) as endzeit, text from segments)"


def _lines(spark, d, name, *columns):
    """Lines of pipe-delimited fields in the shared folder."""
    path = shared_folder(spark, name)
    fx.raw_segments(spark, d).select(F.concat_ws("|", *columns)).write.text(path)
    return path


@query(SEG + RAW + " select media_id::varchar as media_id, seq::varchar as seq, startzeit, endzeit, text from raw")
def read_segments(spark, d):
    path = shared_folder(spark, "segments")
    segment_io.write_segments(fx.raw_segments(spark, d), path)
    return segment_io.read_segments(spark, path)


QUERIES["write_segments"], ORACLE["write_segments"] = read_segments, ORACLE["read_segments"]


@query(SEG + ", s as (select start_sec, end_sec, trim(text) as text, text as whole from segments where seq % 50 not in (7, 9)), w as (select end_sec, start_sec, trim(text) as text, text as whole from segments where seq % 50 = 9) select start_sec, end_sec, text from s where not contains(whole, '|') union all select end_sec as start_sec, start_sec as end_sec, text from w where not contains(whole, '|')")
def read_segments_strict(spark, d):
    return segment_io.read_segments_strict(spark, _lines(spark, d, "strict", "startzeit", "endzeit", "text"))


@query(SEG + RAW + " select startzeit, endzeit, trim(split_part(text, '|', 1)) as text from raw")
def read_segments_numbered(spark, d):
    return segment_io.read_segments_numbered(spark, _lines(spark, d, "numbered", "startzeit", "endzeit", "text")).drop("file", "id")


@query(SEG + "select media_id * 100000 + seq as original_id, 'chunk' || seq || '.wav' as chunk_path from segments where seq % 11 <> 3")
def read_manifest(spark, d):
    clip = F.when(F.col("seq") % 11 != 3, F.concat(F.lit("chunk"), F.col("seq"), F.lit(".wav"))).otherwise("")
    number = (F.col("media_id") * 100000 + F.col("seq")).cast("string")
    path = _lines(spark, d, "manifest", "startzeit", "endzeit", F.translate("text", "|", ","), clip, number)
    return segment_io.read_manifest(spark, path).select("original_id", "chunk_path")


@query(fx.with_sql("hypotheses") + "select segment_id, hypothesis_id::int as hypothesis_id, text, beam_score_raw as score from hypotheses")
def append_hypotheses(spark, d):
    each = F.sort_array(F.collect_list(F.struct("hypothesis_id", "text", F.col("beam_score_raw").alias("score"))))
    h = fx.hypotheses(spark, d).groupBy("segment_id").agg(F.transform(each, lambda x: F.struct(x["text"].alias("text"), x["score"].alias("score"))).alias("hypotheses"))
    path = shared_folder(spark, "hypotheses")
    for k in range(2):  # two appends, as of an interrupted run and its successor
        segment_io.append_hypotheses(h.withColumn("source_text", F.lit("s")).filter(F.col("segment_id") % 2 == k), path)
    return spark.read.parquet(path).select("segment_id", "hypothesis_id", "text", "score")


@query(fx.with_sql("hypotheses") + """select segment_id, hypothesis_id::int as hypothesis_id, text, beam_score_raw as score, case when segment_id % 3 > 0 then beam_score_raw end as beam_score_raw,
case when segment_id % 3 = 2 then hypothesis_id = 0 end as is_best, case when segment_id % 3 = 1 then num_tokens end as tokens, case when segment_id % 3 = 2 then text end as shown from hypotheses""")
def read_hypotheses(spark, d):
    """Three runs append, each with other columns; a struct of the second has other fields in the third."""
    path, h = shared_folder(spark, "evolving"), fx.hypotheses(spark, d)
    best = (F.col("hypothesis_id") == 0).alias("is_best")
    tokens, shown = F.struct(F.col("num_tokens").alias("tokens")).alias("detail"), F.struct(F.col("text").alias("shown")).alias("detail")
    for k, more in enumerate(([], ["beam_score_raw", tokens], [F.col("beam_score_raw").cast("float").alias("beam_score_raw"), best, shown])):
        each = F.struct("hypothesis_id", "text", F.col("beam_score_raw").alias("score"), *more)
        lists = h.filter(F.col("segment_id") % 3 == k).groupBy("segment_id").agg(F.array_sort(F.collect_list(each), lambda a, b: (a["hypothesis_id"] - b["hypothesis_id"]).cast("int")).alias("hypotheses"))
        lists = lists.withColumn("hypotheses", F.transform("hypotheses", lambda x: x.dropFields("hypothesis_id"))).withColumn("source_text", F.lit("s"))
        segment_io.append_hypotheses(lists, path)
    rows = segment_io.read_hypotheses(spark, path).withColumn("beam_score_raw", F.round("beam_score_raw", 1))
    return rows.select("segment_id", "hypothesis_id", "text", "score", "beam_score_raw", "is_best", "detail.tokens", "detail.shown")


BROKEN = SEG + RAW + """, plain as (select media_id, seq, startzeit, endzeit, translate(text, '|"', '') as t from raw),
broken as (select *, seq % 13 = 3 as cut, seq % 17 = 5 and seq % 13 <> 3 as long from plain)
"""


def _broken(spark, d):
    """Segments of which some lines lack fields and some have one too many; some times do not parse."""
    fields = ["media_id", "seq", "startzeit", "endzeit", F.translate("text", '|"', "")]
    line = F.when(F.col("seq") % 13 == 3, F.concat_ws("|", *fields[:3])).when(F.col("seq") % 17 == 5, F.concat_ws("|", *fields, F.lit("more"))).otherwise(F.concat_ws("|", *fields))
    path = shared_folder(spark, "broken")
    fx.raw_segments(spark, d).select(line).write.text(path)
    return segment_io.read_segments_checked(spark, path, ["media_id", "seq", "startzeit", "endzeit", "text"])


_CLOCK = "({0}.split(':')[1]::bigint * 3600 + {0}.split(':')[2]::bigint * 60 + {0}.split(':')[3]::bigint)::double"


@query(BROKEN + f"select media_id::varchar as media_id, seq::varchar as seq, startzeit, endzeit, t as text, {_CLOCK.format('startzeit')} as start_sec, {_CLOCK.format('endzeit')} as end_sec from broken where not cut and not long and startzeit <> 'bad'")
def read_segments_checked(spark, d):
    return _broken(spark, d)[0]


@query(BROKEN + """select case when cut then media_id || '|' || seq || '|' || startzeit else media_id || '|' || seq || '|' || startzeit || '|' || endzeit || '|' || t || case when long then '|more' else '' end end as line,
case when cut or long then 'malformed' else 'start does not parse' end as reason from broken where cut or long or startzeit = 'bad'""")
def rejected_segments(spark, d):
    return _broken(spark, d)[1].drop("file")


@query(fx.with_sql("segments", "manifest") + "select media_id, seq, start_sec, end_sec, text, chunk_path, round(actual_sec, 4) as actual_sec from manifest")
def append_manifest(spark, d):
    path = shared_folder(spark, "manifest")
    for k in range(2):
        segment_io.append_manifest(fx.manifest(spark, d).filter(F.col("seq") % 2 == k), path)
    return _rounded(spark.read.parquet(path), "actual_sec")


@query(fx.with_sql("speech") + "select media_id, count(*)::bigint as n, round(sum(end_sec - start_sec), 1) as seconds from speech group by media_id")
def write_speech_intervals(spark, d):
    path = shared_folder(spark, "speech")
    segment_io.write_speech_intervals(fx.speech(spark, d), path)
    back = spark.read.schema("media_id long, start double, end double").json(path)
    return back.groupBy("media_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("end") - F.col("start")), 1).alias("seconds"))


# streams: the events as they would arrive, run until nothing is left

def _arriving(spark, d):
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    rows = streams.stream_segments(spark, f"{d}/events*.parquet", schema)
    return rows.selectExpr("user_id as media_id", "event_id as seq", "unix_micros(timestamp(ts)) / 1000000.0D as start_sec", "unix_micros(timestamp(ts)) / 1000000.0D + 1 + event_id % 9 as end_sec", "event_type as text", "timestamp(ts) as ts")


def _shuffled(spark, d, parts=4):
    """The events as parts that arrive one after the other, each with rows of all times, and a last row from far ahead, of
    medium -1, that lets the watermark pass all of them."""
    path = shared_folder(spark, "shuffled")
    rows = spark.read.parquet(f"{d}/events.parquet").selectExpr("user_id as media_id", "event_id as seq", "unix_micros(timestamp(ts)) / 1000000.0D as start_sec", "unix_micros(timestamp(ts)) / 1000000.0D + 1 + event_id % 9 as end_sec", "event_type as text", "timestamp(ts) as ts")
    part = F.pmod(F.xxhash64("seq"), F.lit(parts))
    for k in range(parts):
        rows.filter(part == k).write.mode("append").parquet(path)
    last = spark.range(1).selectExpr("-1L as media_id", "0L as seq", "7258118400.0D as start_sec", "7258118400.0D as end_sec", "'end' as text", "timestamp '2200-01-01 00:00:00' as ts")
    last.select(*(F.col(f.name).cast(f.dataType) for f in rows.schema)).write.mode("append").parquet(path)
    return streams.stream_segments(spark, path, rows.schema, files_per_batch=16)


def _drained(spark, df, name, mode):
    """All rows that the query gives until its input ends, from a table that they are appended to."""
    path = shared_folder(spark, name)
    with streams.with_rocksdb(spark):
        streams.stream_append(df, f"{path}/rows", f"{path}/state", name, mode).trigger(availableNow=True).start().awaitTermination()
    return streams.read_appended(spark, f"{path}/rows", df.schema).drop("writer", "batch_id")


@query(fx.with_sql("speech") + "select media_id, seq, event_type as text from speech")
def stream_segments(spark, d):
    return _drained(spark, _arriving(spark, d), "arriving", "append").select("media_id", "seq", "text")


@query(fx.with_sql("speech") + "select distinct media_id, seq from speech")
def stream_resume(spark, d):
    twice = _arriving(spark, d).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return _drained(spark, streams.stream_resume(twice, delay="3650 days"), "resumed", "append").select("media_id", "seq")


@query(fx.with_sql("speech") + "select media_id, count(*)::bigint as done, case when media_id % 3 <> 1 then count(*) + media_id % 3 end::bigint as expected, coalesce(media_id % 3 <> 2, true) as complete from speech group by media_id")
def stream_progress(spark, d):
    """Of the media, by id modulo 3: as many rows as expected, expected not known, and two more expected."""
    expected = fx.speech(spark, d).groupBy("media_id").agg((F.count(F.lit(1)) + F.col("media_id") % 3).alias("expected")).filter("media_id % 3 <> 1")
    rows = _drained(spark, streams.stream_progress(_arriving(spark, d), expected, "3650 days"), "progress", "update")
    return rows.groupBy("media_id").agg(F.max_by(F.struct("done", "expected", "complete"), "done").alias("x")).select("media_id", "x.*")


@query("with w as (select user_id as media_id, unnest([epoch_us(ts) // 27000000, epoch_us(ts) // 27000000 - 1]) as k, epoch_us(ts) as t from events) select media_id, k * 27 as part_start, count(*)::bigint as n from w where t < k * 27000000 + 30000000 group by 1, 2")
def stream_parts(spark, d):
    rows = _drained(spark, streams.stream_parts(_arriving(spark, d), 30, delay="3650 days"), "parts", "update")
    return rows.groupBy("media_id", F.unix_seconds("part_start").alias("part_start")).agg(F.max("n").alias("n"))


SPOKEN = fx.with_sql("speech") + ", spoken as (select media_id, seq, start_sec, end_sec, event_type as text from speech), "


@query(SPOKEN + st.gap_merged("spoken", 3600, 100_000, 400, "m") + " select media_id, seq, start_sec, end_sec, text, n_rows from m")
def stream_gap_merge(spark, d):
    merged = streams.stream_gap_merge(_shuffled(spark, d), 3600, 100_000, 400, delay="3650 days")
    return _drained(spark, merged, "merged", "append").filter("media_id >= 0")


@query(SPOKEN + """ l as (select *, lag(start_sec) over (partition by media_id order by start_sec, seq) as before from spoken),
i as (select *, sum(case when start_sec - before < 7200 then 0 else 1 end) over (partition by media_id order by start_sec, seq rows unbounded preceding) as island from l)
select media_id, min(start_sec) as begin, max(start_sec) + 7200 as "end", count(*)::bigint as n from i group by media_id, island""")
def stream_gap_sessions(spark, d):
    sessions = _drained(spark, streams.stream_gap_sessions(_shuffled(spark, d), "2 hours", delay="3650 days"), "sessions", "append").filter("media_id >= 0")
    return sessions.select("media_id", *((F.unix_micros(c) / 1_000_000.0).alias(c) for c in ("begin", "end")), "n")


@query(fx.with_sql("speech") + "select media_id, seq, start_sec, event_type as text from speech")
def stream_append(spark, d):
    """Two streams append to one table; the second starts anew after its first run's last commit was lost."""
    path, rows = shared_folder(spark, "appended"), _arriving(spark, d)
    for k in range(2):
        mine = rows.filter(F.col("seq") % 2 == k)
        streams.stream_append(mine, f"{path}/rows", f"{path}/state{k}", f"half{k}").trigger(availableNow=True).start().awaitTermination()
    back = streams.read_appended(spark, f"{path}/rows", rows.schema)
    first = back.filter("writer = 'half1' and batch_id = 0").drop("writer", "batch_id")
    streams.append_batch(segment_io.settled(first, f"{path}/again"), 0, f"{path}/rows", "half1")  # a batch that is tried again
    return streams.read_appended(spark, f"{path}/rows", rows.schema).select("media_id", "seq", "start_sec", "text")


# composites

ROUNDED = "select media_id, seq, round(start_sec, 4) as start_sec, round(end_sec, 4) as end_sec, text from {}"


#: Rows whose times parse and are in order.
RAW0 = ", raw0 as (select media_id, seq, start_sec, end_sec, text from segments where seq % 50 not in (7, 9)), "


#: Rounds of merging and splitting, as by default.
ROUNDS = 10


def _merge_sql() -> str:
    """Rounds of merging by gap and splitting with floored times, then short ones joined, three times over."""
    parts, rows = [], "raw0"
    for k in range(ROUNDS):
        parts.append(st.gap_merged(rows, 0.5, 60, 400, f"g{k}"))
        parts.append(f"l{k} as materialized (select *, length(text) > 400 as long from g{k})")
        pieces = f"case when long then {st.split_capped('text', 400)} else [text] end"
        parts.append(st.timed(f"l{k}", pieces, f"t{k}", kept="media_id, seq, n, long"))
        down = lambda c: f"case when long then floor({c})::double else {c} end as {c}"
        parts.append(f"d{k} as (select media_id, seq, piece, {down('start_sec')}, {down('end_sec')}, text from t{k})")
        rows = f"r{k}"
        parts.append(st.renumbered(f"d{k}", rows).replace(f"{rows} as (", f"{rows} as materialized (", 1))
    parts += [st.force_merged(rows, 3, 3, "f0"), st.force_merged("f0", 3, 3, "f1"), st.force_merged("f1", 3, 3, "f")]
    return SEG + RAW0 + ", ".join(parts)


def _tts_sql() -> str:
    n, w = "length(x.r.text)", st.count_words("x.r.text")
    joins = f"(a.k >= 0 and a.chars + 1 + {n} <= 400)"
    step = {"k": f"case when {joins} then a.k else a.k + 1 end", "chars": f"(case when {joins} then a.chars + 1 + {n} else {n} end)::bigint"}
    packed = st.parted("u", {"k": "-1::bigint", "chars": "0::bigint"}, step, "p")
    on = "(a.k >= 0 and a.words < 5)"
    step = {"k": f"case when {on} then a.k else a.k + 1 end", "words": f"(case when {on} then a.words + {w} else {w} end)::bigint"}
    absorbed = st.parted("q", {"k": "-1::bigint", "words": "0::bigint"}, step, "b")
    sentences = st.timed("segments", st.split_sentences_abbrev("text", "de"), "t", exact_end=False)
    group = lambda source, name: f"{name} as (select * exclude (n_rows, part) from (select {st.joined('part')} from {source} group by media_id, part))"
    dots = r"select * replace (trim(regexp_replace(trim(text), '\.+$', '...')) as text) from z"
    return SEG + ", " + ",\n".join([sentences, st.renumbered("t", "u"), packed, group("p", "q"), absorbed, group("b", "z")]) + ", y as (" + dots + ") " + ROUNDED.format("y")


def _translation_sql() -> str:
    """The first word of each fourth segment is protected and restored, which squeezes the blanks of its text."""
    word = r"regexp_matches(text, '^[\p{L}\p{N}_]')"
    restored = rf"s as (select media_id, seq, start_sec, end_sec, case when seq % 4 = 0 and {word} then trim(regexp_replace(text, '\s+', ' ', 'g')) else text end as text from segments)"
    clean = _sanitized(tx.PLACEHOLDERS_ALL).replace("coalesce(text, '')", "coalesce(one, '')")
    pieces = f"list_filter(list_transform({st.split_text('text', 400, 4, 'de')}, lambda one: {clean}), lambda p: p <> '')"
    return SEG + f", {restored}, {st.timed('s', pieces, 't')}, {st.renumbered('t', 'u')} " + ROUNDED.format("u")


_RAW_SPEED = "case when actual_sec > 0.01 and end_sec - start_sec > 0.01 then actual_sec / (end_sec - start_sec) else 1 end"
ASSEMBLY = (
    _recursive(fx.with_sql("segments", "manifest"))
    + f", v as (select *, {_RAW_SPEED} as raw, greatest(0.9, least(1.3, {_RAW_SPEED})) as kept from manifest)"
    + ", played as (select *, round(kept, 9) as speed, abs(kept - raw) > 0.01 as capped, actual_sec / round(kept, 9) as played_sec from v)"
    + _laid("played", "played_sec")
    + "select w.media_id, w.seq, w.start_sec, w.end_sec, round(e, 4) as effective_start, round(case when gap > 0.02 then gap else 0 end, 4) as silence, had_overlap,"
    + f" round(running, 4) as effective_end, chunk_path, round(actual_sec, 4) as actual_sec, round(speed, 4) as speed, capped, {st.tempo('speed')} as tempo"
    + " from w join played using (media_id, seq)"
)


@query(_merge_sql() + " select * from f")
def merge_transcript(spark, d):
    return composites.merge_transcript(segment_io.typed_segments(fx.raw_segments(spark, d)), 3, 60, 0.5, 400, ROUNDS)


_LAST = f"l{ROUNDS - 1}"


@query(_merge_sql() + f" select (select count(*) from segments) as rows_read, (select count(*) from raw0) as rows_valid, (select count(*) from f) as rows_final, (select count(*) from {_LAST} where long and {st.count_words('text')} < 3) as rows_protected")
def merge_report(spark, d):
    return composites.merge_report(segment_io.typed_segments(fx.raw_segments(spark, d)), 3, 60, 0.5, 400, ROUNDS)[1]


@query(_tts_sql())
def format_for_tts(spark, d):
    return _rounded(composites.format_for_tts(fx.segments(spark, d), 400, 5), "start_sec", "end_sec")


@query(SEG + ", " + st.timed("segments", st.split_text("text", 400, 4, "de"), "t") + ", " + st.renumbered("t", "u") + ", " + st.force_merged("u", 0, 4, "f") + " " + ROUNDED.format("f"))
def format_for_tts_split(spark, d):
    return _rounded(composites.format_for_tts_split(fx.segments(spark, d), 400), "start_sec", "end_sec")


@query(_translation_sql())
def format_translation(spark, d):
    return _rounded(composites.format_translation(fx.segments(spark, d), fx.entity_spans(spark, d), 400)[0], "start_sec", "end_sec")


def _refined_sql() -> str:
    """The first word of each fourth segment is protected and restored; its entry of the map goes along, the last of a group counting."""
    word, o = r"regexp_extract(text, '^[\p{L}\p{N}_]+')", "order by start_sec, seq"
    fragile = r"(regexp_matches(t, '^\p{Ll}') or regexp_matches(t, '(?i)^(und|aber|oder|doch)($|[^\p{L}\p{N}_])')) and not regexp_matches(before, '[.!?]$') and not regexp_matches(t, '^[0-9]')"
    clean = _sanitized(tx.PLACEHOLDERS_KEPT_OUT)
    sentences = st.let(st.split_sentences_abbrev("text", "de"), lambda v: f"case when len({v}) > 0 then {v} else [text] end", "found")
    steps = [
        f"a as (select media_id, seq, start_sec, end_sec, text, case when seq % 4 = 0 then nullif({word}, '') end as w from segments)",
        f"b as (select * replace (case when w is not null then {SQUEEZE.format('text')} else text end as text) from a)",
        f"c as (select *, trim(text) as t, lag(trim(text)) over {st.ORDER} as before from b)",
        f"e as (select *, sum(case when before is not null and ({fragile}) then 0 else 1 end) over {st.SO_FAR} as part from c)",
        f"g as (select {st.joined('part')}, last(w {o}) filter (where w is not null) as w from e group by media_id, part)",
        f"h as (select media_id, seq, start_sec, end_sec, {clean} as text, w from g)",
        st.timed("h", sentences, "i", kept="media_id, seq, w"),
        f"j as (select *, case when piece = 0 or {st.count_words('text')} >= 3 then 1 else 0 end as opens, case when length(text) > 0 then w end as m from i)",
        "k as (select *, sum(opens) over (partition by media_id, seq order by piece rows unbounded preceding) as part from j)",
        "l as (select media_id, seq, part::int as piece, first(start_sec order by k.piece) as start_sec, last(end_sec order by k.piece) as end_sec, string_agg(text, ' ' order by k.piece) as text, last(m order by k.piece) filter (where m is not null) as m from k group by media_id, seq, part)",
        st.renumbered("l", "z", ", m"),
    ]
    one = "[{'key': '<extra_id_0>', 't': m, 'label': 'PERSON', 'a': 0, 'b': length(m), 'lang': 'de'}]"
    shown = f"case when m is null then '{{}}' else {_json(one)} end as entity_map"
    return SEG + ", " + ",\n".join(steps) + f" select media_id, seq, round(start_sec, 4) as start_sec, round(end_sec, 4) as end_sec, text, {shown} from z"


@query(_refined_sql())
def refine_segments(spark, d):
    r = composites.refine_segments(fx.segments(spark, d), fx.entity_spans(spark, d))
    return _rounded(r.withColumn("entity_map", en.entity_map_to_json(F.col("entity_map"))), "start_sec", "end_sec")


def _pairs(spark, d):
    """Every hypothesis but the source's own, as a segment of its own, with the source's vector."""
    h = fx.hypotheses(spark, d).filter("hypothesis_id > 0").join(fx.sources(spark, d).drop("source_text"), "segment_id")
    return h.select((F.col("segment_id") * 5 + F.col("hypothesis_id")).alias("segment_id"), "text", "embedding", "source_embedding")


def _evaluated_sql() -> str:
    """FOLD gives the corrections; the report joins those that were accepted."""
    pairs = ", pairs as (select segment_id * 5 + hypothesis_id as segment_id, text, similarity from z where hypothesis_id > 0)"
    better = FOLD.replace("from judged j", "from pairs j").replace("select segment_id, s0", ", f as (select segment_id, s0") + ")"
    status = "case when p.similarity < 0.6 then 'Niedrig (' else 'OK (' end || printf('%.3f', p.similarity) || ')'"
    flag = "case when f.segment_id is not null then 'AUTO-CORRECTED' when p.similarity < 0.6 then 'CHECK MANUALLY' else '' end"
    return (
        fx.with_sql("hypotheses", "attempts") + SIM + pairs + better
        + f" select p.segment_id, coalesce(f.text, p.text) as text, round(p.similarity, 4) as similarity, round(f.similarity, 4) as corrected_similarity, {status} as status, {flag} as flag"
        + " from pairs p left join (select * from f where flag = 'AUTO-CORRECTED') f using (segment_id)"
    )


@query(_evaluated_sql())
def evaluate_quality(spark, d):
    return _rounded(composites.evaluate_quality(_pairs(spark, d), fx.attempts(spark, d), 0.6)[0], "similarity", "corrected_similarity")


@query(ORACLE["polish_summary"])
def polish(spark, d):
    return _rounded(composites.polish(fx.judged(spark, d), fx.attempts(spark, d))[1], "mean_before", "mean_after")


@query(fx.with_sql("segments", "hypotheses") + SIM + ", b as (select segment_id, arg_max(text, {'s': round(similarity, 9), 'h': -hypothesis_id}) as best from z group by 1) select media_id, seq, segment_id, coalesce(best, text) as text from (select media_id, seq, media_id as segment_id, text from segments) s left join b using (segment_id)")
def select_best(spark, d):
    seg = fx.segments(spark, d).select("media_id", "seq", F.col("media_id").alias("segment_id"), "text")
    return composites.select_best(seg, fx.sources(spark, d), fx.hypotheses(spark, d).withColumn("score", F.col("beam_score_raw")), report=False)[0]


@query(fx.with_sql("segments", "progress") + ", t as (select s.* from segments s anti join progress using (media_id, seq)), n as (select media_id, seq, row_number() over (partition by media_id order by start_sec, seq) - 1 as place from t) select media_id, seq, place // 32 as batch, place::int as place from n")
def prepare_translation(spark, d):
    return composites.prepare_translation(fx.segments(spark, d), fx.progress(spark, d)).select("media_id", "seq", "batch", "place")


@query(
    SEG
    + f", good as (select media_id, seq, start_sec, end_sec, {_sanitized(tx.PLACEHOLDERS_ALL)} as text from segments where (media_id + seq) % 3 <> 0 and end_sec > start_sec and length(trim(text)) >= 3 and lower(trim(text)) not in ('de', 'en', 'fr', 'es', 'dt>', 'de.', 'en.'))"
    + " select media_id, seq, start_sec, end_sec, text from segments where (media_id + seq) % 3 = 0 union all select * from good"
)
def finish_translation(spark, d):
    rows = fx.segments(spark, d).select(*composites.CORE)
    old = (F.col("media_id") + F.col("seq")) % 3 == 0
    return composites.finish_translation(rows.filter(~old), rows.filter(old))


@query(ASSEMBLY)
def assembly_plan(spark, d):
    return _rounded(composites.assembly_plan(fx.manifest(spark, d)), "effective_start", "silence", "effective_end", "actual_sec", "speed")


@query(SEG + "select lang, count(*) as segments, count(distinct media_id) as media, round(sum(end_sec - start_sec), 4) as seconds from segments group by lang")
def segments_by_language(spark, d):
    return fx.segments(spark, d).groupBy("lang").agg(F.count(F.lit(1)).alias("segments"), F.count_distinct("media_id").alias("media"), F.round(F.sum(F.col("end_sec") - F.col("start_sec")), 4).alias("seconds"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Merged chunks and their statistics by language: parse, filter, merge by gap, aggregate."""
    raw = segment_io.typed_segments(fx.raw_segments(spark, d))
    merged = windows.gap_merge(filters.drop_invalid_times(raw), 0.5, 60, 400)
    lang = fx.segments(spark, d).select("media_id", "lang").distinct()
    rows = merged.join(lang, "media_id").groupBy("lang").agg(F.count(F.lit(1)).alias("chunks"), F.sum("n_rows").alias("segments"), F.round(F.avg(F.col("end_sec") - F.col("start_sec")), 4).alias("mean_seconds"), F.max(F.length("text")).alias("longest"))
    return rows.orderBy("lang")


def _flagship_sql() -> str:
    merged = RAW0 + st.gap_merged("raw0", 0.5, 60, 400, "m")
    columns = "lang, count(*) as chunks, sum(n_rows)::bigint as segments, round(avg(end_sec - start_sec), 4) as mean_seconds, max(length(text))::int as longest"
    return SEG + merged + f" select {columns} from m join (select distinct media_id, lang from segments) using (media_id) group by lang"


QUERIES["flagship"], ORACLE["flagship"] = flagship, _flagship_sql()
