"""Merging, formatting, refining, judging and assembling of segment tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from timedtext.functions import splitting as sp
from timedtext.functions import text as tx
from timedtext.functions.entities import LEAST_CONFIDENCE, entity_issues, merge_maps, protect, rebase_entities, restore_entities
from timedtext.functions.folds import fold
from timedtext.functions.timecodes import capped_speed, tempo_chain
from timedtext.operators import aggregates, attempts, filters, hypotheses, joins, windows
from timedtext.sources import segment_io
from timedtext.sources.shared import shared_folder

CORE = ["media_id", "seq", "start_sec", "end_sec", "text"]


def _renumbered(pieces: DataFrame) -> DataFrame:
    """seq of (segment, piece) rows in their order, so that later operators order them alike."""
    order = Window.partitionBy("media_id").orderBy("seq", "piece")
    return pieces.withColumn("__n", (F.row_number().over(order) - 1).cast("int")).drop("seq", "piece").withColumnRenamed("__n", "seq")


def _split(df: DataFrame, pieces: Column, exact_end: bool = True, floored: bool = False) -> DataFrame:
    return windows.proportional_times(df.withColumn("pieces", pieces), exact_end=exact_end, floored=floored)


def _merge_round(rows: DataFrame, max_dur: float, max_gap: float, max_chars: int, least: int = 3) -> DataFrame:
    """One round: merged by gap, split where too long (times floored). protected: too long, but of too few words to be split;
    active: the round has changed a row of this medium."""
    merged = windows.gap_merge(rows, max_gap, max_dur, max_chars)
    long = merged.withColumn("long", F.length("text") > max_chars)
    # inside let the splitting is worked out by itself; as part of the generated code it would pass the limit of a method
    long = long.withColumn("pieces", sp.let(F.struct("text", "long"), lambda r: F.when(r["long"], sp.split_capped(r["text"], max_chars)).otherwise(F.array(r["text"]))))
    down = lambda c: F.when(F.col("long"), F.floor(c).cast("double")).otherwise(F.col(c))
    changed = (F.col("n_rows") > 1) | (down("start_sec") != F.col("start_sec")) | (down("end_sec") != F.col("end_sec"))
    long = long.withColumn("changed", changed).withColumn("protected", F.col("long") & (tx.word_count(F.col("text")) < least))
    split = windows.proportional_times(long.drop("n_rows")).withColumn("start_sec", down("start_sec")).withColumn("end_sec", down("end_sec"))
    active = F.max(F.col("changed") | (F.col("piece") > 0)).over(Window.partitionBy("media_id"))
    return _renumbered(split.withColumn("active", active)).select(*CORE, "protected", "active")


def _merged_rounds(rows: DataFrame, max_dur: float, max_gap: float, max_chars: int, iterations: int) -> DataFrame:
    """Rows after so many rounds, with protected.

    Each round is written, which cuts the plan, and goes on with the media that it has changed: a round that changes nothing
    would change nothing again. The first round drops empty chunks, which is told from no row, so every medium has two.
    """
    folder, ended = shared_folder(rows.sparkSession, "rounds"), []
    for k in range(iterations):
        now = segment_io.settled(_merge_round(rows, max_dur, max_gap, max_chars), f"{folder}/{k}")
        goes_on = F.col("active") if k else F.lit(True)
        if k + 1 == iterations or not now.filter(goes_on).limit(1).count():
            ended.append(now)
            break
        ended.append(now.filter(~goes_on))
        rows = now.filter(goes_on).select(*CORE)
    every = ended[0] if ended else rows.withColumn("protected", F.lit(False))
    for part in ended[1:]:
        every = every.unionByName(part)
    return every.select(*CORE, "protected")


def merge_transcript(df: DataFrame, min_dur: float = 3, max_dur: float = 15, max_gap: float = 0.5, max_chars: int = 150, iterations: int = 10, min_words: int = 3) -> DataFrame:
    """Raw segments to chunks: merged by gap, split where too long (times floored), so often, or until a medium stays as it
    is; then short ones merged until none is left to merge.

    Rounds differ from one another since floored times change the gaps. They are worked off when this is called.
    """
    rows = _merged_rounds(filters.drop_invalid_times(df).select(*CORE), max_dur, max_gap, max_chars, iterations)
    return windows.force_merge_stable(rows.select(*CORE), min_dur, min_words)


def merge_report(df: DataFrame, min_dur: float = 3, max_dur: float = 15, max_gap: float = 0.5, max_chars: int = 150, iterations: int = 10, min_words: int = 3) -> tuple[DataFrame, DataFrame]:
    """(chunks, report) of merge_transcript; the report has one row: rows_read, rows_valid, rows_final, rows_protected.

    Rows are counted as they pass through the plans that merge them, not by reading them again. rows_protected counts those of
    the last round that are too long but not split, having fewer than three words.
    """
    read, final = Observation(), Observation()
    valid = F.coalesce(F.col("start_sec") <= F.col("end_sec"), F.lit(False))
    seen = df.observe(read, F.count(F.lit(1)).alias("rows_read"), F.count_if(valid).alias("rows_valid"))
    rows = _merged_rounds(filters.drop_invalid_times(seen).select(*CORE), max_dur, max_gap, max_chars, max(iterations, 1))
    rows = rows.observe(final, F.count_if("protected").alias("rows_protected"))
    chunks = windows.force_merge_stable(rows.select(*CORE), min_dur, min_words)
    spark = df.sparkSession
    merged = Observation()
    chunks = chunks.observe(merged, F.count(F.lit(1)).alias("rows_final"))
    chunks = segment_io.settled(chunks, f"{shared_folder(spark, 'merged')}/rows")
    told = {**read.get, **merged.get, **final.get}
    return chunks, spark.createDataFrame([tuple(told[k] for k in REPORT)], ", ".join(f"{k} long" for k in REPORT))


REPORT = ("rows_read", "rows_valid", "rows_final", "rows_protected")


def format_for_tts(df: DataFrame, max_chars: int = 150, min_words: int = 3, lang: str = "de") -> DataFrame:
    """Sentences with their share of the time, packed across segments to max_chars; a group under min_words absorbs the
    next; final points become an ellipsis. No word is lost."""
    sentences = _renumbered(_split(filters.drop_invalid_times(df).select(*CORE), sp.split_sentences_abbrev(F.col("text"), lang), exact_end=False))
    rows = sentences.groupBy("media_id").agg(F.sort_array(F.collect_list(F.struct("seq", "start_sec", "end_sec", "text"))).alias("rows"))

    def step(acc: Column, r: Column) -> tuple[dict[str, Column], Column]:
        n = F.length(r["text"])
        joins_group = (acc["k"] >= 0) & (acc["chars"] + 1 + n <= max_chars)
        k = F.when(joins_group, acc["k"]).otherwise(acc["k"] + 1)
        return {"k": k, "chars": F.when(joins_group, acc["chars"] + 1 + n).otherwise(n)}, k

    part = fold("rows", {"k": F.lit(-1), "chars": F.lit(0)}, "int", step)
    parts = rows.select("media_id", F.explode(F.arrays_zip("rows", part.alias("part"))).alias("x"))
    parts = parts.select("media_id", "x.part", "x.rows.*")
    groups = windows._joined(parts, ["part"]).drop("n_rows")
    absorbed = _absorb_forward(groups, min_words)
    return absorbed.withColumn("text", tx.final_dots_to_ellipsis(F.col("text")))


def _absorb_forward(df: DataFrame, min_words: int) -> DataFrame:
    """A group absorbs the rows after it until it has min_words."""
    rows = df.groupBy("media_id").agg(F.sort_array(F.collect_list(F.struct("start_sec", "seq", "end_sec", "text"))).alias("rows"))

    def step(acc: Column, r: Column) -> tuple[dict[str, Column], Column]:
        w = tx.word_count(r["text"])
        goes_on = (acc["k"] >= 0) & (acc["words"] < min_words)
        k = F.when(goes_on, acc["k"]).otherwise(acc["k"] + 1)
        return {"k": k, "words": F.when(goes_on, acc["words"] + w).otherwise(w)}, k

    part = fold("rows", {"k": F.lit(-1), "words": F.lit(0)}, "int", step)
    parts = rows.select("media_id", F.explode(F.arrays_zip("rows", part.alias("part"))).alias("x"))
    return windows._joined(parts.select("media_id", "x.part", "x.rows.*"), ["part"]).drop("n_rows")


def format_for_tts_split(df: DataFrame, max_chars: int = 150, min_words: int = 4, merge_short: bool = True, lang: str = "de") -> DataFrame:
    """Over-long segments split; then, if wanted, pieces under min_words joined (the first forward, others backward)."""
    pieces = _renumbered(_split(filters.drop_invalid_times(df).select(*CORE), sp.split_text(F.col("text"), max_chars, min_words, lang)))
    return windows.force_merge_short(pieces, 0.0, min_words) if merge_short else pieces.select(*CORE)


def protect_spans(
    df: DataFrame, spans: DataFrame, words: list[str] = (), style: str = "extra_id", language: str = "en", least_confidence: float = LEAST_CONFIDENCE
) -> DataFrame:
    """Texts with words and entity spans (media_id, seq, start, end, label) behind placeholders, and their entity_map.

    Where spans have a confidence, those below least_confidence stay in the text; a null one counts as sure.
    """
    if "confidence" in spans.columns:
        spans = spans.filter(F.coalesce("confidence", F.lit(1.0)) >= least_confidence)
    place = F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "label")
    rows = df.join(spans.groupBy("media_id", "seq").agg(F.collect_list(place).alias("__spans")), ["media_id", "seq"], "left")
    p = protect(F.col("text"), list(words), F.col("__spans"), F.lit(language), style=style)
    return rows.withColumn("__p", p).withColumn("text", F.col("__p.text")).withColumn("entity_map", F.col("__p.entity_map")).drop("__p", "__spans")


def format_translation(df: DataFrame, spans: DataFrame, max_chars: int = 150, lang: str = "de") -> tuple[DataFrame, DataFrame]:
    """(segments, issues): bad rows dropped, entities protected and restored, texts split, cleaned and timed."""
    rows = protect_spans(filters.drop_invalid_times(df).select(*CORE, F.col("text").alias("original")), spans).withColumn("protected", F.col("text"))
    rows = rows.withColumn("text", restore_entities(F.col("protected"), F.col("entity_map")))
    issues = rows.select("media_id", "seq", F.explode(entity_issues(F.col("original"), F.col("protected"), F.col("protected"), F.col("text"), F.col("entity_map"))).alias("issue"))
    pieces = F.filter(F.transform(sp.split_text(F.col("text"), max_chars, 4, lang), tx.sanitize_text), lambda t: t != "")
    return _renumbered(_split(rows.select(*CORE), pieces)).select(*CORE), issues


def refine_segments(df: DataFrame, spans: DataFrame, words: list[str] = (), lang: str = "de", min_words: int = 3) -> DataFrame:
    """Entities protected and restored, broken contexts closed, texts cleaned; German is split into sentences, of which
    those under min_words join the one before in the same segment."""
    rows = protect_spans(df.select(*CORE), spans, words, language=lang)
    rows = windows.close_context(rows.withColumn("text", restore_entities(F.col("text"), F.col("entity_map"))))
    rows = rows.withColumn("text", tx.sanitize_keep_placeholders(F.col("text")))
    if lang != "de":
        return rows.select(*CORE, "entity_map")
    kept = rows.withColumn("sentences", sp.split_sentences_abbrev(F.col("text"), "de"))
    kept = kept.withColumn("sentences", F.when(F.size("sentences") > 0, F.col("sentences")).otherwise(F.array("text")))
    pieces = _split(kept, F.col("sentences")).drop("sentences")
    inside = Window.partitionBy("media_id", "seq").orderBy("piece")
    before = F.coalesce(F.sum(F.length("text")).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    pieces = pieces.withColumn("before", before)
    pieces = pieces.withColumn("entity_map", rebase_entities(F.col("entity_map"), F.col("before"), F.length("text"))).drop("before")
    opens = F.when((F.col("piece") == 0) | (tx.word_count(F.col("text")) >= min_words), 1).otherwise(0)
    pieces = pieces.withColumn("part", F.sum(opens).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    groups = pieces.groupBy("media_id", "seq", "part").agg(F.array_sort(F.collect_list(F.struct("piece", "start_sec", "end_sec", "text", "entity_map")), lambda a, b: a["piece"] - b["piece"]).alias("r"))
    groups = groups.select("media_id", "seq", F.col("part").cast("int").alias("piece"), F.get("r", F.lit(0))["start_sec"].alias("start_sec"), F.element_at("r", -1)["end_sec"].alias("end_sec"), F.array_join(F.transform("r", lambda x: x["text"]), " ").alias("text"), merge_maps(F.transform("r", lambda x: x["entity_map"])).alias("entity_map"))
    return _renumbered(groups).select(*CORE, "entity_map")


def evaluate_quality(pairs: DataFrame, tries: DataFrame, threshold: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """(report, summary) of pairs (segment_id, text, source_embedding, embedding) with corrections for low ones."""
    scored = pairs.withColumn("similarity", tx.cosine(F.col("source_embedding"), F.col("embedding"))).drop("source_embedding", "embedding")
    fixed = attempts.best_correction(scored, tries, threshold)
    better = fixed.filter("flag = 'AUTO-CORRECTED'").select("segment_id", F.col("similarity").alias("corrected_similarity"), F.col("text").alias("corrected_text"))
    status = tx.similarity_status(F.col("similarity"), threshold)
    report = scored.join(better, "segment_id", "left").select("segment_id", F.coalesce("corrected_text", "text").alias("text"), "similarity", "corrected_similarity", status["status"].alias("status"), F.when(F.col("corrected_similarity").isNotNull(), "AUTO-CORRECTED").otherwise(status["flag"]).alias("flag"))
    return report, aggregates.quality_summary(report, threshold)


def polish(pairs: DataFrame, tries: DataFrame, skip_threshold: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """(decisions, summary) of pairs (segment_id, text, similarity, duration)."""
    decisions = attempts.polish_decision(pairs, tries, skip_threshold)
    return decisions, aggregates.polish_summary(decisions)


def select_best(segments: DataFrame, sources: DataFrame, hyps: DataFrame, report: bool = True) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """(segments with their best hypothesis, report, highest and lowest). The report's medians take rounds over the scores
    when this is called; without report it is None."""
    best = hypotheses.best_hypothesis_by_similarity(sources, hyps)
    told = aggregates.selection_report(hyps, best) if report else None
    return hypotheses.apply_best(segments, best), told, hypotheses.top_bottom_segments(best)


def prepare_translation(segments: DataFrame, finished: DataFrame, batch: int = 32) -> DataFrame:
    """What is still to be translated, entities restored in the source, in numbered batches."""
    rows = joins.resume_by_start(segments, finished)
    if "entity_map" in rows.columns:
        rows = rows.withColumn("text", restore_entities(F.col("text"), F.col("entity_map")))
    return windows.batch_ids(rows, batch)


def finish_translation(results: DataFrame, old: DataFrame) -> DataFrame:
    """Valid results, cleaned, after the old rows."""
    return joins.append_results(old, filters.valid_segments(results).withColumn("text", tx.sanitize_text(F.col("text"))))


def assembly_plan(manifest: DataFrame, mode: str = "actual") -> DataFrame:
    """Per clip: speed, tempo filter, length when played so, silence before it, effective start and end."""
    rows = manifest.withColumn("target_sec", F.col("end_sec") - F.col("start_sec"))
    speed = capped_speed(F.col("actual_sec"), F.col("target_sec"))
    rows = rows.withColumn("speed", F.round(speed["speed"], 9)).withColumn("capped", speed["capped"]).withColumn("played_sec", F.col("actual_sec") / F.col("speed"))
    rows = rows.withColumn("tempo", tempo_chain(F.col("speed"))).withColumn("clip_sec", F.col("actual_sec")).withColumn("actual_sec", F.col("played_sec"))
    return windows.timeline(rows, mode=mode, kept=["chunk_path", "clip_sec", "speed", "capped", "tempo"]).withColumnRenamed("clip_sec", "actual_sec")
