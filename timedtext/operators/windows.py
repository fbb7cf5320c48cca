"""Operators over the ordered segments of each medium.

Every one partitions by media_id and orders by (start_sec, seq), so a chain of them shuffles once. What must be folded
in order is first broken into islands by a window, and folds carry numbers only; texts are joined by a grouping on the
same key, which needs no further shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from timedtext.functions.entities import merge_maps
from timedtext.functions.folds import fold
from timedtext.functions.text import word_count
from timedtext.sources.segment_io import settled
from timedtext.sources.shared import shared_folder

# Words that continue a sentence, in the short and the long list.
CONJUNCTIONS = ["und", "aber", "oder", "doch"]
CONJUNCTIONS_LONG = ["und", "oder", "aber", "doch", "jedoch", "während", "obwohl"]
# End of fixed values.


def order() -> WindowSpec:
    return Window.partitionBy("media_id").orderBy("start_sec", "seq")


def so_far() -> WindowSpec:
    return order().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _joined(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of each group as one: first seq and start, the last row's end, texts joined by blanks, maps merged."""
    maps = [merge_maps(F.transform("rows", lambda r: r["entity_map"])).alias("entity_map")] if "entity_map" in df.columns else []
    fields = ["start_sec", "seq", "end_sec", "text", *(["entity_map"] if maps else [])]
    # maps can't be sorted, so rows are ordered by their leading fields alone
    ordered = F.array_sort(F.collect_list(F.struct(*fields)), lambda a, b: F.when(a["start_sec"] < b["start_sec"], -1).when(a["start_sec"] > b["start_sec"], 1).when(a["seq"] < b["seq"], -1).when(a["seq"] > b["seq"], 1).otherwise(0))
    rows = df.groupBy("media_id", *keys).agg(ordered.alias("rows"))
    texts = F.filter(F.transform("rows", lambda r: F.trim(F.coalesce(r["text"], F.lit("")))), lambda t: t != "")
    first, last = F.get("rows", F.lit(0)), F.element_at("rows", -1)
    return rows.select("media_id", first["seq"].alias("seq"), first["start_sec"].alias("start_sec"), last["end_sec"].alias("end_sec"), F.array_join(texts, " ").alias("text"), *maps, F.size("rows").alias("n_rows"))


def gap_merge(df: DataFrame, max_gap: float = 0.5, max_dur: float = 15.0, max_chars: int = 150) -> DataFrame:
    """Neighbours joined while the gap is 0 to max_gap and the chunk stays within max_dur and max_chars. Empty chunks go."""
    gap = F.col("start_sec") - F.lag("end_sec").over(order())
    islands = df.withColumn("island", F.sum(F.when((gap >= 0) & (gap <= max_gap), 0).otherwise(1)).over(so_far()))
    rows = islands.groupBy("media_id", "island").agg(F.sort_array(F.collect_list(F.struct("start_sec", "seq", "end_sec", "text"))).alias("rows"))

    def step(acc: Column, r: Column) -> tuple[dict[str, Column], Column]:
        n = F.length(F.trim(F.coalesce(r["text"], F.lit(""))))
        longer = acc["chars"] + n + F.when((acc["chars"] > 0) & (n > 0), 1).otherwise(0)
        joins = (acc["k"] >= 0) & (r["end_sec"] - acc["begin"] <= max_dur) & (longer <= max_chars)
        k = F.when(joins, acc["k"]).otherwise(acc["k"] + 1)
        begin, chars = F.when(joins, acc["begin"]).otherwise(r["start_sec"]), F.when(joins, longer).otherwise(n)
        return {"k": k, "begin": begin, "chars": chars}, k

    start = {"k": F.lit(-1), "begin": F.lit(0.0), "chars": F.lit(0)}
    parts = rows.withColumn("part", fold("rows", start, "int", step))
    parts = parts.select("media_id", "island", F.explode(F.arrays_zip("rows", "part")).alias("x")).select("media_id", "island", "x.part", "x.rows.*")
    return _joined(parts, ["island", "part"]).filter("text <> ''")


def _short_merged(df: DataFrame, min_dur: float, min_words: int) -> DataFrame:
    """One pass of force_merge_short, with n_rows: how many segments each came from."""
    words = word_count(F.col("text"))
    valid = F.coalesce(F.col("start_sec") <= F.col("end_sec"), F.lit(False))
    enough = (F.round(F.col("end_sec") - F.col("start_sec"), 3) >= min_dur) & (words >= min_words)
    rows = df.withColumn("rn", F.row_number().over(order()))
    head = (F.round(F.col("end_sec") - F.first("start_sec").over(so_far()), 3) >= min_dur) & (F.sum(words).over(so_far()) >= min_words)
    rows = rows.withColumn("head", head).withColumn("opens", ~valid | enough)
    rows = rows.withColumn("head_end", F.min(F.when(F.col("head"), F.col("rn"))).over(Window.partitionBy("media_id")))
    first = F.col("rn") == 1
    rows = rows.withColumn("part", F.sum(F.when(first | ((F.col("rn") > F.col("head_end")) & F.col("opens")), 1).otherwise(0)).over(so_far()))
    return _joined(rows, ["part"])


def force_merge_short(df: DataFrame, min_dur: float = 3.0, min_words: int = 3, passes: int = 1) -> DataFrame:
    """Segments that are too short, or have too few words, join the one before; a short first one absorbs what follows
    until it is long enough; a sole segment stays. Segments with invalid times open a group of their own.

    One pass is final when ends do not decrease; force_merge_stable is for media where they do.
    """
    for _ in range(passes):
        df = _short_merged(df, min_dur, min_words).drop("n_rows")
    return df


def force_merge_stable(df: DataFrame, min_dur: float = 3.0, min_words: int = 3) -> DataFrame:
    """force_merge_short again and again until it changes no medium.

    A pass is written, which cuts the plan, and the next takes only media that still change; each has fewer rows than before.
    """
    folder, ended, k = shared_folder(df.sparkSession, "passes"), [], 0
    while True:
        active = F.max(F.col("n_rows") > 1).over(Window.partitionBy("media_id"))
        now = settled(_short_merged(df, min_dur, min_words).withColumn("active", active).drop("n_rows"), f"{folder}/{k}")
        ended.append(now.filter(~F.col("active")).drop("active"))
        df, k = now.filter("active").drop("active"), k + 1
        if not df.limit(1).count():
            break
    every = ended[0]
    for part in ended[1:]:
        every = every.unionByName(part)
    return every


def _starts_with(text: Column, words: list[str], boundary: bool = True) -> Column:
    return text.rlike(rf"(?iU)^({'|'.join(words)}){chr(92) + 'b' if boundary else ''}")


def _closed(df: DataFrame, fragile: Column) -> DataFrame:
    rn = F.row_number().over(order())
    rows = df.withColumn("fragile", F.coalesce(fragile, F.lit(False))).withColumn("part", F.sum(F.when(F.col("fragile") & (rn > 1), 0).otherwise(1)).over(so_far()))
    return _joined(rows, ["part"]).drop("n_rows")


def _stripped() -> Column:
    return F.trim(F.coalesce("text", F.lit("")))


def _lower_first(t: Column) -> Column:
    return F.substring(t, 1, 1).rlike(r"^\p{Ll}")


def close_context(df: DataFrame) -> DataFrame:
    """A row that begins in lower case or with a conjunction joins the one before unless that ends a sentence."""
    t = _stripped()
    open_before = ~F.coalesce(F.lag(t.rlike(r"[.!?]$")).over(order()), F.lit(False))
    return _closed(df, (_lower_first(t) | _starts_with(t, CONJUNCTIONS)) & open_before & ~t.rlike(r"^[0-9]"))


def close_context_simple(df: DataFrame) -> DataFrame:
    t = _stripped()
    return _closed(df, _lower_first(t) | _starts_with(t, CONJUNCTIONS))


def merge_lowercase(df: DataFrame) -> DataFrame:
    return _closed(df, _lower_first(F.coalesce("text", F.lit(""))))


def prepend_context(df: DataFrame, most: int = 300) -> DataFrame:
    """A text that begins with an -ing or -ed word gets the one before in front of it, cut to most characters."""
    hangs = F.col("text").rlike(r"(?iU)^\w+(ing|ed)\b")
    before = F.lag("text").over(order())
    return df.withColumn("text", F.when(hangs & before.isNotNull(), F.substring(F.concat(before, F.lit(" [CTX] "), F.col("text")), 1, most)).otherwise(F.col("text")))


def close_context_dedup(df: DataFrame, participles: bool = False) -> DataFrame:
    """Every text ends a sentence, and none repeats the one before it.

    A row that needs context (lower case, a conjunction, no final point; with participles: a participle instead of the
    first two) keeps its own text without leading blanks and points; any other loses a prefix equal to the output
    before it. An empty text stays empty.
    """
    tidy = lambda t: F.regexp_replace(t, r"^[ .]+", "")
    ended = lambda t: F.when((t == "") | t.rlike(r"[.!?]$"), t).otherwise(F.concat(t, F.lit(".")))

    def needing(t: Column) -> Column:
        participle = t.rlike(r"(?i)^(?:[A-Za-zÄÖÜäöüß]+end|[A-Za-z]+nd)\b")
        starts = participle if participles else _lower_first(t) | _starts_with(t, CONJUNCTIONS_LONG, False)
        return starts | ~t.rlike(r"[.!?]$")

    # what a row that needs context gives does not depend on the one before it, so an island begins there
    rn = F.row_number().over(order())
    rows = df.select("media_id", "start_sec", "seq", "end_sec", _stripped().alias("t")).withColumn("needs", needing(F.col("t")))
    rows = rows.withColumn("island", F.sum(F.when(F.col("needs") & (rn > 1), 1).otherwise(0)).over(so_far()))
    items = F.sort_array(F.collect_list(F.struct("start_sec", "seq", "end_sec", "t", "needs")))
    rows = rows.groupBy("media_id", "island").agg(items.alias("rows"))

    def step(acc: Column, r: Column) -> tuple[dict[str, Column], Column]:
        t, before = r["t"], acc["last"]
        rest = tidy(F.substring(t, F.length(before) + 1, F.length(t)))
        own = F.when(before.isNull(), t).when(r["needs"], tidy(t)).when(F.startswith(t, before), rest).otherwise(t)
        return {"last": ended(own)}, ended(own)

    first = F.when(F.col("island") > 0, F.lit(""))  # any text: a row that needs context does not look at it
    texts = fold("rows", {"last": first}, "string", step)
    rows = rows.select("media_id", F.explode(F.arrays_zip("rows", texts.alias("out"))).alias("x"))
    return rows.select("media_id", "x.rows.seq", "x.rows.start_sec", "x.rows.end_sec", F.col("x.out").alias("text"))


def overlap_crossfade_plan(df: DataFrame, rate: int = 24_000, fade_sec: float = 0.1) -> DataFrame:
    """start_sample, end_sample, overlap and fade of each clip against the clip before it."""
    clip = (F.col("actual_sec") * rate).cast("long")
    rows = df.withColumn("start_sample", (F.col("start_sec") * rate).cast("long")).withColumn("clip_samples", clip)
    rows = rows.withColumn("end_sample", F.col("start_sample") + F.col("clip_samples"))
    over = F.greatest(F.lag("end_sample").over(order()) - F.col("start_sample"), F.lit(0).cast("long"))
    rows = rows.withColumn("overlap", F.coalesce(over, F.lit(0).cast("long")))
    return rows.withColumn("fade", F.least("overlap", F.lit(int(fade_sec * rate)).cast("long"), "clip_samples"))


def plan_parts(media: DataFrame, parts: int | None = None, length: float | None = None, overlap: float = 3.0) -> DataFrame:
    """media_id, part, start_sec, end_sec: so many equal parts, each with an overlap to the left, or parts of a length
    whose starts are length - overlap apart. media has media_id and duration."""
    d = F.col("duration")
    if parts:
        rows = media.select("media_id", d, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
        start = F.greatest(F.lit(0.0), F.col("part") * d / parts - F.when(F.col("part") > 0, overlap).otherwise(0.0))
        end = F.least(d, (F.col("part") + 1) * d / parts)
    else:
        step = length - overlap
        rows = media.select("media_id", d, F.explode(F.sequence(F.lit(0), F.floor(d / step).cast("int"))).alias("part"))
        start = F.col("part") * step
        end = F.least(d, F.col("part") * step + length)
    return rows.select("media_id", "part", start.cast("double").alias("start_sec"), end.cast("double").alias("end_sec"), "duration").filter("start_sec < duration").drop("duration")


def clamp_silence(df: DataFrame, most: float = 2.0, rate: int = 16_000) -> DataFrame:
    """Where more than so many seconds lie before a speech interval, it begins that long after the one before; in samples too."""
    before = F.lag("end_sec").over(order())
    rows = df.withColumn("start_sec", F.when(F.col("start_sec") - before > most, before + most).otherwise(F.col("start_sec")))
    return rows.withColumn("start_sample", F.greatest((F.col("start_sec") * rate - 0.5).cast("long"), F.lit(0).cast("long"))).withColumn("end_sample", (F.col("end_sec") * rate + 1).cast("long"))


def proportional_times(df: DataFrame, pieces: str = "pieces", exact_end: bool = True, floored: bool = False) -> DataFrame:
    """Pieces as rows that share their segment's time by characters; without characters, equally. The last one ends with
    the segment (exact_end) or where the sum of shares ends."""

    def step(acc: Column, p: Column) -> tuple[dict[str, Column], Column]:
        upto = acc["upto"] + F.length(p)
        return {"upto": upto}, F.struct(p.alias("text"), upto.alias("upto"))

    summed = fold(pieces, {"upto": F.lit(0)}, "struct<text:string,upto:int>", step)
    kept = [c for c in df.columns if c not in (pieces, "text", "start_sec", "end_sec")]
    rows = df.select(*kept, "start_sec", "end_sec", summed.alias("__p"))
    rows = rows.select(*kept, "start_sec", "end_sec", F.size("__p").alias("n"), F.element_at("__p", -1)["upto"].alias("total"), F.posexplode("__p").alias("piece", "__p"))
    rows = rows.withColumn("upto", F.col("__p.upto")).withColumn("text", F.col("__p.text"))

    def at(chars: Column, k: Column) -> Column:
        return F.col("start_sec") + (F.col("end_sec") - F.col("start_sec")) * F.when(F.col("total") > 0, chars / F.col("total")).otherwise(k / F.col("n"))

    start, end = at(F.col("upto") - F.length("text"), F.col("piece")), at(F.col("upto"), F.col("piece") + 1)
    if exact_end:
        end = F.when(F.col("piece") + 1 == F.col("n"), F.col("end_sec")).otherwise(end)
    down = (lambda c: F.floor(c).cast("double")) if floored else (lambda c: c)
    return rows.select(*kept, "piece", down(start).alias("start_sec"), down(end).alias("end_sec"), "text")


def timeline(df: DataFrame, min_gap: float = 0.2, least_silence: float = 0.02, mode: str = "target", kept: list[str] = ()) -> DataFrame:
    """Where each clip is laid so that none overlaps: effective start, silence before it, had_overlap.

    mode target: a clip takes end - start; actual: its actual_sec. Columns named in kept go along.
    """
    length = F.col("end_sec") - F.col("start_sec") if mode == "target" else F.col("actual_sec")
    rows = df.select("media_id", "seq", "start_sec", "end_sec", length.cast("double").alias("dur"), F.struct(F.lit(0).alias("__none"), *kept).alias("kept"))
    # the end of what was laid so far is at most `latest`: every clip since some start, each with the gap before it
    upto = F.sum(F.greatest(F.col("dur"), F.lit(0.0)) + max(min_gap, 0.0)).over(so_far())
    rows = rows.withColumn("upto", upto).withColumn("before", F.coalesce(F.lag("upto").over(order()), F.lit(0.0)))
    latest = F.col("upto") + F.max(F.col("start_sec") - F.col("before")).over(so_far())
    latest = F.greatest(latest, F.col("upto"))  # time begins at 0
    rows = rows.withColumn("latest", latest)
    free = F.col("start_sec") >= F.coalesce(F.lag("latest").over(order()), F.lit(0.0)) + 1e-3  # sums of doubles are not exact
    rows = rows.withColumn("island", F.sum(F.when(free, 1).otherwise(0)).over(so_far()))
    items = F.sort_array(F.collect_list(F.struct("start_sec", "seq", "end_sec", "dur", "kept")))
    rows = rows.groupBy("media_id", "island").agg(items.alias("rows"))

    def step(acc: Column, r: Column) -> tuple[dict[str, Column], Column]:
        eff = F.when(r["start_sec"] < acc["running"], acc["running"] + min_gap).otherwise(r["start_sec"])
        return {"running": eff + r["dur"]}, eff

    # before the first island nothing runs; any other begins when what was before has ended
    first = F.when(F.col("island") == 0, 0.0).otherwise(F.get("rows", F.lit(0))["start_sec"])
    rows = rows.withColumn("eff", fold("rows", {"running": first}, "double", step))
    rows = rows.select("media_id", F.explode(F.arrays_zip("rows", "eff")).alias("x")).select("media_id", "x.rows.*", F.col("x.eff").alias("effective_start"))
    rows = rows.withColumn("effective_end", F.col("effective_start") + F.col("dur"))
    running = F.coalesce(F.lag("effective_end").over(order()), F.lit(0.0))
    gap = F.col("effective_start") - running
    rows = rows.withColumn("silence", F.when(gap > least_silence, gap).otherwise(0.0)).withColumn("had_overlap", F.col("start_sec") < running)
    return rows.select("media_id", "seq", "start_sec", "end_sec", "effective_start", "silence", "had_overlap", "effective_end", *(F.col(f"kept.{c}") for c in kept))


def batch_ids(df: DataFrame, size: int) -> DataFrame:
    """batch and place of each row within its medium's order; segment numbers go on over batches."""
    n = F.row_number().over(order()) - 1
    return df.withColumn("batch", F.floor(n / size)).withColumn("place", n)
