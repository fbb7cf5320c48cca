"""Joins of segment tables with finished work, with each other, with spans, words and parts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from timedtext.functions.text import tts_validity
from timedtext.sources.shared import importable

KEY = ["media_id", "seq"]
#: Words of one automaton, which is broadcast, and terms up to which their table is.
MOST_WORDS, MOST_TERMS = 500_000, 200_000


def resume_by_start(segments: DataFrame, finished: DataFrame, by_start: bool = False) -> DataFrame:
    """Segments that aren't finished yet, by (media_id, seq), or by start second (by_start: equal starts are one)."""
    if by_start:
        done = finished.select("media_id", F.floor("start_sec").alias("__s")).distinct()
        return segments.withColumn("__s", F.floor("start_sec")).join(done, ["media_id", "__s"], "left_anti").drop("__s")
    return segments.join(finished.select(*KEY), KEY, "left_anti")


def resume_by_id(segments: DataFrame, manifest: DataFrame) -> DataFrame:
    """Segments without a clip whose text can be spoken."""
    return segments.filter(tts_validity(F.col("text"))["ok"]).join(manifest.select(*KEY), KEY, "left_anti")


def resume_two_outputs(segments: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """A segment is done only if both outputs have it."""
    return segments.join(common_keys(first, second), KEY, "left_anti")


def common_keys(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.select(*KEY).intersect(second.select(*KEY))


def append_results(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new, allowMissingColumns=True)


def align_pairs(source: DataFrame, target: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, rejects): row i of a medium's source with row i of its target, for media with as many of both; the
    others' counts are the rejects."""
    order = Window.partitionBy("media_id").orderBy("start_sec", "seq")
    s = source.select("media_id", "seq", "start_sec", "end_sec", F.col("text").alias("source_text"), F.row_number().over(order).alias("place"), F.count(F.lit(1)).over(Window.partitionBy("media_id")).alias("n_source"))
    t = target.select("media_id", F.col("text").alias("target_text"), F.row_number().over(order).alias("place"), F.count(F.lit(1)).over(Window.partitionBy("media_id")).alias("n_target"))
    pairs = s.join(t, ["media_id", "place"]).filter("n_source = n_target").drop("n_source", "n_target", "place")
    counts = source.groupBy("media_id").agg(F.count(F.lit(1)).alias("n_source")).join(target.groupBy("media_id").agg(F.count(F.lit(1)).alias("n_target")), "media_id", "full_outer").na.fill(0)
    return pairs, counts.filter("n_source <> n_target")


def free_of_spans(matches: DataFrame, spans: DataFrame) -> DataFrame:
    """Matches (media_id, seq, start, end) that overlap no span of their segment."""
    m, s = matches.alias("m"), spans.alias("s")
    over = (F.col("m.media_id") == F.col("s.media_id")) & (F.col("m.seq") == F.col("s.seq")) & (F.col("m.start") < F.col("s.end")) & (F.col("s.start") < F.col("m.end"))
    return m.join(s, over, "left_anti")


@lru_cache(maxsize=4)
def _automaton(number: int, words: tuple[str, ...]) -> ahocorasick.Automaton:
    """Built once in each worker; number tells lists apart."""
    found = ahocorasick.Automaton()
    for w in words:
        found.add_word(w, w)
    found.make_automaton()
    return found


class _Hits:
    """Which words of a broadcast list a batch of texts contains: one pass over each text, however many words there are."""

    def __init__(self, number: int, words: Broadcast) -> None:
        self.number, self.words = number, words

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _automaton(self.number, self.words.value)
        for batch in batches:
            hits = [sorted({w for _, w in found.iter(t)}, key=lambda w: (-len(w), w)) if t and len(found) else [] for t in batch.column("text").to_pylist()]
            some = pa.array([len(h) > 0 for h in hits], pa.bool_())
            kept = pa.RecordBatch.from_arrays([batch.column(KEY[0]), batch.column(KEY[1]), pa.array(hits, pa.list_(pa.string()))], [*KEY, "words"])
            yield kept.filter(some)


def dictionary_hits(segments: DataFrame, words: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """media_id, seq, words: which words (column word) each text contains, longest first, case kept.

    The words become an automaton that reads each text once. A list of more than most words is cut by a hash into lists of
    about so many, each with an automaton of its own; what these find in a segment is put together. Null and empty words
    are in no text; a segment without any has no row.
    """
    spark = importable(segments.sparkSession)
    words = words.select("word").filter("word <> ''").distinct()
    n = words.count()
    lists = max(1, -(-n // max(most, 1)))
    texts = segments.select(*KEY, "text")
    schema = StructType([*texts.select(*KEY).schema.fields, StructField("words", ArrayType(StringType()))])
    parts = []
    for k in range(lists):
        mine = words.filter(F.pmod(F.xxhash64("word"), F.lit(lists)) == k) if lists > 1 else words
        listed = spark.sparkContext.broadcast(tuple(sorted(r["word"] for r in mine.collect())))
        parts.append(texts.mapInArrow(_Hits(listed._jbroadcast.id(), listed), schema))
    if lists == 1:
        return parts[0]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    ranked = F.sort_array(F.flatten(F.collect_list(F.transform("words", lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))))
    return every.groupBy(*KEY).agg(ranked.alias("x")).select(*KEY, F.transform("x", lambda x: x["w"]).alias("words"))


def glossary_hits(segments: DataFrame, glossary: DataFrame, most: int = MOST_TERMS) -> DataFrame:
    """media_id, seq, glossary: lines "- term: options" of the terms that occur as whole words, sorted; case counts for nothing.

    The words of a text are looked up in a table of the terms by their first word, and what else a term has is checked in
    place; so a text meets only terms of which it has the first word. The table is broadcast up to most terms; a longer one
    is joined by shuffle, without the texts, which meet their terms afterwards. A term without any letter or digit is
    looked for in every text.
    """
    glossary = glossary.select("term", "options").filter("term <> ''").distinct()
    n = glossary.count()
    first = F.regexp_extract(F.lower("term"), r"(?U)\w+", 0)  # stands in a text as a word of its own wherever the term does
    entry = F.struct(F.lower("term").alias("term"), F.concat(F.lit("- "), F.col("term"), F.lit(": "), F.col("options")).alias("line"))
    table = glossary.groupBy(first.alias("__word")).agg(F.collect_list(entry).alias("__terms"))
    texts = segments.select(*KEY, F.lower("text").alias("t")).filter("t <> ''")
    wordless = bool(table.filter("__word = ''").limit(1).count())
    tokens = F.array_distinct(F.regexp_extract_all("t", F.lit(r"(?U)\w+"), F.lit(0)))
    tokens = F.concat(tokens, F.array(F.lit(""))) if wordless else tokens
    if n <= most:
        met = texts.withColumn("__word", F.explode(tokens)).join(F.broadcast(table), "__word")
    else:
        texts = texts.withColumn("__row", F.xxhash64(*KEY, "t"))
        found = texts.select("__row", F.explode(tokens).alias("__word")).distinct().join(table, "__word").drop("__word")
        met = texts.join(found, "__row").drop("__row")

    def whole(x: Column) -> Column:
        quoted = F.concat(F.lit(r"(?U)\b\Q"), F.replace(x["term"], F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E\b"))
        return F.contains(F.col("t"), x["term"]) & F.rlike(F.col("t"), quoted)

    lines = F.transform(F.filter("__terms", whole), lambda x: x["line"])
    hits = met.select(*KEY, lines.alias("x")).filter(F.size("x") > 0)
    hits = hits.groupBy(*KEY).agg(F.array_sort(F.filter(F.array_distinct(F.flatten(F.collect_list("x"))), lambda x: x.isNotNull())).alias("x"))
    return hits.filter(F.size("x") > 0).select(*KEY, F.array_join("x", "\n").alias("glossary"))


def glossary_text():
    """Aggregate: the glossary rows of a group as one sorted list."""
    return F.array_join(F.sort_array(F.collect_set(F.concat(F.lit("- "), F.col("term"), F.lit(": "), F.col("options")))), "\n")


def assign_to_parts(segments: DataFrame, length: float, overlap: float = 3.0) -> DataFrame:
    """Each segment with the numbers of the fixed-length overlapping parts that it touches; the numbers are computed, so
    nothing is joined."""
    step = length - overlap
    low = F.greatest(F.floor((F.col("start_sec") - length) / step) + 1, F.lit(0))
    high = F.greatest(F.ceil(F.col("end_sec") / step) - 1, low)
    return segments.withColumn("part", F.explode(F.sequence(low.cast("int"), high.cast("int"))))
