"""Benchmark decontamination with DataFrame functions only.

A benchmark item's windows are its runs of 10 consecutive words (shorter items are one window). The normalised windows
form a hash table that is broadcast while its size stays under a bound, and joined by shuffle beyond it. Token windows
of a document are looked up by their text, which is the full window, so a hit is verified by equality itself.
To read few windows, each benchmark window names an anchor, its longest word: a document window is built only where an
anchor stands at its place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timedtext.llm.common import ascii_lower, prepare, written

WINDOW = 10
#: Pairs of a benchmark window and an item that has it, up to this many, are broadcast (some 200 bytes each); more are joined by shuffle.
BROADCAST_WINDOWS = 50_000
#: Bits of the filter that tells places where an anchor may stand from the others. Its size, and the plan's, does not grow with the benchmark.
FILTER_BITS = 1 << 20
#: ASCII characters that stand between words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; null has none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def benchmark_windows(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """gram, anchor, offset (of the anchor in the window), length, item_ids: one row per distinct window."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1)))
    rows = items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, n))).alias("w"))
    longest = F.array_max(F.transform("w", lambda w, i: F.struct(F.length(w).alias("n"), (-i).alias("i"), w.alias("word"))))
    rows = rows.select("item_id", F.array_join("w", " ").alias("gram"), F.size("w").alias("length"), longest.alias("a"))
    return rows.groupBy("gram").agg(F.first("a.word").alias("anchor"), (-F.first("a.i")).alias("offset"), F.first("length").alias("length"), F.collect_set("item_id").alias("item_ids"))


def _windows(n: int) -> Column:
    """All windows of n words of the column w."""
    each = F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.struct(i.alias("start"), F.lit(n).alias("length"), F.array_join(F.slice("w", i, n), " ").alias("gram")))
    return F.when(F.size("w") >= n, each).otherwise(F.array().cast("array<struct<start:int,length:int,gram:string>>"))


def _bit(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(FILTER_BITS))


def _may_be(anchors: DataFrame) -> Column:
    """An array of longs, FILTER_BITS bits: that of a word is set if the word is an anchor, and by chance of few others."""
    bits = anchors.select(_bit(F.col("anchor")).alias("b")).groupBy(F.shiftright("b", 6).cast("int").alias("k"))
    words = bits.agg(F.bit_or(F.expr("shiftleft(1L, int(b & 63))")).alias("v")).collect()  # FILTER_BITS / 64 rows at most
    longs = ["0"] * (FILTER_BITS >> 6)
    for k, v in words:
        longs[k] = str(v)
    return F.split(F.lit(" ".join(longs)), " ").cast("array<long>")


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """One row per row of docs: row (a key of this run), doc_id, n_words, hit (sorted places of hit words), item_ids.

    Null texts have no words; repeated rows are separate; an empty or word-less benchmark hits nothing. item_ids are
    strings in order. Other columns of docs and benchmark are not read.
    """
    prepare(docs.sparkSession)
    grams = written(benchmark_windows(benchmark, n))
    pairs = grams.agg(F.coalesce(F.sum(F.size("item_ids")), F.lit(0))).first()[0]
    source = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words_of(F.col("text")).alias("w")).withColumn("n_words", F.size("w"))
    if pairs <= BROADCAST_WINDOWS:
        anchors = grams.groupBy("anchor").agg(F.collect_set(F.struct("offset", "length")).alias("places"))
        bits = _may_be(anchors)
        # of a place where an anchor stands only the words around it are carried on: n - 1 before it and behind it
        around = lambda i: F.slice("w", F.greatest(i - n + 2, F.lit(1)), F.least(i, F.lit(n - 1)) + n)
        set_in = lambda b: F.getbit(F.get(bits, F.shiftright(b, 6).cast("int")), F.pmod(b, F.lit(64)).cast("int")) == 1
        place = lambda w, i: F.when(set_in(_bit(w)), F.struct((i + 1).alias("at"), around(i).alias("near")))
        found = F.filter(F.transform("w", place), lambda p: p.isNotNull())
        at = source.select("row", "doc_id", "n_words", F.explode_outer(found).alias("p"))
        at = at.select("row", "doc_id", "n_words", "p.at", "p.near", F.least("p.at", F.lit(n)).alias("here"))  # here: the anchor's place in near
        near = at.withColumn("anchor", F.get("near", F.col("here") - 1)).join(F.broadcast(anchors), "anchor", "left").withColumn("p", F.explode_outer("places"))
        near = near.withColumn("start", F.col("at") - F.col("p.offset")).withColumn("first", F.col("here") - F.col("p.offset"))
        inside = (F.col("first") >= 1) & (F.col("first") + F.col("p.length") - 1 <= F.size("near"))
        gram = F.when(inside, F.array_join(F.slice("near", F.col("first"), F.col("p.length")), " ")).alias("gram")
        near = near.select("row", "doc_id", "n_words", "start", F.col("p.length").alias("length"), gram)
        near = near.join(F.broadcast(grams.select("gram", "item_ids")), "gram", "left")
    else:
        lengths = [r[0] for r in grams.select("length").distinct().collect()]  # n values at most
        every = F.inline_outer(F.flatten(F.array(*map(_windows, lengths))))
        near = source.select("row", "doc_id", "n_words", every).join(grams.select("gram", "item_ids"), "gram", "left")
    spans = F.collect_set(F.when(F.col("item_ids").isNotNull(), F.struct("start", "length")))
    items = F.array_distinct(F.flatten(F.collect_set("item_ids"))).alias("item_ids")
    rows = near.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), spans.alias("spans"), items)
    places = F.array_sort(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1)))))
    return rows.select("row", "doc_id", "n_words", places.alias("hit"), F.array_sort(F.transform("item_ids", lambda i: i.cast("string"))).alias("item_ids"))


def op3(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    hits = contamination(docs, benchmark)
    return hits.select("doc_id", F.col("n_words").cast("long"), F.size("hit").cast("long").alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hit") > 0).alias("contaminated"))
