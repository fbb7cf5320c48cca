"""Collocations: frequent phrases that say more than their parts, mined by sorting suffixes.

Every place of a text where a phrase could begin is a suffix: the next words of its piece, five at most. Suffixes are
routed by their leading words, so that all that begin alike meet in one task, and are sorted there by multikey
three-way quicksort: by the first word, the equal part by the second, and so on. The size of a part that is equal in
its first words is the count of these words as a phrase; a part too small to count is not sorted any further.

Before that, words are counted; a suffix ends before a word that is rare, since no phrase that counts has one. Where one
route would get too many suffixes, these are routed by three, four or five words; equal suffixes are counted before they
travel, and counts of phrases shorter than their route are summed afterwards. So no task gets more than its share.

Words are told apart by 64-bit numbers. That no two words share one is checked for each corpus, by a second number
of 64 bits; if any do, another seed is taken.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timedtext.llm.common import keyed, prepare, written
from timedtext.llm.words import mix

LONGEST, LEAST_COUNT, TOP = 5, 100, 2000
#: Buckets of leading words whose suffixes are counted to plan routes, suffixes of a route on average, and those from which a bucket is routed by more words.
BUCKETS, ROUTE_ROWS, HOT_ROWS = 1 << 16, 1 << 18, 1 << 19
#: Frequent words (8 bytes each) up to which their numbers are sent to all tasks, to leave out rare words; beyond it, none are left out.
MOST_FREQUENT = 4_000_000
#: Bytes of text that numpy works on at once, and suffixes sorted before they travel.
BLOCK_BYTES, FLUSH_SUFFIXES = 2 << 20, 500_000
#: Parts below this size are sorted outright.
SMALL = 4096
#: Words longer than this are hashed whole.
LONG_WORD = 1024

_IN_WORD = np.ones(256, bool)
_IN_WORD[[0x20, 0x09, *range(0x0A, 0x0E), *b".,;:!?"]] = False
_ENDS_PIECE = np.zeros(256, bool)
_ENDS_PIECE[[*range(0x0A, 0x0E), *b".,;:!?"]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _numbers(buf: np.ndarray, start: np.ndarray, size: np.ndarray, begin: np.ndarray, odd: np.uint64) -> np.ndarray:
    """A 64-bit number for each word of buf (which has 8 spare bytes): its bytes, eight at a time, are mixed into begin."""
    eight = np.ndarray((len(buf) - 7,), "<u8", buffer=buf, strides=(1,))
    with np.errstate(over="ignore"):
        h = mix(begin + size.astype(np.uint64) * odd)
        h = mix(h ^ (eight[start] & _MASK[np.minimum(size, 8)]) * odd)
        on = np.flatnonzero((size > 8) & (size <= LONG_WORD))
        k = 8
        while len(on):
            h[on] = mix((h[on] * odd) ^ (eight[start[on] + k] & _MASK[np.minimum(size[on] - k, 8)]))
            k += 8
            on = on[size[on] > k]
        for i in np.flatnonzero(size > LONG_WORD):
            whole = hashlib.blake2b(buf[start[i] : start[i] + size[i]].tobytes(), digest_size=8, key=int(odd).to_bytes(8, "little")).digest()
            h[i] = mix(h[i] ^ np.uint64(int.from_bytes(whole, "little")))
    return h


class Words:
    """The words of a block of texts: number, second number, place in buf, and whether the next word is in the same piece."""

    def __init__(self, langs: list[str], texts: list[bytes], seed: int, both: bool) -> None:
        joined = b"\n".join(texts) + b"\n"
        self.buf = np.zeros(len(joined) + 8, np.uint8)
        self.buf[:-8] = _LOWER[np.frombuffer(joined, np.uint8)]
        inside = _IN_WORD[self.buf[:-8]]
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
        self.start, end = edge[::2], edge[1::2]
        self.size = end - self.start
        bounds = np.cumsum([len(t) + 1 for t in texts])
        self.row = np.searchsorted(bounds, self.start, side="right")
        pieces = np.cumsum(_ENDS_PIECE[self.buf[:-8]], dtype=np.int32)[self.start] if len(self.start) else np.empty(0, np.int32)
        self.same = np.zeros(len(self.start), bool)
        self.same[:-1] = pieces[1:] == pieces[:-1]
        ids = {lang: hashlib.blake2b(f"{seed} {lang}".encode(), digest_size=16).digest() for lang in set(langs)}
        begin = lambda a: np.array([int.from_bytes(ids[x][a : a + 8], "little") for x in langs], np.uint64)[self.row]
        self.number = np.maximum(_numbers(self.buf, self.start, self.size, begin(0), _ODD[0]), np.uint64(1))  # 0 is no word
        self.second = _numbers(self.buf, self.start, self.size, begin(8), _ODD[1]) if both else None

    def suffixes(self, codes: np.ndarray, longest: int) -> np.ndarray:
        """Rows of up to longest codes, filled up with 0, of each word that has a code and a next word with one in its piece."""
        at = np.flatnonzero(codes != 0)
        out = np.zeros((longest, len(at)), codes.dtype)
        out[0], on = codes[at], np.ones(len(at), bool)
        for d in range(1, longest):
            i = np.minimum(at + d, len(codes) - 1)
            on = on & (at + d < len(codes)) & self.same[np.minimum(at + d - 1, len(codes) - 1)]
            out[d] = np.where(on, codes[i], 0)
            on = on & (out[d] != 0)
        return out[:, out[1] != 0]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], list[bytes]]]:
    """Languages and texts of blocks of about BLOCK_BYTES; a longer text is a block of its own."""
    langs: list[str] = []
    texts: list[bytes] = []
    total = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if texts and total + len(text) > BLOCK_BYTES:
                yield langs, texts
                langs, texts, total = [], [], 0
            langs.append(lang)
            texts.append(text)
            total += len(text) + 1
    if texts:
        yield langs, texts


def _bucket(suffixes: np.ndarray, words: int) -> np.ndarray:
    """A hash of the leading words of each suffix."""
    with np.errstate(over="ignore"):
        h = np.zeros(suffixes.shape[1], np.uint64)
        for d in range(words):
            h = mix(h * _ODD[0] ^ suffixes[d].astype(np.uint64))
    return h


COUNTED = "kind int, h long, second long, lang string, word binary, n long"


def _counts(seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Words with their counts (kind 1) of each block, and suffixes of a task by bucket of their first two, three and four words (kinds 2 to 4)."""
    names = ["kind", "h", "second", "lang", "word", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = np.zeros((LONGEST, BUCKETS), np.int64)
        for langs, texts in _blocks(batches):
            w = Words(langs, texts, seed, both=True)
            order = np.argsort(w.number, kind="stable")
            a, b = w.number[order], w.second[order]
            first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.empty(0, np.int64)
            at, n = order[first], np.diff(first, append=len(a))
            of = [langs[r] for r in w.row[at].tolist()]
            word = [w.buf[x:y].tobytes() for x, y in zip(w.start[at].tolist(), (w.start[at] + w.size[at]).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(at), np.int32)), pa.array(w.number[at].view(np.int64)), pa.array(w.second[at].view(np.int64)), pa.array(of, pa.string()), pa.array(word, pa.binary()), pa.array(n)], names)
            del order, a, b, of, word
            s = w.suffixes(w.number, LONGEST)
            for d in range(2, LONGEST):
                buckets[d] += np.bincount((_bucket(s, d) & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
        for d in range(2, LONGEST):
            some = np.flatnonzero(buckets[d])
            nothing = pa.nulls(len(some))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), d, np.int32)), pa.array(some), pa.array(np.zeros(len(some), np.int64)), nothing.cast(pa.string()), nothing.cast(pa.binary()), pa.array(buckets[d][some])], names)

    return run


def _coded(numbers: np.ndarray, frequent: np.ndarray | None) -> np.ndarray:
    """Codes of words: places in the sorted numbers of frequent words, from 1, and 0 for rare ones; without these, the numbers."""
    if frequent is None:
        return numbers
    at = np.minimum(np.searchsorted(frequent, numbers), max(0, len(frequent) - 1))
    return np.where(frequent[at] == numbers, at + 1, 0).astype(np.uint32) if len(frequent) else np.zeros(len(numbers), np.uint32)


def _routed(seed: int, shared: Broadcast, routes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Suffixes of a task by route, equal ones as one with their count; by how many words they are routed is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, hot = shared.value

        def sent(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            s, route, level = (np.concatenate(x, axis=-1) for x in zip(*parts, strict=True))
            whole = _bucket(s, LONGEST)
            key = (route.astype(np.uint64) << np.uint64(40)) | (whole >> np.uint64(24))  # equal suffixes lie side by side, whatever else does
            order = np.argsort(key, kind="stable")
            s, route, level = s[:, order], route[order], level[order]
            new = np.concatenate([[True], (s[:, 1:] != s[:, :-1]).any(axis=0) | (route[1:] != route[:-1])])
            first = np.flatnonzero(new)
            n = np.diff(first, append=len(route)).astype(np.uint32)
            s, route, level = s[:, first], route[first], level[first]
            cuts = np.flatnonzero(np.concatenate([[True], route[1:] != route[:-1]]))
            ends = np.append(cuts[1:], len(route))
            blobs = [s[:, a:b].tobytes() + n[a:b].tobytes() + level[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(route[cuts].astype(np.int64)), pa.array((ends - cuts).astype(np.int64)), pa.array(blobs, pa.binary())], ["route", "n", "suffixes"])

        parts, total = [], 0
        for langs, texts in _blocks(batches):
            w = Words(langs, texts, seed, both=False)
            s = w.suffixes(_coded(w.number, frequent), LONGEST)
            if not s.shape[1]:
                continue
            numbers = s if frequent is None else np.concatenate([[np.uint64(0)], frequent])[s]
            level, at = np.full(s.shape[1], LONGEST, np.uint8), np.zeros(s.shape[1], np.uint64)
            at[:] = mix(_bucket(numbers, LONGEST))
            for d in range(LONGEST - 1, 1, -1):  # by as few words as their buckets allow
                bucket = _bucket(numbers, d)
                cold = ~hot[d][(bucket & np.uint64(BUCKETS - 1)).astype(np.int64)]
                level[cold], at[cold] = d, bucket[cold]
            parts.append((s, (at & np.uint64(BUCKETS - 1)) % np.uint64(routes), level))
            total += s.shape[1]
            if total >= FLUSH_SUFFIXES:
                yield sent(parts)
                parts, total = [], 0
        if parts:
            yield sent(parts)

    return run


def partitions(words: np.ndarray, n: np.ndarray, level: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(row, length, count): the parts that are equal in their first 2, 3, … words, with a row of each, that count.

    words has a column for each suffix, ended by zeros. Parts with less than least are left out, but those of suffixes that
    are routed by more words than the part's length (level), whose counts are summed elsewhere.
    """
    longest, found = len(words), []
    todo = [(np.arange(len(n)), 0)]
    while todo:
        rows, d = todo.pop()
        if n[rows].sum() < least and level[rows].max(initial=0) <= d:
            continue
        rows = rows[words[d][rows] != 0]  # the others have ended
        if not len(rows):
            continue
        if len(rows) <= SMALL:
            rows = rows[np.lexsort([words[e][rows] for e in range(longest - 1, d - 1, -1)])]
            block = words[:, rows]
            new = np.zeros(len(rows), bool)
            new[0] = True
            for e in range(d, longest):
                new[1:] |= block[e, 1:] != block[e, :-1]
                first = np.flatnonzero(new)
                count = np.add.reduceat(n[rows], first)
                keep = (block[e, first] != 0) & ((count >= least) | (level[rows[first]] > e + 1)) if e else np.zeros(len(first), bool)
                found += [(int(r), e + 1, int(c)) for r, c in zip(rows[first[keep]], count[keep], strict=True)]
            continue
        values = words[d][rows]
        some = np.sort(values[:: max(1, len(values) // 9)])
        pivot = some[len(some) // 2]
        same = rows[values == pivot]
        total, deep = int(n[same].sum()), bool((level[same] > d + 1).any())
        if d and (total >= least or deep):
            found.append((int(same[0]), d + 1, total))
        if d + 1 < longest and (total >= least or deep):
            todo.append((same, d + 1))
        todo += [(part, d) for part in (rows[values < pivot], rows[values > pivot]) if len(part)]
    return found


def _sorted(shared: Broadcast, least: int):
    """Counts of the phrases of a route; phrase is the words' numbers, joined by commas."""

    def run(table: pa.Table) -> pa.Table:
        frequent = shared.value[0]
        kind = np.dtype(np.uint64 if frequent is None else np.uint32)
        suffixes, counts, levels = [], [], []
        for m, blob in zip(table["n"].to_pylist(), table["suffixes"].to_pylist(), strict=True):
            cut = LONGEST * m * kind.itemsize
            suffixes.append(np.frombuffer(blob[:cut], kind).reshape(LONGEST, m))
            counts.append(np.frombuffer(blob[cut : cut + 4 * m], np.uint32))
            levels.append(np.frombuffer(blob[cut + 4 * m :], np.uint8))
        words, n, level = np.concatenate(suffixes, axis=1), np.concatenate(counts).astype(np.int64), np.concatenate(levels)
        found = partitions(words, n, level, least)
        of = words if frequent is None else np.concatenate([[np.uint64(0)], frequent])[words]
        phrase = [",".join(map(str, of[:size, row].view(np.int64).tolist())) for row, size, _ in found]
        return pa.table({"phrase": pa.array(phrase, pa.string()), "n": pa.array([c for _, _, c in found], pa.int64())})

    return run


def phrase_counts(documents: DataFrame, least: int = LEAST_COUNT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(phrases, words, totals): counts of all phrases of 2 to 5 words that occur least times; of the words that do; and
    of all words by language. phrases has phrase (numbers of its words, joined by commas) and n; words h, lang, word and n."""
    spark = prepare(documents.sparkSession)
    texts = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    for seed in range(100):
        counted = texts.mapInArrow(_counts(seed), COUNTED)
        # all rows of a number meet, so both groupings need no more shuffle
        summed = written(counted.repartition("h").groupBy("h", "kind", "second", "lang", "word").agg(F.sum("n").alias("n")))
        if not summed.filter("kind = 1").groupBy("h").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").limit(1).count():
            break
    else:
        raise RuntimeError("no seed tells all words apart")
    words = summed.filter("kind = 1").select("h", "lang", F.col("word").cast("string").alias("word"), "n")
    frequent = words.filter(F.col("n") >= least)
    numbers = None
    if frequent.count() <= MOST_FREQUENT:
        numbers = np.sort(frequent.select("h").toPandas()["h"].to_numpy(np.int64).view(np.uint64))
    hot = np.zeros((LONGEST, BUCKETS), bool)
    for r in summed.filter("kind > 1").filter(F.col("n") > HOT_ROWS).select("kind", "h").collect():  # BUCKETS * 3 at most
        hot[r["kind"], r["h"]] = True
    total = summed.filter("kind = 2").agg(F.sum("n")).first()[0] or 0
    routes = min(BUCKETS, max(8, -(-total // ROUTE_ROWS)))
    shared = spark.sparkContext.broadcast((numbers, hot))
    sent = texts.mapInArrow(_routed(seed, shared, routes), "route long, n long, suffixes binary")
    parts = sent.groupBy("route").applyInArrow(_sorted(shared, least), "phrase string, n long")
    phrases = written(parts.groupBy("phrase").agg(F.sum("n").alias("n")).filter(F.col("n") >= least))
    return phrases, frequent, words.groupBy("lang").agg(F.sum("n").alias("total"))


def _part(phrase: Column, first: Column | int, size: Column | int) -> Column:
    return F.array_join(F.slice(phrase, first, size), ",")


def collocations(documents: DataFrame, least: int = LEAST_COUNT, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of 2 to 5 words.

    documents has lang (null counts as und) and text (null counts as empty). Texts are cut at . , ; : ! ? and line ends into
    pieces, these at blanks and tabs into words; A-Z are lower-cased. a is a phrase's count, n that of all words of the
    language. Of the cuts of a phrase in two, with counts l and r, that with the least floor(1000 a n / (l r)), the score,
    counts, and of equal ones the first. Phrases that lie inside a longer one that is as frequent are left out. Order: score, a
    (both descending), phrase by its bytes. A language without frequent phrases, and an empty table, give no rows.
    Equal rows count each; other columns are left alone. A text, however long, is read whole by one task.
    """
    phrases, words, totals = phrase_counts(documents, least)
    phrases = phrases.withColumn("w", F.split("phrase", ","))
    size = F.size("w")
    counts = phrases.select("phrase", F.col("n").alias("f")).unionByName(words.select(F.col("h").cast("string").alias("phrase"), F.col("n").alias("f")))
    # a longer phrase that is as frequent as one inside it is so through one that is longer by a word
    longer = phrases.filter(size > 2).select("n", F.explode(F.array(_part(F.col("w"), 1, size - 1), _part(F.col("w"), 2, size - 1))).alias("phrase"))
    longer = longer.groupBy("phrase").agg(F.max("n").alias("most"))
    kept = phrases.join(longer, "phrase", "left").filter("most is null or most < n").select("phrase", F.col("n").alias("a"), "w")
    cuts = kept.select("phrase", "a", "w", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("phrase", "a", "k", _part(F.col("w"), 1, F.col("k")).alias("left"), _part(F.col("w"), F.col("k") + 1, size - F.col("k")).alias("right"), F.get("w", F.lit(0)).cast("long").alias("h"))
    cuts = keyed(cuts, counts.select(F.col("phrase").alias("left"), F.col("f").alias("l")), "left", how="inner").drop("left")
    cuts = keyed(cuts, counts.select(F.col("phrase").alias("right"), F.col("f").alias("r")), "right", how="inner").drop("right")
    cuts = keyed(cuts, words.select("h", "lang"), "h", how="inner")
    cuts = keyed(cuts, totals.select("lang", F.col("total").alias("n")), "lang", how="inner")
    whole = lambda c: F.col(c).cast("decimal(16,0)")
    cuts = cuts.withColumn("__over", (whole("a") * whole("n")).cast("decimal(33,0)") * F.lit(1000).cast("decimal(4,0)")).withColumn("__under", (whole("l") * whole("r")).cast("decimal(33,0)"))
    cuts = cuts.withColumn("score", F.expr("__over div __under"))
    least_cut = F.min(F.struct("score", "k", "l", "r")).alias("x")
    scored = cuts.groupBy("phrase", "lang", "a", "n").agg(least_cut).select("phrase", "lang", "a", "n", "x.score", "x.l", "x.r")
    # the words themselves, for what can be among the best: ties at the end are kept until the words tell
    ahead = scored.withColumn("__rank", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).filter(F.col("__rank") <= top).drop("__rank")
    each = ahead.select("phrase", F.posexplode(F.split("phrase", ",")).alias("at", "h")).withColumn("h", F.col("h").cast("long"))
    each = keyed(each, words.select("h", "word"), "h", how="inner")
    text = each.groupBy("phrase").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("text"))
    shown = ahead.join(text, "phrase").drop("phrase").withColumnRenamed("text", "phrase")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return shown.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13(documents: DataFrame) -> DataFrame:
    return collocations(documents)
