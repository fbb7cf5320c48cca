"""Near-duplicate groups by circulant MinHash with exact verification.

Steps, all on classes of documents with equal shingle sets (copies never multiply work):

1. Signatures. Two permutations: sigma sends a shingle to a place in [0, 2**20), pi is a table over those places;
   coordinate k is the least pi[(sigma + k) mod 2**20], so one table read circularly shifted gives all of them.
2. Banding: equal bands put classes in one bucket.
3. Exact pruning (by 85 %, or percent): a class with more than 15 % shingles that no other candidate has can't link with
   any (its overlap is at most its other shingles, and a link needs 85 % of the union). Repeated once, as pruning frees shingles.
4. Each bucket links its members to its hub (the member in most buckets), verified on full sets; components follow.
5. Classes of buckets that still hold different components are compared where they can link at all, by one of two
   prefix filters. Over whole sets: a pair of 85 % shares one of the rarest shingles of both, so pages that share a
   template and differ in their own words never meet. Over differences from a common hub: a pair of which one is not
   linked to the hub shares what it differs in, so near copies of one text whose changes lie apart never meet. For each
   hub the filter that makes fewer pairs is taken. Pairs of one component are not made. No link of classes compared is lost.

Joins on keys that many rows can share (class, bucket, hub, label, shingle) go through common.keyed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timedtext.llm.common import counted, hot_keys, keyed, prepare, text_bytes, written
from timedtext.llm.words import blocks, chained, mix, words_of

PLACES = 1 << 20
SHINGLE = 5
PERCENT = 85
BANDS, BAND_ROWS = 20, 5

_pi: dict[tuple[int, int], np.ndarray] = {}


def _pi_windows(width: int, seed: int) -> np.ndarray:
    """Row s holds pi at s, s + 1, ... circularly: a view, not a copy."""
    if (width, seed) not in _pi:
        pi = np.random.default_rng(seed).permutation(PLACES).astype(np.uint32)
        _pi[width, seed] = np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[: width - 1]]), width)
    return _pi[width, seed]


def shingle_sets(texts: list[bytes], n: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the n-word shingles of each text; fewer words make one shingle, none make none."""
    for a, b in blocks(texts):
        w = words_of(texts[a:b])
        runs = chained(w.hash, n)
        for i in range(b - a):
            lo, hi = w.first[i], w.first[i + 1]
            if hi - lo >= n:
                yield np.unique(runs[lo : hi - n + 1])
            else:
                yield chained(w.hash[lo:hi], hi - lo) if hi > lo else np.empty(0, np.uint64)


def signature(shingles: np.ndarray, width: int, seed: int = 1) -> np.ndarray:
    """Least pi over the shingles' places at each circular shift."""
    windows, least = _pi_windows(width, seed), np.full(width, PLACES, np.uint32)
    at = (mix(shingles + np.uint64(seed)) >> np.uint64(44)).astype(np.int64)
    for k in range(0, len(at), 4096):
        np.minimum(least, windows[at[k : k + 4096]].min(axis=0), out=least)
    return least


def class_of(shingles: np.ndarray) -> int | None:
    """One 64-bit id for each distinct shingle set; none for the empty set."""
    with np.errstate(over="ignore"):
        total = shingles.sum(dtype=np.uint64) + mix(shingles).sum(dtype=np.uint64) * np.uint64(3)
    return int(mix(total).astype(np.int64)) if len(shingles) else None


def _signed(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for s in shingle_sets(batch.column("bytes").to_pylist()):
                out[0].append(len(s))
                out[1].append(class_of(s))
                if len(s):
                    sig = signature(s, bands * rows).astype(np.uint64).reshape(bands, rows)
                    with np.errstate(over="ignore"):
                        key = np.arange(1, bands + 1, dtype=np.uint64)
                        for k in range(rows):
                            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, k])
                    out[2].append(key.astype(np.int64))
                else:
                    out[2].append(np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True))], names=["doc_id", "n_shingles", "class", "bands"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = list(shingle_sets(batch.column("bytes").to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array(map(class_of, sets), pa.int64()), pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64()))], names=["class", "shingles"])


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node reachable over edges (a, b). Least labels of neighbours, then of labels, until nothing changes."""
    pairs = written(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    hot = hot_keys(counted(pairs, "b"), "b")
    labels = written(pairs.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = keyed(pairs, labels.withColumnRenamed("node", "b"), "b", hot, "inner").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        new = written(labels.join(near, "node").select("node", "label", F.least("label", "near").alias("next")))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        new = keyed(new, jump, "next").select("node", "label", F.least("next", "far").alias("next"))
        new = written(new)
        done = new.filter(F.col("label") != F.col("next")).isEmpty()
        labels = new.select("node", F.col("next").alias("label"))
        if done:
            return labels


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b): sizes of what their full sets share and of their union."""
    pairs = written(pairs.select("a", "b"))
    side = lambda k: sets.select(F.col("class").alias(k), F.col("shingles").alias(f"s{k}"))
    hot = hot_keys(counted(pairs, "b"), "b")
    both = keyed(keyed(pairs, side("a"), "a", how="inner"), side("b"), "b", hot, "inner")
    both = both.withColumn("shared", F.size(F.array_intersect("sa", "sb")))
    return both.select("a", "b", "shared", (F.size("sa") + F.size("sb") - F.col("shared")).alias("total"))


def _rarest_first(each: DataFrame, keys: list[str], n: str) -> DataFrame:
    """Rows (class, s, …, and n, how many s the class has) that other classes of the same keys have too, with the place of s among the class's, rarest first."""
    each = written(each.withColumn("__at", F.xxhash64(*keys, "s")))
    df = written(counted(each, "__at").filter("n > 1"))
    each = keyed(each, df.select("__at", F.col("n").alias("df")), "__at", hot_keys(df, "__at"), "inner").drop("__at")
    by_class = Window.partitionBy("class")
    # what no other class has comes first, so it only shifts the others
    rank = F.row_number().over(by_class.orderBy("df", "s")) + F.col(n) - F.count(F.lit(1)).over(by_class)
    return each.withColumn("rank", rank)


def _set_prefixes(some: DataFrame, percent: int) -> DataFrame:
    """s, class, label, home, n, small: the shingles by which a set can meet others; small if it can meet larger ones by it.

    A set of n shingles can link to one at least as large only by one of its n - ceil(2t/(1+t) n) + 1 rarest, and to
    one at most as large by one of its n - ceil(t n) + 1 rarest.
    """
    each = some.select("class", "label", "home", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    each = _rarest_first(each, [], "n").filter(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    least = F.ceil(F.col("n") * (2 * percent) / (100 + percent))
    return written(each.select("s", "class", "label", "home", "n", (F.col("rank") <= F.col("n") - least + 1).alias("small")))


def _difference_prefixes(some: DataFrame, hubs: DataFrame, hot: dict, percent: int) -> DataFrame:
    """s, class, label, home, far, tight: what a class and its hub do not share, as far as the class can meet others by it.

    With W = 100 * missing + percent * own shingles and K = (100 - percent) * the hub's, a class is linked to the hub
    when W <= K, else far. Two classes a, b of one hub link only if they share at least (Wa + Wb - K) / (100 + percent)
    of their differences. Of two with different labels one is far, so a class that is near meets it only by more than
    W / (100 + percent) of its differences, as two far ones do (tight); a far one meets near ones by (W - K) / (100 + percent).
    """
    rows = keyed(some.filter("class <> home").select("class", "label", "home", "shingles"), hubs, "home", hot, "inner")
    missing, own = F.array_except("hub_shingles", "shingles"), F.array_except("shingles", "hub_shingles")
    rows = rows.select("class", "label", "home", F.size("hub_shingles").alias("n_hub"), missing.alias("missing"), own.alias("own"))
    w, k, scale = 100 * F.size("missing") + percent * F.size("own"), (100 - percent) * F.col("n_hub"), 100 + percent
    rows = rows.select("class", "label", "home", w.alias("w"), k.alias("k"), F.concat("missing", "own").alias("differs"))
    rows = rows.select("class", "label", "home", "w", "k", F.size("differs").alias("n"), F.explode("differs").alias("s"))
    each = _rarest_first(rows, ["home"], "n")
    far, mine = F.col("w") > F.col("k"), F.floor(F.col("w") / scale) + 1
    tight = F.col("rank") <= F.col("n") - mine + 1
    wide = F.col("rank") <= F.col("n") - F.greatest(F.ceil((F.col("w") - F.col("k")) / scale), F.lit(1)) + 1
    return written(each.filter(tight | (far & wide)).select("s", "class", "label", "home", far.alias("far"), tight.alias("tight")))


def _met(a: DataFrame, b: DataFrame, on: list[str], group: list[str], fits) -> DataFrame:
    """Pairs (a, b) of rows that agree in on and whose groups differ in every column; members of one group are not paired."""
    two = lambda df, k: df.select(*on, *(F.col(c).alias(f"{c}_{k}") for c in df.columns if c not in on))
    a, b = two(a, "a"), two(b, "b")
    ga, gb = [f"{c}_a" for c in group], [f"{c}_b" for c in group]
    meet = a.select(*on, *ga).distinct().join(b.select(*on, *gb).distinct(), on)
    for c in group:
        meet = meet.filter(F.col(f"{c}_a") != F.col(f"{c}_b"))
    pairs = meet.join(a, [*on, *ga]).join(b, [*on, *gb]).filter(fits)
    return pairs.select(F.col("class_a").alias("a"), F.col("class_b").alias("b"))


def unlinked_pairs(some: DataFrame, hubs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different label that can reach percent, of rows (class, label, home, shingles): no pair that does
    is left out, but for those of a class and its home, which are compared before. hubs: home, hub_shingles."""
    hot = hot_keys(counted(some, "home"), "home")
    sets, differences = _set_prefixes(some, percent), _difference_prefixes(some, hubs, hot, percent)
    by_sets = sets.groupBy("home", "s").agg((F.count_if("small") * F.count(F.lit(1))).alias("x")).groupBy("home").agg(F.sum("x").alias("by_sets"))
    far, near = F.expr("far"), F.expr("not far and tight")
    of_far = F.count_if(far) * F.count_if(near) + F.count_if(far & F.col("tight")) * F.count_if(far & F.col("tight"))
    by_differences = differences.groupBy("home", "s").agg(of_far.alias("x")).groupBy("home").agg(F.sum("x").alias("by_differences"))
    choice = by_sets.join(by_differences, "home", "left").select("home", (F.coalesce("by_differences", F.lit(0)) < F.col("by_sets")).alias("differ"))
    choice = written(choice)
    fits = (F.col("n_a") * 100 >= F.col("n_b") * percent) & (F.struct("n_a", "class_a") < F.struct("n_b", "class_b"))
    apart = _met(sets.filter("small"), sets, ["s"], ["label", "home"], fits)
    together = keyed(sets, choice, "home", hot, "inner").filter("not differ").drop("differ")
    together = _met(together.filter("small"), together, ["home", "s"], ["label"], fits)
    by_hub = written(keyed(differences, choice, "home", hot, "inner").filter("differ").drop("differ"))
    mixed = _met(by_hub.filter("far"), by_hub.filter("not far and tight"), ["home", "s"], ["label"], F.lit(True))
    distant = _met(by_hub.filter("far and tight"), by_hub.filter("far and tight"), ["home", "s"], ["label"], F.col("class_a") < F.col("class_b"))
    return apart.union(together).union(mixed).union(distant).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, bands: int = BANDS, rows: int = BAND_ROWS, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (least doc_id of the group), kept.

    Null or word-less texts have no shingles and stay alone; rows with null doc_id stay alone unless their text
    equals another's (then that group's id). Repeated rows are members of one class. A row is kept when its doc_id
    is its component_id; a null doc_id is kept if nothing gives it a component. Other columns of docs are not read.
    """
    prepare(docs.sparkSession)
    source = docs.select("doc_id", text_bytes("text").alias("bytes"))
    signed = written(source.mapInArrow(_signed(bands, rows), "doc_id long, n_shingles long, class long, bands array<long>"))
    # one document stands for each class of equal sets
    one = signed.filter("class is not null").groupBy("class")
    classes = written(one.agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands")))
    member = classes.select("class", "n", F.explode("bands").alias("bucket"))
    shared = written(member.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    hot = hot_keys(shared, "bucket")
    member = written(keyed(member, shared.select("bucket", F.col("n").alias("size")), "bucket", hot, "inner"))
    candidates = member.select("class").distinct().join(classes.select("class", "rep"), "class")
    text = source.join(candidates.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select("bytes")
    sets = text.mapInArrow(_sets, "class long, shingles array<long>").join(candidates.select("class"), "class", "left_semi")
    sets = written(sets.dropDuplicates(["class"]))
    alive = sets.select("class", F.size("shingles").alias("n"))
    for _ in range(2):  # as numbers only: what is pruned frees shingles of others
        alone = sets.join(alive.select("class"), "class").select("class", F.explode("shingles").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("df"), F.min("class").alias("class"))
        alone = alone.filter("df = 1").groupBy("class").agg(F.count(F.lit(1)).alias("own"))
        alive = written(alive.join(alone, "class", "left").filter(F.coalesce("own", F.lit(0)) * 100 <= F.col("n") * (100 - percent)).select("class", "n"))
    alive = written(sets.join(alive.select("class"), "class").select("class", "shingles"))
    member = member.join(alive.select("class"), "class")
    member = written(member.join(member.groupBy("class").agg(F.sum("size").alias("weight")), "class").select("bucket", "class", "weight"))
    hub = member.groupBy("bucket").agg(F.max_by("class", F.struct("weight", "class")).alias("hub"), F.max("weight").alias("hub_weight"), F.count(F.lit(1)).alias("n"))
    member = written(keyed(member, hub.filter("n > 1").drop("n"), "bucket", hot, "inner"))
    star = written(_overlaps(member.filter("class <> hub").select(F.col("class").alias("a"), F.col("hub").alias("b")).distinct(), alive))
    linked = star.filter(f"shared * 100 >= total * {percent}").select("a", "b")
    labels = components(linked)
    member = member.join(labels.withColumnRenamed("node", "class"), "class", "left").select("bucket", "class", "hub", "hub_weight", F.coalesce("label", "class").alias("label"))
    mixed = member.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi")
    home = F.max_by("hub", F.struct("hub_weight", "hub")).alias("home")
    rest = keyed(member, mixed.select("bucket", "lo"), "bucket", hot, "inner").groupBy("class", "label").agg(home)
    rest = written(rest.join(alive, "class"))
    hubs = rest.select("home").distinct().join(alive.select(F.col("class").alias("home"), F.col("shingles").alias("hub_shingles")), "home")
    pairs = unlinked_pairs(rest, hubs, percent).join(star.select("a", "b").union(star.select("b", "a")), ["a", "b"], "left_anti")
    more = written(_overlaps(pairs, alive).filter(f"shared * 100 >= total * {percent}").select("a", "b"))
    if not more.isEmpty():
        labels = components(linked.union(more))
    least = written(labels.join(classes.select(F.col("class").alias("node"), "rep"), "node"))
    group = least.groupBy("label").agg(F.min("rep").alias("component"), F.count(F.lit(1)).alias("n"))
    least = keyed(least, group.select("label", "component"), "label", hot_keys(group, "label")).select(F.col("node").alias("class"), "component")
    known = classes.join(least, "class", "left").filter("component is not null or copies > 1").select("class", F.coalesce("component", "rep").alias("component"))
    hot = hot_keys(classes.select("class", F.col("copies").alias("n")), "class")
    out = keyed(signed.select("doc_id", "n_shingles", "class"), known, "class", hot)
    out = out.withColumn("component_id", F.coalesce("component", "doc_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept")
    return out.select("doc_id", "n_shingles", "component_id", kept)
