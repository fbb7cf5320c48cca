"""Packing documents into training sequences by a grouping genetic algorithm on islands.

Pieces of full length fill a sequence each. The rest is dealt at random into blocks of bounded size; each block is
evolved by several islands, whose best packings migrate round the ring between epochs. A packing is its bins: a
crossover injects whole well-filled bins of one parent into the other, drops bins that hold one of their documents
twice, and puts the displaced documents into the best-fitting bins. A mutation empties the bins with most room and some
others and fills them anew, each as full as its documents allow, which moves the room of many bins into one. Bins that
stay under-filled are opened again and packed together at a second level, so that the blocks' loose ends do not add up.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timedtext.llm.common import prepare, written

CAPACITY = 1024
END_ID = 2
BLOCK = 2048
ISLANDS, EPOCHS, GENERATIONS, POPULATION = 2, 2, 8, 3
#: Bins that a mutation empties: so many with most room, and as many others.
EMPTIED = 3
OPEN_BELOW = 0.97
#: The added token of the tokenizer file, which the rank file leaves out.
SPECIAL = {"<|endoftext|>": 50256}

_encoders: dict[str, tiktoken.Encoding] = {}


def encoder(ranks: str) -> tiktoken.Encoding:
    """The byte-level vocabulary of a rank file; it gives the ids of the tokenizer file of the same vocabulary."""
    if ranks not in _encoders:
        pairs = (line.split() for line in open(ranks, "rb"))
        _encoders[ranks] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens=SPECIAL)
    return _encoders[ranks]


def token_ids(text: str, ranks: str) -> np.ndarray:
    return np.append(encoder(ranks).encode_to_numpy(text, allowed_special="all"), END_ID).astype("<u4")


def _pieces(ranks: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 36
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = token_ids(text or "", ranks)
                cuts = [0, *range(len(ids) % capacity or min(len(ids), capacity), len(ids) + 1, capacity)]
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append((uid, doc, piece, a, b - a, zlib.crc32(ids[a:b])))
                    uid += 1
            names = ["uid", "doc_id", "piece", "start", "length", "ids_crc32"]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], names=names)

    return run


def best_fit(order: list[int], sizes: list[int], bins: list[list[int]], room: list[int], capacity: int) -> None:
    """Put each item, in order, into the bin with the least sufficient room, or into a new one."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for k, r in enumerate(room):
        if r:
            by_room[r].append(k)
            mask |= 1 << r
    for i in order:
        s = sizes[i]
        fit = mask >> s
        if fit:
            r = s + (fit & -fit).bit_length() - 1
            k = by_room[r].pop()
            if not by_room[r]:
                mask ^= 1 << r
            bins[k].append(i)
        else:
            r, k = capacity, len(bins)
            bins.append([i])
            room.append(capacity)
        r -= s
        room[k] = r
        if r:
            if not by_room[r]:
                mask |= 1 << r
            by_room[r].append(k)


def _fitness(room: list[int], capacity: int) -> tuple[int, int]:
    return -len(room), sum((capacity - r) ** 2 for r in room)


def crossover(into: tuple, source: tuple, sizes: list[int], capacity: int, rng: np.random.Generator) -> tuple:
    """Inject about half of source's well-filled bins whole; drop into's bins that share a document; refit the displaced."""
    bins, room = source
    order = np.argsort(room, kind="stable")[: max(1, len(bins) // 2)]
    taken = [int(k) for k in order[rng.random(len(order)) < 0.7]]
    inside = {i for k in taken for i in bins[k]}
    new, free, loose = [list(bins[k]) for k in taken], [room[k] for k in taken], []
    for b, r in zip(*into, strict=True):
        if inside.isdisjoint(b):
            new.append(list(b))
            free.append(r)
        else:
            loose += [i for i in b if i not in inside]
    loose.sort(key=lambda i: -sizes[i])
    best_fit(loose, sizes, new, free, capacity)
    return new, free


def fullest(items: list[int], sizes: list[int], room: int) -> list[int]:
    """Items whose sizes have the largest sum that is not above room; items named first are preferred."""
    reach, mask = [1], (1 << room + 1) - 1  # bit s: some of the items so far add up to s
    for i in items:
        reach.append(reach[-1] | reach[-1] << sizes[i] & mask)
    left, taken = reach[-1].bit_length() - 1, []
    for i, before in zip(reversed(items), reversed(reach[:-1]), strict=True):
        if not before >> left & 1:
            taken.append(i)
            left -= sizes[i]
    return taken


def exchange(bins: list[list[int]], room: list[int], loose: list[int], sizes: list[int]) -> None:
    """Where a bin has room, give it one or two loose documents for as many or more of its own that fill it less."""
    by_sum: dict[int, tuple[int, ...]] = {}
    for k in sorted((k for k, r in enumerate(room) if r), key=lambda k: -room[k]):
        if not by_sum:
            by_sum = {sizes[i] + sizes[j]: (i, j) for i, j in combinations(loose, 2)} | {sizes[i]: (i,) for i in loose}
            one = sum(1 << x for x in {sizes[i] for i in loose})
            any_two = sum(1 << x for x in by_sum)
        few = sorted(bins[k], key=lambda i: -sizes[i])[:6]
        best, out = 0, ()
        for own in (*combinations(few, 2), *((i,) for i in few)):
            had = sum(sizes[i] for i in own)
            most = ((any_two if len(own) > 1 else one) & (1 << had + room[k] + 1) - 1).bit_length() - 1
            if most - had > best:
                best, out, come = most - had, own, by_sum[most]
        if best:
            bins[k] = [i for i in bins[k] if i not in out] + list(come)
            room[k] -= best
            loose[:] = [i for i in loose if i not in come] + list(out)
            by_sum = {}


def mutate(parent: tuple, sizes: list[int], capacity: int, rng: np.random.Generator) -> tuple:
    """Empty the EMPTIED bins with most room and as many others, exchange, then fill bins anew round the largest left."""
    bins, room = parent
    order = np.argsort(room, kind="stable")[::-1]
    emptied = {int(k) for k in (*order[:EMPTIED], *rng.permutation(order[EMPTIED:])[:EMPTIED])}
    new = [list(b) for k, b in enumerate(bins) if k not in emptied]
    free = [r for k, r in enumerate(room) if k not in emptied]
    loose = [i for k in emptied for i in bins[k]]
    exchange(new, free, loose, sizes)
    loose.sort(key=lambda i: -sizes[i])
    while loose:
        inside = [loose[0], *fullest(loose[1:], sizes, capacity - sizes[loose[0]])]
        new.append(inside)
        free.append(capacity - sum(sizes[i] for i in inside))
        gone = set(inside)
        loose = [i for i in loose if i not in gone]
    return new, free


def _solution(label: list[int], sizes: list[int], capacity: int) -> tuple:
    bins: dict[int, list[int]] = {}
    for i, k in enumerate(label):
        bins.setdefault(k, []).append(i)
    return list(bins.values()), [capacity - sum(sizes[i] for i in b) for b in bins.values()]


def evolve(sizes: list[int], elites: list[list[int]], capacity: int, generations: int, population: int, seed: int) -> list[int]:
    """Bin of each item in the best packing found from the elites and from random starts."""
    rng, least = np.random.default_rng(seed), -(-sum(sizes) // capacity)
    group = [_solution(x, sizes, capacity) for x in elites]
    falling = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    while len(group) < population:
        noise = rng.random(len(sizes))
        order = falling if not group else sorted(falling, key=lambda i: -sizes[i] * (1 + 0.3 * noise[i]))
        group.append(([], []))
        best_fit(order, sizes, *group[-1], capacity)
        if len(group[-1][1]) <= least:
            break
    score = lambda x: _fitness(x[1], capacity)
    group.sort(key=score, reverse=True)
    for _ in range(generations):
        if len(group[0][1]) <= least or len(group) < 2:
            break
        a, b = rng.choice(len(group), 2, replace=False)
        for x, y in ((a, b), (b, a)):
            child = mutate(crossover(group[x], group[y], sizes, capacity, rng), sizes, capacity, rng)
            if score(child) > score(group[-1]):
                group[-1] = child
                group.sort(key=score, reverse=True)
    label = [0] * len(sizes)
    for k, b in enumerate(group[0][0]):
        for i in b:
            label[i] = k
    return label


def _epoch(capacity: int, generations: int, population: int, epoch: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            best = []
            for block, island, lengths, elites in zip(pdf["block"], pdf["island"], pdf["lengths"], pdf["elites"], strict=True):
                sizes = [int(x) for x in lengths]
                best.append(evolve(sizes, [[int(x) for x in e] for e in elites], capacity, generations, population, hash((int(block), int(island), epoch)) & 0xFFFFFFFF))
            yield pdf.assign(best=best, n_bins=[max(b, default=-1) + 1 for b in best])[["block", "island", "uids", "lengths", "best", "n_bins"]]

    return run


def _placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """uid, bin, place in it, and how full the bin is, from one packing of each block."""
    for pdf in batches:
        out = []
        for block, uids, lengths, best in zip(pdf["block"], pdf["uids"], pdf["lengths"], pdf["best"], strict=True):
            x = pd.DataFrame({"uid": np.asarray(uids, np.int64), "length": np.asarray(lengths, np.int64), "bin": np.asarray(best, np.int64)})
            group = x.groupby("bin")["length"]
            x["offset"], x["fill"], x["block"] = group.cumsum() - x["length"], group.transform("sum"), block
            out.append(x)
        yield pd.concat(out)[["uid", "length", "block", "bin", "offset", "fill"]] if out else pd.DataFrame({c: pd.Series([], dtype="int64") for c in ("uid", "length", "block", "bin", "offset", "fill")})


def _evolved(items: DataFrame, capacity: int) -> DataFrame:
    """Pack items (uid, length) block by block; the columns of _placed."""
    n_blocks = max(1, -(-items.count() // BLOCK))
    rows = items.groupBy(F.pmod(F.xxhash64("uid"), F.lit(n_blocks)).alias("block")).agg(F.sort_array(F.collect_list(F.struct("uid", "length"))).alias("x"))
    rows = rows.select("block", F.col("x.uid").alias("uids"), F.col("x.length").alias("lengths"), F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"))
    rows = rows.withColumn("elites", F.array().cast("array<array<long>>"))
    rows = rows.repartition(max(spark_width(items), 1), "block", "island")
    for epoch in range(EPOCHS):
        schema = "block long, island int, uids array<long>, lengths array<long>, best array<long>, n_bins long"
        rows = written(rows.mapInPandas(_epoch(capacity, GENERATIONS, POPULATION, epoch), schema))
        if epoch + 1 < EPOCHS:  # each island goes on from its own best packing and its neighbour's
            come = rows.select("block", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("best").alias("migrant"))
            rows = rows.join(come, ["block", "island"]).select("block", "island", "uids", "lengths", F.array("best", "migrant").alias("elites"))
    first = rows.groupBy("block").agg(F.min_by("island", F.struct("n_bins", "island")).alias("island"))
    return rows.join(first, ["block", "island"]).mapInPandas(_placed, "uid long, length long, block long, bin long, offset long, fill long")


def spark_width(df: DataFrame) -> int:
    return 3 * df.sparkSession.sparkContext.defaultParallelism


def pack(docs: DataFrame, capacity: int = CAPACITY, ranks: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts count as empty (their one id is the end id). Every row of docs is packed, repeated ones and those with
    null doc_id too. Other columns are not read. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    ranks = ranks or str(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    pieces = written(docs.select("doc_id", "text").mapInArrow(_pieces(ranks, capacity), "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"))
    placed = written(_evolved(pieces.filter(F.col("length") < capacity).select("uid", "length"), capacity))
    loose = F.col("fill") < capacity * OPEN_BELOW
    again = _evolved(placed.filter(loose).select("uid", "length"), capacity)
    number = lambda level: ((F.col("block") * (1 << 14) + F.col("bin")) * 2 + level) * 2
    bins = placed.filter(~loose).select("uid", number(0).alias("sequence_id"), "offset").unionByName(again.select("uid", number(1).alias("sequence_id"), "offset"))
    full = pieces.filter(F.col("length") >= capacity).select("*", (F.col("uid") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.filter(F.col("length") < capacity).join(bins, "uid").select(full.columns)
    return full.unionByName(rest).drop("uid")
