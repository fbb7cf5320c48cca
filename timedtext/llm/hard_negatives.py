"""Hard negatives by lists that clusters of anchors share.

Anchors travel in blocks to shards of candidates. In a shard, each cluster of a block sorts the candidates once by an
upper bound of their inner product with any of its members: with c the cluster's centre and t the widest angle between c
and a member, no member of length 1 has more with a candidate x than |x| cos(angle(c, x) - t). Every member then walks
that one list and stops where the bound, times its own length, is below what it still needs: the k-th score that it has,
or the least score that it asks for. So nothing that could count is left out.

Two rounds of this mine hard negatives: the first finds each anchor's positives, the second, for each positive, the best
candidates of other labels within a band of scores. Each round first meets the shard that the block's own cell of the
space is in, and what is found there goes along to all others as what is needed. Blocks and shards meet as pairs of file
parts that a task reads, so neither is copied for each of the others by a shuffle or a broadcast.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timedtext.llm.common import prepare, written
from timedtext.llm.kdtree import _dot, scaled

#: Candidates of a shard, anchors of a block, members of a cluster on average, and candidates that a walk looks at in its first step.
SHARD_ROWS, BLOCK_ANCHORS, CLUSTER, STEP = 8192, 256, 32, 512
#: Vectors from which cells of the space are learnt, vectors of a cell, and most cells. They change the speed, not the rows.
SAMPLE, CELL_ROWS, MOST_CELLS = 20_000, 65_536, 256
#: What rounding can add to the cosine of a difference of two angles.
SLACK = 1e-7
LEAST, MOST = -(2**63) + 1, 2**63 - 1

POINT = "vec_id long, label long, embedding array<double>, cell int"
HITS = "anchor_id long, positive_id long, vec_id long, score long"


def _directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths, and vectors of length 1 (zero vectors stay)."""
    length = np.sqrt((x * x).sum(axis=1))
    return length, x / np.where(length > 0, length, 1.0)[:, None]


def centres(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k directions among which those of x fall into clusters; begun with vectors that lie far from one another."""
    _, d = _directions(x)
    first = [0]
    near = d @ d[0]
    for _ in range(1, min(k, len(d))):
        first.append(int(np.argmin(near)))
        near = np.maximum(near, d @ d[first[-1]])
    c = d[first]
    for _ in range(rounds if len(c) > 1 else 1):
        at = np.argmax(d @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, d)
        c = np.where((sums != 0).any(axis=1)[:, None], _directions(sums)[1], c)
    return c


def _cells(vectors: DataFrame, n: int) -> dict[int, np.ndarray]:
    """For each vector length, the centres of its cells: at most MOST_CELLS, learnt from SAMPLE vectors at most, in a task of their own."""
    k = min(MOST_CELLS, max(1, -(-n // CELL_ROWS)))
    if k == 1:
        return {}

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        c = centres(np.stack([np.asarray(v) for v in pdf["embedding"]]), k)
        return pd.DataFrame({"dim": [len(pdf["embedding"].iloc[0])], "c": [c.ravel()]})

    some = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding")
    found = some.groupBy(F.size("embedding").alias("__n")).applyInPandas(lambda pdf: fit(pdf), "dim int, c array<double>").collect()
    return {r["dim"]: np.array(r["c"]).reshape(-1, max(1, r["dim"])) for r in found}


def _placed(cells: Broadcast) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cell = np.zeros(len(pdf), np.int32)
            for n, rows in pdf.groupby(pdf["embedding"].map(len)).indices.items():
                if n in cells.value and n:
                    x = np.stack([np.asarray(pdf["embedding"].iloc[i], np.float64) for i in rows])
                    cell[rows] = np.argmax(_directions(x)[1] @ cells.value[n].T, axis=1)
            yield pdf.assign(cell=cell)

    return run


def _shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """Candidates as arrays, and what a block must know of them: their mean direction, widest angle to it and greatest length."""
    pdf = pdf.sort_values("vec_id")
    x = scaled(list(pdf["embedding"]))
    length, d = _directions(x)
    mean = _directions(d.sum(axis=0)[None])[1][0]
    wide = float(np.arccos(np.clip((d @ mean).min(initial=1.0), -1, 1)))
    small = np.abs(x).max(initial=0) < 2**15
    blob = pickle.dumps((pdf["vec_id"].to_numpy(np.int64), pdf["label"].to_numpy(np.int64), x.astype(np.int16) if small else x))
    first = pdf.iloc[0]
    return pd.DataFrame({"dim": [x.shape[1]], "cell": [first["cell"]], "part": [first["part"]], "rows": [blob], "mean": [mean], "wide": [wide], "longest": [float(length.max(initial=0.0))]})


def _block(pdf: pd.DataFrame) -> pd.DataFrame:
    """Members as arrays with their clusters, and what each asks for: (member, positive_id, least, most, k-th score so far)."""
    pdf = pdf.sort_values("vec_id")
    x = scaled(list(pdf["embedding"]))
    length, d = _directions(x)
    c = centres(x, max(1, len(x) // CLUSTER))
    at = np.argmax(d @ c.T, axis=1)
    asks = [(m, a["positive_id"], a["least"], a["most"]) for m, each in enumerate(pdf["asks"]) for a in each]
    member, positive, least, most = (np.array(v, np.int64) for v in zip(*asks, strict=True))
    first = pdf.iloc[0]
    blob = pickle.dumps({"ids": pdf["vec_id"].to_numpy(np.int64), "labels": pdf["label"].to_numpy(np.int64), "x": x, "length": length, "c": c, "at": at, "member": member, "positive": positive, "least": least, "most": most, "kth": np.full(len(member), LEAST)})
    return pd.DataFrame({"dim": [x.shape[1]], "cell": [first["cell"]], "part": [first["part"]], "block": [blob]})


def walk(block: dict, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, k: int, same: bool) -> list[tuple[int, int, int]]:
    """(ask, vec_id, score): for each ask the best k of the candidates with its member's label (same), or with another, whose
    score lies within its band and is not below its k-th score so far."""
    x = x.astype(np.float64)
    length, d = _directions(x)
    out = []
    for cluster in range(len(block["c"])):
        members = np.flatnonzero(block["at"] == cluster)
        if not len(members):
            continue
        centre = block["c"][cluster]
        own = _directions(block["x"][members])[1]
        wide = np.arccos(np.clip((own @ centre).min(), -1, 1))
        bound = length * (np.cos(np.maximum(np.arccos(np.clip(d @ centre, -1, 1)) - wide, 0)) + SLACK)
        listed = np.argsort(-bound, kind="stable")
        bound = bound[listed]
        asks = {m: np.flatnonzero(block["member"] == m) for m in members}
        floors = {m: np.maximum(block["least"][on], block["kth"][on]).astype(np.float64) for m, on in asks.items()}
        best = {a: (np.empty(0, np.int64), np.empty(0, np.int64)) for on in asks.values() for a in on}
        at, step = 0, STEP
        while at < len(listed):  # the members that still look for something, together
            members = [m for m in members if block["length"][m] * bound[at] * (1 + 1e-12) + 1e-6 >= floors[m].min()]
            if not members:
                break
            rows = listed[at : at + step]
            at, step = at + step, step * 2
            scores = np.maximum(_dot(x[rows], block["x"][members]), LEAST).T
            for m, score in zip(members, scores, strict=True):
                floor = floors[m]
                fits = np.flatnonzero(score >= floor.min())
                fits = fits[((labels[rows[fits]] == block["labels"][m]) == same) & (ids[rows[fits]] != block["ids"][m])]
                if not len(fits):
                    continue
                score, found = score[fits], ids[rows[fits]]
                order = np.lexsort((found, -score))
                score, found = score[order], found[order]
                for j, a in enumerate(asks[m]):
                    low = np.searchsorted(-score, -block["most"][a], side="left")
                    high = np.searchsorted(-score, -max(block["least"][a], block["kth"][a]), side="right")
                    if low >= high:
                        continue
                    s, i = np.concatenate([best[a][0], score[low:high][:k]]), np.concatenate([best[a][1], found[low:high][:k]])
                    keep = np.lexsort((i, -s))[:k]
                    best[a] = s[keep], i[keep]
                    if len(keep) == k:
                        floor[j] = max(floor[j], s[keep][-1])
        out += [(a, int(i), int(s)) for a, (ss, ii) in best.items() for s, i in zip(ss, ii, strict=True)]
    return out


def _reached(block: dict, dim: int, home: int, told: dict) -> list[int]:
    """The shards in which a member could find what it asks for, the block's own left out."""
    need = np.full(len(block["ids"]), np.inf)
    np.minimum.at(need, block["member"], np.maximum(block["least"], block["kth"]).astype(np.float64))
    own, reached = _directions(block["x"])[1], []
    for shard, (n, mean, wide, longest) in told.items():
        if n == dim and shard != home:
            turn = np.arccos(np.clip(own @ mean, -1, 1)) - wide
            most = block["length"] * longest * (np.cos(np.maximum(turn, 0)) + SLACK)
            if (np.where(most < 0, 0, most) * (1 + 1e-12) + 1e-6 >= need).any():
                reached.append(shard)
    return reached


def _first_walk(k: int, same: bool, told: Broadcast | None) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """In the block's own shard: its hits, the block with the k-th scores found, and the shards to go on to (null: all of its length)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, blob, home, rows in zip(pdf["dim"], pdf["block"], pdf["home"], pdf["rows"], strict=True):
                block, hits = pickle.loads(blob), []
                if rows is not None:
                    found = walk(block, *pickle.loads(rows), k, same)
                    scores: dict[int, list[int]] = {}
                    for a, i, s in found:
                        scores.setdefault(a, []).append(s)
                        hits.append({"anchor_id": int(block["ids"][block["member"][a]]), "positive_id": int(block["positive"][a]), "vec_id": i, "score": s})
                    for a, s in scores.items():
                        if len(s) == k:
                            block["kth"][a] = min(s)
                reached = _reached(block, dim, home, told.value) if told else None
                yield pd.DataFrame({"dim": [dim], "home": [home], "block": [pickle.dumps(block)], "reached": [reached], "hits": [hits]})

    return run


def _next_walk(k: int, same: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, candidates = None, ()
        for pdf in batches:
            for shard, blob, rows in zip(pdf["shard"], pdf["block"], pdf["rows"], strict=True):
                if shard != now:
                    now, candidates = shard, pickle.loads(rows)
                block = pickle.loads(blob)
                found = walk(block, *candidates, k, same)
                hits = [(int(block["ids"][block["member"][a]]), int(block["positive"][a]), i, s) for a, i, s in found]
                yield pd.DataFrame(hits, columns=["anchor_id", "positive_id", "vec_id", "score"]).astype("int64")

    return run


def _parts(rows: DataFrame, size: int) -> DataFrame:
    """Rows of each vector length and cell in parts of about so many, by a hash of their id."""
    counts = rows.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("__n"))  # MOST_CELLS for each vector length
    of = F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("__n") / size).cast("long")).cast("int")
    return rows.join(F.broadcast(counts), ["dim", "cell"]).withColumn("part", of).drop("__n")


#: Shards whose summaries (a vector each) are sent to all tasks; beyond it, blocks go to every shard.
MOST_SUMMARIES = 50_000
#: Blocks of a file, and files that shards are written to, about: tasks are pairs of parts of both.
BLOCKS_A_FILE, FILES = 2, 64


def _searched(anchors: DataFrame, shards: DataFrame, k: int, same: bool) -> DataFrame:
    """anchor_id, positive_id, vec_id, score, rank: the best k candidates of each ask of the anchors (…, asks)."""
    spark = anchors.sparkSession
    blocks = _parts(anchors, BLOCK_ANCHORS).groupBy("dim", "cell", "part").applyInPandas(_block, "dim int, cell int, part int, block binary")
    near = shards.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("shard").alias("least"))
    home = F.col("least") + F.pmod("part", "n")  # shards of a cell are numbered one after the other
    blocks = blocks.join(near, ["dim", "cell"], "left").withColumn("home", F.coalesce(home, F.lit(-1).cast("long"))).drop("n", "least")
    # by file size shards or blocks look small enough for a broadcast, which their rows need not be
    at_home = blocks.join(shards.select(F.col("shard").alias("home"), "rows").hint("merge"), "home", "left")
    told = None
    if shards.count() <= MOST_SUMMARIES:
        summaries = shards.select("shard", "dim", "mean", "wide", "longest").collect()
        told = spark.sparkContext.broadcast({r["shard"]: (r["dim"], np.array(r["mean"]), r["wide"], r["longest"]) for r in summaries})
    schema = f"dim int, home long, block binary, reached array<long>, hits array<struct<{HITS.replace(' ', ':').replace(',:', ',')}>>"
    first = written(at_home.mapInPandas(_first_walk(k, same, told), schema), maxRecordsPerFile=BLOCKS_A_FILE)
    onward = first.select(F.col("dim").alias("__dim"), "home", "block", "reached")
    meets = (F.col("dim") == F.col("__dim")) & F.coalesce(F.array_contains("reached", F.col("shard")), F.col("shard") != F.col("home"))
    pairs = shards.select("dim", "shard", "rows").hint("shuffle_replicate_nl").join(onward, meets)
    more = pairs.select("shard", "rows", "block").mapInPandas(_next_walk(k, same), HITS)
    hits = first.select(F.inline("hits")).unionByName(more)
    best = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, least_percent: int = 30, most_percent: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors has vec_id, label (a whole number) and embedding; anchor is a condition on them. Scores are exact inner
    products of floor(256 x). An anchor's positives are its first other rows of the same label, its negatives for each
    positive the first rows of other labels whose score is between two shares of the positive's (none where that is
    below 0); higher scores come first, ties by smaller vec_id; fewer candidates give fewer rows. Rows with a null
    id, label or vector, or a null or non-finite component, take no part; only vectors of the anchor's length are
    compared. Of rows with one vec_id that with the least label and vector counts. An empty table gives no rows.
    """
    spark = prepare(vectors.sparkSession)
    whole = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    whole = whole & F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), F.lit(False)))
    told = vectors.filter(whole).select("vec_id", F.struct(F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce(anchor, F.lit(False)).alias("is_anchor")).alias("x"))
    points = told.groupBy("vec_id").agg(F.min("x").alias("x")).select("vec_id", "x.*")
    n = points.count()
    cells = spark.sparkContext.broadcast(_cells(points, n))
    points = written(points.mapInPandas(_placed(cells), POINT.replace("cell", "is_anchor boolean, cell")).withColumn("dim", F.size("embedding")))
    shards = _parts(points, SHARD_ROWS).groupBy("dim", "cell", "part").applyInPandas(_shard, "dim int, cell int, part int, rows binary, mean array<double>, wide double, longest double")
    shards = written(shards)
    number = shards.select("dim", "cell", "part").withColumn("shard", F.row_number().over(Window.orderBy("dim", "cell", "part")).cast("long") - 1)  # a row for each SHARD_ROWS vectors
    shards = written(shards.join(F.broadcast(number), ["dim", "cell", "part"]).drop("part"), maxRecordsPerFile=-(-n // (SHARD_ROWS * FILES)) or 1)

    ask = lambda positive, least, most: F.struct(positive.cast("long").alias("positive_id"), least.cast("long").alias("least"), most.cast("long").alias("most"))
    anchors = points.filter("is_anchor").drop("is_anchor")
    every = F.array(ask(F.lit(-1), F.lit(LEAST), F.lit(MOST)))
    found = written(_searched(anchors.withColumn("asks", every), shards, positives, same=True).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    wide = F.col("positive_score").cast("decimal(20,0)")
    least, most = F.ceil(wide * least_percent / 100), F.floor(wide * most_percent / 100)
    bands = found.filter("positive_score >= 0").groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_list(ask(F.col("positive_id"), least, most))).alias("asks"))
    mined = _searched(anchors.join(bands, "vec_id"), shards, negatives, same=False)
    rows = mined.withColumnRenamed("vec_id", "negative_id").withColumnRenamed("score", "negative_score").join(found, ["anchor_id", "positive_id"])
    return rows.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12(embeddings: DataFrame) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(embeddings.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)
