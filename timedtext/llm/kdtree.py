"""Exact top-k inner products by a KD-tree per shard.

Vectors are dealt to shards of bounded size by a hash of their id. Each shard's tree splits at medians of the widest
side and keeps a tight bounding box per node. The queries of a block go through a tree together, each with its best box
first: the largest inner product that any point of a box could have bounds what is in it, and boxes below a query's k-th
best score so far are left out for it.
Queries travel in blocks; a block first searches one shard, and the k-th scores found there go with it to all others.
Blocks and trees meet as pairs of file parts that a task reads, so neither is copied for each of the others by a shuffle
or a broadcast.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timedtext.llm.common import prepare, written

SHARD_ROWS, BLOCK_QUERIES, LEAF = 8192, 512, 128
#: Blocks that meet a shard's tree together after their first search, so that it is sent once for all of them.
TOGETHER = 8
#: Files that trees are written to, about: tasks are pairs of parts of theirs and of the blocks'.
FILES = 64
SCALE = 256
HITS = "query_id long, vec_id long, score long"


def scaled(vectors: list, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) as whole doubles, kept within what a long holds."""
    return np.clip(np.floor(np.stack([np.asarray(v, np.float64) for v in vectors]) * scale), -(2.0**62), 2.0**62)


def build(ids: np.ndarray, x: np.ndarray, leaf: int = LEAF) -> dict:
    """Nodes in arrays: box corners, range of rows, children (-1 for a leaf). Rows are put in node order."""
    order, nodes, todo = np.arange(len(ids)), [], [(0, len(ids), -1)]
    lo, hi, kids = [], [], []
    while todo:
        a, b, parent = todo.pop()
        part = x[order[a:b]]
        k = len(nodes)
        nodes.append((a, b))
        lo.append(part.min(axis=0))
        hi.append(part.max(axis=0))
        kids.append([-1, -1])
        if parent >= 0:
            kids[parent][0 if kids[parent][0] < 0 else 1] = k
        side = int(np.argmax(hi[k] - lo[k])) if x.shape[1] else 0
        if b - a > leaf and hi[k][side] > lo[k][side]:  # else all are equal: one leaf, however many
            mid = (a + b) // 2
            order[a:b] = order[a:b][np.argpartition(part[:, side], mid - a)]
            todo += [(a, mid, k), (mid, b, k)]
    x = x[order]
    small = np.abs(x).max(initial=0) < 2**15
    return {"ids": ids[order], "x": x.astype(np.int16) if small else x, "lo": np.array(lo), "hi": np.array(hi), "span": np.array(nodes), "kids": np.array(kids)}


def _dot(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products with one vector, or with each of several (a column each); Python integers where doubles could round."""
    if np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * max(1, x.shape[1]) < 2.0**53:
        return (x @ q.T).astype(np.int64)
    if q.ndim == 2:
        return np.stack([_dot(x, one) for one in q], axis=1)
    whole = [sum(int(a) * int(b) for a, b in zip(row, q, strict=True)) for row in x]
    return np.array([max(min(v, 2**63 - 1), -(2**63)) for v in whole], np.int64)


class _Best:
    """The k best hits of each query, and the score that others have to reach."""

    def __init__(self, kth: np.ndarray, k: int):
        self.score, self.vec, self.has = np.zeros((len(kth), k), np.int64), np.zeros((len(kth), k), np.int64), np.zeros((len(kth), k), bool)
        self.least = np.array(kth, np.float64)

    def add(self, at: np.ndarray, score: np.ndarray, vec: np.ndarray, own: np.ndarray) -> None:
        """Scores of the queries at (rows) with the vectors vec (columns)."""
        fits = (score >= self.least[at][:, None]) & (vec[None] != own[at][:, None])
        rows, columns = fits.any(axis=1), fits.any(axis=0)
        at, fits, score = at[rows], fits[np.ix_(rows, columns)], score[np.ix_(rows, columns)]
        if not len(at):
            return
        has = np.concatenate([self.has[at], fits], axis=1)
        score = np.concatenate([self.score[at], score], axis=1)
        vec = np.concatenate([self.vec[at], np.broadcast_to(vec[columns], fits.shape)], axis=1)
        first = np.lexsort((vec, ~score, ~has), axis=-1)[:, : self.has.shape[1]]  # ~ turns the order of whole numbers round
        self.has[at], self.score[at], self.vec[at] = (np.take_along_axis(v, first, axis=1) for v in (has, score, vec))
        full = self.has[at].all(axis=1)
        self.least[at[full]] = np.maximum(self.least[at[full]], self.score[at[full], -1])


def search(tree: dict, query_ids: np.ndarray, queries: np.ndarray, kth: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
    """Per query the best (score, -vec_id), at most k, of those that reach its kth score; the query's own id is left out.

    Queries go down the tree together: first each to the leaf of its best box, then all from the root to those nodes
    whose box still has something for them, the node that more of them want first.
    """
    x, own = tree["x"].astype(np.float64), np.asarray(query_ids)
    with np.errstate(over="ignore"):
        bounds = np.maximum(queries, 0) @ tree["hi"].T + np.minimum(queries, 0) @ tree["lo"].T
        bounds = bounds + np.abs(queries) @ np.maximum(np.abs(tree["hi"]), np.abs(tree["lo"])).T * 1e-12
    best, leaves = _Best(kth, k), np.flatnonzero(tree["kids"][:, 0] < 0)

    def look(leaf: int, at: np.ndarray) -> None:
        a, z = tree["span"][leaf]
        best.add(at, _dot(x[a:z], queries[at]).T, tree["ids"][a:z], own)

    home = leaves[np.argmax(bounds[:, leaves], axis=1)]
    for leaf in np.unique(home):
        at = np.flatnonzero((home == leaf) & (bounds[:, leaf] >= best.least))
        if len(at):
            look(leaf, at)
    todo = [(0, np.arange(len(own)))]
    while todo:
        node, at = todo.pop()
        at = at[bounds[at, node] >= best.least[at]]
        left, right = tree["kids"][node]
        if left < 0:
            at = at[home[at] != node]
            if len(at):
                look(node, at)
        elif len(at):
            todo += [(right, at), (left, at)] if bounds[at, left].sum() >= bounds[at, right].sum() else [(left, at), (right, at)]
    return [[(int(s), -int(v)) for s, v, h in zip(*row, strict=True) if h] for row in zip(best.score, best.vec, best.has, strict=True)]


def _trees(pdf: pd.DataFrame) -> pd.DataFrame:
    """One tree for each vector length of the shard."""
    out: dict[int, dict] = {}
    for n, part in pdf.sort_values("vec_id").groupby(pdf["embedding"].map(len)):
        out[int(n)] = build(part["vec_id"].to_numpy(np.int64), scaled(list(part["embedding"])))
    return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "trees": [pickle.dumps(out)]})


def _found(trees: dict, ids: np.ndarray, vectors: list, kth: np.ndarray, skip: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
    lengths, best = np.array([len(v) for v in vectors]), [[] for _ in ids]
    for n in trees.keys() & set(lengths.tolist()):
        at = np.flatnonzero((lengths == n) & ~skip)
        if len(at):
            for i, hits in zip(at, search(trees[n], ids[at], scaled([vectors[i] for i in at]), kth[at], k), strict=True):
                best[i] = hits
    return best


def _first_searched(k: int):
    """Of each block in its home shard: the hits, and the k-th score of each query (or minus infinity)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for block, shard, blob, ids, vectors in zip(pdf["block"], pdf["shard"], pdf["trees"], pdf["ids"], pdf["vectors"], strict=True):
                ids = np.asarray(ids, np.int64)
                best = _found(pickle.loads(blob), ids, vectors, np.full(len(ids), -np.inf), np.zeros(len(ids), bool), k)
                hits = [{"query_id": int(q), "vec_id": -v, "score": s} for q, b in zip(ids, best, strict=True) for s, v in b]
                kth = [float(b[-1][0]) if len(b) == k else -np.inf for b in best]
                yield pd.DataFrame({"block": [block], "ids": [ids], "vectors": [vectors], "homes": [np.full(len(ids), shard)], "kth": [kth], "hits": [hits]})

    return run


def _searched(k: int):
    """Hits of the blocks' queries in a shard that is not their home."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, trees = None, {}
        for pdf in batches:
            for shard, blob, ids, vectors, homes, kth in zip(pdf["shard"], pdf["trees"], pdf["ids"], pdf["vectors"], pdf["homes"], pdf["kth"], strict=True):
                if shard != now:
                    now, trees = shard, pickle.loads(blob)
                ids = np.asarray(ids, np.int64)
                best = _found(trees, ids, vectors, np.asarray(kth, np.float64), np.asarray(homes) == shard, k)
                rows = [(int(q), -v, s) for q, b in zip(ids, best, strict=True) for s, v in b]
                yield pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best inner products among vectors but its own id.

    Both frames have vec_id and embedding. Rows with a null id, or a vector that is null or holds null or non-finite
    components, take no part; only vectors of the query's length are compared. Ties go to the smaller vec_id; of rows
    with one vec_id that with the least vector counts. Fewer than k candidates give fewer rows.
    """
    spark = prepare(vectors.sparkSession)
    whole = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), F.lit(False)))
    # of rows with one vec_id the least vector counts, as a query and as a candidate
    ready = lambda df: df.filter(whole).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    points = ready(vectors).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = ready(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    shards = max(1, -(-points.count() // SHARD_ROWS))
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    keyed = points.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)))
    trees = written(keyed.groupBy("shard").applyInPandas(_trees, "shard long, trees binary"), maxRecordsPerFile=-(-shards // FILES))
    asked = asked.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block")).agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias("x"))
    asked = asked.select("block", F.col("x.vec_id").alias("ids"), F.col("x.embedding").alias("vectors"))
    at_home = asked.withColumn("shard", F.pmod("block", F.lit(shards)))
    schema = "block long, ids array<long>, vectors array<array<double>>, homes array<long>, kth array<double>, hits array<struct<query_id:long,vec_id:long,score:long>>"
    # by file size trees or blocks look small enough for a broadcast, which their rows need not be
    first = written(at_home.join(trees.hint("merge"), "shard").mapInPandas(_first_searched(k), schema))
    parts = (F.flatten(F.collect_list(c)).alias(c) for c in ("ids", "vectors", "homes", "kth"))
    onward = written(first.groupBy(F.floor(F.col("block") / TOGETHER).alias("group")).agg(*parts).drop("group"), maxRecordsPerFile=1)
    more = trees.hint("shuffle_replicate_nl").crossJoin(onward).mapInPandas(_searched(k), HITS)
    hits = first.select(F.inline("hits")).unionByName(more)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1(embeddings: DataFrame) -> DataFrame:
    return top_k(embeddings, embeddings.filter("vec_id % 50 = 0"))
