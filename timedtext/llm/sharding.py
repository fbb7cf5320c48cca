"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has a fixed number of places; a document's place comes from its doc_id, a shard stands at many places (its
virtual nodes) that depend on the shard alone. A document belongs to the next virtual node clockwise; where that shard
is full it goes on to the next whose shard is not. Capacities are the row count divided by the shards, rounded so that
shards differ by one row at most. Only counts per place reach the driver, so what it plans with is bounded by the ring
and not by the rows; the plan says which ranks of a place go to which shard and slot.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timedtext.llm.common import prepare, written

SHARDS, VIRTUAL_NODES = 16, 128
PLACES = 1 << 14
#: Parts in which the rows of one place are ranked.
SUBS = 64


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES, places: int = PLACES) -> list[tuple[int, int]]:
    """(place, shard) of every virtual node in clockwise order; a shard's places do not depend on the others."""
    at = lambda s, v: int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big") % places
    return sorted((at(s, v), s) for s in range(shards) for v in range(virtual_nodes))


def plan(counts: dict[int, int], shards: int, virtual_nodes: int = VIRTUAL_NODES, places: int = PLACES) -> list[tuple[int, int, int, int, int, int]]:
    """(place, home shard, first rank, last rank, shard, slot of the first rank): where the rows of each place go."""
    nodes, total = ring(shards, virtual_nodes, places), sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used, onward = [0] * shards, list(range(len(nodes)))

    def open_node(k: int) -> int:
        path = []
        while used[nodes[k][1]] >= room[nodes[k][1]]:
            path.append(k)
            k = onward[k] if onward[k] != k else (k + 1) % len(nodes)
        for x in path:
            onward[x] = k
        return k

    out, k = [], 0
    for place in sorted(counts):
        while k < len(nodes) and nodes[k][0] < place:
            k += 1
        home, done, at = k % len(nodes), 0, k % len(nodes)
        while done < counts[place]:
            at = open_node(at)
            s = nodes[at][1]
            n = min(counts[place] - done, room[s] - used[s])
            out.append((place, nodes[home][1], done, done + n - 1, s, used[s]))
            done, used[s] = done + n, used[s] + n
    return out


def shard(docs: DataFrame, shards: int = SHARDS, virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, home_shard, shard, slot.

    size is the text's UTF-8 bytes plus 1; null texts count as empty, null ids as one key. Repeated rows are separate
    rows of one place, told apart by rank; equal ones are interchangeable. Other columns are not read. Rows of one place
    are ranked in SUBS parts, equal rows as one, so a key that many rows share is no single task's work.
    """
    spark = prepare(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(PLACES)).cast("int").alias("place")
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), place)
    equal = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))
    equal = written(equal.withColumn("sub", F.pmod(F.xxhash64("text_crc32", "size"), F.lit(SUBS)).cast("int")))
    parts = equal.groupBy("place", "sub").agg(F.sum("n").alias("n"))
    counts = {r["place"]: r["n"] for r in parts.groupBy("place").agg(F.sum("n").alias("n")).collect()}  # PLACES rows at most
    goes = spark.createDataFrame(plan(counts, shards, virtual_nodes), "place int, home_shard int, lo long, hi long, shard int, base long")
    before = F.sum("n").over(Window.partitionBy("place").orderBy("sub")) - F.col("n")  # SUBS rows a place at most
    parts = parts.select("place", "sub", before.alias("before"))
    order = Window.partitionBy("place", "sub").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = equal.withColumn("first", F.sum("n").over(order) - F.col("n")).join(parts, ["place", "sub"])
    first = F.col("before") + F.col("first")
    rows = ranked.select("doc_id", "size", "text_crc32", F.col("place").alias("at"), F.explode(F.sequence(first, first + F.col("n") - 1)).alias("rank"))
    goes = F.broadcast(goes)  # a row per place and, at most, one more per shard that fills up
    out = rows.join(goes, (F.col("at") == F.col("place")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") <= F.col("hi")))
    return out.select("doc_id", "size", "text_crc32", "home_shard", "shard", (F.col("base") + F.col("rank") - F.col("lo")).alias("slot"))


def op2(docs: DataFrame) -> DataFrame:
    out = shard(docs)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard")
