"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

Every source has a target number of words. Its documents all want target / size copies: the whole part is given to each,
and the fractions are rounded together, so that the words of a source end near its target and not only on average.
Two documents at a time, words of one's fraction go to the other, in a random direction that keeps both on average,
until one of them is none or a whole copy; the other goes on to the next pair. Documents of a source are dealt to leaves
of bounded size; what a leaf leaves over, one document, meets that of other leaves in a tree of as many levels as the
largest source needs. Long documents are what is left over, so a share of the small ones of each source waits for the
last: it meets all of them together. One small document remains in the end and is rounded alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timedtext.functions.folds import fold
from timedtext.llm.common import keyed, written

#: Most times that a document may be taken, and that a target may exceed its source's size.
MOST_COPIES = 3
#: Weights of the sources in their order, repeating.
WEIGHTS = (1, 2, 3)
#: Documents of a leaf on average, and left-over documents that meet in a node of the tree above.
LEAF, FAN = 256, 64
#: Leaves whose documents of no more than average size wait until the tree has ended.
RESERVE = 8
#: Sources from which their table is joined by shuffle and not broadcast (some 100 bytes each).
BROADCAST_SOURCES = 50_000
#: Equal rows that are written out as one block.
COPIES_BLOCK = 4096

SEED = 20240611


def words_in(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; null has none. No array of the words is made."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]++", "x")
    return F.length(F.translate(marked, " \t\n\x0b\x0c\r", "")).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """source, source_size, n, source_no, target of sources (source, source_size, n), of which there may be any number.

    In the order of their code points, null last, sources have the weights in turn and share the sum of all sizes by
    them; a target stops at most times its source's size, and what is above is shared again until none is above.
    """
    ordered = sources.orderBy(F.col("source").isNull(), "source").withColumn("__at", F.monotonically_increasing_id())
    ordered = written(ordered)  # the numbers hold for this order of partitions
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = ordered.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))  # a row for each partition
    rows = ordered.withColumn("__part", part).join(F.broadcast(before), "__part").withColumn("source_no", F.col("__before") + place)
    by_turn = F.array(*map(F.lit, weights))
    rows = written(rows.withColumn("weight", F.get(by_turn, F.pmod("source_no", F.lit(len(weights))).cast("int")).cast("long")).drop("__part", "__before", "__at"))

    cap = F.col("source_size") * most
    total, weight = rows.agg(F.sum("source_size"), F.sum("weight")).first()
    left, share, held = total or 0, weight or 0, -1
    above = F.lit(False)
    while share:
        wide = lambda c: c.cast("decimal(38,0)")
        above = wide(cap) * F.lit(share).cast("decimal(18,0)") < wide(F.col("weight")) * F.lit(left).cast("decimal(18,0)")
        full, n, rest = rows.agg(F.sum(F.when(above, cap)), F.count_if(above), F.sum(F.when(~above, F.col("weight")))).first()
        if n == held:
            break
        left, share, held = (total or 0) - (full or 0), rest or 0, n
    target = F.when(above, cap.cast("double")).otherwise(F.lit(float(left)) * F.col("weight") / F.lit(float(share or 1))) if share else cap.cast("double")
    return rows.select("source", "source_size", "n", "source_no", target.alias("target"))


def _chance(*of: Column) -> Column:
    """A number from 0 to below 1 that depends on the columns alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *of), 11).cast("double") * F.lit(2.0**-53)


ITEM = "struct<doc_id:{id},size:bigint,p:double,left_over:boolean>"


def _items(first: Column, kind: str) -> Column:
    """The rows of a group as items: those marked first, then by size, descending."""
    rows = F.sort_array(F.collect_list(F.struct(first.alias("first"), F.col("size").alias("s"), F.xxhash64("doc_id").alias("h"), "doc_id", "p")), asc=False)
    return F.transform(rows, lambda x: F.struct(x["doc_id"].alias("doc_id"), x["s"].alias("size"), x["p"].alias("p"), x["first"].alias("left_over")).cast(kind))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), where value is worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _given_to_small(items: Column, kind: str) -> Column:
    """items, whose first is what the tree has left over, if it has: that document meets all others together.

    It goes up with chance p and down else; what it takes or gives, the others share within the room that both ways
    leave them, so every chance holds on average. So the last document of a source is a small one.
    """
    first, rest = F.get(items, F.lit(0)), F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0)))
    size, p = first["size"].cast("double"), first["p"]

    def moved(room: Column) -> Column:
        words = F.least(room, size)
        up = _chance(F.lit("up"), first["doc_id"], first["size"], p) < p
        change = F.when(up, 1 - p).otherwise(-p)
        own = F.when(room >= size, F.when(up, 1.0).otherwise(0.0)).otherwise(p + change * words / size)

        def other(x: Column) -> Column:
            b, q = x["size"].cast("double"), x["p"]
            share = F.least(q * b / (1 - p), (1 - q) * b / p) * words / room
            return F.struct(x["doc_id"].alias("doc_id"), x["size"].alias("size"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), q - change * share / b)).alias("p"), F.lit(False).alias("left_over")).cast(kind)

        head = F.struct(first["doc_id"].alias("doc_id"), first["size"].alias("size"), own.alias("p"), F.lit(False).alias("left_over")).cast(kind)
        return F.concat(F.array(head), F.transform(rest, other))

    room = F.aggregate(rest, F.lit(0.0), lambda a, x: a + F.least(x["p"] * x["size"] / (1 - p), (1 - x["p"]) * x["size"] / p))
    fits = first["left_over"] & (p > 0) & (p < 1) & (F.size(rest) > 0)
    return F.when(fits, _let(room, moved)).otherwise(F.transform(items, lambda x: x.withField("left_over", F.lit(False)).cast(kind)))


def _rounded(items: Column, kind: str, level: int) -> Column:
    """Each item of an array (size descending) with p 0 or 1, but one, left over, whose p may lie between.

    The fold's state is the one document that is not settled yet; its p is 0 or 1 where both of a pair were settled at once.
    """
    none = F.lit(None).cast(kind)

    def step(acc: Column, x: Column) -> tuple[dict[str, Column], Column]:
        now = acc["held"]
        a, b, p, q = now["size"].cast("double"), x["size"].cast("double"), now["p"], x["p"]
        up = F.least((1 - p) * a, q * b)  # words that can go from x to now, and from now to x
        down = F.least(p * a, (1 - q) * b)
        to_now = _chance(F.lit(level), now["doc_id"], now["size"], now["p"], x["doc_id"], x["size"], x["p"]) * (up + down) < down
        now_full, x_empty = (1 - p) * a <= q * b, q * b <= (1 - p) * a
        now_empty, x_full = p * a <= (1 - q) * b, (1 - q) * b <= p * a
        p2 = F.when(to_now, F.when(now_full, 1.0).otherwise(p + up / a)).otherwise(F.when(now_empty, 0.0).otherwise(p - down / a))
        q2 = F.when(to_now, F.when(x_empty, 0.0).otherwise(q - up / b)).otherwise(F.when(x_full, 1.0).otherwise(q + down / b))
        settled = F.when(to_now, now_full).otherwise(now_empty)

        def item(of: Column, chance: Column) -> Column:
            return F.struct(of["doc_id"].alias("doc_id"), of["size"].alias("size"), chance.alias("p"), F.lit(False).alias("left_over")).cast(kind)

        before = (p <= 0) | (p >= 1)  # now was settled together with an earlier one: it goes out as it is
        out = F.when(x.isNull(), now.withField("left_over", F.lit(True)).cast(kind)).when(now.isNull(), none).when(before, now).when(settled, item(now, p2)).otherwise(item(x, q2))
        go_on = F.when(x.isNull() | now.isNull() | before, x).when(settled, item(x, q2)).otherwise(item(now, p2))
        return {"held": go_on.cast(kind)}, out

    ended = F.concat(items, F.array(none))  # at the end the one that is not settled goes out too
    return F.filter(fold(ended, {"held": none}, kind, step), lambda x: x.isNotNull())


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, size: Column | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies of every row: how often it goes into the mix.

    documents has doc_id, source, and text (or a size column of non-negative whole numbers is given). Copies are the
    whole part of target / source size, or one more, and taken is size times copies; a source's taken words differ from
    its target by about a small document. The same rows give the same copies, in any order or
    partitioning. A null text has no words; rows without words have taken 0, and so has every row of a source without
    words (target 0). A null source is one of its own, last in order. Null, equal and repeated doc_ids are no matter: equal rows
    (doc_id, source, size) are counted, rounded together and written out again, so that no key is one task's work.
    An empty table gives no rows. Other columns are left alone and not returned.
    """
    size = words_in(F.col("text")) if size is None else size.cast("long")
    docs = documents.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = written(docs.groupBy("source", "size", "doc_id").agg(F.count(F.lit(1)).alias("m")))
    sums = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count(F.lit(1)).alias("n"))
    table = written(targets(sums, weights, most))
    n_sources, largest, most_equal = table.count(), table.agg(F.max("n")).first()[0] or 0, rows.agg(F.max("m")).first()[0] or 0

    table = table.withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))  # a null source is joined too
    rows = rows.withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))).drop("source")
    told = ["source_size", "n", "source_no", "target"]
    if n_sources <= BROADCAST_SOURCES:
        rows = rows.join(F.broadcast(table.select("key", *told)), "key").drop("key")
    else:
        rows = keyed(rows, table.select("key", *told), "key", how="inner").drop("key")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    base = F.least(F.floor(each), F.lit(most)).cast("int")
    p = F.when((base >= most) | (F.col("size") == 0), 0.0).otherwise(each - base)
    # of m equal rows the fractions settle among themselves, but for one
    whole = F.floor(F.col("p") * F.col("m")).cast("long")
    rest = F.when(F.col("p") * F.col("m") > whole, F.col("p") * F.col("m") - whole).otherwise(0.0)
    rows = rows.withColumns({"base": base, "p": p}).withColumns({"whole": whole, "rest": rest})
    rows = rows.withColumn("open", (F.col("rest") > 0).cast("int"))
    given = ["doc_id", "size", "source_no"]
    settled = rows.select(*given, F.explode(F.array(F.struct(F.lit(1).alias("more"), F.col("whole").alias("m")), F.struct(F.lit(0).alias("more"), (F.col("m") - F.col("whole") - F.col("open")).alias("m")))).alias("x"))
    settled = settled.select(*given, F.col("x.more").alias("more"), F.col("x.m").alias("m")).filter("m > 0")

    # the tree: leaves by a hash, then the left-over documents of FAN nodes each; a share of the small documents waits for its end
    leaves = F.ceil(F.col("n") / LEAF).cast("long")
    todo = rows.filter("open = 1").withColumn("node", F.pmod(F.xxhash64("doc_id", "size"), leaves))
    small = (F.col("node") < RESERVE) & (F.col("size") <= F.col("source_size") / F.col("n"))
    todo = todo.select(*given, F.col("rest").alias("p"), "node", small.alias("waits"))
    waiting = todo.filter("waits").select(*given, "p", F.lit(False).alias("first"))
    todo, level, width = todo.filter("not waits"), 0, -(-largest // LEAF)
    done = [settled.select(*given, "more", "m")]
    kind = ITEM.format(id=id_type)
    while True:
        nodes = todo.groupBy("source_no", "node").agg(_items(F.lit(False), kind).alias("items"))
        out = written(nodes.select("source_no", "node", F.explode(_rounded(F.col("items"), kind, level)).alias("x")).select("source_no", "node", "x.*"))
        done.append(out.filter("not left_over").select(*given, (F.col("p") > 0.5).cast("int").alias("more"), F.lit(1).cast("long").alias("m")))
        if width <= 1:
            break
        todo = out.filter("left_over").select(*given, "p", F.floor(F.col("node") / FAN).alias("node"))
        level, width = level + 1, -(-width // FAN)
    ends = out.filter("left_over").select(*given, "p", F.lit(True).alias("first")).unionByName(waiting)
    ends = ends.groupBy("source_no").agg(_items(F.col("first"), kind).alias("items"))
    out = written(ends.select("source_no", F.explode(_rounded(_given_to_small(F.col("items"), kind), kind, -1)).alias("x")).select("source_no", "x.*"))
    last = _chance(F.lit("last"), F.col("source_no"), F.col("doc_id"), F.col("size")) < F.col("p")
    more = F.when(F.col("left_over"), last).otherwise(F.col("p") > 0.5)
    done.append(out.select(*given, more.cast("int").alias("more"), F.lit(1).cast("long").alias("m")))

    every = done[0]
    for part in done[1:]:
        every = every.unionByName(part)
    # equal rows are written out in blocks
    blocks = F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / COPIES_BLOCK)), lambda k: F.least(F.lit(COPIES_BLOCK).cast("long"), F.col("m") - k * COPIES_BLOCK))
    every = every.withColumn("m", F.explode(blocks))
    if most_equal > 64 * COPIES_BLOCK:  # then one task's rows may be most of all
        every = every.repartition(F.rand(SEED))
    every = every.withColumn("__k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m")))).drop("__k", "m")
    told = table.select("source_no", "source_size", "target", base.alias("base"))
    if n_sources <= BROADCAST_SOURCES:
        every = every.join(F.broadcast(told), "source_no")
    else:
        every = keyed(every, told, "source_no", how="inner")
    copies = F.when(F.col("size") > 0, F.col("base") + F.col("more")).otherwise(F.col("base"))
    return every.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"), copies.cast("int").alias("copies"))


def op11(documents: DataFrame) -> DataFrame:
    return mix(documents)
