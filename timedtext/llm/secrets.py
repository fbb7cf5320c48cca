"""Secret scans over a ledger of content-addressed blobs, with DataFrame functions only.

Every text version is known by its SHA-256. The ledger has a row for each (blob, rule, rule version) scanned so far;
a run scans one copy of each blob that lacks a row for some rule's present version, appends those rows, and joins the
findings of all present rule versions back to every row that holds the blob.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timedtext.llm.common import keyed, prepare, shared_folder, written


@dataclass(frozen=True)
class Rule:
    """Matches of pattern, leftmost first and without overlap; kept if the group has at least so many characters."""

    name: str
    version: int
    pattern: str
    group: int
    least: int
    #: Texts that lack all of these strings have no match.
    needs: tuple[str, ...] = ()


RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, (":", "=")),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 16, ("AKIA",)),
    # maximal runs, so asking for 32 in the pattern finds the same matches as filtering afterwards
    Rule("hex", 1, r"[0-9a-f]{32,}", 0, 32),
)
LEDGER = "blob string, rule string, version int, spans array<struct<start:int,end:int>>"
SPANS = "array<struct<start:int,end:int>>"
#: Matches summed at once, and code points of a text in one block when it is masked.
RUN, BLOCK = 256, 4096


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f's result reads it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _total(lengths: Column, first: Column, n: Column) -> Column:
    return F.aggregate(F.slice(lengths, first, n), F.lit(0), lambda s, x: s + x)


def _sums_before(lengths: Column) -> tuple[Callable[[Column, Column], Column], Column]:
    """(sum before a place, given the sums before runs; those sums): whole runs first, then the rest of the place's own."""
    runs = F.transform(F.sequence(F.lit(0), F.floor(F.size(lengths) / RUN).cast("int")), lambda k: _total(lengths, k * RUN + 1, F.lit(RUN)))
    at = _bound(runs, lambda u: F.transform(u, lambda _, k: _total(u, F.lit(1), k)))
    return lambda place, sums: F.get(sums, F.floor(place / RUN).cast("int")) + _total(lengths, place - place % RUN + 1, place % RUN), at


def spans_of(text: Column, rule: Rule) -> Column:
    """Code-point spans of a rule's matches: what stands between matches and the matches' lengths give the places.

    Patterns are run once a text, and places are summed by runs, so texts with very many matches stay cheap.
    """
    lengths = lambda xs: F.transform(xs, lambda x: F.length(x))
    every = lambda group: lengths(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(group)))
    cut = F.struct(every(0).alias("found"), every(rule.group).alias("value"), lengths(F.split(text, rule.pattern, -1)).alias("between"))

    def spans(c: Column) -> Column:
        steps = F.zip_with(F.slice(c["between"], 1, F.size(c["found"])), c["found"], lambda a, b: a + b)

        def placed(s: Column) -> Column:
            before, at = _sums_before(s)

            def one(n: Column, i: Column, r: Column) -> Column:
                start = before(i, r) + F.get(c["between"], i)
                return F.when(F.get(c["value"], i) >= rule.least, F.struct(start.cast("int").alias("start"), (start + n).cast("int").alias("end")))

            return _bound(at, lambda r: F.filter(F.transform(c["found"], lambda n, i: one(n, i, r)), lambda x: x.isNotNull()))

        return _bound(steps, placed)

    may = text.rlike(rule.pattern)
    for i, x in enumerate(rule.needs):
        some = F.contains(text, F.lit(x)) if i == 0 else some | F.contains(text, F.lit(x))
    return F.when((some & may) if rule.needs else may, _bound(cut, spans)).otherwise(F.array().cast(SPANS))


def scan_unseen(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> None:
    """Append to the ledger what it lacks for docs' texts under the present rule versions."""
    spark = docs.sparkSession
    spark.createDataFrame([], LEDGER).write.mode("append").parquet(ledger)
    seen = spark.read.schema(LEDGER).parquet(ledger)
    now = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")) for r in rules))
    blobs = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
    once = blobs.groupBy("blob").agg(F.first("text").alias("text"))
    if seen.isEmpty():
        due = once.withColumn("due", F.array(*(F.lit(r.name) for r in rules)))
    else:
        lacks = blobs.select("blob").distinct().select("blob", F.inline(now)).join(seen, ["blob", "rule", "version"], "left_anti")
        due = once.join(lacks.groupBy("blob").agg(F.collect_set("rule").alias("due")), "blob")
    scan = lambda r: F.when(F.array_contains("due", r.name), spans_of(F.col("text"), r))
    results = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"), scan(r).alias("spans")) for r in rules))
    due.select("blob", F.inline(results)).filter("spans is not null").write.mode("append").parquet(ledger)


def findings(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with spans added: array of (start, kind number from 0, end, kind), in that order; empty where nothing is found.

    Null texts count as empty. Repeated rows and copies share one scan. An own column named spans is replaced.
    Without a ledger path the run starts a new ledger in the shared folder.
    """
    spark = prepare(docs.sparkSession)
    ledger = ledger or shared_folder(spark)
    scan_unseen(docs, ledger, rules)
    rank = F.create_map(*(F.lit(x) for i, r in enumerate(rules) for x in (r.name, i)))
    present = F.create_map(*(F.lit(x) for r in rules for x in (r.name, r.version)))
    rows = spark.read.schema(LEDGER).parquet(ledger).filter((F.size("spans") > 0) & (F.col("version") == present[F.col("rule")]))
    rows = rows.select("blob", "rule", F.inline("spans")).select("blob", F.struct("start", rank[F.col("rule")].alias("rank"), "end", F.col("rule").alias("kind")).alias("x"))
    found = written(rows.groupBy("blob").agg(F.sort_array(F.collect_set("x")).alias("spans")))
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("spans", "__blob")]
    rows = docs.select(*kept, F.sha2(F.coalesce("text", F.lit("")), 256).alias("__blob"))
    out = keyed(rows, found.withColumnRenamed("blob", "__blob"), "__blob")
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    return out.select(*kept, F.coalesce("spans", empty).alias("spans"))


def _between(blocks: Column, start: Column, end: Column) -> Column:
    """Code points start to end (exclusive) of a text cut into blocks; reads only the blocks that hold them."""
    a, b = F.floor(start / BLOCK).cast("int"), F.floor((end - 1) / BLOCK).cast("int")
    read = F.array_join(F.slice(blocks, a + 1, b - a + 1), "")
    return F.when(end > start, F.substring(read, start - a * BLOCK + 1, end - start)).otherwise(F.lit(""))


def _ends_before(ends: Column) -> Callable[[Column, Column], Column]:
    """Greatest end before a place, given the greatest ends before each run of RUN places."""
    return lambda place, runs: F.greatest(F.lit(0), F.get(runs, F.floor(place / RUN).cast("int")), F.array_max(F.slice(ends, place - place % RUN + 1, place % RUN)))


def redacted(text: Column, spans: Column, mark: str = "[REDACTED]") -> Column:
    """The text with every span replaced by the mark; overlapping spans by one. Null stays null.

    spans are in order of their starts. What stands between them is cut from blocks of the text and joined once.
    """
    cut = F.struct(
        F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)).alias("blocks"),
        F.transform(spans, lambda s: s["start"]).alias("start"),
        F.transform(spans, lambda s: s["end"]).alias("end"),
        F.length(text).alias("n"),
    )

    def masked(c: Column) -> Column:
        before = _ends_before(c["end"])
        of_runs = F.transform(F.sequence(F.lit(0), F.floor(F.size(c["end"]) / RUN).cast("int")), lambda k: F.array_max(F.slice(c["end"], k * RUN + 1, F.lit(RUN))))
        runs = _bound(of_runs, lambda most: F.transform(most, lambda _, k: F.array_max(F.slice(most, F.lit(1), k))))

        def pieces(r: Column) -> Column:
            piece = lambda at, start: F.when(start >= at, F.concat(_between(c["blocks"], at, start), F.lit(mark))).otherwise(F.lit(""))
            return F.transform(c["start"], lambda start, i: _bound(before(i, r), lambda at: piece(at, start)))

        return F.concat(_bound(runs, lambda r: F.array_join(pieces(r), "")), _between(c["blocks"], F.array_max(c["end"]), c["n"]))

    return F.when(F.size(spans) > 0, _bound(cut, masked)).otherwise(text)


def op4(docs: DataFrame) -> DataFrame:
    found = findings(docs.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    line = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(line.cast("binary"), 256).alias("base_sha256"), line.alias("spans"))
