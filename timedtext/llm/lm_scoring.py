"""Language-model scores of texts by a causal self-attention network on subword ids.

A text is its words (A-Z lower-cased, parted by ASCII white space), each as subword ids, and an end; its score is the
log probability that the network gives to all of them. The network (attention.py) has ids of its own for the subwords
that are commonest in all training texts; the others share one id, and their part of it follows from their counts.

What is learnt comes from the whole corpus: counts of words and of subword ids, and the network's tables. Some texts
only give the network a place to start from; then every partition goes on from there over all of its training texts,
and the averages of their tables, weighted by windows, are the model.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timedtext.llm.attention import END, IDS, OTHER, SIDE, Network, windows
from timedtext.llm.common import id_bucket, prepare, text_bytes, written
from timedtext.llm.packing import encoder
from timedtext.llm.words import SPACED, Words, blocks, words_of

#: Training texts that the network starts from (those with the least hashed ids), its steps of gradient descent and their rate.
SAMPLE, STEPS, RATE = 1500, 1100, 0.02
#: One of so many training texts is learnt from after that, in its partition, at this rate (1: all of them).
SHARE, SHARE_RATE = 1, 0.01
#: Models averaged in one task.
FAN_IN = 64
#: Words in the table that is broadcast; counts of all others are joined by shuffle.
FREQUENT = 1 << 18
CHUNK = 1 << 21
#: Bytes of the texts that share a row of the spelled table, its rows that are read at once, and bytes of them that go to Python at once.
BLOCK, GROUP, SENT = 1 << 19, 8, 4 << 20
#: Spellings that a worker remembers at most.
REMEMBERED = 1 << 19
#: For Python workers: arrays of a step of learning are taken from the heap again, not from new pages each time.
ALLOCATION = {"MALLOC_MMAP_THRESHOLD_": str(32 << 20), "MALLOC_TRIM_THRESHOLD_": str(64 << 20)}
LN10 = float(np.log(10))
BEYOND_ASCII_SPACE = re.compile(r"[^\S\x00-\x7f]")

_state: dict[str, tuple] = {}
_spellers: dict[str, Speller] = {}


def lowered(data: bytes) -> bytes:
    return data.lower()  # of bytes: A-Z only


def id_lengths(ranks: str) -> np.ndarray:
    """Bytes of each subword id of a rank file."""
    values = encoder(ranks)._mergeable_ranks
    out = np.zeros(max(values.values()) + 1, np.int64)
    for token, k in values.items():
        out[k] = len(token)
    return out


class Speller:
    """Subword ids of words, each as it stands behind a space; remembered by the words' hashes."""

    def __init__(self, ranks: str):
        self.encoder, self.lengths = encoder(ranks), id_lengths(ranks)
        self.forget()

    def forget(self) -> None:
        self.slots: dict[int, int] = {}
        self.ids, self.first, self.count = np.zeros(0, np.uint16), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, and how many each has."""
        text = (b" " + b" ".join(words)).decode()
        if len(words) > 1 and BEYOND_ASCII_SPACE.search(text):  # such white space can join words to one run
            each = [self._encoded([w]) for w in words]
            return np.concatenate([i for i, _ in each]), np.concatenate([n for _, n in each])
        ids = self.encoder.encode_to_numpy(text, disallowed_special=())
        starts = np.cumsum([0, *(len(w) + 1 for w in words)])
        n = self.lengths[ids]
        of = np.searchsorted(starts, np.cumsum(n) - n, side="right") - 1
        return ids.astype(np.uint16), np.bincount(of, minlength=len(words))

    def spell(self, texts: list[bytes], w: Words) -> Spelled:
        """All words in w, of the lower-cased texts."""
        if len(self.slots) > REMEMBERED:
            self.forget()
        distinct, inverse = np.unique(w.hash, return_inverse=True)
        at = np.empty(len(distinct), np.int64)
        at[inverse] = np.arange(len(inverse))  # one of the places of each
        hashes = distinct.tolist()
        slot = np.fromiter((self.slots.get(h, -1) for h in hashes), np.int64, len(hashes))
        new = np.flatnonzero(slot < 0)
        if len(new):
            buf = b"\n" + b"\n".join(texts) + b"\n"
            ids, count = self._encoded([buf[a:b] for a, b in zip(w.start[at[new]].tolist(), w.end[at[new]].tolist(), strict=True)])
            slot[new] = np.arange(len(self.count), len(self.count) + len(new))
            self.slots.update(zip(distinct[new].tolist(), slot[new].tolist(), strict=True))
            self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(count) - count])
            self.count, self.ids = np.concatenate([self.count, count]), np.concatenate([self.ids, ids])
        n = self.count[slot]
        return Spelled(np.diff(w.first), inverse, distinct, n, self.ids[_runs(self.first[slot], n)])


def _runs(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Places of runs that begin at first and are n long, one behind the other."""
    return np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)


@dataclass
class Spelled:
    """Words of some texts: how many each text has, where each stands among the distinct words, their hashes, and their subword ids."""

    n_words: np.ndarray
    at: np.ndarray
    hash: np.ndarray
    n_ids: np.ndarray
    ids: np.ndarray

    KINDS = {"n_words": np.uint32, "at": None, "hash": np.uint64, "n_ids": np.uint32, "ids": np.uint16}

    def packed(self) -> dict[str, bytes]:
        short = np.uint16 if len(self.hash) <= 1 << 16 else np.uint32
        return {c: getattr(self, c).astype(kind or short).tobytes() for c, kind in self.KINDS.items()}

    @classmethod
    def unpacked(cls, cells: dict[str, bytes]) -> Spelled:
        of = {c: np.frombuffer(cells[c], k) for c, k in cls.KINDS.items() if k}
        of["at"] = np.frombuffer(cells["at"], np.uint16 if len(of["hash"]) <= 1 << 16 else np.uint32)
        return cls(**{c: v if c in ("hash", "ids") else v.astype(np.int64) for c, v in of.items()})

    def of_text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n_words)), self.n_words)

    def only(self, keep: np.ndarray) -> Spelled:
        """The same without the words of other texts."""
        return self if keep.all() else Spelled(self.n_words[keep], self.at[np.repeat(keep, self.n_words)], self.hash, self.n_ids, self.ids)

    def sums(self, by_word: np.ndarray) -> np.ndarray:
        """Sums by text of what each distinct word has."""
        return np.bincount(self.of_text(), weights=by_word[self.at], minlength=len(self.n_words))

    def sequences(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The network's ids of all texts, each with its end, and their number by text."""
        n = self.n_ids[self.at]
        by_text = np.bincount(self.of_text(), weights=n, minlength=len(self.n_words)).astype(np.int64)
        out = np.full(int(by_text.sum()) + len(by_text), END, np.int64)
        out[_runs(np.cumsum(by_text + 1) - (by_text + 1), by_text)] = place[self.ids][_runs((np.cumsum(self.n_ids) - self.n_ids)[self.at], n)]
        return out, by_text + 1


def spelled(texts: list[bytes], ranks: str) -> Spelled:
    """Of lower-cased texts."""
    return speller(ranks).spell(texts, words_of(texts, SPACED))


def speller(ranks: str) -> Speller:
    if ranks not in _spellers:
        _spellers[ranks] = Speller(ranks)
    return _spellers[ranks]


def text_log_p(net: Network, of: Spelled, place: np.ndarray, tail: np.ndarray, at_once: int = 512) -> np.ndarray:
    """log10 probability of each text; tail has the log probability of each id among those without one of their own."""
    x, text = windows(*of.sequences(place))
    sums = np.concatenate([*(net.log_p(x[k : k + at_once]).sum(axis=1) for k in range(0, len(x), at_once)), np.zeros(0)])
    total = np.bincount(text, weights=sums, minlength=len(of.n_words))
    rare = np.where(place[of.ids] == OTHER, tail[of.ids], 0)
    return (total + of.sums(np.bincount(np.repeat(np.arange(len(of.n_ids)), of.n_ids), weights=rare, minlength=len(of.n_ids)))) / LN10


def vocabulary(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each subword id among the network's ids by counts, and log probability of each id among the rest."""
    place, rest = np.full(len(counts), OTHER, np.int64), counts + 1.0
    frequent = np.argsort(-counts, kind="stable")[:OTHER]
    place[frequent], rest[frequent] = np.arange(len(frequent)), 0
    return place, np.log(np.where(rest > 0, rest, 1) / max(1.0, rest.sum()))


def _windows_of(texts: list[bytes], place: np.ndarray, ranks: str) -> Iterator[np.ndarray]:
    texts = [lowered(t) for t in texts]
    return (windows(*spelled(texts[a:b], ranks).sequences(place))[0] for a, b in blocks(texts))


#: A row of the spelled table: some texts, their words, and whether each is held out, counted only, or learnt from as well.
HELD_OUT, COUNTED, LEARNT = range(3)
SPELLED = {"doc_id": pa.list_(pa.int64()), "uses": pa.binary()} | {c: pa.binary() for c in Spelled.KINDS}
SPELLED_SCHEMA = "doc_id array<long>, uses binary, " + ", ".join(f"{c} binary" for c in Spelled.KINDS)


def _spelled(ranks: str):
    """Texts (doc_id, bytes, uses) as rows of the spelled table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, uses = batch.column("doc_id").to_pylist(), np.array(batch.column("uses").to_pylist(), np.uint8)
            texts = [lowered(t) for t in batch.column("bytes").to_pylist()]
            for a, b in blocks(texts, BLOCK):
                cells = {"doc_id": docs[a:b], "uses": uses[a:b].tobytes()} | spelled(texts[a:b], ranks).packed()
                yield pa.RecordBatch.from_arrays([pa.array([cells[c]], t) for c, t in SPELLED.items()], names=list(SPELLED))

    return run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, Spelled]]:
    """doc_id, uses and words of each row of the spelled table."""
    for batch in batches:
        for k in range(batch.num_rows):
            cells = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
            yield cells.get("doc_id"), np.frombuffer(cells.get("uses", b""), np.uint8), Spelled.unpacked(cells)


def started(counts: np.ndarray, ends: int, place: np.ndarray) -> Network:
    """A network whose output biases are the logarithms of the ids' shares."""
    share = np.bincount(place, weights=counts, minlength=IDS) + 0.1
    share[END] += ends
    share, net = share.reshape(SIDE, SIDE), Network()
    net.p["bc"] = np.log(share.sum(1) / share.sum()).astype(np.float32)
    net.p["bm"] = np.log(share / share.sum(1, keepdims=True)).astype(np.float32)
    return net


def packed(net: Network) -> bytes:
    return b"".join(net.p[k].astype(np.float32).tobytes() for k in Network.NAMES)


def unpacked(data: bytes) -> Network:
    like, flat, at, out = Network().p, np.frombuffer(data, np.float32), 0, {}
    for k in Network.NAMES:
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).copy()
        at += like[k].size
    return Network(values=out)


def _learnt(model, ranks: str, steps: int | None, rate: float):
    """Go on from the model: so many steps over the partition's texts, which then are few, or else once through its rows of the spelled table as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, place = unpacked(model.value["net"]), model.value["place"]
        if steps is None:
            n = net.train_once((windows(*of.only(uses == LEARNT).sequences(place))[0] for _, uses, of in _rows(batches)), rate)
        else:
            parts = list(_windows_of(sorted(t for b in batches for t in b.column("bytes").to_pylist()), place, ranks))
            n = sum(map(len, parts))
            if n:
                net.train(np.concatenate(parts), steps, rate)
        if n:
            cells = [[TaskContext.get().partitionId()], [float(n)], [packed(net)]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.int64(), pa.float64(), pa.binary()), strict=True)], names=["part", "weight", "data"])

    return run


MODELS = "part long, weight double, data binary"


def _averaged(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(w * np.frombuffer(d, np.float32).astype(np.float64) for w, d in zip(pdf["weight"], pdf["data"], strict=True))
    weight = float(pdf["weight"].sum())
    return pd.DataFrame({"part": [int(pdf["part"].min()) // FAN_IN], "weight": [weight], "data": [(total / weight).astype(np.float32).tobytes()]})


def averaged(models: DataFrame) -> bytes | None:
    """The mean of the models by weight, FAN_IN at a time: no task and not the driver sees more than that."""
    while True:
        models = written(models)
        top = models.agg(F.max("part")).first()[0]
        if top is None:
            return None
        if top == 0:
            return bytes(models.first()["data"])
        models = models.groupBy(F.floor(F.col("part") / FAN_IN)).applyInPandas(_averaged, MODELS)


def trained(learn: DataFrame, table: DataFrame, counts: np.ndarray, ends: int, ranks: str, sample: int) -> tuple[Network, np.ndarray, np.ndarray]:
    """The network, and vocabulary(): from the counts of all training texts, a start, and then what the spelled table says is learnt from."""
    spark = learn.sparkSession
    place, tail = vocabulary(counts)
    model = {"net": packed(started(counts, ends, place)), "place": place}
    given = learn.withColumn("key", F.xxhash64("doc_id"))
    keys = given.filter("doc_id is not null").select("doc_id", "key").distinct().orderBy("key", "doc_id").limit(sample).select("doc_id")
    first = given.join(F.broadcast(keys), "doc_id").groupBy("doc_id").agg(F.min("bytes").alias("bytes"))  # a row an id: bounded by the sample
    start = first.select("bytes").repartition(1).mapInArrow(_learnt(spark.sparkContext.broadcast(model), ranks, STEPS, RATE), MODELS)
    model["net"] = averaged(start) or model["net"]
    files = max(1, len(table.inputFiles()))  # as many models as parts of the texts, however the table is split again
    model["net"] = averaged(table.drop("doc_id").coalesce(files).mapInArrow(_learnt(spark.sparkContext.broadcast(dict(model)), ranks, None, SHARE_RATE), MODELS)) or model["net"]
    return unpacked(model["net"]), place, tail


def _counted(n_ids: int):
    """(word, count) and (subword id, count), told apart by spelled, of the training texts in a partition of the spelled table: some million words at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, ids = [], 0, np.zeros(n_ids, np.int64)

        def flush() -> pa.RecordBatch:
            word, at = np.unique(np.concatenate([*(h for h, _ in held), np.zeros(0, np.uint64)]), return_inverse=True)
            count = np.bincount(at, weights=np.concatenate([*(c for _, c in held), np.zeros(0, np.int64)]), minlength=len(word))
            return rows(word.astype(np.int64), count.astype(np.int64), False)

        def rows(key: np.ndarray, count: np.ndarray, spelled: bool) -> pa.RecordBatch:
            cells = [pa.array(key, pa.int64()), pa.array(count, pa.int64()), pa.array(np.full(len(key), spelled))]
            return pa.RecordBatch.from_arrays(cells, names=["word", "n", "spelled"])

        for _, uses, of in _rows(batches):
            count = np.bincount(of.only(uses != HELD_OUT).at, minlength=len(of.hash))
            ids += np.bincount(of.ids, weights=np.repeat(count, of.n_ids), minlength=n_ids).astype(np.int64)
            some = np.flatnonzero(count)
            held.append((of.hash[some], count[some]))
            n += len(some)
            if n >= CHUNK:
                yield flush()
                held, n = [], 0
        yield flush()
        at = np.flatnonzero(ids)
        yield rows(at, ids[at], True)

    return run


PARTS = {"row": pa.int64(), "doc_id": pa.int64(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base": pa.float64(), "score": pa.float64(), "word": pa.int64()}
PARTS_SCHEMA = "row long, doc_id long, n_tokens long, n_known long, base double, score double, word long"


def _parts(**given) -> pa.RecordBatch:
    n = len(given["row"])
    return pa.RecordBatch.from_arrays([pa.array(given[c], t) if c in given else pa.nulls(n, t) for c, t in PARTS.items()], names=list(PARTS))


def _scored(model):
    """A row for each text of the spelled table, and one for each word in it that is not among the broadcast counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        if m["id"] not in _state:
            _state.clear()
            _state[m["id"]] = unpacked(m["net"])
        net, words, ends = _state[m["id"]], m["words"], m["ends"]
        row = TaskContext.get().partitionId() << 40
        for docs, _, of in _rows(batches):
            at = np.searchsorted(words, of.hash)
            at[at == len(words)] = 0
            known = words[at] == of.hash if len(words) else np.zeros(len(of.hash), bool)
            part = np.zeros(len(known))
            part[known] = np.log10(m["counts"][at[known]] + 1)
            rows, r = row + np.arange(len(docs)), np.flatnonzero(~known[of.at])
            base, n_known = of.sums(part) + np.log10(ends + 1), of.sums(known).astype(np.int64) + (ends > 0)
            yield _parts(row=rows, doc_id=docs, n_tokens=of.n_words + 1, n_known=n_known, base=base, score=text_log_p(net, of, m["place"], m["tail"]))
            yield _parts(row=rows[of.of_text()[r]], word=of.hash[of.at[r]].astype(np.int64))
            row += len(docs)

    return run


def score(docs: DataFrame, sample: int = SAMPLE, ranks: str | None = None, frequent: int = FREQUENT, share: int = SHARE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of docs.

    Words are compared by 64-bit hashes of their bytes. Null texts count as empty: their only token is the end. Null
    ids hash as the empty text and are learnt from like others. Repeated rows count and are scored as often as they
    stand there; in the start an id counts once, with its least text. Without training rows every count is 0, and an
    untrained network is all there is. Other columns are not read. The network starts from sample training texts and
    then learns from every training text, once, where it lies; share=n asks for one of n of them instead.
    """
    spark = prepare(docs.sparkSession)
    spark.sparkContext.environment |= ALLOCATION
    ranks = ranks or str(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rows = docs.select("doc_id", text_bytes("text").alias("bytes"))
    learn = rows.filter(id_bucket(F.col("doc_id"), 7) != 2)
    asked = F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0
    uses = F.when(id_bucket(F.col("doc_id"), 7) == 2, HELD_OUT).when(asked, LEARNT).otherwise(COUNTED).alias("uses")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(SENT))  # until prepare() below
    table = rows.select("doc_id", "bytes", uses).mapInArrow(_spelled(ranks), SPELLED_SCHEMA)
    table = written(table, **{"parquet.block.row.count.limit": str(GROUP)})  # what follows need not read or spell the texts again
    n_ids = len(id_lengths(ranks))
    every = table.drop("doc_id").mapInArrow(_counted(n_ids), "word long, n long, spelled boolean").groupBy("spelled", "word").agg(F.sum("n").alias("n"))
    every = written(every)
    counts, ends = every.filter("not spelled").select("word", "n"), learn.count()
    by_id = every.filter("spelled").select("word", "n").toPandas()  # a row per id of the tokenizer at most
    id_counts = np.bincount(by_id["word"].to_numpy(np.int64), weights=by_id["n"].to_numpy(np.float64), minlength=n_ids)
    # the largest threshold that leaves few enough words to broadcast, from counts by size class
    size = F.floor(F.log2("n") * 16).alias("size")
    classes = counts.groupBy(size).agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n"), F.min("n").alias("least")).orderBy(F.desc("size")).collect()
    total, distinct, held, least = sum(r["n"] for r in classes) + ends, sum(r["words"] for r in classes) + (ends > 0), 0, None
    for r in classes:
        held += r["words"]
        if held > frequent:
            break
        least = r["least"]
    top = counts.filter(F.col("n") >= least if least is not None else F.lit(False)).toPandas()
    words, n = top["word"].to_numpy(np.int64).astype(np.uint64), top["n"].to_numpy(np.float64)
    order, rate = np.argsort(words), float(total + distinct + 1)
    net, place, tail = trained(learn, table, id_counts, ends, ranks, sample)
    model = {"id": uuid.uuid4().hex, "net": packed(net), "place": place, "tail": tail, "words": words[order], "counts": n[order], "ends": ends}
    parts = written(table.drop("uses").mapInArrow(_scored(spark.sparkContext.broadcast(model)), PARTS_SCHEMA))
    prepare(spark)
    rare = parts.filter("word is not null").select("row", "word").join(counts, "word", "left").filter("n is not null")
    rare = rare.groupBy("row").agg(F.sum(F.log10(F.col("n") + 1)).alias("rare_base"), F.count(F.lit(1)).alias("rare_known"))
    out = parts.filter("word is null").drop("word").join(rare, "row", "left").na.fill(0, ["rare_base", "rare_known"])
    base = F.col("base") + F.col("rare_base") - F.col("n_tokens") * float(np.log10(rate))
    return out.select(
        "doc_id",
        (id_bucket(F.col("doc_id"), 7) == 2).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.col("rare_known")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        "score",
    )
