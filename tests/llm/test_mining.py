"""Mixing, hard negatives and collocations against plain models."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from timedtext.llm import collocations, hard_negatives, kdtree, mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes):
    """Targets by source: shares by weight, stopped at three times the size, the excess shared again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    full = set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        open_weight = sum(w for s, w in weight.items() if s not in full)
        now = {s for s in order if s in full or 3 * sizes[s] < weight[s] * left / open_weight}
        if now == full:
            return {s: 3.0 * sizes[s] if s in full else left * weight[s] / open_weight for s in order}
        full = now


def mixed_rows(seed):
    rng = random.Random(seed)
    sources = ["a", "b", "ä", "Z", None, "tiny", "none", "hot"]
    rows = [(k, rng.choice([*sources[:5], *["hot"] * 4]), rng.choice([1, 2, 5, 20, 60, 300])) for k in range(2500)]
    rows += [(9000 + k, "tiny", 3) for k in range(4)] + [(9100, "none", 0), (None, "a", 7), (None, "a", 7), (None, None, 5)] + [(9200, "b", 4)] * 700
    return [(k, s, None if n == 0 else "\tx" * n) for k, s, n in rows]


def test_mix(spark):
    rows = mixed_rows(1)
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({"m": F.lit(1), "p": F.lit("x"), "node": F.lit(2), "target": F.lit(0)})
    got = mixing.mix(docs).collect()
    sizes = defaultdict(int)
    for _, s, t in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = plain_targets(sizes)
    assert want["tiny"] == 3.0 * sizes["tiny"]  # the case is there
    assert Counter((r.doc_id, r.size) for r in got) == Counter((k, len(WORD.findall(t or ""))) for k, _, t in rows)
    by = defaultdict(list)
    source_of = {(k, len(WORD.findall(t or ""))): s for k, s, t in rows if k is not None}
    for r in got:
        assert r.taken == r.size * r.copies and 0 <= r.copies <= 3
        if r.doc_id is not None:
            s = source_of[r.doc_id, r.size]
            assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
            each = want[s] / sizes[s] if sizes[s] else 0
            assert r.size == 0 or int(each + 1e-9) <= r.copies <= int(each) + 1
        by[r.source_size].append(r)
    for s, target in want.items():
        assert abs(sum(r.taken for r in by[sizes[s]]) - target) <= 60
    again = mixing.mix(docs.repartition(7, "text")).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mix_is_fair(spark):
    """Over many sources alike, a document of any size is taken as often as its share says."""
    rows = [(k, f"s{k % 300:03}", (1, 4, 9, 50)[k // 300 % 4]) for k in range(300 * 40)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, n int"), size=F.col("n")).collect()
    for third, share in ((0, 0.5), (1, 1.0), (2, 1.5)):
        for size in (1, 4, 9, 50):
            mine = [r.copies for r in got if r.doc_id % 300 % 3 == third and r.size == size]
            assert sum(mine) / len(mine) == pytest.approx(share, abs=0.06), (third, size)


def test_mix_of_little(spark):
    schema = "doc_id string, source string, text string"
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
    none = mixing.mix(spark.createDataFrame([("a", None, None), ("b", "s", " \n ")], schema)).collect()
    assert {(r.doc_id, r.size, r.target, r.taken) for r in none} == {("a", 0, 0.0, 0), ("b", 0, 0.0, 0)}
    one = mixing.mix(spark.createDataFrame([("a", "s", "x " * 100_000)], schema)).first()
    assert (one.size, one.source_size, one.target, one.taken) == (100_000, 100_000, 100_000.0, 100_000)
    many = mixing.mix(spark.createDataFrame([("a", "s", "x y")] * 9000 + [("b", "t", "x")] * 9000, schema))
    assert many.count() == 18_000 and abs(many.filter("doc_id = 'a'").agg(F.sum("taken")).first()[0] - 9000) <= 2


def plain_negatives(rows, anchors, k=5, m=10):
    points = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            points[i] = min(points.get(i, (label, v)), (label, v))
    e = {i: [int(np.floor(256 * x)) for x in v] for i, (_, v) in points.items()}
    out = set()
    for a in (i for i in points if anchors(i)):
        score = sorted((-sum(x * y for x, y in zip(e[a], e[i], strict=True)), i) for i in points if i != a and len(e[i]) == len(e[a]))
        for s, i in [(s, i) for s, i in score if points[i][0] == points[a][0]][:k]:
            fits = [(n, j) for n, j in score if points[j][0] != points[a][0] and 30 * -s <= 100 * -n <= 90 * -s][:m]
            out |= {(a, i, rank + 1, j, -s, -n) for rank, (n, j) in enumerate(fits)}
    return out


@pytest.mark.parametrize("shards, cells, summaries", [(8192, 1 << 20, 1000), (40, 150, 1000), (40, 150, 0)])
def test_hard_negatives(spark, monkeypatch, shards, cells, summaries):
    monkeypatch.setattr(hard_negatives, "SHARD_ROWS", shards)
    monkeypatch.setattr(hard_negatives, "CELL_ROWS", cells)
    monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", 16)
    monkeypatch.setattr(hard_negatives, "MOST_SUMMARIES", summaries)
    rng = random.Random(3)
    groups = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    near = lambda: [x + rng.gauss(0, 0.4) for x in rng.choice(groups)]
    rows = [(i, rng.randrange(4), near()) for i in range(400)]
    rows += [(1000 + i, i % 3, rows[7][2]) for i in range(120)]  # a large group of equal vectors
    rows += [(2000, None, near()), (2005, 1, None), (2010, 1, [1.0, None] * 3), (2015, 1, [float("nan")] * 6), (2020, 1, [float("inf")] + [0.0] * 5), (2025, 1, [0.0] * 6), (None, 1, near())]
    rows += [(5, 3, near()), rows[9], (3000, 2, [1.0, 2.0]), (3001, 1, [1.0, 2.0]), (3002, 2, [1.5, 2.0]), (3005, 1, []), (3006, 1, []), (3010, 900, near())]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({"rank": F.lit(1), "cell": F.lit("x"), "score": F.lit(None).cast("int")})
    got = hard_negatives.hard_negatives(df, F.col("vec_id") % 5 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert {tuple(r) for r in got.collect()} == plain_negatives(rows, lambda i: i % 5 == 0)


def test_a_walk_ends_where_nothing_can_count():
    """Every list is sorted by a bound that no member's score exceeds, and long lists are left early."""
    rng = np.random.default_rng(5)
    x = np.floor(256 * rng.normal(size=(4000, 8)) * np.linspace(4, 0.01, 4000)[:, None])
    ids, labels = np.arange(4000), np.zeros(4000, np.int64)
    members = x[:40] + np.floor(rng.normal(size=(40, 8)))
    length, d = hard_negatives._directions(members)
    c = hard_negatives.centres(members, 4)
    block = {"ids": np.arange(9000, 9040), "labels": np.zeros(40, np.int64), "x": members, "length": length, "c": c, "at": np.argmax(d @ c.T, axis=1), "member": np.arange(40), "positive": np.full(40, -1), "least": np.full(40, hard_negatives.LEAST), "most": np.full(40, hard_negatives.MOST), "kth": np.full(40, hard_negatives.LEAST)}
    looked = []
    plain = hard_negatives._dot
    try:
        hard_negatives._dot = lambda a, q: looked.append(len(a)) or plain(a, q)
        got = hard_negatives.walk(block, ids, labels, x, 3, True)
    finally:
        hard_negatives._dot = plain
    want = {(m, int(i), int(x[i] @ members[m])) for m in range(40) for i in sorted(range(4000), key=lambda i: (-(x[i] @ members[m]), i))[:3]}
    assert set(got) == want and sum(looked) < 40 * 4000 * 0.8


def joins_of(query, spark):
    df = spark.createDataFrame([(i, i % 3, [float(i % 17), float(i % 5)]) for i in range(1200)], "vec_id long, label int, embedding array<float>")
    plan = query(df)._jdf.queryExecution().executedPlan().toString()
    return plan.count("CartesianProduct"), plan.count("BroadcastExchange"), plan.count("explode")


def test_trees_and_blocks_are_not_broadcast(spark):
    """They meet as pairs of file parts: their files are small, but what a join of all pairs would send is not."""
    assert joins_of(kdtree.op1, spark) == (1, 0, 0)


def test_shards_and_blocks_are_not_broadcast(spark):
    assert joins_of(hard_negatives.op12, spark) == (1, 1, 0)  # positives are joined to the negatives at the end


def test_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert hard_negatives.op12(empty).count() == 0
    two = spark.createDataFrame([(0, 1, [1.0]), (1, 2, [1.0])], "vec_id long, label int, embedding array<double>")
    assert hard_negatives.op12(two).count() == 0  # no positive


def plain_collocations(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for d in range(1, 6):
                f[lang].update(" ".join(w[i : i + d]) for i in range(len(w) - d + 1))
    out = []
    for lang, counts in f.items():
        some = {p: a for p, a in counts.items() if a >= least and " " in p}
        inside = lambda p, q: f" {p} " in f" {q} "
        kept = []
        for p, a in some.items():
            if any(len(q) > len(p) and c >= a and inside(p, q) for q, c in some.items()):
                continue
            w = p.split(" ")
            cut = [(1000 * a * n[lang] // (counts[" ".join(w[:k])] * counts[" ".join(w[k:])]), k, counts[" ".join(w[:k])], counts[" ".join(w[k:])]) for k in range(1, len(w))]
            score, _, left, right = min(cut)
            kept.append((-score, -a, p.encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def texts_of_phrases(seed, n=400):
    rng = random.Random(seed)
    words = ["the", "of", "A", "ä", "É", "x\x00", "y", "longer-than-eight", "longer-than-eighu", "w" * 3000, "und"]
    rows = []
    for k in range(n):
        t = ""
        for _ in range(rng.randint(0, 30)):
            t += rng.choice(words[: 4 + k % 8]) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", ";"])
        rows.append((rng.choice(["en", "de", "en", None, ""]), t))
    return rows + [("en", "of the people by the people for the people")] * 90 + [("en", None), (None, ""), ("fr", "seldom seen"), ("en", "x " * 3000)]


@pytest.mark.parametrize("case", ["plain", "no list of frequent words", "routes by more words"])
def test_collocations(spark, monkeypatch, case):
    if case == "no list of frequent words":
        monkeypatch.setattr(collocations, "MOST_FREQUENT", -1)
    if case == "routes by more words":
        monkeypatch.setattr(collocations, "HOT_ROWS", 40)
        monkeypatch.setattr(collocations, "ROUTE_ROWS", 500)
    rows = texts_of_phrases(4)
    df = spark.createDataFrame(rows, "lang string, text string").withColumns({"n": F.lit(1), "h": F.lit("x"), "word": F.lit(2), "k": F.lit(None).cast("string")}).repartition(5)
    for least, top in ((8, 2000), (3, 15)):
        got = collocations.collocations(df, least, top)
        assert sorted(map(tuple, got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == plain_collocations(rows, least, top)


def test_collocations_of_nothing(spark):
    assert collocations.op13(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert collocations.op13(spark.createDataFrame([(None, None), ("en", ""), ("en", " . ")], "lang string, text string")).count() == 0


@pytest.mark.parametrize("small", [1, 7, 4096])
def test_multikey_quicksort(monkeypatch, small):
    monkeypatch.setattr(collocations, "SMALL", small)
    rng = np.random.default_rng(small)
    words = rng.integers(1, 6, size=(5, 3000)).astype(np.uint32)
    ended = rng.integers(2, 6, size=3000)
    words[np.arange(5)[:, None] >= ended] = 0
    n, level = rng.integers(1, 4, size=3000), np.where(words[0] == 3, 4, 2).astype(np.uint8)
    want = Counter()
    for k in range(3000):
        for d in range(2, int(ended[k]) + 1):
            want[tuple(words[:d, k].tolist())] += int(n[k])
    want = {p: c for p, c in want.items() if c >= 30 or (p[0] == 3 and len(p) < 4)}
    got = collocations.partitions(words, n, level, 30)
    assert {tuple(words[:d, r].tolist()): c for r, d, c in got} == want and len(got) == len(want)


def test_words_that_share_a_number_are_told_apart(spark, monkeypatch):
    """A seed under which two words have one number is left for the next."""
    tried = []
    plain = collocations._counts

    def counts(seed):
        run = plain(seed)
        tried.append(seed)
        if seed:
            return run

        def clash(batches):
            for b in run(batches):
                d = b.to_pydict()
                d["h"] = [7 if k == 1 else h for k, h in zip(d["kind"], d["h"], strict=True)]
                yield type(b).from_pydict(d, schema=b.schema)

        return clash

    monkeypatch.setattr(collocations, "_counts", counts)
    rows = [("en", "a b c")] * 5
    got = collocations.collocations(spark.createDataFrame(rows, "lang string, text string"), 3)
    assert tried == [0, 1] and [r.phrase for r in got.collect()] == ["a b c"]
