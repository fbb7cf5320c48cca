"""Page and vector operators against plain models."""

import base64
import gzip
import hashlib
import io
import random
import time
from collections import Counter

import numpy as np
import pytest

from timedtext.llm import extraction, kdtree, warc

PAGE = '<!DOCTYPE html><html><head><title>T {i}</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About</a></li></ul></nav><!-- ad --><div class="ad">Buy {i} now.</div><article><h1>Head {i}</h1><p><b>First &amp; {i} bold,\n  with   spaces.<br><p>Second para {i} of it.</p></article><footer>&copy; site {i} &middot; all rights</footer>'
SCHEMA = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://x/{i} y", PAGE.format(i=i)) for i in range(40)]
    rows += [(40, None, None), (41, "u", ""), (42, "u", PAGE.format(i=3)), (42, "u", PAGE.format(i=3)), (None, "n", PAGE.format(i=4)), (43, "u", "no markup at all"), (44, "u", "<p>unclosed <b"), (45, "u", "é\r\n\r\nWARC/1.1\r\n日本 " * 50), (1, "u", "another page of the same id")]
    return rows, spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as key", "'y' as text", "1 as n_chars", "'z' as value", "0 as first").repartition(3)


def test_extraction(pages):
    rows, df = pages
    got = Counter((r.page_id, r.url, r.text, r.n_chars) for r in extraction.extract(df).collect())
    for i, u, h in rows[:40]:
        t = f"Head {i} First & {i} bold, with spaces. Second para {i} of it."
        assert got[i, u, t, len(t)] == 1
    assert got[40, None, "", 0] == got[41, "u", "", 0] == 1
    assert sum(got.values()) == len(rows)
    assert extraction.extract(df.limit(0)).count() == 0


def test_viterbi_and_gradient_match_enumeration():
    from itertools import product

    rng = np.random.default_rng(3)
    for n in (1, 2, 5):
        x, step = rng.normal(size=n), rng.normal(size=(2, 2))
        score = lambda y: sum(x[i] * y[i] for i in range(n)) + sum(step[y[i - 1], y[i]] for i in range(1, n))  # noqa: B023, E731
        paths = list(product([0, 1], repeat=n))
        assert tuple(extraction.viterbi(list(x), step.tolist())) == max(paths, key=score)
        p = np.exp([score(y) for y in paths])
        p /= p.sum()
        g, _ = extraction.gradient(x, np.zeros(n, int), step)
        assert np.allclose(g, [-sum(q for q, y in zip(p, paths, strict=True) if y[i]) for i in range(n)])


def test_extraction_in_other_layouts():
    rng, word = random.Random(1), lambda: "".join(rng.choices("aeioulnrst", k=rng.randint(2, 8)))
    say = lambda n: " ".join(word() for _ in range(rng.randint(1, n))).capitalize() + "."
    pages = []
    for _ in range(80):
        links = "".join(f'<li><a href="/">{word()}</a></li>' for _ in range(rng.randint(2, 6)))
        body = "".join(f"<p>{say(60)}" for _ in range(rng.randint(1, 6)))
        pages.append(f'<html><head><title>{say(5)}</title></head><body><nav><ul>{links}</ul></nav><div class="ad">{say(9)}</div><article><h1>{say(9)[:-1]}</h1>{body}</article><footer>&copy; {word()} {say(12)}</footer></body></html>')
    w, step = extraction.fit(pages)
    page = "<html><body><div class='navbar'><a href=x>Home</a></div><div class='article-content'><h2>Title</h2><p>Hello there, this is a text.</p></div><div class='sidebar'><p>Some more links here.</p></div><div class='comment-list'><p>My comment is here, too.</p></div></body></html>"
    assert extraction.main_text(page, w, step) == "Title Hello there, this is a text."


#: Layouts that the field is not trained on: {0} title, {1} body, {2} links, {3} to {5} other texts.
OTHERS = [
    '<html><body class="home"><div id="masthead"><p>{3}</p><ul class="menu">{2}</ul></div><div id="primary"><div class="hentry post-12"><h1>{0}</h1>{1}</div><div id="comments"><h3>{4}</h3><ol class="comment-list"><li><p>{5}</p></li></ol></div></div><div id="secondary" class="widget-area sidebar"><p>{4}</p></div></body></html>',
    '<html><body><header><a href="/">{3}</a><nav>{2}</nav></header><main><article>{1}<form action="/s"><p>{4}</p><input><button>{5}</button></form></article><aside>{5}</aside></main><footer>&copy; {3}</footer></body></html>',
    '<html><body><div class="cookie-banner">{3}<button>{4}</button></div><div class="content">{1}</div><div class="footer"><ul>{2}</ul></div></body></html>',
    '<html><body><div class="nav-menu"><ul>{2}</ul></div><section class="story-body"><h2>{0}</h2>{1}<div class="advert">{4}</div></section><section class="comments"><p>{3}</p><p>{5}</p></section></body></html>',
]


def test_extraction_of_lists_and_forms_in_layouts_not_trained_on():
    """Whatever 150 pages are learnt from: lists of an article stay, forms in it go, and no long paragraph without a final point is lost."""
    rng = random.Random(5)
    words = ["".join(rng.choices("aeioulnrstdm", k=rng.randint(2, 9))) for _ in range(400)]
    say = lambda a, b: " ".join(rng.choices(words, k=rng.randint(a, b))).capitalize()
    trained = [PAGE.format(i=say(3, 12)).replace("Second para", say(5, 60) + ".<p>" + say(5, 600)) for _ in range(150)]
    w, step = extraction.fit(trained)
    right = 0
    for k in range(120):
        title, body = say(2, 7), [say(6, 60) + ".", say(3, 9), say(3, 9) + ".", say(200, 500), say(6, 60) + "."]
        marked = f"<p>{body[0]}</p><ul><li>{body[1]}</li><li>{body[2]}</li></ul><p>{body[3]}</p><p>{body[4]}</p>"
        links = "".join(f'<li><a href="/">{say(1, 2)}</a></li>' for _ in range(4))
        layout = OTHERS[k % len(OTHERS)]
        page = layout.format(title, marked, links, say(2, 9), say(2, 9), say(3, 20) + ".")
        want = " ".join(([title] if "{0}" in layout else []) + body)
        right += extraction.main_text(page, w, step) == want
    assert right >= 108, right
    long = say(300, 400)
    for page in (f"<html><body><nav><ul><li><a href=/>x</a></li></ul></nav><article><h1>A title</h1><p>{long}</p></article></body></html>",):
        assert extraction.main_text(page, w, step) == f"A title {long}"


def test_extraction_reads_on_behind_embedded_elements():
    texts = lambda page: [b[1] for b in extraction.leaf_blocks(page)]
    for x in ("<svg-icon></svg-icon>", "<object-view></object-view>", "<template-x>", "<script-x></script-x>", '<svg viewBox="0 0" />', "<math/>", "<object data='a'/>", "<style>p{}</style >", "<script>'<p>no</p>'</script x>"):
        assert texts(f"<article><p>one</p>{x}<p>two</p></article>") == ["one", "two"]
    assert texts("<p>a <math><mi>x</mi></math> b") == ["a", "x", "b"] and texts("<noscript><p>c</p></noscript><object>d</object>") == ["c", "d"]
    paths = {b[1]: tuple(x for n in reversed(list(b[0].up())) for x in n.names) for b in extraction.leaf_blocks("<article><svg/><p>e</p><template><p>f</p></template><p>g <object>h</object> i</article>")}
    assert paths["e"] == ("t:article", "t:p") and paths["f"] == ("t:article", "t:template", "t:p") and paths["i"] == paths["g"] == ("t:article", "t:p")


def test_extraction_where_few_pages_or_none_name_their_article(spark):
    plain = '<html><body><div class="navbar"><ul><li><a href="/">Home</a></li><li><a href="/a">About us</a></li></ul></div><div class="article-content"><h2>Title {i}</h2><p>Hello there, this is text number {i} of the table.</p></div><div class="sidebar"><p>Some more links here.</p></div><div id="footer">&copy; all rights</div></body></html>'
    bare = "<main>{i}</main>"  # names an article and has nothing beside it
    rows = [(i, "u", plain.format(i=i)) for i in range(30)]
    want = {i: f"Title {i} Hello there, this is text number {i} of the table." for i in range(30)}
    for more in ([], [(100 + i, "v", bare.format(i=i)) for i in range(9)], [(100 + i, "v", bare.format(i=i)) for i in range(9)] + [(200 + i, "w", PAGE.format(i=i)) for i in range(3)]):
        got = {r.page_id: r.text for r in extraction.extract(spark.createDataFrame(rows + more, SCHEMA), sample=3).collect()}
        assert {i: got[i] for i in range(30)} == want
        assert all(got[i] == f"Head {i - 200} First & {i - 200} bold, with spaces. Second para {i - 200} of it." for i in got if i >= 200)


def test_extraction_of_deep_and_long_pages():
    """Time grows with the page, not with depth times length; nothing is cut off."""
    w, step = extraction.fit([PAGE.format(i=i) for i in range(30)], epochs=2)
    took = []
    for n in (20_000, 80_000):
        began = time.process_time()
        page = "<article>" + "<div class='c'>x" * n + "</nav>" * n + "</article>"
        blocks = extraction.leaf_blocks(page)
        assert len(blocks) == n and sum(1 for _ in blocks[-1][0].up()) == n + 2
        assert set(extraction.main_text(page, w, step).split()) <= {"x"}
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0]
    long = "<article>" + "<p>Some text of it, here.</p>" * 50_000 + "</article>"
    assert extraction.main_text(long, w, step).count("text of it") == 50_000


def test_features_of_a_block_are_its_ancestors_once():
    blocks = extraction.leaf_blocks('<div class="a b"><div class="b c"><p id=x>one</p></div><p>two</p></div><p>three')
    rng = np.random.default_rng(0)
    w = rng.normal(size=extraction.DIM)
    for block, want in zip(blocks, ({"t:div", "c:a", "c:b", "c:c", "t:p", "c:x", "leaf t:p"}, {"t:div", "c:a", "c:b", "t:p", "leaf t:p"}, {"t:p", "leaf t:p"}), strict=True):
        assert np.isclose(extraction.node_score(block[0], w), sum(w[extraction._place(x)] for x in want))
        assert sorted(extraction.places(block)) == sorted([extraction._place(x) for x in want] + extraction.text_places(block[1], block[2]))


def test_warc_round_trip(pages):
    rows, df = pages
    got = Counter(tuple(r) for r in warc.op6(df).collect())
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = Counter()
    for i, _, h in rows:
        b, f = (h or "").encode(), first.get(h or "")
        again = f is not None and f != i
        want[i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", f if again else None] += 1
    assert got == want
    assert warc.op6(df.limit(0)).count() == 0


def test_warc_archives_are_bounded_and_dated(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3000)
    rows = [(i, "http://x/\u3000 y" if i == 5 else f"http://x/{i}", f"{i} " * 200, "2021-02-03 04:05:06") for i in range(60)]
    rows += [(100, "http://long", "z" * 2_000_000, None)] + [(200 + i, "http://copy", "copy", None) for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, at string").selectExpr("page_id", "url", "html", "timestamp(at) as at").repartition(2)
    path = str(tmp_path / "archives")
    warc.write_archives(df, f"file://{path}", captured="at")
    got = warc.read_archives(spark, f"file://{path}").collect()
    assert Counter(r.page_id for r in got) == Counter(r[0] for r in rows)
    assert Counter(r.record_type for r in got) == {"response": 62, "revisit": 299} and {r.refers_to for r in got if r.record_type == "revisit"} == {200}
    files = list((tmp_path / "archives").glob("*.gz"))
    records = [r for f in files for r in warc.read_warc(io.BufferedReader(gzip.open(f)))]
    assert len(files) > 30 and len(records) == len(rows)
    assert Counter(f["WARC-Date"] for f, _ in records) == {"2021-02-03T04:05:06Z": 60, "2024-01-01T00:00:00Z": 301}
    assert "http://x/%E3%80%80%20y" in {f["WARC-Target-URI"] for f, _ in records}


@pytest.mark.parametrize("version", [1, 2])
def test_arc_lines_and_lengths(version):
    records = [warc.page_record(i, f"http://a/{i}", b) for i, b in enumerate([b"", b"\n\nhttp://trap 0.0.0.0 20200101000000 text/html 5\n", b"x" * 999])]
    back = list(warc.read_arc(warc.arc_file(records, version)))
    assert [(f["URL"], c) for f, c in back] == [(u, c) for u, _, c in records]
    data = b"".join(warc.warc_record(f, c, None if k else 7) + b"\r\n\r\n" for k, (f, c) in enumerate(back))
    fields = [f for f, _ in warc.read_warc(io.BytesIO(data))]
    assert [f["WARC-Type"] for f in fields] == ["revisit", "response", "response"]
    assert fields[1]["WARC-Date"] == "2024-01-01T00:00:00Z" and fields[1]["WARC-Record-ID"].startswith("<urn:uuid:")
    assert gzip.decompress(gzip.compress(data)) == data
    with pytest.raises(ValueError):
        list(warc.read_warc(io.BytesIO(data[:-3])))


def plain_top_k(table):
    want = {}
    for q in (i for i in table if i % 50 == 0):
        best = sorted((-int(table[q] @ v), i) for i, v in table.items() if i != q and len(v) == len(table[q]))[:5]
        want[q] = [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    return {k: v for k, v in want.items() if v}


@pytest.mark.parametrize("kind", ["float", "double"])
def test_top_k_over_many_shards(spark, monkeypatch, kind):
    monkeypatch.setattr(kdtree, "SHARD_ROWS", 200)
    monkeypatch.setattr(kdtree, "BLOCK_QUERIES", 3)
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.normal(size=5)]) for i in range(1200)]
    rows += [(100, [9.0] * 5), (100, [-9.0] * 5), (101, [8.0] * 5)]  # ids with two vectors: the least counts
    least = {}
    for i, e in rows:
        least[i] = min(least.get(i, e), e)
    table = {i: np.floor(256 * np.array(e, np.float32 if kind == "float" else np.float64).astype(float)) for i, e in least.items()}
    got = {}
    for r in kdtree.op1(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert {k: sorted(v) for k, v in got.items()} == plain_top_k(table)


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.normal(size=6)]) for i in range(300)]
    rows += [(300 + i, rows[50][1]) for i in range(40)]  # copies, so ties
    rows += [(400, None), (401, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (None, rows[0][1]), (450, [1.0, 2.0]), (451, [0.5, 1.0]), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as shard", "2 as block", "3 as rank")
    got = {}
    for r in kdtree.op1(df).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    table = {i: np.floor(256 * np.array(e, np.float32).astype(float)) for i, e in rows if i is not None and e and None not in e and np.isfinite(e).all()}
    assert {k: sorted(v) for k, v in got.items()} == plain_top_k(table)
    assert kdtree.op1(df.limit(0)).count() == 0


def test_tree_prunes_and_is_exact_for_huge_values():
    rng = np.random.default_rng(2)
    x = rng.integers(-50, 50, (2000, 3)).astype(float)
    tree = kdtree.build(np.arange(2000), x, 32)
    assert all((tree["lo"][k] <= x[np.isin(np.arange(2000), tree["ids"][a:b])]).all() for k, (a, b) in enumerate(tree["span"]))
    q = rng.integers(-50, 50, (5, 3)).astype(float)
    for hits, v in zip(kdtree.search(tree, np.full(5, -1), q, np.full(5, -np.inf), 4), q, strict=True):
        s = x @ v
        assert [(h[0], -h[1]) for h in hits] == sorted(((int(s[i]), i) for i in range(2000)), key=lambda t: (-t[0], t[1]))[:4]
    big = kdtree.build(np.arange(3), np.array([[2.0**40, 1.0], [2.0**40, 2.0], [2.0**40, 3.0]]))
    hits = kdtree.search(big, np.array([9]), np.array([[2.0**20, 1.0]]), np.array([-np.inf]), 3)[0]
    assert hits == [(2**60 + 3, -2), (2**60 + 2, -1), (2**60 + 1, 0)]


def test_queries_go_through_a_tree_together():
    """Over a tree of clusters they look at few leaves, in one product a leaf; hits are those of every vector, ties by id."""
    rng = np.random.default_rng(7)
    at = rng.normal(size=(40, 12)) * 100
    x = np.floor(at[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 12)))
    x[3000:3200] = x[5]  # equal vectors
    q, own, looked = np.concatenate([x[:100], np.floor(rng.normal(size=(5, 12)) * 50), np.zeros((1, 12))]), np.concatenate([np.arange(100), np.full(6, -1)]), []
    tree, plain, kth = kdtree.build(np.arange(6000), x), kdtree._dot, np.full(106, -np.inf)
    kth[50] = 1e9
    try:
        kdtree._dot = lambda a, b: looked.append((len(a), len(b))) or plain(a, b)
        got = kdtree.search(tree, own, q, kth, 4)
    finally:
        kdtree._dot = plain
    s = (q @ x.T).astype(int)
    for k, hits in enumerate(got):
        best = sorted(((int(v), -i) for i, v in enumerate(s[k]) if i != own[k] and v >= kth[k]), reverse=True)[:4]
        assert hits == best
    assert len(looked) <= 2 * len(tree["span"]) and sum(a * b for a, b in looked) < 0.5 * 106 * 6000
