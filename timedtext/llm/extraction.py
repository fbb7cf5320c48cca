"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page becomes the sequence of its leaf blocks: runs of text between block-level tags, each with its open ancestors.
Features of a block are its ancestors' tags and class and id words and some facts of its text; the field joins them
with weights for neighbouring labels, is trained by gradient on labelled pages, and decodes by Viterbi.

Labelled pages come from a bounded sample of the table itself: pages whose markup names their article (article or main
outside of navigation and the like) label themselves, and their titles and paragraphs are set again into other
layouts, in which what is main text is known by construction.
"""

from __future__ import annotations

import html
import math
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from timedtext.llm.common import prepare

#: Pages that label the training set: of those that label themselves, the ones with the least hashed ids.
SAMPLE = 150
#: Characters of a page, and elements around a block, beyond which a page is not learnt from (it is extracted like any other).
LONGEST, DEEPEST = 1 << 18, 200
#: With fewer of them, invented articles make up the number.
FEW = 60
DIM, EPOCHS, RATE, DECAY = 1 << 13, 6, 0.3, 1e-4

BLOCK_TAGS = frozenset("address article aside blockquote body button caption dd details dialog dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html iframe label legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul div center".split())
#: Elements that blocks have as ancestors but that end no paragraph; written self-closing they are empty.
EMBEDDED = frozenset("noscript template svg math object".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSES = {"p": frozenset("p".split()), "li": frozenset("li".split()), "dt": frozenset("dt dd".split()), "dd": frozenset("dt dd".split()), "tr": frozenset("tr td th".split()), "td": frozenset("td th".split()), "th": frozenset("td th".split()), "option": frozenset(["option"])}
ENDS_P = BLOCK_TAGS - frozenset("html head body button label".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style)(?=[\s/>])[^>]*>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<(?:[!?/]|[a-zA-Z])[^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)", re.I)
SPACE = re.compile(r"\s+")



class Node:
    """An open element: its parent, its tag, and those of its features that no ancestor has. Blocks share their ancestors."""

    __slots__ = ("parent", "tag", "new", "names", "score", "states")

    def __init__(self, parent: Node | None, tag: str, new: tuple[str, ...], names: tuple[str, ...]):
        self.parent, self.tag, self.new, self.names = parent, tag, new, names
        self.score: float | None = None
        self.states: tuple[bool, bool] | None = None

    def up(self) -> Iterator[Node]:
        node: Node | None = self
        while node is not None:
            yield node
            node = node.parent


#: (innermost open element, text, characters inside links)
Block = tuple[Node, str, int]


def leaf_blocks(page: str) -> list[Block]:
    """Each block that has text. Work and memory grow with the page alone, however deep its elements are nested."""
    out: list[Block] = []
    stack = [Node(None, "", (), ())]
    opened: Counter[str] = Counter()  # tags and features of the stack
    parts: list[str] = []
    linked, in_link = 0, False

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append((stack[-1], text, linked))
            parts, linked = [], 0

    def close() -> None:
        node = stack.pop()
        opened.subtract((f"<{node.tag}", *node.names))

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
            linked += (m.start() - at) * in_link
        at = m.end()
        tag = m[3]
        if not tag:
            if m[1]:
                flush()
            continue
        tag = tag.lower()
        if tag == "br":
            parts.append(" ")
        if tag == "a":
            in_link = not m[2]
        if tag not in BLOCK_TAGS and tag not in EMBEDDED:
            continue
        flush()
        if m[2]:
            while opened[f"<{tag}"]:
                last = stack[-1].tag == tag
                close()
                if last:
                    break
        else:
            closes = CLOSES.get(tag, frozenset()) | (frozenset(["p"]) if tag in ENDS_P else frozenset())
            while stack[-1].tag in closes:
                close()
            if tag not in VOID_TAGS and not (tag in EMBEDDED and m[4].endswith("/")):
                words = [f"t:{tag}"]
                for _, value in ATTRIBUTE.findall(m[4]):
                    words += [f"c:{x}" for x in re.findall(r"[a-z]+", value.lower())]
                names = tuple(dict.fromkeys(words))
                stack.append(Node(stack[-1], tag, tuple(w for w in names if not opened[w]), names))
                opened.update((f"<{tag}", *names))
        in_link = False
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


_places: dict[str, int] = {}


def _place(feature: str) -> int:
    if feature not in _places:
        if len(_places) > 100_000:
            _places.clear()
        _places[feature] = zlib.crc32(feature.encode()) % DIM
    return _places[feature]


def node_score(node: Node, w: np.ndarray) -> float:
    """Sum of the weights of all ancestors' features, and of the innermost tag as such; sums are kept at the nodes."""
    todo = []
    for n in node.up():
        if n.score is not None:
            break
        todo.append(n)
    for n in reversed(todo):
        n.score = (n.parent.score if n.parent else 0.0) + sum(float(w[_place(x)]) for x in n.new)
    return node.score + (float(w[_place(f"leaf t:{node.tag}")]) if node.tag else 0.0)


def text_places(text: str, linked: int) -> list[int]:
    n = len(text)
    share = min(linked / n, 1.0)
    last = text[-1] if not text[-1].isalnum() else "a"
    facts = [f"length {min(int(math.log2(n)), 8)}", f"links {int(share * 3.99)}", f"words {min(text.count(' '), 8)}", f"ends {last}"]
    if "©" in text:
        facts.append("copyright")
    return [_place(x) for x in facts]


def places(block: Block) -> list[int]:
    node, text, linked = block
    path = [_place(x) for n in node.up() for x in n.new]
    return path + ([_place(f"leaf t:{node.tag}")] if node.tag else []) + text_places(text, linked)


def gradient(x: np.ndarray, y: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the log likelihood of labels y, by emission scores x of label 1 and scores of label pairs: forward and backward sums."""
    n = len(x)
    e = np.stack([np.zeros(n), x], axis=1)
    fore, back = np.zeros((n, 2)), np.zeros((n, 2))
    fore[0] = e[0]
    for i in range(1, n):
        fore[i] = e[i] + np.logaddexp(fore[i - 1][0] + step[0], fore[i - 1][1] + step[1])
    for i in range(n - 2, -1, -1):
        back[i] = np.logaddexp(step[:, 0] + e[i + 1][0] + back[i + 1][0], step[:, 1] + e[i + 1][1] + back[i + 1][1])
    z = np.logaddexp(*fore[-1])
    one = np.exp(fore[:, 1] + back[:, 1] - z)
    pairs = np.zeros((2, 2))
    for i in range(1, n):
        pairs -= np.exp(fore[i - 1][:, None] + step + (e[i] + back[i])[None, :] - z)
        pairs[y[i - 1], y[i]] += 1
    return y - one, pairs


def viterbi(x: list[float], step: list[list[float]]) -> list[int]:
    """The likeliest labels; ties go to label 1."""
    a, b, came = 0.0, x[0] if x else 0.0, []
    for v in x[1:]:
        a0, b0, a1, b1 = a + step[0][0], b + step[1][0], a + step[0][1], b + step[1][1]
        came.append((int(b0 >= a0), int(b1 >= a1)))
        a, b = max(a0, b0), max(a1, b1) + v
    label = [int(b >= a)] if x else []
    for c in reversed(came):
        label.append(c[label[-1]])
    return label[::-1]


MAIN = re.compile(r"t:(article|main)$")
ASIDE = re.compile(
    r"t:(nav|aside|footer|header|form|title|button|select)$"
    r"|c:(ads?|advert\w*|comments?|sidebar|menu|nav\w*|footer|cookie\w*|notice|banner|promo|related|share)$"
)


def _states(node: Node) -> tuple[bool, bool]:
    """Whether the node is in an article, and whether it is in what stands beside one; kept at the nodes."""
    todo = []
    for n in node.up():
        if n.states is not None:
            break
        todo.append(n)
    for n in reversed(todo):
        main, aside = n.parent.states if n.parent else (False, False)
        n.states = main or any(map(MAIN.match, n.names)), aside or any(map(ASIDE.match, n.names))
    return node.states


def self_labels(blocks: list[Block]) -> list[int]:
    """Of a page whose markup names its article: blocks in article or main and in nothing that stands beside it."""
    return [int(main and not aside) for main, aside in (_states(b[0]) for b in blocks)]


def layouts(title: str, texts: list[str], noise: list[str]) -> Iterator[str]:
    """The same article in other layouts. Noise texts fill what isn't main text."""
    esc, n = html.escape, [html.escape(x) for x in noise]
    body = "".join(f"<p>{esc(x)}</p>" for x in texts)
    links = "".join(f'<li><a href="/{i}">{x}</a></li>' for i, x in enumerate(n[0].split(" ")[:6]))
    head = f"<html><head><title>{esc(title)}</title></head><body>"
    h1 = f"<h1>{esc(title)}</h1>"
    yield f'{head}<div id="header"><div class="logo">{n[1]}</div><div class="menu"><ul>{links}</ul></div></div><div class="cookie-notice">{n[2]}</div><div id="content" class="post">{h1}{body}</div><div class="sidebar"><h3>{n[3]}</h3><ul>{links}</ul><p>{n[4]}</p></div><div class="comments"><h3>{n[5]}</h3><p>{n[6]}</p><p>{n[7]}</p></div><div id="footer">&copy; {n[8]}</div></body></html>'
    yield f'{head}<header><p>{n[1]}</p><nav>{links}</nav></header><main>{h1}{body}</main><aside><p>{n[3]}</p><p>{n[4]}</p></aside><section class="comments"><div class="comment"><p>{n[6]}</p></div><div class="comment"><p>{n[7]}</p></div></section><form><label>{n[5]}</label><button>{n[2]}</button></form><footer><p>&copy; {n[8]}</p></footer></body></html>'
    yield f'{head}<nav><ul>{links}</ul></nav><div class="banner notice">{n[2]}</div><article><h1>{esc(title)}</h1><div class="ad">{n[3]}</div>{body}<aside class="related"><p>{n[4]}</p></aside></article><div id="comments"><p>{n[6]}</p><p>{n[7]}</p></div><form class="newsletter"><p>{n[5]}</p></form><footer>{n[8]}</footer></body></html>'
    yield f'{head}<div class="topnav">{links}</div><div class="wrapper"><div class="entry-content article-body">{h1}<blockquote>{esc(texts[0])}</blockquote>{"".join(f"<p>{esc(x)}</p>" for x in texts[1:])}</div><div class="advert promo"><p>{n[3]}</p></div></div><div class="footer-links"><ul>{links}</ul></div></body></html>'


#: Class words of invented layouts.
MAIN_WORDS = "content post entry article story text body main".split()
ASIDE_WORDS = "sidebar comments comment ad ads advert footer header nav navbar menu notice cookie banner promo related share newsletter form widget popup breadcrumb login".split()


#: Elements that hold a text of an article: most are paragraphs.
HOLDERS = ["<p>{}</p>"] * 8 + ["<ul><li>{}</li></ul>", "<ol><li>{}</li></ol>", "<div>{}</div>", "<h2>{}</h2>", "<blockquote><p>{}</p></blockquote>", "<table><tr><td>{}</td></tr></table>", "<dl><dd>{}</dd></dl>", "<pre>{}</pre>"]
#: What a form holds.
FIELDS = ["<p>{}</p>", "<label>{}</label><input>", "<button>{}</button>", "<div><label>{}</label><textarea></textarea></div>", "<select><option>{}</option></select>", "<ul><li>{}</li></ul>"]


def random_body(texts: list[str], noise: list[str], rng: np.random.Generator) -> str:
    """Texts of an article in paragraphs, lists and the like; a form or an advert may stand among them."""
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    parts, k = [], 0
    while k < len(texts):
        n = 1 + int(rng.integers(3)) if rng.random() < 0.25 else 0
        if n:  # a list of several items
            tag = pick(["ul", "ol"])
            parts.append(f"<{tag}>" + "".join(f"<li>{html.escape(x)}</li>" for x in texts[k : k + n]) + f"</{tag}>")
        else:
            parts.append(pick(HOLDERS).format(html.escape(texts[k])))
        k += n or 1
    if rng.random() < 0.5:
        fields = "".join(pick(FIELDS).format(html.escape(pick(noise))) for _ in range(1 + int(rng.integers(3))))
        parts.insert(int(rng.integers(len(parts) + 1)), f"<form>{fields}</form>")
    if rng.random() < 0.3:
        parts.insert(int(rng.integers(len(parts) + 1)), f'<div class="{pick(ASIDE_WORDS)}"><p>{html.escape(pick(noise))}</p></div>')
    return "".join(parts)


def random_layout(title: str, texts: list[str], noise: list[str], rng: np.random.Generator) -> str:
    """Asides of random class words, as div, section or aside, before and after the article."""
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    named = lambda words: f'{pick(["class", "id"])}="{pick(words)}{pick(["", "-box", "-list", "-wrap"])}"'

    def aside(x: str) -> str:
        tag, inner = pick(["div", "div", "section", "aside"]), pick(["{}", "<p>{}</p>", "<p>{}</p>", '<ul><li><a href="/">{}</a></li></ul>', "<ul><li>{}</li></ul>", "<div><p>{}</p></div>"])
        return f"<{tag} {named(ASIDE_WORDS)}>{inner.format(html.escape(x))}</{tag}>"

    cut = int(rng.integers(len(noise)))
    top = f"<h{1 + int(rng.integers(2))}>{html.escape(title)}</h1>"
    tag = pick(["div", "div", "div", "section", "article"])
    inside = f"<{tag} {named(MAIN_WORDS)}>{top}{random_body(texts, noise, rng)}</{tag}>"
    return f"<html><body>{''.join(map(aside, noise[:cut]))}{inside}{''.join(map(aside, noise[cut:]))}</body></html>"


def without_final_points(texts: list[str], rng: np.random.Generator) -> list[str]:
    """A third of the texts end as headlines and list items do, so that how a text ends does not decide alone."""
    return [(x.rstrip(".!?…") or x) if rng.random() < 1 / 3 else x for x in texts]


def invented(n: int) -> list[tuple[list[str], list[str]]]:
    """Articles of made-up words (title, then paragraphs), each with short texts that stand beside it."""
    rng = random.Random(7)
    words = ["".join(rng.choices("aeioulnrst", k=rng.randint(2, 8))) for _ in range(500)]
    say = lambda most: " ".join(rng.choices(words, k=rng.randint(1, most))).capitalize()
    return [([say(9), *(say(60) + "." for _ in range(rng.randint(1, 6)))], [say(12) + rng.choice(["", "."]) for _ in range(6)]) for _ in range(n)]


def labels_itself(page: str) -> bool:
    """Whether a page's markup names its article and something else; pages too long or too deep to learn from do not count."""
    blocks = leaf_blocks(page) if len(page) <= LONGEST else []
    y = self_labels(blocks)
    return 0 < sum(y) < len(y) and all(sum(1 for _ in islice(b[0].up(), DEEPEST + 1)) <= DEEPEST for b in blocks)


def training_set(pages: list[str]) -> list[tuple[list[list[int]], np.ndarray]]:
    """Features and labels of self-labelled pages and of their articles in other layouts."""
    cases, known = [], []
    for page in pages:
        if labels_itself(page):
            blocks = leaf_blocks(page)
            y = self_labels(blocks)
            cases.append((blocks, y))
            known.append(([b[1] for b, on in zip(blocks, y, strict=True) if on], [b[1] for b, on in zip(blocks, y, strict=True) if not on]))
    known += invented(FEW - len(known))
    for k, (texts, _) in enumerate(known):
        other = [x for j in range(1, 10) for x in known[(k + j) % len(known)][1] if x not in texts]
        longer = [x for x in known[(k + 3) % len(known)][0] if x not in texts]
        noise = (other[:6] + longer[:2] + other[6:] + ["more", "about us", "menu", "subscribe", "log in", "share", "terms", "home", "contact"])[:12]
        rng = np.random.default_rng(k)
        some = [[noise[i] for i in rng.choice(len(noise), 4, replace=False)] for _ in range(5)]
        ends = without_final_points(texts, rng)
        inside = set(texts) | set(ends)
        for page in [*layouts(texts[0], ends[1:] or texts, noise), *(random_layout(texts[0], ends[1:] or texts, x, rng) for x in some)]:
            blocks = leaf_blocks(page)
            cases.append((blocks, [int(b[1] in inside and b[0].tag != "title") for b in blocks]))
    return [([places(b) for b in blocks], np.array(y)) for blocks, y in cases if blocks]


def fit(pages: list[str], epochs: int = EPOCHS) -> tuple[np.ndarray, list[list[float]]]:
    """Weights of features for label 1 and of label pairs, by stochastic gradient with a rate for each weight."""
    w, step, seen, seen_step = np.zeros(DIM), np.zeros((2, 2)), np.full(DIM, 1e-6), np.full((2, 2), 1e-6)
    cases, rng = training_set(pages), np.random.default_rng(5)
    for _ in range(epochs):
        for k in rng.permutation(len(cases)):
            xs, y = cases[k]
            g, pairs = gradient(np.array([w[x].sum() for x in xs]), y, step)
            total = np.zeros(DIM)
            for x, v in zip(xs, g, strict=True):
                np.add.at(total, x, v)
            total -= DECAY * w
            seen += total * total
            w += RATE * total / np.sqrt(seen)
            seen_step += pairs * pairs
            step += RATE * (pairs - DECAY * step) / np.sqrt(seen_step)
    return w, step.tolist()


def main_text(page: str, w: np.ndarray, step: list[list[float]]) -> str:
    blocks = leaf_blocks(page)
    scores = [node_score(node, w) + float(sum(w[p] for p in text_places(text, linked))) for node, text, linked in blocks]
    return " ".join(b[1] for b, on in zip(blocks, viterbi(scores, step), strict=True) if on)


def _extracted(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, step = model.value
        for batch in batches:
            texts = [main_text(h or "", w, step) for h in batch.column("html").to_pylist()]
            cells = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cells, names=["page_id", "url", "text", "n_chars"])

    return run


def _self_labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array(map(labels_itself, batch.column("html").to_pylist()), pa.bool_()))


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: whether all pages label themselves, how many there are, the weights of features and of label pairs."""
    pages = sorted((k, h) for batch in batches for k, h in zip(batch.column("key").to_pylist(), batch.column("html").to_pylist(), strict=True) if h is not None)
    w, step = fit([h for _, h in pages])
    row = {"useful": [sum(labels_itself(h) for _, h in pages)], "n": [len(pages)], "w": [w.tolist()], "step": [sum(step, [])]}
    yield pa.RecordBatch.from_pydict(row, schema=pa.schema([("useful", pa.int64()), ("n", pa.int64()), ("w", pa.list_(pa.float64())), ("step", pa.list_(pa.float64()))]))


def extract(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """page_id, url, text, n_chars: one row per row of pages.

    Null or block-less html gives an empty text. Repeated rows are extracted alike. Where fewer than FEW pages of the
    table name their article, the field is fitted on invented ones too. Other columns are not read. The field is fitted
    in one task, on at most sample pages of LONGEST characters each; the driver only sees its weights.
    """
    spark = prepare(pages.sparkSession)
    named = pages.filter((F.length("html") <= LONGEST) & F.col("html").rlike(r"(?i)<(article|main)[\s/>]"))
    named = named.select("html", F.xxhash64("page_id", "url").alias("key"))

    def fitted(rows: DataFrame) -> Row:
        keys = rows.select("key").distinct().orderBy("key").limit(sample)
        least = rows.join(F.broadcast(keys), "key").groupBy("key").agg(F.min("html").alias("html"))
        # an empty table has no task that would fit, so a row without a page stands in; it is left out in the task
        alone = spark.range(1).select(F.lit(None).cast("long").alias("key"), F.lit(None).cast("string").alias("html"))
        one = least.unionByName(alone).repartition(1).select("key", "html")
        return one.mapInArrow(_fitted, "useful long, n long, w array<double>, step array<double>").first()

    found = fitted(named)
    if found["n"] == sample and found["useful"] < sample:  # others may stand behind those that do not label themselves
        found = fitted(named.mapInArrow(_self_labelled, "html string, key long"))
    model = (np.array(found["w"]), [list(found["step"][:2]), list(found["step"][2:])])
    return pages.select("page_id", "url", "html").mapInArrow(_extracted(spark.sparkContext.broadcast(model)), "page_id long, url string, text string, n_chars long")
