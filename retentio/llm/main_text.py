"""Main-text extraction by gradient-boosted trees over DOM nodes.

A page becomes a tree of block elements; each has features of its subtree
(text and link density, punctuation, sizes), its attribute tokens and those
above it, its depth and its siblings. Boosted trees (pyspark.ml) give the odds
that a node belongs to, or holds, the main text. Decoding picks the set of
nodes of the highest total log odds in which every chosen node's parent is
chosen, so no descendant of a rejected node survives and no container is kept
against all it holds.

The trees are fitted on a bounded sample: ``TRAIN_PAGES`` pages (lowest hash),
each twice, once as it is with labels from telling tags and attributes, and
once rebuilt into a random layout whose parts are known: navigation, headers,
notices, adverts, sidebars, forms, comments, links and footers in several
spellings, with or without semantic tags, around the page's own text.

Scripts, styles, comments and other markup never count as text. As in a
browser, what is inside a script, style, title, textarea, iframe or noscript is
no markup: only its own end tag ends it. Any other unseen element ends at the
latest with the element around it. Character
references are decoded, white space in a block becomes one space, blocks are
joined by an empty line.

Defined results: null html is empty and gives an empty text; a page without
any tags is one block of main text; repeated rows are extracted alike, each for
itself; an empty table gives no rows (and the fit runs on rebuilt pages of fixed words). Other columns are not read.
"""

from __future__ import annotations

import math
import random
import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentio.llm.common import pieces, table

TRAIN_PAGES, ITERATIONS, TREE_DEPTH = 300, 20, 4
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+)>|<[!?][^>]*(?:>|\Z)|<(?=/?[a-zA-Z])[^<>]*\Z|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
LABEL = re.compile(r"data-part=\"([01])\"")
#: Kinds of HTML elements.
RAW = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for name in "script style noscript textarea iframe title".split()}
UNSEEN = frozenset("template svg math canvas object select option button video audio".split()) | RAW.keys()
FOREIGN, EMBEDDING = frozenset("svg math".split()), frozenset("foreignobject desc annotation-xml mi mo mn ms mtext".split())
OPTION_PARENTS = frozenset("select datalist optgroup".split())
BLOCKS = frozenset("html body article main section nav header footer aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre form fieldset figure figcaption details summary dialog address hr menu center".split())
VOID = frozenset("hr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
OUTER_TAGS = frozenset("nav header footer aside form menu dialog".split())
INNER_TAGS = frozenset("article main".split())
PROSE_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
LIST_TAGS = frozenset("ul ol li dl dt dd table tr td th".split())
OUTER_TOKENS = frozenset(
    "ad ads adv advert advertisement banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs pagination header masthead topbar footer bottom sidebar "
    "aside widget rail related recommended more cookie cookies consent notice alert popup modal newsletter subscribe signup login form search comment comments reply replies "
    "disqus discussion respond share sharing social contentinfo complementary copyright legal tags toolbar".split()
)
INNER_TOKENS = frozenset("article articlebody content main post entry story text body maincontent".split())
WORDS = "the a of to and in that it is for on with as was at by from this are or an be which have has had were not but can they more one all time new some these two first also".split()
PUNCTUATION = re.compile(r"[.,;:!?]")
N_FEATURES = 25


class Node:
    __slots__ = ("tag", "parent", "children", "tokens", "label", "runs", "size", "linked", "marks", "words", "nodes", "lists", "prose", "start", "order")

    def __init__(self, tag: str, parent: Node | None, tokens: frozenset, label: int | None):
        self.tag, self.parent, self.tokens, self.label = tag, parent, tokens, label
        self.children, self.runs = [], []
        self.size = self.linked = self.marks = self.words = self.nodes = self.lists = self.prose = self.start = self.order = 0


def parse(html: str) -> Node:
    """Tree of block elements. ``runs`` of a leaf are its text; text beside child elements becomes ``#text`` leaves."""
    root = Node("#root", None, frozenset(), None)
    at, held, links, linked = root, [], 0, 0
    skip, depth, within = "", 0, []  # the unseen element, how often it is open, and the blocks open in it
    endless, pos = set(), 0

    def flush():
        nonlocal held, linked
        text = " ".join("".join(held).split())
        if text:
            leaf = Node("#text", at, frozenset(), None)
            leaf.runs, leaf.size, leaf.linked, leaf.words = [text], len(text), min(linked, len(text)), text.count(" ") + 1
            leaf.marks = len(PUNCTUATION.findall(text))
            at.children.append(leaf)
        held, linked = [], 0

    def close(tags):
        nonlocal at
        node = at
        while node.parent is not None and node.tag not in tags:
            node = node.parent
        if node.parent is not None:
            flush()
            at = node.parent

    def is_open(tag):
        node = at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        return node.tag == tag

    def ends_skip(name, end, closed):
        """Whether the tag ends the unseen element before its own end tag."""
        if not end:
            outside = skip == "option" or (skip in FOREIGN and EMBEDDING.isdisjoint(within))
            if name in BLOCKS and outside:
                return True
            if not closed and (name in EMBEDDING or (name in BLOCKS and name not in VOID)):
                within.append(name)
        elif name in within:
            while within.pop() != name:
                pass
        elif skip != "template":
            return name in BLOCKS and is_open(name)
        return False

    while m := TOKEN.match(html, pos):  # tokens leave no gap
        pos = m.end()
        name = m[2]
        if name is None:
            raw = m[0]
            if not skip and not raw.startswith(("<!", "<?")) and not (raw[0] == "<" and len(raw) > 1):
                text = unescape(raw)
                held.append(text)
                linked += links and len(text.strip())
            continue
        name, end = name.lower(), bool(m[1])
        closed = m[3].endswith("/")
        if name in RAW and not end and not closed and name not in endless:
            behind = RAW[name].search(html, pos)
            if behind:
                pos = behind.end()
            elif skip:
                endless.add(name)
            else:
                break
            continue
        if skip:
            if name == skip and skip != "option":
                depth += -1 if end else not closed
                skip = skip if depth else ""
                continue
            if skip == "option" and (name in OPTION_PARENTS or (end and name == skip)):
                skip = ""
            elif ends_skip(name, end, closed):
                skip = ""
            else:
                continue
        if name in UNSEEN:
            if not end and not closed and name not in RAW:
                skip, depth, within = name, 1, []
            continue
        if name == "a":
            links = max(0, links + (-1 if end else 1))
        elif name == "br":
            held.append(" ")
        elif name in BLOCKS:
            if end:
                close({name})
                links = 0
                continue
            flush()
            links = 0
            if at.tag in PROSE_TAGS and (at.tag == "p" or name in PROSE_TAGS):
                at = at.parent
            elif name in CLOSES:
                node = at
                while node.tag not in CLOSES[name] and node.tag not in LIST_TAGS - CLOSES[name] and node.parent is not None:
                    node = node.parent
                if node.tag in CLOSES[name]:
                    at = node.parent
            if name not in VOID:
                tokens = frozenset(t for a in ATTRIBUTE.findall(m[3]) for t in re.split(r"[^a-z]+", (a[1] or a[2] or a[3]).lower()) if t) if m[3] else frozenset()
                marked = LABEL.search(m[3])
                node = Node(name, at, tokens, int(marked[1]) if marked else None)
                at.children.append(node)
                at = node
    flush()
    return root


def flatten(root: Node) -> list[Node]:
    """Nodes, parents first, with the sums of their subtrees."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        # an element with one text and nothing else is its own leaf
        if len(node.children) == 1 and node.children[0].tag == "#text":
            leaf = node.children.pop()
            node.runs, node.size, node.linked, node.words, node.marks = leaf.runs, leaf.size, leaf.linked, leaf.words, leaf.marks
        node.order = len(out)
        out.append(node)
        stack.extend(reversed(node.children))
    at = 0
    for node in out:
        node.start = at
        at += node.size
    for node in reversed(out):
        node.nodes += 1
        node.lists += node.tag in LIST_TAGS
        node.prose += node.tag in PROSE_TAGS
        if node.parent is not None:
            for s in ("size", "linked", "marks", "words", "nodes", "lists", "prose"):
                setattr(node.parent, s, getattr(node.parent, s) + getattr(node, s))
    return out


def features(nodes: list[Node]) -> np.ndarray:
    out = np.zeros((len(nodes), N_FEATURES), np.float32)
    total = max(1, nodes[0].size)
    above = [(0, 0, 0)] * len(nodes)
    for i, n in enumerate(nodes):
        outer = n.tag in OUTER_TAGS or not OUTER_TOKENS.isdisjoint(n.tokens)
        inner = n.tag in INNER_TAGS or not INNER_TOKENS.isdisjoint(n.tokens)
        up = above[n.parent.order] if n.parent else (0, 0, 0)
        above[i] = (up[0] + 1, up[1] or outer, up[2] or inner)
        family = n.parent.children if n.parent else [n]
        size = max(1, n.size)
        out[i, :23] = (
            up[0], math.log1p(n.size), n.linked / size, math.log1p(n.nodes), math.log1p(n.size / n.nodes), n.marks / size * 100, math.log1p(n.words),
            len(family), 0, n.size / max(1, n.parent.size if n.parent else n.size), n.size / total, n.lists / n.nodes, math.log1p(n.prose),
            n.tag in OUTER_TAGS, n.tag in INNER_TAGS, n.tag in PROSE_TAGS, n.tag in LIST_TAGS, n.tag == "#text",
            not OUTER_TOKENS.isdisjoint(n.tokens), not INNER_TOKENS.isdisjoint(n.tokens), up[1], up[2], n.start / total,
        )
        kids = n.children
        for k, c in enumerate(kids):
            out[c.order, 8] = k / len(kids)
            out[c.order, 23] = kids[k - 1].linked / max(1, kids[k - 1].size) if k else -1
            out[c.order, 24] = kids[k + 1].linked / max(1, kids[k + 1].size) if k + 1 < len(kids) else -1
    return out


def weak_labels(nodes: list[Node]) -> list[int | None]:
    """0 at and below telling outer parts, 1 inside and above telling inner ones, else unknown."""
    out: list[int | None] = [None] * len(nodes)
    for i, n in enumerate(nodes):
        up = out[n.parent.order] if n.parent else None
        if n.label is not None:
            out[i] = n.label
        elif up == 0 or n.tag in OUTER_TAGS or not OUTER_TOKENS.isdisjoint(n.tokens):
            out[i] = 0
        elif up == 1 or n.tag in INNER_TAGS or ("itemprop" in n.tokens and "articlebody" in n.tokens):
            out[i] = 1
    for n in reversed(nodes):
        if out[n.order] == 1 and n.parent is not None and out[n.parent.order] is None:
            out[n.parent.order] = 1
    return out


def rebuilt(words: list[str], seed: int) -> str:
    """A page of a random layout around ``words``; data-part tells main text (1) from the rest (0)."""
    r = random.Random(seed)
    words = words if len(words) >= 40 else words + WORDS
    semantic = r.random() < 0.5

    def some(a, b):
        n, at = r.randint(a, b), r.randrange(len(words))
        return " ".join((words + words)[at : at + n])

    def part(tag, names, inside, label=0):
        own = tag if semantic and tag else r.choice(("div", "section"))
        name = r.choice(names) if names else ""
        attr = f' {r.choice(("class", "id"))}="{name}"' if name and (own != tag or r.random() < 0.5) else ""
        return f'<{own}{attr} data-part="{label}">{inside}</{own}>'

    def links(a, b):
        return "<ul>" + "".join(f'<li><a href="/x">{some(1, 4)}</a></li>' for _ in range(r.randint(a, b))) + "</ul>"

    def paragraphs(a, b, low=8, high=90):
        return "".join(f"<p>{some(low, high)}.</p>" for _ in range(r.randint(a, b)))

    outer = [
        lambda: part("nav", ["menu", "nav", "navbar main-navigation", "breadcrumb"], links(3, 9)),
        lambda: part("header", ["header", "masthead site-header", "topbar"], f"<h2>{some(1, 4)}</h2><p>{some(2, 8)}</p>" + (links(2, 5) if r.random() < 0.5 else "")),
        lambda: part("", ["ad", "ads", "advert", "banner", "sponsored promo"], some(3, 25) if r.random() < 0.5 else f"<p>{some(3, 25)}.</p>"),
        lambda: part("aside", ["sidebar", "widget", "related", "right-rail"], f"<h3>{some(1, 3)}</h3>" + (links(3, 8) if r.random() < 0.6 else paragraphs(1, 3, 4, 25))),
        lambda: part("", ["cookie-notice", "notice", "alert", "consent popup"], f"<p>{some(5, 30)}.</p>"),
        lambda: f'<form data-part="0"><label>{some(1, 3)}</label><p>{some(1, 8)}</p><input name="q"></form>',
        lambda: part("", ["share", "social", "newsletter signup", "search"], some(2, 8)),
    ]
    comments = "".join(f'<{t} class="comment"><p>{some(1, 2)}</p><p>{some(4, 40)}.</p></{t}>' for t in (r.choice(("div", "li", "article")),) for _ in range(r.randint(1, 5)))
    after = [
        lambda: part("section", ["comments", "comment-list", "discussion", "replies"], f"<h3>{some(1, 2)}</h3>{comments}").replace("<section data-part", '<section id="comments" data-part'),
        lambda: part("footer", ["footer", "site-footer", "bottom", "copyright"], f"&copy; {some(2, 12)}." if r.random() < 0.5 else f"<p>{some(3, 15)}</p>{links(2, 5)}"),
    ]
    inside = f"<h1>{some(3, 12)}</h1>"
    for _ in range(r.randint(1, 14)):
        kind = r.random()
        inside += f"<p>{some(1, 110)}.</p>" if kind < 0.8 else f"<h2>{some(2, 7)}</h2>" if kind < 0.87 else f"<blockquote>{some(5, 40)}</blockquote>" if kind < 0.92 else "<ul>" + "".join(f"<li>{some(3, 25)}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
        if r.random() < 0.06:
            inside += r.choice((outer[2], outer[6], outer[4], outer[3]))()
    main = part(r.choice(("article", "main")), ["content", "post", "article-body", "entry", "story", "", "main"], inside, 1)
    if r.random() < 0.3:
        main = f"<div>{main}</div>"
    before = "".join(f() for f in r.sample(outer, r.randint(1, 4)))
    behind = "".join(f() for f in r.sample(outer, r.randint(0, 3))) + "".join(f() for f in after if r.random() < 0.7)
    return f"<html><head><title>{some(2, 6)}</title><script>var a=1;</script></head><body>{before}{main}{behind}</body></html>"


def visible_words(html: str) -> list[str]:
    return [w for n in flatten(parse(html)) for t in n.runs for w in t.replace("<", " ").replace("&", " ").split()]


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> list[tuple]:
    """Boosted trees as (feature, threshold, left, right, value) arrays; values hold their tree's weight."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    spark = pages.sparkSession
    picked = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(html_col), F.lit("")).alias("html")).orderBy(F.xxhash64("id"), "id", F.md5("html")).limit(TRAIN_PAGES)

    def examples(batches):
        for part in pieces(batches, 16):
            rows, ys = [], []
            for k, html in enumerate(part.column("html").to_pylist()):
                seed = part.column("id")[k].as_py() or 0
                # a very long page's words are drawn from, not copied whole
                for source in (html, rebuilt(visible_words(html), seed), rebuilt(visible_words(html), ~seed)):
                    nodes = flatten(parse(source))
                    for x, y in zip(features(nodes), weak_labels(nodes), strict=True):
                        if y is not None:
                            rows.append(x)
                            ys.append(float(y))
            yield pa.RecordBatch.from_arrays([pa.array([r.tolist() for r in rows], pa.list_(pa.float64())), pa.array(ys, pa.float64())], names=["x", "label"])

    fixed = spark.createDataFrame([(i, "") for i in range(20)], "id long, html string")
    made = picked.unionByName(fixed).repartition(4).mapInArrow(examples, "x array<double>, label double").select(array_to_vector("x").alias("features"), "label").persist()
    try:
        model = GBTClassifier(maxIter=ITERATIONS, maxDepth=TREE_DEPTH, stepSize=0.3, minInstancesPerNode=5, seed=11).fit(made)
    finally:
        made.unpersist()
    trees = []
    for tree, weight in zip(model.trees, model.treeWeights, strict=True):
        nodes: list[list] = []

        def walk(node, nodes=nodes, weight=weight):
            at = len(nodes)
            nodes.append([-1, 0.0, at, at, weight * node.prediction()])
            if node.subtreeDepth() > 0:
                split = node.split()
                nodes[at][:2] = [split.featureIndex(), split.threshold()]
                nodes[at][2] = walk(node.leftChild())
                nodes[at][3] = walk(node.rightChild())
            return at

        walk(tree._java_obj.rootNode())
        f, t, a, b, v = zip(*nodes, strict=True)
        trees.append((np.maximum(np.array(f), 0), np.array(t), np.array(a), np.array(b), np.array(v)))
    return trees


def log_odds(trees: list[tuple], x: np.ndarray) -> np.ndarray:
    """Twice the trees' weighted sum: the log odds under the boosting loss."""
    total = np.zeros(len(x))
    rows = np.arange(len(x))
    for feature, threshold, left, right, value in trees:
        at = np.zeros(len(x), np.int64)
        for _ in range(TREE_DEPTH):
            at = np.where(x[rows, feature[at]] <= threshold[at], left[at], right[at])
        total += value[at]
    return 2 * total


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """Chosen nodes: the best total in which every chosen node but the root has a chosen parent."""
    best = odds.astype(float).copy()
    for n in reversed(nodes[1:]):
        if best[n.order] > 0:
            best[n.parent.order] += best[n.order]
    chosen = np.zeros(len(nodes), bool)
    chosen[0] = True  # the root stands for the page
    for n in nodes[1:]:
        chosen[n.order] = chosen[n.parent.order] and best[n.order] > 0
    return chosen


def main_text(nodes: list[Node], chosen: np.ndarray) -> str:
    return "\n\n".join(t for n in nodes if chosen[n.order] for t in n.runs)


def extract(pages: DataFrame, trees: list[tuple], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: page_id, url, text, n_chars, n_nodes, n_chosen."""
    types = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html"))

    def run(batches):
        for part in pieces(batches, 32):
            trees_of = [flatten(parse(h or "")) for h in part.column("html").to_pylist()]
            odds = log_odds(trees, np.concatenate([features(n) for n in trees_of]))
            texts, counts, at = [], [], 0
            for nodes in trees_of:
                chosen = decode(nodes, odds[at : at + len(nodes)])
                at += len(nodes)
                texts.append(main_text(nodes, chosen))
                counts.append((len(nodes), int(chosen.sum())))
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([a for a, _ in counts], pa.int64()), pa.array([b for _, b in counts], pa.int64())], names=["page_id", "url", "text", "n_chars", "n_nodes", "n_chosen"])

    return rows.mapInArrow(run, f"page_id {types[0]}, url {types[1]}, text string, n_chars long, n_nodes long, n_chosen long")


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, fit(pages)).select("page_id", "url", "text", "n_chars")


QUERIES = {"op6_main_text": op6_main_text}

SQL = {
    "op6_main_text": r"""
WITH a AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*?)</article>', 1) AS h FROM pages),
b AS (
  SELECT page_id, url, generate_subscripts(string_split_regex(h, '</?(?:p|h1|h2|h3|div|ul|li|section)(?: [^>]*)?>'), 1) AS i,
         unnest(string_split_regex(h, '</?(?:p|h1|h2|h3|div|ul|li|section)(?: [^>]*)?>')) AS t FROM a),
c AS (
  SELECT page_id, url, i, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(t, '<br ?/?>', ' ', 'g'), '<[^>]*>', '', 'g'),
         '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) AS t FROM b),
d AS (SELECT page_id, url, string_agg(t, chr(10) || chr(10) ORDER BY i) AS text FROM c WHERE t <> '' GROUP BY page_id, url)
SELECT a.page_id, a.url, coalesce(d.text, '') AS text, CAST(length(coalesce(d.text, '')) AS BIGINT) AS n_chars
FROM a LEFT JOIN d ON a.page_id = d.page_id
"""
}
