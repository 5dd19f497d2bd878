import pytest
from pyspark.sql import functions as F

from retentio.llm import main_text as H


@pytest.fixture(scope="module")
def trees(spark, sf_dir):
    return H.fit(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def text_of(trees, html):
    nodes = H.flatten(H.parse(html))
    return H.main_text(nodes, H.decode(nodes, H.log_odds(trees, H.features(nodes))))


def test_rebuilt_pages_not_fitted_on(trees):
    """Held-out layouts: blocks are chosen as their parts say."""
    words = ("Some words of a longer text, which goes on. It has sentences; and marks " * 12).split()
    right = total = 0
    for seed in range(10_000, 10_300):
        nodes = H.flatten(H.parse(H.rebuilt(words, seed)))
        chosen, labels = H.decode(nodes, H.log_odds(trees, H.features(nodes))), H.weak_labels(nodes)
        for n in nodes:
            if n.runs and labels[n.order] is not None:
                total += 1
                right += bool(chosen[n.order]) == bool(labels[n.order])
    assert right / total > 0.98


def test_parts_are_left_out(trees):
    body = "".join(f"<p>This is paragraph {i} of the article, and it says a few things &amp; more.</p>" for i in range(6))
    page = (
        '<body><nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav><div class="cookie-notice">We use cookies.</div>'
        f'<article><h1>The title</h1><script>var t="</p>";</script>{body}</article><aside class="sidebar"><a href="x">Related one</a></aside>'
        '<div id="comments"><p>Nice text, thank you.</p></div><form><p>Your name</p></form><footer>&copy; someone</footer></body>'
    )
    blocks = text_of(trees, page).split("\n\n")
    assert blocks[0] == "The title" and len(blocks) == 7 and blocks[1].endswith("things & more.")


def test_parsing():
    runs = lambda html: [t for n in H.flatten(H.parse(html)) for t in n.runs]
    assert runs("<p>a\n <b>b</b><br>c<p>d&eacute;&#x41;&lt;x") == ["a b c", "déA<x"]
    assert runs("<div>one<p>two</p>three</div>") == ["one", "two", "three"]
    assert runs("<style>p{}</style><script>'</p><p>x'</script><!-- <p>no --><p>yes</p><!-- open") == ["yes"]
    assert runs('<p title="a>b">c</p><p title="x') == ["c"]
    assert runs("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>") == ["a", "b", "c", "d", "e"]
    assert runs("1 < 2 and <3") == ["1 < 2 and <3"]
    assert runs("") == []


def test_unseen_elements_end_where_they_end():
    """Nothing behind a script, head, option or an element left open is lost."""
    runs = lambda html: [t for n in H.flatten(H.parse(html)) for t in n.runs]
    assert runs("<script>for(var i=0;i<n;i++){t+=i}</script><p>a</p><script>var b;</script><p>c</p>") == ["a", "c"]
    assert runs("<script>document.write('<script src=a><\\/script>')</script><p>a</p>") == ["a"]
    assert runs("<script><!-- open\nx()</script><p>a</p><style><!-- p{}</style ><p>b</p>") == ["a", "b"]
    assert runs("<title>1 <b </TITLE><p>a</p><textarea><p></textarea><iframe><!--</iframe>b") == ["a", "b"]
    assert runs("<html><head><meta charset=utf-8><title>t</title><script>1</script><body><p>a</p>") == ["a"]
    assert runs("<head><title>t</title><p>a<div>b</div>") == ["a", "b"]
    assert runs("<datalist><option>x<option value=1>y</datalist><p>a</p><option>z<p>b</p>") == ["a", "b"]
    assert runs("<select><optgroup><option>x<option>y</select>a<div><option>z</div>b") == ["a", "b"]
    assert runs("<div><button>x<p>y</p></div><p>a</p><div><object><div>z</div></div>b") == ["a", "b"]
    assert runs("<svg><title>x</title><style>p{}<p>y</style><foreignObject><div>z</div></foreignObject><path/></svg>a<svg><g><p>b</p>") == ["a", "b"]
    assert runs("<button><script>'</button>'</script>x</button>a<svg><style>") == ["a"]
    assert runs("<template><div>x</p></div></section></template><p>a</p>") == ["a"]


def test_decoding_keeps_parents_and_children_in_step(trees):
    """The chosen total is the best of all consistent choices."""
    from itertools import product

    import numpy as np

    nodes = H.flatten(H.parse("<div><p>a</p><ul><li>b</li><li>c</li></ul></div><p>d</p><div><p>e</p></div>"))
    for seed in range(30):
        odds = np.random.default_rng(seed).normal(size=len(nodes))
        best = max(sum(odds[i] for i, c in enumerate(own) if c) for own in product((0, 1), repeat=len(nodes)) if own[0] and all(own[n.parent.order] for n in nodes[1:] if own[n.order]))
        chosen = H.decode(nodes, odds)
        assert all(chosen[n.parent.order] for n in nodes[1:] if chosen[n.order])
        assert odds[chosen].sum() == pytest.approx(best)


def test_messy_and_empty(spark, trees):
    rows = [(1, "u", None), (1, "u", None), (None, None, ""), (2, "u", "plain text only"), (3, "v", "<div>" * 5000 + "deep"), (4, "w", "<article><p>" + "word " * 50_000 + "</p></article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("text", "n_chars", "x")})
    got = sorted(((r.page_id, r.text[:15], r.n_chars) for r in H.extract(pages, trees).collect()), key=repr)
    assert len(got) == len(rows) and (2, "plain text only", 15) in got and (1, "", 0) in got
    assert (4, "word word word ", 249_999) in got
    assert H.extract(pages.where("false"), trees).collect() == []
    assert len(H.fit(pages.where("false"))) == H.ITERATIONS
