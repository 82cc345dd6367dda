import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import data_dir
from seqcast.llm.boosting import boost
from seqcast.llm.html_extract import NOISE, Layouts, decode, extract, main_text, train_extractor
from seqcast.llm.html_tree import FEATURES, node_features, parse

PROSE = [f"This is sentence {i}, which has a number of words in it. It goes on for a while, and then it ends." for i in range(40)]


@pytest.fixture(scope="module")
def learned(spark):
    rows = spark.read.parquet(f"{data_dir('0.01')}/pages.parquet").orderBy("page_id").limit(150).collect()
    return rows, train_extractor([r.html for r in rows if len(r.html) < 20_000])


@pytest.mark.parametrize("html, blocks", [
    ("<p>a<p>b</p>c", ["a", "b", "c"]),
    ("<p><b>bold <i>it</i><br><p>next</p>", ["bold it", "next"]),
    ("x<!-- <p>no</p> -->y<script>if (a<b) {'</p>'}</script>z", ["xyz"]),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]),
    ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
    ("&lt;b&gt; &amp;amp; caf&eacute; &#x41;&#66; a&nbsp;&nbsp;b\n\t c", ["<b> &amp; café AB a b c"]),
    ("<head><title>no</title></head><body>yes", ["yes"]), ("<head><meta x><body>yes", ["yes"]),
    ("<title>no</title>yes<style>p{}</style><textarea>no</textarea>", ["yes"]),
    ("</p></div>a</span>", ["a"]), ("a < b and c > d", ["a < b and c > d"]), ("<p title='a>b' x=\">\">q</p>", ["q"]),
    ("<p unclosed 'quote>a</p><p>b</p>", ["a", "b"]), ("<script>never ends <p>a", []), ("<!-- never ends <p>a", []), ("", []), ("<", ["<"]),
    ("<article><h1>T</h1><template>t<p>after</p></article>", ["T", "t", "after"]), ("a<svg><p>b", ["a", "b"]), ("a<noscript>n<p>b", ["a", "n", "b"]),
    ("a<canvas>c<p>b<video>v</p>d", ["a", "c", "b", "v", "d"]), ("a<svg><text>no</text></svg>b", ["ab"]), ("<p>x <math><mi>y</mi></math> z</p>", ["x", "y", "z"]),
    ("<object>o</object><p>b", ["o", "b"]), ("a<textarea>never ends <p>b", ["a"]), ("<audio>no</audio><p>b<audio>c", ["b", "c"]),
    ("<ul><li>a<div>b<ul></li>c<li>d</ul></li>e", ["a", "b", "c", "d", "e"]), ("<table><tr><td><li>a</td>b</table></li>c", ["a", "b", "c"]),
    ("<DIV>A</DIV><Br/>B<hr>C", ["A", "B", "C"]), ("<p>a<div", ["a"])])
def test_blocks(html, blocks):
    tree = parse(html)
    assert tree.texts == blocks
    assert node_features(tree).shape == (len(tree.tags), len(FEATURES))


@pytest.mark.parametrize("part", ["<div>", "<div><p>", "<svg>", "<ul><li>x", "<li>", "<div></li>", "<p><b>", "<table><tr><td>"])
def test_time_grows_with_the_page(part):
    def seconds(n):
        page, started = part * n + "text", time.process_time()
        parse(page)
        return time.process_time() - started

    seconds(2000)
    assert seconds(60_000) < 12 * max(0.05, seconds(12_000))


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 5))
    y = ((x[:, 0] > 0.5) & (x[:, 2] < 0.3)).astype(float)
    model = boost(x, y, trees=20)
    z = rng.random((1000, 5))
    assert ((model.margin(z) > 0) == ((z[:, 0] > 0.5) & (z[:, 2] < 0.3))).mean() > 0.97
    assert boost(x[:0], y[:0], trees=2).margin(z).tolist() == [0] * 1000


def test_decoding_never_contradicts():
    """Against every assignment of keep, drop and split on small trees."""
    from itertools import product

    rng = np.random.default_rng(1)
    for _ in range(60):
        tree = parse("".join(rng.choice(["<div>", "</div>", "text words", "<p>more"], 9)))
        n, margin = len(tree.tags), rng.normal(size=50)
        m, w = np.clip(margin[:n], -4, 4), np.zeros(n)
        for o, t in zip(tree.owners, tree.texts):
            w[o] += np.log1p(len(t))
        best = -np.inf
        for state in product((1, -1, 0), repeat=n):
            if any(p >= 0 and state[p] and state[p] != s for s, p in zip(state, tree.parents)):
                continue
            best = max(best, sum(s * a * b if s else abs(a * b) - 1.0 for s, a, b in zip(state, m, w)))
        kept = decode(tree, margin[:n])
        # The best score of an assignment that gives the same blocks.
        same = max(sum(s * a * b if s else abs(a * b) - 1.0 for s, a, b in zip(state, m, w)) for state in product((1, -1, 0), repeat=n)
                   if not any(p >= 0 and state[p] and state[p] != s for s, p in zip(state, tree.parents))
                   and [state[o] > 0 or (state[o] == 0 and m[o] > 0) for o in tree.owners] == kept)
        assert same == pytest.approx(best)


def test_real_pages(learned):
    import html
    import re

    rows, model = learned
    for r, got in zip(rows, extract([r.html for r in rows], model)):
        inside = re.sub(r"</?(p|h1)>", "\0", re.search("<article>(.*)</article>", r.html, re.S)[1])
        want = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in inside.split("\0")]
        assert got == "\n\n".join(b for b in want if b)


def test_other_layouts(learned):
    _, model = learned
    made, seen, right = Layouts(5, PROSE), 0, 0
    for i in range(150):
        tree = parse(made.page(f"Title {i} of a page", PROSE[i % 30: i % 30 + 1 + i % 8]))
        kept = decode(tree, model.margin(node_features(tree)))
        seen += len(kept)
        right += sum(k != (NOISE in t) for k, t in zip(kept, tree.texts))
    assert right / seen > 0.98


def test_a_page_by_hand(learned):
    _, model = learned
    body = "".join(f"<p>{p}</p>" for p in PROSE[:4])
    page = (f"<html><head><title>T</title></head><body><header class=site-header><a href=/>Home</a></header><ul class=menu><li><a href=/a>News</a></li><li><a href=/b>Sport</a></li></ul>"
            f"<div class='cookie-notice'>We use cookies. <button>OK</button></div><div class=content><h1>A headline</h1>{body}</div>"
            f"<div class=sidebar><h3>Related</h3><ul><li><a href=/c>Other story</a></li></ul></div><form class=newsletter>Sign up <input><button>Go</button></form>"
            f"<section class=comments><div class=comment><p>Me</p><p>{PROSE[20]}</p></div></section><footer>&copy; all rights</footer></body></html>")
    assert extract([page], model) == ["\n\n".join(["A headline", *PROSE[:4]])]


def test_edge_cases(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "no markup at all"), (None, "u", "<article><p>x</p></article>"), (4, "u", "<p>" * 3000 + "deep"),
            (5, "u", "<div>" * 2000 + "deep" + "</div>" * 2000), (5, "u", "<p>" + "long text. " * 50_000), (6, "u", "<" * 5000), (7, "u", "<a '" * 3000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit(2))
    got = main_text(df).collect()
    assert len(got) == 9 and all(r.n_chars == len(r.text) for r in got)
    assert {r.text for r in got if r.page_id in (1, 2)} == {""}
    assert main_text(df.limit(0)).count() == 0
