"""Leaf blocks of messy pages, the field against enumeration, held-out labelled pages and the pages of the test table."""

import html
import itertools
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkstone.llm import html_extraction as extraction
from inkstone.llm import queries
from inkstone.llm.html_blocks import Place, blocks
from inkstone.llm.labelled_pages import LABELS, labelled_pages

DATA = "/root/testdata/sf0.001"


def texts(page):
    return [b.text for b in blocks(page, Place(None, "", ""))]


@pytest.fixture(scope="module")
def model():
    return extraction.fit()


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", []),
        ("plain", ["plain"]),
        ("<p>a <b>b</b>c<p>d<br>e", ["a bc", "d e"]),
        ("<div>x<p>y</p>z</div>", ["x", "y", "z"]),
        ("<ul><li>1<li>2<ul><li>3</ul>4</ul>5", ["1", "2", "3", "4", "5"]),
        ("<table><tr><td>1<td>2<tr><th>3</table>", ["1", "2", "3"]),
        ("a<!-- <p>no --> b<!-->c<!-- open", ["a bc"]),
        ("<script>var t='</p><p>';</script><style>p{}</style><title>t</title>x", ["x"]),
        ("<SCRIPT>a</Script >b<script>never closed <p>c", ["b"]),
        ('<p title="a>b" class=\'c>d\'>e</p>', ["e"]),
        ("<p title=it's>it's</p><p>so</p>", ["it's", "so"]),
        ('<a href="x>y', ["y"]),
        ('<a href="x>y</a><p>z', ["y", "z"]),
        ("1 < 2 &lt; 3 &amp;amp; &#233;&#x41; &copy; &unknown; &nbsp; x", ["1 < 2 < 3 &amp; éA © &unknown; x"]),
        ("<p>a\n\t b 　c </p>  <p> </p>", ["a b c"]),
        ("</p></div>x</p>y", ["x", "y"]),
        ("<div><p>a</div>b<section>c</article>d</section>", ["a", "b", "c", "d"]),
        ("<p>a<svg><text>no</text></svg>b<textarea>no</textarea>", ["a", "b"]),
        ("<p>" + "x" * 300_000 + "</p>", ["x" * 300_000]),
    ],
)
def test_blocks(page, want):
    assert texts(page) == want


def test_places():
    found = blocks('<body><article class="postBody main-2"><p>a <a href=x>b</a></p></article><div hidden id=Ad><i>c</i></div>', Place(None, "", ""))
    assert found[0].where.tags == {"", "body", "article", "p"} and found[0].where.within == {"post", "body", "main"} and 0 < found[0].linked < 0.5
    assert found[1].where.names == {"(hidden)", "ad"} and found[1].where.tag == "div"


def test_deep_and_wide():
    assert texts("<div>" * 20_000 + "x" + "</div>" * 20_000 + "y") == ["x", "y"]
    assert len(texts("<p>a" * 50_000)) == 50_000


def test_viterbi_like_enumeration():
    rng = np.random.default_rng(1)
    k = len(LABELS)
    model = extraction.Model({}, np.zeros((0, k)), rng.normal(size=(k, k)), rng.normal(size=k), rng.normal(size=k))
    sizes = [3, 0, 1, 5, 0]
    emit = rng.normal(size=(sum(sizes), k))
    got, at = extraction.viterbi(model, emit, sizes), 0
    for n in sizes:
        e = emit[at : at + n]

        def score(path, e=e):
            return sum(e[i, p] for i, p in enumerate(path)) + sum(model.steps[a, b] for a, b in zip(path, path[1:])) + model.first[path[0]] + model.last[path[-1]]

        if n:
            assert tuple(got[at : at + n]) == max(itertools.product(range(k), repeat=n), key=score)
        at += n


def test_training_raises_the_likelihood_of_enumerated_paths():
    """One feature a label and a forced order: the trained field gives the labels it has seen."""
    labels = np.array([0, 1, 2, 0, 1, 2, 0, 1])
    model = extraction._trained({"x": 0, "y": 1}, np.array([0, 1, 1] * 2 + [0, 1]), np.arange(9), labels, np.array([3, 3, 2]))
    assert list(extraction.viterbi(model, model.weights[[0, 1, 1, 0, 1]], [3, 2])) == [0, 1, 2, 0, 1]


def test_held_out_labelled_pages(model):
    extractor, exact, right, count = extraction.Extractor(model), 0, 0, 0
    for page, labels in labelled_pages(200, 7):
        found = blocks(page, Place(None, "", ""))
        want = "\n".join(b.text for b, label in zip(found, labels, strict=True) if label == 0)
        got = extractor.texts([page])[0]
        exact += got == want
        kept = set(got.split("\n"))
        right += sum((b.text in kept) == (label == 0) for b, label in zip(found, labels, strict=True))
        count += len(labels)
    assert exact >= 160 and right / count > 0.97


def test_all_parts_of_a_page(model):
    page = """<html><head><title>T</title></head><body><div class="cookie-notice"><p>We use cookies here.</p><button>OK</button></div>
      <header><div class="logo">My site</div><nav><a href=/>Home</a> <a href=/n>News</a></nav></header>
      <main><article><h1>A title</h1><p>First paragraph of the text, with <a href=/x>a link</a> in it.</p><div class="ad">Buy this thing now.</div>
      <p>Short.</p><ul><li>One point.</li><li>Another point.</li></ul><form><p>Your email</p><button>Subscribe</button></form>
      <p>Last &amp; longest paragraph, which goes on for a while and then ends.</p></article></main>
      <aside class="sidebar"><h3>Related</h3><ul><li><a href=/1>Some other story of the day</a></li></ul></aside>
      <section id="comments"><h3>2 comments</h3><div class="comment"><p>Ann says:</p><p>I liked this text. It is long and good.</p></div></section>
      <footer>&copy; 2020 My site</footer></body></html>"""
    want = "A title\nFirst paragraph of the text, with a link in it.\nShort.\nOne point.\nAnother point.\nLast & longest paragraph, which goes on for a while and then ends."
    assert extraction.Extractor(model).texts([page, None, ""]) == [want, "", ""]


def test_test_table(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    rows = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    want = {}
    for r in rows:
        inner = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        parts = (" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner))
        want[r["page_id"]] = (r["url"], "\n".join(x for x in parts if x))
    got = queries.QUERIES["op12_html_extraction"](spark, DATA).collect()
    assert len(got) == len(rows) and all((r["url"], r["text"]) == want[r["page_id"]] and r["n_chars"] == len(r["text"]) for r in got)


def test_odd_rows(spark, model):
    rows = [(None, None, None), (1, "u", ""), (1, "u", ""), (2, "u", "<article><p>Hello there.</p></article>"), (3, "v", "<article><p>" + "Many words here. " * 20_000 + "</p></article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x")).withColumn("a.b", F.lit(1))
    got = sorted((tuple(r) for r in extraction.extract(pages, model).collect()), key=repr)
    assert [(r[0], r[3]) for r in got] == [(1, 0), (1, 0), (2, 12), (3, 339_999), (None, 0)]
    assert extraction.extract(pages.limit(0), model).columns == ["page_id", "url", "text", "n_chars"]
    assert extraction.extract(pages.limit(0), model).collect() == []
