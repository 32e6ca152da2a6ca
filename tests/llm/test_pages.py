"""Main text of pages: hand-made cases and held-out labelled pages."""

import html
import itertools
import math
import random

import pytest

from docsentry.llm import html_extraction as E


@pytest.fixture(scope="module")
def model():
    return E.train(E.labelled_pages())


LONG = "This is a sentence of the story, long enough to count. And here is one more of them, with a comma."
PAGES = [
    (f"<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><div class=\"ad\">{LONG}</div><article><h1>Title &amp; more</h1><p>{LONG}</p></article><footer>&copy; me</footer></body></html>", f"Title & more\n{LONG}"),
    (f"<body><article><h1>T</h1><p><b>a  b\n c.<br><p>{LONG}<script>var t='</p>';</script></article><!-- x --><footer>f</footer>", f"T\na b c.\n{LONG}"),
    (f"<body><header>Site</header><article><p>{LONG}</p><section class='comments'><div class='comment'><p>{LONG}</p></div></section></article><aside><p>{LONG}</p></aside>", LONG),
    (f"<body><div class='cookie-notice'><p>{LONG}</p></div><form><p>{LONG}</p><input></form><article><p>{LONG} &#233;&nbsp;x</p></article>", f"{LONG} é x"),
    ("", ""),
    (None, ""),
    ("<", ""),
    ("<script>never closed <p>x", ""),
    ("<!-- never closed <article><p>x</p></article>", ""),
]


@pytest.mark.parametrize("number", range(len(PAGES)))
def test_pages(model, number):
    source, expected = PAGES[number]
    assert model.extract(source) == expected


def test_hostile_pages_finish(model):
    for source in ("<div>" * 20000, "</div>" * 20000, "<p" * 20000, "<a href='" * 5000, "<" * 50000, "&" * 50000, "<article><p>" + "x " * 300000):
        model.extract(source)


def test_held_out_pages(model):
    right = whole = 0
    for source in E.labelled_pages(200, seed=77):
        page = E.parse(source)
        truth = E.labels_of(page)
        marginal, _ = model.marginals(page, model.potentials(E.features(page)))
        nodes = {n for n, _ in page.blocks}
        right += sum((marginal[n] > 0.5) == truth[n] for n in nodes)
        whole += len(nodes)
    assert right >= 0.98 * whole


def test_marginals_equal_enumeration():
    draw = random.Random(4)
    page = E.Page(tags=["html", "body", "div", "p", "p", "div"], parents=[-1, 0, 1, 2, 2, 1])
    model = E.Model()
    model.edges = [[[draw.gauss(0, 1) for _ in (0, 1)] for _ in (0, 1)] for _ in (0, 1)]
    scores = [draw.gauss(0, 1) for _ in page.tags]
    total, ones = 0.0, [0.0] * 6
    for labels in itertools.product((0, 1), repeat=6):
        weight = sum(s for s, y in zip(scores, labels, strict=True) if y)
        weight += sum(model.edges[page.tags[p] in ("html", "body")][labels[p]][labels[i]] for i, p in enumerate(page.parents) if p >= 0)
        total += math.exp(weight)
        ones = [o + math.exp(weight) * y for o, y in zip(ones, labels, strict=True)]
    marginal, joint = model.marginals(page, scores)
    assert all(abs(m - o / total) < 1e-9 for m, o in zip(marginal, ones, strict=True))
    assert all(abs(sum(map(sum, table)) - 1) < 1e-9 for table in joint[1:])


def test_operator_keeps_every_row(spark, model):
    df = spark.createDataFrame([(i, "u", s, "x") for i, (s, _) in enumerate(PAGES)], "page_id long, url string, html string, text string")
    out = E.extract(df, model)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert {r["page_id"]: (r["text"], r["n_chars"]) for r in out.collect()} == {i: (t, len(t)) for i, (_, t) in enumerate(PAGES)}
    assert E.extract(df.limit(0), model).count() == 0


def test_every_page_of_the_table(spark, sf, model):
    import re

    for r in E.extract(spark.read.parquet(f"{sf}/pages.parquet"), model, ("page_id", "html")).collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(b for b in blocks if b)
