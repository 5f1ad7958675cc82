import html
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabflow.llm.blocks import page_blocks
from tabflow.llm.pages import INPUT, Labeller, Vectors, extracted, fit_pages, main_text, train

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return fit_pages(spark.read.parquet(f"{FOLDER}/pages.parquet"))


def plain(page):
    inside = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)
    return " ".join(html.unescape(re.sub(r"<[^>]*>?", " ", re.sub(r"</?b>", "", inside[1]))).split()) if inside else ""


def test_pages_equal_their_articles(spark, model):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    texts = {r.page_id: r.html for r in pages.collect()}
    rows = extracted(pages, model).collect()
    assert len(rows) == len(texts)
    assert sum(r.text != plain(texts[r.page_id]) for r in rows) <= len(rows) // 200
    assert all(r.n_chars == len(r.text) for r in rows)


OTHERS = [
    ("""<html><body><header><div>Site name</div><nav><a href=x>Home</a></nav></header><div class="cookie-notice"><p>We use cookies on this site.</p></div><main><h1>Real title of it</h1>
    <p>First paragraph of the <a href=y>article</a> text is here, and it is long enough.</p><div class="advert">Buy it now!</div><p>Second paragraph follows the advert, with more words.</p>
    <form><label>Your mail</label><button>Send</button></form><section id="comments"><h2>Comments</h2><p>Great article, thanks a lot for this.</p></section></main><aside>See also: other</aside>
    <footer>(c) 2020</footer></body></html>""",
     "Real title of it First paragraph of the article text is here, and it is long enough. Second paragraph follows the advert, with more words."),
    ("""<body><div class=notice>This site will be down on Monday for some hours.</div><div id=content><h1>Title</h1><p>Para one is here &amp; it has an entity.</p>
    <p>Para two&nbsp;is here.</p></div><div class=related>Related: a, b</div><form><p>Search the site</p><input></form>""", "Title Para one is here & it has an entity. Para two is here."),
]


@pytest.mark.parametrize(("page", "want"), OTHERS)
def test_other_layouts(model, page, want):
    assert main_text([page], model, Vectors()) == [want]


def test_blocks():
    page = """<!DOCTYPE html><title>no</title><script>var t = "</p><p>no";</script><STYLE>p{}</STYLE><!-- <p>no</p> --><p class='a b2' title="x>y">one <b>t</b>wo<br>three &amp; &copy;<p>four
    <ul><li>five<li>six <a href=1>link</a></ul>a < b<div/><div>seven</div></span></nope></div>eight <!-- open <p>no"""
    blocks = page_blocks(page)
    assert [b.text for b in blocks] == ["one two three & ©", "four", "five", "six link", "a < b", "seven", "eight"]
    assert blocks[0].path[:2] == ("leaf:p", "p") and ".a" in blocks[0].path and blocks[3].linked == 4
    assert [b.text for b in page_blocks("x &am")] == ["x &am"] and [b.text for b in page_blocks("x<p>y<di")] == ["x", "y"]
    assert page_blocks("") == [] and page_blocks("<p") == [] and page_blocks("<script>x") == []
    assert len(page_blocks("<div>" * 30_000 + "x" + "</div>" * 30_000)) == 1


def test_gradient():
    """The backward pass against differences."""
    rng = np.random.default_rng(0)
    model = Labeller({k: v.astype(np.float64) for k, v in Labeller.random(3).p.items()})
    x = rng.normal(size=(4, 3, INPUT)) * 0.2
    y, mask = rng.integers(0, 2, (4, 3)).astype(float), np.ones((4, 3))
    mask[2:, 1] = 0
    _, grads = model.step(x, mask, y, mask)
    for name in model.p:
        flat = model.p[name].reshape(-1)
        for i in rng.choice(flat.size, 2):
            keep, e = flat[i], 1e-4
            flat[i] = keep + e
            up = model.step(x, mask, y, mask)[0]
            flat[i] = keep - e
            down = model.step(x, mask, y, mask)[0]
            flat[i] = keep
            assert grads[name].reshape(-1)[i] == pytest.approx((up - down) / (2 * e), rel=2e-2, abs=2e-5)


def test_batches_do_not_matter(model):
    rng = np.random.default_rng(1)
    x = model.project(rng.normal(size=(60, INPUT)).astype(np.float32))
    starts = np.array([0, 10, 10, 11, 40, 60])
    assert np.allclose(model.probabilities(x, starts), model.probabilities(x, starts, cells=1), atol=1e-5)


def test_edges(spark, model):
    rows = [(None, None, None), (1, "u", None), (2, None, ""), (3, "u", "<html><body></body></html>"), (4, "u", "<article><p>" + "Long text of many words. " * 40_000), (5, "u", "<article>" + "<p>Some words of text here.</p>" * 4000),
            (5, "u", "<nav>Menu</nav>"), (5, "u", "<nav>Menu</nav>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit("clash")).withColumn("text", F.lit(0))
    out = extracted(pages, model).collect()
    assert len(out) == len(rows)
    assert [r.text for r in out if r.page_id in (None, 1, 2, 3)] == [""] * 4
    assert next(r for r in out if r.page_id == 4).n_chars == len("Long text of many words. " * 40_000) - 1
    assert max(r.n_chars for r in out if r.page_id == 5) == 25 * 4000 - 1 and sum(r.text == "" for r in out if r.page_id == 5) == 2
    assert extracted(pages.limit(0), model).count() == 0
    assert isinstance(fit_pages(pages.limit(0)), Labeller) and isinstance(train([]), Labeller)


def test_embedded_elements_lose_nothing():
    texts = lambda page: [b.text for b in page_blocks(page)]
    assert texts('<svg class="i"/><p>two</p><p>three</p>') == ["two", "three"]
    assert texts('<p>one <svg class="i"><title/><path d="x"/></svg> more</p><p>two') == ["one", "more", "two"]
    for tag in ("object", "video", "audio", "canvas", "svg", "select"):
        assert texts(f"<article><p>one</p><{tag} data=a><p>rest</p></article><p>two") == ["one", "rest", "two"]
    assert texts('<p>We have <math display="x"><mi>x</mi><mo>=</mo><mn>1</mn></math> here.</p>') == ["We have x=1 here."]
    assert texts('<script src="a"/><p>one</p><iframe src="b" /><textarea/><p>two</p><script>no</script><script src=/c/>no</script>') == ["one", "two"]
    assert texts("<p>one</p><select><option>a<optgroup label=x><option>b</select><p>two</p><video>no video</video>") == ["one", "two", "no video"]
    path = page_blocks(f"<div style='{'x' * 5000}' data-a='{'y' * 5000}' class=footer>one</div>")[0].path
    assert ".footer" in path
    assert "video" in page_blocks("<p>a<video>b</video>c")[1].path and page_blocks("<p>a<video>b</video>c")[2].path == page_blocks("<p>c")[0].path
    page = '<video src="a">' * 20_000 + "<script>" * 20_000
    assert texts(page + "<p>x") == []


UTILITY = "alpha beta body-x card col container dark flex gap grid hidden inner large"
ARTICLE = "<h1>A title of some words</h1><p>The first paragraph of the text is here, and it is long enough.</p><p>A second paragraph follows, with more words in it.</p>"
TEXT = "A title of some words The first paragraph of the text is here, and it is long enough. A second paragraph follows, with more words in it."


def test_all_names_and_the_whole_path(model):
    block = page_blocks(f'<div class="{UTILITY} sidebar">{"<div>" * 30}<p>x')[0]
    assert {".sidebar", ".alpha", ".large", "leaf:p"} <= set(block.path)
    assert "in:aside" in page_blocks("<aside>" + "<section>" * 10 + "<p>x")[0].path
    deep, back = "<div>" * 30, "</div>" * 30
    for article in (f'<div class="{UTILITY} content">{ARTICLE}</div>', f"<article>{deep}{ARTICLE}{back}</article>"):
        for part in (f'<div class="{UTILITY} sidebar"><p>See what else there is to read.</p></div>', f'<div class="sidebar">{deep}<p>See what else there is to read.</p>{back}</div>', f'<div class="comments">{deep}<p>I liked this very much, thanks.</p>{back}</div>'):
            assert main_text([f"<body>{article}{part}</body>"], model, Vectors()) == [TEXT]
    closed = page_blocks("<div class=a><div class=b><p>x</p></div><p>y</p></div><p>z")
    assert [b.path for b in closed] == [("leaf:p", "div", ".a", ".b", "p"), ("leaf:p", "div", ".a", "p"), ("leaf:p", "p")]
