"""HTML extraction: the block parser, the labeller's gradients, whole pages."""

import html
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import htmltext


@pytest.fixture(scope="module")
def labeller(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/pages.parquet")
    return htmltext.fit(pages)


def texts(page):
    return [b.text for b in htmltext.blocks(page)]


def test_blocks():
    assert texts("<p>a &amp; b<br>c</p><P CLASS=x>d&nbsp;\n e<b>f</b>g") == ["a & b c", "d efg"]
    assert texts("<script>var t='</p>';</script>x<style>p{}</STYLE >y<!-- <p>no -->z") == ["xyz"]
    assert texts("1 < 2 <p>&lt;b&gt; &#233;&eacute;&#x41;") == ["1 < 2", "<b> ééA"]
    assert texts("<p title='a > b'>in</p></div></p>out") == ["in", "out"]
    assert texts("<ul><li>a<li>b<p>c</ul>d") == ["a", "b", "c", "d"]
    assert texts("") == texts("<!-- never closed <p>x") == texts("<script>never") == []
    path = htmltext.blocks("<main><div class='Post-body' id=x1><p>t</p></div></main>")[0].path
    assert path == ("main", "div post body x", "p")
    assert htmltext.blocks("<p><a href=x>all</a></p>")[0].linked == 3


def test_gradients():
    rng = np.random.default_rng(0)
    net = htmltext.Labeller(1)
    pages = [rng.normal(size=(n, htmltext.WIDTH)) for n in (4, 2)]
    x, mask = htmltext.stacked(pages)
    y = rng.integers(0, 2, mask.shape).astype(float)

    def loss():
        p = net.forward(x, mask)[0]
        return -((y * np.log(p) + (1 - y) * np.log(1 - p)) * mask).sum() / mask.sum()

    grads = net.gradients(x, mask, y)
    for name, weight in net.weights.items():
        for _ in range(4):
            at = tuple(rng.integers(s) for s in weight.shape)
            kept = weight[at]
            weight[at] = kept + 1e-5
            up = loss()
            weight[at] = kept - 1e-5
            down = loss()
            weight[at] = kept
            assert grads[name][at] == pytest.approx((up - down) / 2e-5, abs=1e-6), name


def test_padding_changes_nothing():
    rng = np.random.default_rng(2)
    net = htmltext.Labeller(3)
    pages = [rng.normal(size=(n, htmltext.WIDTH)) for n in (7, 3, 1)]
    together = net.label(pages)
    for page, mark in zip(pages, together):
        assert np.allclose(net.label([page])[0], mark)


def test_pages(spark, sf_dir, labeller):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r for r in htmltext.extract(pages, labeller).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for row in rows:
        article = re.search(r"<article>(.*)</article>", row.html or "", re.S)
        parts = re.split(r"</?(?:p|h1)>", article[1]) if article else []
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in parts]
        assert got[row.page_id].text == "\n\n".join(filter(None, parts))
        assert got[row.page_id].n_chars == len(got[row.page_id].text)


def test_other_templates(spark, labeller):
    words = "The quick brown fox jumps over the lazy dog and goes home again. "
    page = f"""<html><head><title>T</title></head><body><header>Site name</header>
      <div class="cookie-notice">We use cookies <button>OK</button></div>
      <div class="menu"><ul><li><a href=a>Home</a><li><a href=b>News</a></ul></div>
      <main><h1>Heading</h1><p>{words * 3}<p>{words * 2}</main>
      <aside class="sidebar"><h3>Related</h3><p>{words}</p></aside>
      <form><label>Mail</label><input></form>
      <section id="comments"><p>{words}</p><p>nice</p></section>
      <footer>(c) somebody</footer></body></html>"""
    rows = spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")
    got = htmltext.extract(rows, labeller).first().text
    assert got == "\n\n".join(["Heading", (words * 3).strip(), (words * 2).strip()])


def test_edges(spark, labeller):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<article><p>x y z</p></article>"),
            (3, "u", "<p>" * 5000), (4, "u", "<article>" + "<p>a b c.</p>" * 20_000),
            (5, "u", "<article><p>same</p>"), (5, "u", "<article><p>same</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn(
        "text", F.lit(1))
    got = htmltext.extract(pages, labeller).collect()
    assert len(got) == len(rows)
    by_id = {r.page_id: r for r in got}
    assert by_id[1].text == by_id[2].text == by_id[3].text == "" and by_id[1].n_chars == 0
    assert by_id[4].text.count("a b c.") == 20_000 and by_id[None].text == "x y z"
    assert htmltext.extract(pages.limit(0), labeller).collect() == []
    assert htmltext.main_text(pages.limit(0)).collect() == []


def test_one_huge_page_among_short_ones(monkeypatch):
    """Short pages are not padded to the longest page, and no step is kept outside training."""
    rng, shapes, kept = np.random.default_rng(5), [], []
    net, whole, stacked = htmltext.Labeller(3), htmltext.Labeller._pass, htmltext.stacked
    pages = [rng.normal(size=(n, htmltext.WIDTH)) for n in [5000, *range(1, 100)]]

    def watched(self, x, mask, side, *keep):
        out = whole(self, x, mask, side, *keep)
        kept.append(len(out[1]))
        return out

    def measured(some):
        out = stacked(some)
        shapes.append(out[0].shape[:2])
        return out

    monkeypatch.setattr(htmltext.Labeller, "_pass", watched)
    monkeypatch.setattr(htmltext, "stacked", measured)
    marks = net.label(pages)
    assert [len(m) for m in marks] == [len(p) for p in pages]
    assert all(n == 1 or blocks * n <= 2000 for blocks, n in shapes) and (5000, 1) in shapes
    assert not any(kept)
    assert np.allclose(net.label([pages[60]])[0], marks[60])


@pytest.mark.parametrize("tag", ["math", "svg", "object", "canvas"])
def test_embedded_elements_are_parsed(tag):
    assert texts(f"<p>a <{tag} class=x><b>in</b></{tag}> b</p><p>c</p>") == ["a in b", "c"]
    assert texts(f"<article><p>a <{tag}>in<p>b</p><p>c</p></article>d") == ["a in", "b", "c", "d"]
    assert texts(f"<{tag}><style>p{{}}</style><p>fallback</p></{tag}>") == ["fallback"]


def test_hostile_pages_take_linear_time():
    """Quotes that never close, and tags that never end, cost no more than their length."""
    began = time.thread_time()
    for page in ("<a \"" * 250_000, "<a '>'" * 150_000, "<a \"\"" * 150_000 + "\">\"",
                 "<a " * 300_000 + "\">\"", "<!" * 400_000, "<script/>" * 100_000,
                 "<div></p>" * 2000 + "</b>" * 100_000, "<a\"" * 300_000 + " >"):
        htmltext.blocks(page)
    assert time.thread_time() - began < 16
    assert [b.text for b in htmltext.blocks("<p title=\"a > b\">one</p><p title='x>two</p>")] == [
        "one", "two"]
    assert [b.text for b in htmltext.blocks("<p>a < b, <3 and <b")] == ["a < b, <3 and <b"]
    assert [b.text for b in htmltext.blocks("<!doctype html><?x y?><p a=b>c<!-- <p>d -->e")] == [
        "ce"]
