import re
from html import unescape

from tidemark.llm import html_content as hc

SCHEMA = "page_id long, url string, html string, text string, n_chars int"


def article(html):
    """The text of the tables' pages, which hold one article element with p, h1, b and br."""
    inner = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    blocks = re.split(r"</?(?:p|h1|h2)>", inner)
    blocks = [" ".join(unescape(re.sub(r"</?b>", "", b.replace("<br>", " "))).split()) for b in blocks]
    return " ".join(b for b in blocks if b)


def test_pages_give_their_article(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    want = {r.page_id: article(r.html) for r in pages.collect()}
    got = {r.page_id: r.text for r in hc.extract(pages, hc.train(pages)).collect()}
    assert got == want


def test_other_markup(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    model = hc.train(pages)
    body = "<h1>A title</h1><p>First &eacute;t&eacute; &amp; more&nbsp;text, with <b>bold</b>ness.</p><p>Second one<br>goes on. It ends here.</p>"
    around = '<nav><a href="/">Home</a></nav><div id="cookie-banner"><p>We use cookies. Accept them all.</p></div><div class="menu"><ul><li><a href="#">News</a></li></ul></div>{}<div class="comments"><div class="comment"><p>I liked this. Thanks for it.</p></div></div><aside><p>Other things to read. Go there.</p></aside><form><p>Join our list.</p></form><div class="ad">Buy this. Now.</div><footer>&copy; us</footer><script>var x="<p>no</p>"</script>'
    want = "A title First été & more text, with boldness. Second one goes on. It ends here."
    rows = [(i, "u", f"<html><head><title>T</title></head><body>{around.format(h.format(body))}</body></html>", "x", 1) for i, h in enumerate(("<article>{}</article>", "<main>{}</main>", '<div class="content">{}</div>', '<div id="post-body">{}</div>'))]
    rows += [(10, None, None, "x", 1), (11, "u", "", None, None), (11, "u", "", None, None), (12, "u", "<nav>only <a href=x>menu</a></nav>", "x", 1), (13, "u", "<p unclosed '<b", "x", 1)]
    out = hc.extract(spark.createDataFrame(rows, SCHEMA), model).collect()
    assert len(out) == len(rows) and all(r.n_chars == len(r.text) for r in out)
    assert [r.text for r in sorted(out, key=lambda r: r.page_id)[:4]] == [want] * 4
    assert [r.text for r in out if r.page_id in (10, 11, 12)] == [""] * 4
    assert hc.extract(spark.createDataFrame([], SCHEMA), model).collect() == []


def test_marginals_equal_enumeration():
    import itertools

    import numpy as np

    t = hc.Trees()
    t.add(0, '<body><div class="menu"><p>a</p></div><div><p>Some text here.</p><p>More.</p></div></body>')
    model = hc.ContentModel()
    model.edges += [[5, 1], [2, 7]]
    model.counts[0] += np.random.default_rng(0).random(model.counts[0].shape)
    found, parent, _ = model.features(t)
    n = len(parent)
    logs = sum(np.log(c / c.sum(1, keepdims=True))[:, f].T for c, f in zip(model.counts, found))
    edge, total, want = np.log(model.edges / model.edges.sum(1, keepdims=True)), 0.0, np.zeros(n)
    for y in itertools.product((0, 1), repeat=n):
        p = np.exp(sum(logs[i, y[i]] for i in range(n)) + sum(edge[y[parent[i]], y[i]] for i in range(n) if parent[i] >= 0) + np.log(0.5))
        total += p
        want += p * np.array(y)
    assert np.allclose(model.marginals(t), want / total)
