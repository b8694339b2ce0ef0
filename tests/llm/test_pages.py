"""Main text: blocks of broken markup, gradients, pages of known text, rows that go wrong easily."""

import html
import re

import numpy as np
import pytest

from claimflow.llm import pages
from claimflow.llm.text import table


def texts(page: str) -> list[str]:
    return [leaf[3] for leaf in pages.leaves(page)]


def test_blocks():
    assert texts("<p>a <b>b</b>\n c&amp;&lt;d<br>e</p><p>f") == ["a b c&<d e", "f"]
    assert texts("x<!-- <p>no</p> -->y<script>var t='</p>';</script>z") == ["xyz"]
    assert texts("<p><b>One.<br><p>Two.</p>") == ["One.", "Two."]
    assert texts("<ul><li>a<li>b</ul>c") == ["a", "b", "c"]
    assert texts("<style>p{}</style><title>t</title>3 < 4 &eacute;&#233;&nbsp;x") == ["3 < 4 éé x"]
    assert texts('<p title="a>b" class=x>in</p>') == ["in"]
    assert texts("<script>never ends") == texts("<!-- never ends <p>x") == texts("") == texts(" <p> </p>\t") == []
    assert texts("</p></div>a<p don't>b</p>") == ["a", "b"]
    path = pages.leaves("<div id='mainMenu' class=\"ad-Box x\"><p hidden>t")[0][0]
    assert path == ("div", ".main", ".menu", ".ad", ".box", ".x", "p", ".hidden")


def test_long_and_deep_pages_take_linear_time():
    assert len(texts("<p>word</p>" * 50_000)) == 50_000
    assert len(pages.leaves("<div class=a>" * 20_000 + "x")[0][0]) == 2
    assert texts("<a href=x>y</a> " * 30_000)[0].count("y") == 30_000


def test_gradients():
    rng = np.random.default_rng(1)
    blocks = lambda n: [pages.Block(("html", str(rng.integers(3))), "p", rng.integers(0, 9, 3), rng.normal(size=8), int(rng.integers(-1, 2))) for _ in range(n)]
    s, y = pages._joined([blocks(4), blocks(2), blocks(3)])
    y[0] = 1
    model = pages.Labeller(2)
    ((grid, held),) = list(s.batches())

    def loss():
        z = model.logits(s)[y >= 0]
        return float(np.mean(np.log1p(np.exp(-z * (2 * y[y >= 0] - 1)))))

    for name, g in model.step(s, y, grid, held).items():
        flat, own = model.p[name].reshape(-1), g.reshape(-1)
        for k in {int(np.abs(own).argmax()), int(rng.integers(len(flat)))}:
            was = flat[k]
            flat[k] = was + 1e-5
            up = loss()
            flat[k] = was - 1e-5
            down = loss()
            flat[k] = was
            assert own[k] == pytest.approx((up - down) / 2e-5, abs=1e-6), name


def expected(page: str) -> str:
    article = re.search(r"<article>(.*)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", article.replace("<br>", " "))
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in parts]
    return "\n\n".join(b for b in blocks if b)


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return pages.fit(table(spark, sf_dir, "pages"))


def test_pages_of_the_table(spark, sf_dir, model):
    rows = table(spark, sf_dir, "pages")
    got = {r["page_id"]: r for r in pages.main_text(rows, model).collect()}
    want = {r["page_id"]: expected(r["html"]) for r in rows.collect()}
    wrong = [i for i in want if got[i]["text"] != want[i]]
    assert len(got) == len(want) and len(wrong) <= 0.01 * len(want)
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_other_layouts(model):
    """Parts that the fitting pages don't have, and pages of another make."""
    page = (
        '<html><body><header><h1>Site</h1></header><aside><ul><li>Related</li></ul></aside><article><h1>Title</h1><p>One &amp; two words here.</p>'
        "<ul><li>Item a</li><li>Item b</li></ul><form><p>Send a mail</p></form></article><div class='cookie-notice'><p>We use cookies.</p></div>"
        '<section class="comments"><p>Nice post, I read all of it.</p></section><footer>(c) me</footer></body></html>'
    )
    found, _, s = pages.read([page])
    kept = [t for t, z in zip(found[0], model.logits(s)) if z > 0]
    assert kept == ["Title", "One & two words here.", "Item a", "Item b"]


def test_odd_rows(spark, sf_dir, model):
    rows = [(1, "u", None), (2, None, ""), (2, None, ""), (None, "u", "<article><p>Hello there, all of you.</p></article>"), (3, "u", "<p>" * 5000 + "&#0;"), (4, "u", "plain")]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int").repartition(3)
    got = pages.main_text(frame, model).collect()
    assert len(got) == 6 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert [r["text"] for r in got if r["page_id"] in (1, 2)] == ["", "", ""]
    assert [r["text"] for r in got if r["page_id"] is None] == ["Hello there, all of you."]
    assert pages.main_text(frame.limit(0), model).count() == 0
    assert pages.fit(frame.limit(0)) is None
    assert {r["text"] for r in pages.main_text(frame, None).collect()} >= {"", "plain"}
