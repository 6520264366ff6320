"""Main text over layouts of common publishing systems: what is kept, and that hints of wrong containers harm none."""

import random

import pytest

WORDS = "the river town market old bridge people walk every morning slowly because light falls on stone and water near gardens".split()


def prose(r, n):
    return (" ".join(r.choice(WORDS) for _ in range(n)) + ".").capitalize()


def article(r):
    """Markup and text of a heading and four paragraphs."""
    head, paras = prose(r, 6), [prose(r, n) for n in (40, 25, 60, 30)]
    return f"<h1>{head}</h1>" + "".join(f"<p>{p}</p>" for p in paras), "\n\n".join([head, *paras])


LINKS = "".join(f'<li><a href="/{x}">{x.title()}</a></li>' for x in ("home", "news", "sport", "about us", "contact"))
NAV, FOOT = f"<ul>{LINKS}</ul>", '<p>&copy; 2024 A company. <a href="/t">Terms</a> <a href="/p">Privacy</a></p>'
#: Layouts: A stands for the article, N for links, F for the last lines, S and C for a sidebar's and readers' words.
LAYOUTS = {
    "elements": "<body><nav>N</nav><main>A</main><aside><p>S</p></aside><footer>F</footer></body>",
    "article element": "<body><header>N</header><article>A</article><section id='comments'><p>C</p><p>C</p></section><footer>F</footer></body>",
    "no zones": "<body><div>N</div><div>A</div><div>F</div></body>",
    "table cells": "<body><table><tr><td>N</td><td>A</td></tr><tr><td>F</td></tr></table></body>",
    "classes": "<body class='home blog'><div class='site-header'>N</div><div class='entry-content'>A</div><div class='widget-area'><p>S</p></div><div class='site-footer'>F</div></body>",
    "body has sidebar": "<body class='home has-sidebar'><div id='wrap'><ul class='menu'>N</ul><div>A</div></div></body>",
    "body no sidebar": "<body class='no-sidebar'><div>A</div></body>",
    "body right sidebar": "<body class='page right-sidebar'><div id='wrap'><div>A</div><div class='sidebar'><p>S</p></div></div></body>",
    "body comments open": "<body class='single-post comments-open'><div id='wrap'>A</div></body>",
    "side by side": "<body><div class='side-by-side'><div>A</div></div></body>",
    "wrapper named for its sidebar": "<body><div class='content-sidebar-wrap'><div>A</div></div></body>",
    "form around all": "<body><form id='aspnetForm'><div>N</div><div>A</div></form></body>",
    "list of comments": "<body><article class='post'>A</article><ol class='comment-list'><li><article class='comment'><p>C</p></article></li></ol></body>",
    "cookie notice": "<body><div id='cookie-notice'><p>S</p></div><div class='ad'>S</div><div id='content'>A</div><div class='related'><ul>N</ul></div></body>",
    "header in article": "<body><article><header class='entry-header'>A</header></article><div role='complementary'><p>S</p></div></body>",
    "newsletter": "<body><main>A<form><p>S</p></form><div class='newsletter'><p>S</p></div></main></body>",
}


def page(layout, seed):
    r = random.Random(seed)
    a, want = article(r)
    made = "".join({"A": a, "N": NAV, "F": FOOT, "S": prose(r, 14), "C": prose(r, 22)}.get(c, c) if c in "ANFSC" else c for c in layout)
    return f"<!DOCTYPE html><html><head><title>x</title><style>p {{}}</style></head>{made}</html>", want


def short(r):
    """A heading and three paragraphs of some twenty words."""
    head, paras = prose(r, 5), [prose(r, n) for n in (22, 18, 25)]
    return head, paras


#: Pages whose hints are wrong: {h} is the heading, {p} all paragraphs, {1} to {3} each; N, F, S and C as above.
WRONG = {
    "main-sidebar": "<body><nav>{N}</nav><main><h1>{h}</h1></main><div class='main-sidebar'>{p}</div><footer>{F}</footer></body>",
    "share post": "<body><div class='site-header'>{N}</div><article><h1>{h}</h1><div class='share post'>{p}</div></article></body>",
    "legal": "<body><div class='content'><h1>{h}</h1></div><div class='legal'>{p}</div><div class='site-footer'>{F}</div></body>",
    "widget": "<body><div><h1>{h}</h1></div><div class='widget widget-text'>{p}</div><div class='comments'><p>{C}</p></div></body>",
    "widgets of one kind": "<body><h1>{h}</h1><div class='elementor-widget widget'><p>{1}</p></div><div class='elementor-widget widget'><p>{2}</p></div><div class='elementor-widget widget'><p>{3}</p></div></body>",
    "widgets by name": "<body><h1>{h}</h1><div class='widget'><p>{1}</p></div><div class='widget'><p>{2}</p></div><div class='widget'><p>{3}</p></div><div class='ad'><p>{S}</p></div></body>",
    "search": "<body><h1>{h}</h1><section class='search'>{p}</section><div class='cookie-notice'>{S}</div></body>",
    "another attribute": "<body><div data-id='sidebar' data-class=\"ad\"><h1>{h}</h1>{p}</div><div class='sidebar'><p>{S}</p></div></body>",
    "banner": "<body><nav>{N}</nav><section class='banner section'><h1>{h}</h1><p>{1}</p></section><div><p>{2}</p><p>{3}</p></div></body>",
    "title without head": "<title>Some title of a page</title><body><article><h1>{h}</h1>{p}</article></body>",
    "a paragraph in a link": "<body><article><h1>{h}</h1><p>{1}</p><p><a href='/x'>{2}</a></p><p>{3}</p></article></body>",
    "a paragraph in a link, no zone": "<body><div><h1>{h}</h1><p>{1}</p><p><a href='/x'>{2}</a></p><p>{3}</p></div></body>",
    "an open link": "<body><article><h1>{h}</h1><p>{1}</p><p><a href='/x'>{2}</p><p>{3}</p></article></body>",
    "a link around paragraphs": "<body><article><h1>{h}</h1><a href='/x'><p>{1}</p><p>{2}</p><p>{3}</p></article></body>",
}


@pytest.mark.parametrize("name", WRONG)
def test_wrong_hints_lose_nothing(name):
    from quire.llm import pages

    for seed in range(5):
        r = random.Random(seed)
        head, paras = short(r)
        fields = {"h": head, "p": "".join(f"<p>{x}</p>" for x in paras), "N": NAV, "F": FOOT, "S": prose(r, 14), "C": prose(r, 22)}
        page_ = WRONG[name]
        for k, v in {**fields, **{str(i + 1): x for i, x in enumerate(paras)}}.items():
            page_ = page_.replace("{" + k + "}", v)
        assert pages.main_text(f"<!DOCTYPE html><html>{page_}</html>") == "\n\n".join([head, *paras])


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    from quire.llm import pages

    for seed in range(5):
        html, want = page(LAYOUTS[name], seed)
        assert pages.main_text(html) == want


def shares(zones):
    """Shares of blocks judged rightly over all layouts."""
    from quire.llm import pages

    right = n = 0
    for layout in LAYOUTS.values():
        for seed in range(5):
            html, want = page(layout, seed)
            found = pages.blocks(html)
            right += sum(k == (b.text in want.split("\n\n")) for b, k in zip(found, pages.judged(found, zones)))
            n += len(found)
    return right / n


def test_counts_alone_do_most():
    assert shares(False) > 0.8 and shares(True) > 0.9


def test_tables(spark):
    from quire.llm import pages

    schema = "page_id bigint, url string, html string, text string"
    nothing = spark.createDataFrame([], schema)
    assert pages.extract(nothing).collect() == [] and pages.extract(nothing).columns == ["page_id", "url", "text"]
    body = "<p>" + "word " * 20 + "</p>"
    long = spark.createDataFrame([(1, "u", "<article>" + body * 20_000 + "</article>", None), (2, None, "", "t"), (None, "u", None, None)], schema)
    got = {r["page_id"]: r["text"] for r in pages.extract(long).collect()}
    assert got[1].count("\n\n") == 19_999 and got[2] == got[None] == ""
    with pytest.raises(ValueError):
        pages.extract(long, ("page_id", "text"))
