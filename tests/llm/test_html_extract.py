import math
import random

import pytest

from blockloom.llm import html_extract
from blockloom.llm.html_extract import extract, main_text, smoothed

BODY = "".join(f"<p>Paragraph {k} has some words &amp; a <a href='/x'>link</a>, all of\n  them content.</p>" for k in range(4))
WANT = "\n\n".join(f"Paragraph {k} has some words & a link, all of them content." for k in range(4))


def page(article, before="", after=""):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{before}{article}{after}</body></html>"


def test_article_without_what_surrounds_it():
    before = "<header><h1>Site</h1></header><nav><ul><li><a href='/'>Home</a></li></ul></nav><div class='cookie-notice'><p>We use cookies.</p></div><div class=\"ad\">Buy this now, it is a very good thing to buy.</div>"
    after = "<aside><p>More</p></aside><section id='comments'><p>First! What a long comment this is, longer than some paragraphs.</p></section><form><p>Mail</p><input></form><footer>&copy; us</footer>"
    assert main_text(page(f"<article><h1>Head</h1>{BODY}</article>", before, after)) == "Head\n\n" + WANT
    assert main_text(page(f"<main>{BODY}<div class='share'>Tell</div></main>", before, after)) == WANT


def test_without_an_article_element_the_text_ratio_decides():
    links = "<div><ul>" + "".join(f"<li><a href='/{k}'>Link {k}</a></li>" for k in range(9)) + "</ul></div>"
    assert main_text(page(f"<div id='c'>{BODY}</div>", links, links)) == WANT


def test_short_blocks_entities_and_spaces_stay():
    html = "<article><p>A</p><p> b\t\n c </p><p>&lt;x&gt; &#233;&#x41;&eacute; &unknown; &amp</p><p></p>tail<br>end</article>"
    assert main_text(html) == "A\n\nb c\n\n<x> éAé &unknown; &\n\ntail end"


def test_broken_markup():
    assert main_text("<article><p>one<p>two<b>three<p>four") == "one\n\ntwothree\n\nfour"
    assert main_text("<nav><a>x</a><article><p>text</p></article>") == "text"  # a menu left open
    assert main_text("<article><p>cut of") == "cut of"
    assert main_text("<div class='ad'><div>a</div>b</div><p>text</p>") == "text"
    assert main_text("<article><p class='notice'>gone<p>stays<ul><li class=ad>x<li>y</ul></article>") == "stays\n\ny"
    assert main_text("<html><head><title>T<body><p>text</p>") == "text"
    assert main_text("just words") == "just words"
    assert main_text("<article><script>if (a < b) { '<p>' }</script><p>t</p></article>") == "t"


def test_table(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "<article><p>é x</p></article>"), (3, None, "<article><p>é x</p></article>"), (4, "u", "<p>" + "long " * 50_000 + "</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = sorted((r.page_id, r.text, r.n_chars) for r in extract(pages).collect())
    assert found == [(1, "", 0), (2, "", 0), (3, "é x", 3), (3, "é x", 3), (4, ("long " * 50_000).strip(), 249_999)]
    assert extract(pages).columns == ["page_id", "url", "text", "n_chars"]
    assert extract(pages.limit(0)).collect() == []


LONG = ["".join(f"{w} {k} of paragraph text that goes on for a while, " for k in range(8)).strip() for w in ("First", "Second", "Third")]


def test_a_teaser_article_does_not_replace_the_main_text():
    teaser = "<article class='card'><h3>Another story</h3><p>A teaser of some words about it.</p></article>"
    body = "".join(f"<div><p>{p}</p></div>" for p in LONG)
    for html in (page(f"<div id='c'>{body}</div>", after=teaser), page(f"<div id='c'>{body}</div>", before=teaser)):
        found = main_text(html).split("\n\n")
        assert [p for p in found if p in LONG] == LONG


def test_link_blocks_in_an_article_go_and_its_short_lines_stay():
    links = "<div><p>See</p><ul>" + "".join(f"<li><a href='/{k}'>Link number {k}</a></li>" for k in range(9)) + "</ul></div>"
    html = f"<article><h1>Head</h1><p>{LONG[0]}</p>{links}<p>{LONG[1]}</p><div><p>Short.</p></div><ul><li>one</li><li>two</li></ul></article>"
    assert main_text(page(html)).split("\n\n") == ["Head", LONG[0], LONG[1], "Short.", "one", "two"]


def test_lists_and_tables_without_an_article_stay():
    links = "<div><ul>" + "".join(f"<li><a href='/{k}'>Link {k}</a></li>" for k in range(9)) + "</ul></div>"
    items = [f"A list item, number {k}" for k in range(6)]
    cells = [f"cell {k}" for k in range(9)]
    ul = "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
    table = "<table>" + "".join("<tr>" + "".join(f"<td>{x}</td>" for x in cells[k : k + 3]) + "</tr>" for k in (0, 3, 6)) + "</table>"
    prose = "".join(f"<p>{p}</p>" for p in LONG)
    for block, want in ((ul, items), (table, cells), (f"<div>{ul}</div>", items)):
        assert main_text(page(f"<div id='c'>{prose}{block}</div>", links, links)).split("\n\n") == LONG + want
    rows = "".join(f"<div><p>{p}</p></div><div><p>Yes.</p><p>No.</p><p>Or so.</p><p>Well.</p><p>Fine.</p></div>" for p in LONG[:2]) + f"<div>{LONG[2]}</div>"
    found = main_text(page(f"<div id='c'>{rows}</div>", links, links)).split("\n\n")
    assert found == [x for p in LONG[:2] for x in (p, "Yes.", "No.", "Or so.", "Well.", "Fine.")] + LONG[2:]


def test_one_very_long_line_does_not_outweigh_others():
    html = page(f"<div><p>{'long ' * 5000}</p></div><div>" + "".join(f"<p>{p}</p>" for p in LONG * 2) + "</div>")
    assert main_text(html).split("\n\n")[1:] == LONG * 2


def test_pages_of_links_and_deep_pages():
    assert main_text("<ul><li><a>a</a><li><a>b</a><li><a>c</a></ul>") == "a\n\nb\n\nc"
    assert main_text("<div>" * 3000 + f"<p>{LONG[0]}</p>" + "<p>x</p>" * 3000).startswith(LONG[0])


def test_smoothing_keeps_constants():
    assert all(abs(v - 3.0) < 1e-12 for v in smoothed([3.0] * 7, 1.5))


SIDE = "<nav><ul><li><a href='/'>Home</a></li><li><a href='/b'>About us</a></li></ul></nav>"
FOOT = "<footer>&copy; The company, all rights reserved, and so on and so forth.</footer>"


def test_a_form_round_the_page():
    html = page(f"<form action='/x'>{SIDE}<div id='c'>{BODY}</div><div class='comments'><p>{LONG[0]}</p></div>{FOOT}</form>")
    assert main_text(html) == WANT
    assert main_text(page(f"<div>{BODY}</div>", after=f"<form><p>{LONG[0]}</p><input></form>")) == WANT


def test_names_of_classes_are_weights():
    assert main_text(page(f"<div class='social'>{BODY}</div>", SIDE + "<div><a href='#c'>Skip to content</a></div>", FOOT)) == WANT
    assert main_text(page(f"<div class='has-sidebar'>{BODY}</div>", SIDE, FOOT)) == WANT
    inside = f"<article>{BODY}<div class='comment-content'><p>{LONG[0]}</p><p>{LONG[1]}</p></div></article>"
    assert main_text(page(inside)) == WANT
    assert main_text(page(f"<div id='c'>{BODY}</div><div class='sidebar-content'><p>{LONG[0]}</p></div>")) == WANT
    assert main_text(page(f"<div id='c'>{BODY}</div><div class='userComments'><p>{LONG[0]}</p></div>")) == WANT


def test_many_comments_do_not_outweigh_a_short_article():
    comments = "<section class='comments'>" + "".join(f"<div class='comment'><p>{p}</p></div>" for p in LONG * 4) + "</section>"
    for tag in ("article", "div"):
        assert main_text(page(f"<{tag}>{BODY}</{tag}>", SIDE, comments + FOOT)) == WANT


def test_planted_blocks_without_an_article_element():
    blocks = ["<div class='cookie-consent'>%s</div>", "<aside>%s</aside>", "<div class='ad'>%s</div>", "<div id='newsletter'>%s</div>", "<ul class='menu'><li>%s</li></ul>", "<header>%s</header>", "<div role='contentinfo'>%s</div>"]
    for k in range(len(blocks)):
        before = "".join(b % f"<p>{LONG[0]}</p>" for b in blocks[:k])
        after = "".join(b % f"<p>{LONG[1]}</p>" for b in blocks[k:])
        assert main_text(page(f"<div>{BODY}</div>", SIDE + before, after + FOOT)) == WANT


def test_every_given_page_goes_through_ratio_and_threshold(monkeypatch):
    import pyarrow.parquet as pq

    seen = []
    monkeypatch.setattr(html_extract, "smoothed", lambda values, sigma: seen.append(len(values)) or smoothed(values, sigma))
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).column("html").to_pylist()
    assert all(main_text(h) for h in pages) and len(seen) == len(pages)


def test_ratio_smoothing_and_threshold_against_a_slow_version():
    """Lines that stand out by a plain computation are all in the text, and no line far below the threshold stands alone."""
    rng = random.Random(6)
    for _ in range(60):
        divs = []
        for _ in range(rng.randint(1, 6)):
            tags = "".join(rng.choice(["<p>%s</p>", "<li><a href='#'>%s</a></li>", "<p><b>%s</b></p>"]) % ("w" * rng.randint(1, 9) + " x" * rng.randint(0, 80)) for _ in range(rng.randint(1, 6)))
            divs.append(f"<div>{tags}</div>")
        parser = html_extract.Lines()
        parser.feed("<body>" + "".join(divs) + "</body>")
        parser.close()
        parser.cut()
        lines = parser.lines
        ratio = [min(300, max(0, len(x.text) - x.link)) / (1 + x.tags) for x in lines]
        smooth = []
        for i in range(len(lines)):
            near = [(math.exp(-0.5 * (i - j) ** 2), ratio[j]) for j in range(len(lines)) if abs(i - j) <= 2]
            smooth.append(sum(w * r for w, r in near) / sum(w for w, _ in near))
        assert html_extract.ratios(lines, parser.nodes)[0] == pytest.approx(ratio) and smoothed(ratio, 1.0) == pytest.approx(smooth)
        best = 0.0
        for node in {x.node for x in lines}:
            of = [(len(x.text), s if r else 0.0) for x, r, s in zip(lines, ratio, smooth) if x.node == node]
            best = max(best, sum(n * s for n, s in of) / sum(n for n, _ in of))
        kept = {id(x) for x in html_extract.content(lines, parser.nodes, 1.0, 0.25)}
        strong = [min(r, s) >= 0.25 * best for r, s in zip(ratio, smooth)]
        if best:
            assert all(id(x) in kept for x, good in zip(lines, strong) if good)
            for node in {x.node for x in lines}:
                of = [(x, s) for x, s in zip(lines, smooth) if x.node == node]
                if max(s for _, s in of) < 0.25 * best and node in (lines[0].node, lines[-1].node):
                    assert not any(id(x) in kept for x, _ in of)


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "<p>some text here</p>", 2, 3, "old")], "page_id long, html string, page_html int, `a.b` int, TEXT string")
    found = extract(df)
    assert found.columns == ["page_id", "page_html", "a.b", "text", "n_chars"]
    assert tuple(found.first()) == (1, 2, 3, "some text here", 14)
