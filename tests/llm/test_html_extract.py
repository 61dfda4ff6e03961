"""Page text: hand-made pages with known text, and the article element on the given table."""

import html
import re

from memspark.llm.html_extract import extract, host_paths, page_text

NOISE = (
    '<nav><ul><li><a href="/x">Menu</a></ul></nav><header>Site name</header><div class="cookie-notice">We use cookies</div>'
    '<aside>Side</aside><div class="sidebar">More side</div><form><label>Mail</label><input name=a></form>'
)
TAIL = '<section id="comments"><p>Reader says a long thing about all of this and more and more</p></section><footer>Foot</footer>'


def page(body, extra=""):
    return f"<!DOCTYPE html><html><head><title>T</title><script>var a='<p>no</p>';</script></head><body>{NOISE}{body}{extra}{TAIL}</body></html>"


CASES = [
    (page("<article><h1>Head &amp; line</h1><p>One\n two&nbsp;three <b>bold<p>Next<br>line</article>"), "Head & line\n\nOne two three bold\n\nNext line"),
    (page('<div class="post-12"><p>First text of the page here</p><div class="ad">Buy</div><p>Second text</p><ul><li>a<li>b</ul></div>'), "First text of the page here\n\nSecond text\n\na\n\nb"),
    (page('<div class="post-77"><p>Short</p></div><div class="extra"><p>A block that stands beside it and is by far the longer one</p></div>'), "Short"),
    (page("<main><p>x &lt;tag&gt; y &#233; &unknown; z</p><style>p{}</style><!-- c --><p hidden>no</p></main>"), "x <tag> y é &unknown; z"),
    ("just text, no tags", "just text, no tags"),
    ("", ""),
    (None, ""),
    ("<html><body><article><p>cut off in the mid", "cut off in the mid"),
    ("<p>open <a href='x>y'>link</a> 1 < 2 end", "open link 1 < 2 end"),
    ("<div><script>while(1){</div>", ""),
]


def test_cases(spark):
    hosts = ["a", "b", "b", "c", "d", "e", "f", "g", "h", "i"]
    votes = [(100 + i, f"http://b/{i}", page('<div class="post-%d"><p>%s</p></div>' % (i, "some words of the text " * 9))) for i in range(5)]
    rows = [(i, f"http://{hosts[i]}/p", x) for i, (x, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows + votes + [(7, None, CASES[0][0])], "page_id long, url string, html string").selectExpr("*", "1 AS text")
    got = {(r.page_id, r.url is None): r for r in extract(df).collect()}
    for i, (_, want) in enumerate(CASES):
        assert got[i, False].text == want and got[i, False].n_chars == len(want), i
    assert got[7, True].text == CASES[0][1]
    assert {r.host: r.path for r in host_paths(df).collect()}["b"] == "html/body/div.post-"
    assert extract(df.limit(0)).count() == 0


def test_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r.text for r in extract(pages).collect()}
    for r in pages.collect():
        article = r.html[r.html.index("<article>") + 9 :].split("</article>")[0]
        parts = [" ".join(html.unescape(re.sub("<br>", " ", x).replace("<b>", "").replace("</b>", "")).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert got[r.page_id] == "\n\n".join(x for x in parts if x)


def test_names_do_not_cost_the_article():
    words = "<p>These are the words of the article and there are quite a few of them</p>"
    text = words[3:-4]
    for body in (
        f'<article class="post has-comments">{words}</article>',
        f'<div id="page" class="no-sidebar">{words}</div>',
        f'<div class="content search-result">{words}</div>',
        f'<section class="related-work">{words}</section>',
        f'<div class="widget">{words}</div>',
    ):
        assert page_text(f"<html><body><nav>Menu</nav>{body}<footer>Foot</footer></body></html>", None) == text, body
    kept = page_text(page(f'<article><header class="entry-header"><h1>Title</h1></header>{words}<p>x <math><mi>y</mi></math> z</p><div class="share">Share</div></article>'), None)
    assert kept == f"Title\n\n{text}\n\nx y z"
    assert page_text(f'<div id="comments">{words * 9}</div><div><p>Short text</p></div>', None) == "Short text"
    assert page_text('<div class="comments"><p>Nothing else</p></div>', None) == "Nothing else"


def test_a_host_path_with_next_to_nothing_gives_way():
    text = "This is a sentence of the article that stands elsewhere. " * 30
    html_ = f'<html><body><div class="a"><p>{text}</p></div><div class="b"><p>teaser</p></div></body></html>'
    assert page_text(html_, "html/body/div.b") == text.strip()
    assert page_text(html_, "html/body/div.a") == text.strip()


def test_inline_names_are_weighed():
    say = lambda x: page_text(f"<html><body><article><p>{x}</p></article></body></html>", None)
    assert say('See the <a class="search">search engine</a> paper') == "See the search engine paper"
    assert say("Press the <label>red</label> key") == "Press the red key"
    assert say('A full text here. <a class="search">Engines</a> are fine.') == "A full text here. Engines are fine."
    assert say('A full text here. <span class="login">Log in</span>') == "A full text here."
    assert say('Words and <span class="ad">buy<span>x</span> now</span> more') == "Words and more"
    assert say('Words and <span hidden>not <span>this</span> at all</span> more') == "Words and more"
    assert say('Words <span class="ad">never closed') == "Words"
    assert page_text('<body><p>One <span class="ad">left open</p><p>Two two two</p></body>', None) == "One\n\nTwo two two"
    assert page_text('<body><p>One one one one</p><span class="ad"><div>buy</div></span><p>Two</p></body>', None) == "One one one one\n\nTwo"


def test_deep_and_odd_nesting_takes_time_in_proportion():
    import time

    for page_ in ("<div>" * 100_000 + "deep", "<div>x" * 30_000, "<div>" * 30_000 + "<li>a</li>" * 30_000, "<div>" * 30_000 + "</p>" * 30_000 + "end", '<p>w <span class="login">' * 10_000):
        start = time.time()
        assert page_text(page_, None)
        assert time.time() - start < 15
