import time
from collections import Counter

import pytest

from tallyglass.llm import extract

ARTICLE = "<article><h1>Head &amp; line</h1><p>One <b>two</b>three<br>four<p>Five&nbsp;&copy; &#x41;&am<ul><li>six<li>seven</ul></article>"


def page(body, article=ARTICLE):
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t='</p><article>';</script></head><body>{body}{article}<footer>foot</footer></body></html>"


WANT = "Head & line One twothree four Five © A&am six seven"


def test_furniture_goes_and_the_article_stays():
    furniture = "<nav><ul><li><a href='/x>y'>menu</a></ul></nav><div class='ad big'>buy</div><aside>side</aside><form><input value='a'>f</form><div id=cookie-notice>cookies</div><!-- c --><header>top</header>"
    assert extract.main_text(page(furniture)) == WANT


def test_noise_inside_the_article():
    inner = ARTICLE.replace("</article>", "<section class=comments><p>first!</p></section><div class='Ad'>x</div><script>y</script><noscript>z</noscript></article>")
    assert extract.main_text(page("", inner)) == WANT


def test_without_article():
    assert extract.main_text("<body><nav>n</nav><main><p>a</p></main><p>b</p></body>") == "a"
    assert extract.main_text("<body class='has-sidebar'><nav>n</nav><p>a</p>b</body>") == "a b"
    assert extract.main_text("plain  text &lt; <") == "plain text < <"


def test_broken_markup():
    assert extract.main_text("") == ""
    assert extract.main_text("<article><p>a<b>b<p>c</article><p>out</p>") == "ab c"
    assert extract.main_text("<article><p>a</p><p>b <a hre") == "a b"
    assert extract.main_text("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>") == "deep"
    assert extract.main_text("<article><table><tr><td>a<td>b<tr><td>c</table></article>") == "a b c"


def test_templates_are_found_per_host(spark):
    rows = []
    for i in range(8):
        body = f"<div class=x1><div>Sign up for our letter</div></div><p>text {i} is here</p><p>All rights reserved.</p>"
        rows.append((i, f"http://h.org/{i}", f"<html><body><article>{body}</article></body></html>"))
        rows.append((100 + i, f"http://one{i}.org/", f"<html><body><article>{body}</article></body></html>"))
        rows.append((200 + i, "http://copies.org/", "<html><body><article><div>same text</div></article></body></html>"))
    df = spark.createDataFrame([*rows, (300, None, None), (300, None, None)], "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS template")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in extract.extracted(df).collect()}
    for i in range(8):
        assert got[i][0] == f"text {i} is here All rights reserved."
        assert got[100 + i][0] == f"Sign up for our letter text {i} is here All rights reserved."
        assert got[200 + i] == ("same text", 9)
    assert got[300] == ("", 0)
    assert extract.extracted(df.limit(0)).count() == 0


@pytest.mark.parametrize(("html", "want"), [
    ('<body><div class="content-with-sidebar"><article><p>Hello world</p></article></div></body>', "Hello world"),
    ('<body><article class="post has-comments"><p>Hello world</p></article></body>', "Hello world"),
    ('<body><div id="page" class="hide-header"><p>Hello world</p></div></body>', "Hello world"),
    ('<body><article>Up <div class="share-price">12.5</div> now</article></body>', "Up 12.5 now"),
    ('<body><div class="sidebar"><article>only one</article></div></body>', "only one"),
    ('<body><article>text</article><div class="related-items"><article>teaser</article></div><aside><article>other</article></aside></body>', "text"),
    ('<body><main>text</main><div class="related"><article>teaser</article></div></body>', "text"),
    ('<body><div>text</div><section id="comments"><article class="comment">me too</article></section></body>', "text"),
    ('<body><form action="x"><input><article>in a form</article></form></body>', "in a form"),
    ('<body><article>a<div class="site-header">top</div><div class="newsletter-form">join</div><div class="post-comments">hi</div>b</article></body>', "a b"),
    ('<article>a<p hidden>h</p><p style="display: none">n</p><p class="hidden">c</p>b</article>', "a b"),
    ('<article><a title="x > y" href=/a?b=c>link</a> <a "odd>text</a></article>', "link text"),
    ('<article>1 < 2 <3 a<b <!doctype x> & <? y ?>c</article>', "1 < 2 <3 a & c"),
    ("<article>a <a href='never ends>b</a> <p>c</article>", "a b c"),
])
def test_wrappers_stay_and_furniture_goes(html, want):
    assert extract.main_text(html) == want


@pytest.mark.parametrize("html", [
    "<article>" + "<div>" * 100_000 + "deep" + "</div>" * 100_000, "<b>" * 60_000 + "</x>" * 60_000 + "deep", '<a "' * 250_000, "<a ='" * 200_000, "</x>" * 250_000, "<p>" * 200_000 + "deep",
    "<b>" * 50_000 + "<p>" * 50_000, "<ul><li>" * 50_000, "<script" * 100_000, "<script>" + "</script " * 100_000, "<!--" * 100_000, "<!" * 300_000, "<" * 500_000, "<table><tr><td>" * 30_000, "&" * 500_000, "<title>" + "</titl" * 100_000,
    "<a class='" + "x-" * 200_000 + "'>", "<a " + "b" * 500_000, "<a " + "b = " * 200_000 + ">",
])
def test_time_is_linear(html):
    start = time.process_time()
    extract.main_text(html, {1})
    extract.subtrees(html)
    assert time.process_time() - start < 10


def test_templates_equal_a_recount_without_spark(spark):
    """Every subtree is written out as text and counted by page; unlabelled menus go from pages without an article."""
    rows = []
    for host in range(3):
        for i in range(7):
            menu = "".join(f"<li>entry {k} of host {host}</li>" for k in range(5))
            note = f"<div><p>Season {i % 2} note</p></div>"
            rows.append((host * 10 + i, f"http://host{host}.org/{i}", f"<html><body><div><ul>{menu}</ul></div>{note}<div><p>Page {i} of {host} says <b>this</b>.</p></div></body></html>"))

    def written(node):
        return f"<{node.tag} {sorted(node.marks)}>" + "".join(written(x) if isinstance(x, extract.Node) else "|" + " ".join(x.split()) for x in node.children if isinstance(x, extract.Node) or x.strip())

    hash_of, counted, pages = {}, Counter(), Counter()
    for _, url, html in rows:
        host, tree = url.split("/")[2], extract.parse(html)
        pages[host] += 1
        own = set()
        for node, value in extract._hashes(tree):
            hash_of[value] = written(node)
            if node.tag not in ("#root", "html", "head", "body", "b"):
                own.add((host, written(node)))
        counted.update(own)
    assert len(set(hash_of.values())) == len(hash_of)
    want = {(h, w) for (h, w), n in counted.items() if n > 0.5 * pages[h]}
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r["host"], hash_of[v]) for r in extract.templates(df).collect() for v in r["template"]}
    assert got == want and any("entry 3" in w for _, w in got)
    text = {r["page_id"]: r["text"] for r in extract.extracted(df).collect()}
    assert text[11] == "Season 1 note Page 1 of 1 says this." and text[10] == "Page 0 of 1 says this."
    assert all("entry 3" in r["text"] for r in extract.extracted(df, ratio=2.0).collect())


def test_the_test_pages(spark):
    import html
    import re

    from tallyglass.llm.store import table

    for r in extract.extracted(table(spark, "/root/testdata/sf0.001", "pages")).join(table(spark, "/root/testdata/sf0.001", "pages").select("page_id", "html"), "page_id").collect():
        body = r["html"].split("<article>", 1)[1].split("</article>")[0]
        want = " ".join(html.unescape(re.sub("</?(?:p|h1|br)>", " ", re.sub("</?b>", "", body))).split())
        assert (r["text"], r["n_chars"]) == (want, len(want))


@pytest.mark.parametrize(("html", "want"), [
    ('<article><h2 class="section-header">Part one</h2><p>a</p></article>', "Part one a"),
    ('<article><p class="notice">Told to all</p><p>a</p></article>', "Told to all a"),
    ('<article><div class="article-header"><h1>Title</h1></div><p>a</p></article>', "Title a"),
    ("<article><header><h1>Title</h1></header><p>a</p></article>", "Title a"),
    ("<body><header><h1>Site</h1></header><article><p>a</p></article>", "a"),
    ('<body><form id="aspnetForm"><div><p>the whole page text</p><input value=x><button>go</button></div></form>', "the whole page text"),
    ('<body><div class="search"><p>about search engines</p></div>', "about search engines"),
    ('<body><p>the text of the page</p><form><p>Sign up</p></form><div class="search">find</div>', "the text of the page"),
    ('<article><p>a</p><div class="user-comments"><p>first</p></div></article>', "a"),
    ('<article><p>a</p><div class="comment-content">first</div></article>', "a"),
    ('<article><p>a</p></article><section class="readers"><article class="c">first</article></section>', "a"),
    ('<article><p>a</p><div><article class="c">first</article><article class="c">second</article></div></article>', "a"),
    ('<article><div class="ad-slot">x</div><div class="google-ad">y</div><div class="ad-300x250">z</div><p>a</p></article>', "a"),
    ('<article><p>a</p></article><div class="cookie-law-info-bar">c</div>', "a"),
    ('<body><div class="cookie-law-info-bar">c</div><p>the text of the page</p>', "the text of the page"),
])
def test_articles_whole_and_alone(html, want):
    assert extract.main_text(html) == want


def test_furniture_without_marks_whose_texts_differ_goes_by_its_shape(spark, monkeypatch):
    """Menus and adverts of many hosts, no mark on any, different on each page; no article element."""
    monkeypatch.setattr(extract, "MARKS", frozenset())
    extract.marked.cache_clear()
    rows, want = [], {}
    for h in range(3):
        for i in range(9):
            menu = "".join(f"<li><a href=/{h}/{i}/{k}>Go to place {h} {i} {k}</a></li>" for k in range(2 + i % 4))
            advert = f"<div class='x{i}'><div><a href=/b>Buy {h * i} of thing {i} now</a></div></div>"
            text = " ".join(f"Sentence {k} of page {i} on host {h} says something." for k in range(6))
            links = f"<p>{text} See <a href=/q>the other page {i}</a>.</p>" * (1 + i % 3)
            rows.append((100 * h + i, f"http://h{h}.org/{i}", f"<html><body><div id=top-{h}><ul>{menu}</ul></div><div class=t{h}><h1>Head {i}</h1>{links}</div>{advert}</body></html>"))
            want[100 * h + i] = f"Head {i} " + " ".join([f"{text} See the other page {i}."] * (1 + i % 3))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    try:
        assert {r["page_id"]: r["text"] for r in extract.extracted(df).collect()} == want
        off = {r["page_id"]: r["text"] for r in extract.extracted(df, ratio=2.0).collect()}
        assert all(off[k] != want[k] and want[k] in off[k] for k in want)
    finally:
        extract.marked.cache_clear()
