from tallyglass.llm import linededup, urlfilter

URLS = [
    (1, "http://www.example.com/en/1"), (2, "https://EXAMPLE.com/en/1?x=/es/"), (3, "http://example.com"), (4, "http://a.b.net/es/x#y"), (5, "http://net/fr/"), (6, "ftp://x.org/en/"),
    (7, None), (8, ""), (9, "no scheme.com/en/"), (10, "http://notexample.com/en/"), (10, "http://notexample.com/en/"), (11, "http://m.www.example.com/en/a"), (12, "http://example.com/en"),
    (13, "://com/"), (14, "http://" + "a." * 3000 + "com/" + "p/" * 3000), (15, "http://x.net/EN/"), (16, "http://x.com?y=http://example.com/en/"), (17, "a\nb://x.com/\n"),
]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h + p), v, h + p) for h, p, v in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, "allow", None))
    return host, path, best[2], best[1]


def test_verdicts_match_brute_force(spark):
    df = spark.createDataFrame(URLS, "page_id long, url string").selectExpr("*", "1 AS row", "2 AS host", "3 AS rule")
    got = sorted(map(tuple, urlfilter.judged(df, urlfilter.rule_table(spark)).collect()), key=str)
    assert got == sorted(((i, *brute(u)) for i, u in URLS), key=str)


def test_ties_letters_and_rules_of_many_sizes(spark):
    rules = [("X.org", "/a", "allow"), ("x.org", "/a", "block"), ("y.x.org", "", "allow"), ("\u00c9.org", "/", "block"), (None, "/", "block"), ("q.org", None, "block"), ("x.org", "/z", None)]
    rules += [("s.org", "/" + "p" * k, "block" if k % 2 else "allow") for k in range(60)]
    urls = [(1, "http://y.x.org/a"), (2, "http://X.ORG/a/b"), (3, "http://\u00e9.org/"), (4, "http://\u00c9.org/"), (5, "http://w.q.org"), (6, "http://x.org/z"), (7, "http://s.org/" + "p" * 33 + "x"), (8, "http://s.org/" + "p" * 99)]
    table = spark.createDataFrame(rules, "rule_host string, rule_path string, rule_verdict string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urlfilter.judged(spark.createDataFrame(urls, "page_id long, url string"), table).collect()}
    assert got == {
        1: ("x.org/a", "block"), 2: ("x.org/a", "block"), 3: (None, "allow"), 4: ("\u00c9.org/", "block"), 5: ("q.org", "block"), 6: (None, "allow"), 7: ("s.org/" + "p" * 33, "block"), 8: ("s.org/" + "p" * 59, "block"),
    }


def test_pages_of_one_id_and_clashing_columns(spark):
    rows = [(1, "http://h/a", "<p>menu<p>own"), (1, "http://h/a", "<p>menu<p>own"), (2, "http://h/b", "<p>menu<p>b"), (3, "http://h/c", "<p>menu<p>menu<p>c"), (None, "http://h/d", None), (4, None, "<p>menu")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS host", "'y' AS lines", "1 AS site", "2 AS id", "3 AS common")
    got = sorted(map(tuple, linededup.cleaned_pages(df, ratio=0.5).collect()), key=str)
    want = [(1, "h", "own", 2, 1)] * 2 + [(2, "h", "b", 2, 1), (3, "h", "c", 3, 2), (None, "h", "", 0, 0), (4, "", "menu", 1, 0)]
    assert got == sorted(want, key=str)


def test_no_rules_and_no_pages(spark):
    df = spark.createDataFrame(URLS, "page_id long, url string")
    none = spark.createDataFrame([], "rule_host string, rule_path string, rule_verdict string")
    assert {r["verdict"] for r in urlfilter.judged(df, none).collect()} == {"allow"}
    assert urlfilter.judged(df.limit(0), urlfilter.rule_table(spark)).count() == 0


def test_lines_on_many_pages_of_a_host_go(spark):
    rows = [(i, "h", [f"own {i}", "menu", "menu", None, f"own {i}"]) for i in range(6)] + [(6, "h", ["menu"]), (7, None, ["menu"]), (8, "", None), (9, "small", ["menu"]), (10, "small", ["menu"]), (10, "small", ["menu"])]
    df = spark.createDataFrame(rows, "id long, host string, lines array<string>").selectExpr("*", "1 AS site", "2 AS common")
    got = sorted(((r["id"], r["kept"], r["dropped"]) for r in linededup.without_boilerplate(df).collect()), key=str)
    want = [(i, [f"own {i}", None, f"own {i}"], 2) for i in range(6)] + [(6, [], 1), (7, ["menu"], 0), (8, [], 0), (9, ["menu"], 0), (10, ["menu"], 0), (10, ["menu"], 0)]
    assert got == sorted(want, key=str)
    assert linededup.without_boilerplate(df.limit(0)).count() == 0


def test_a_line_at_the_ratio_stays(spark):
    df = spark.createDataFrame([(i, "h", ["often"] if i < 3 else ["rare"] if i == 3 else []) for i in range(10)], "id long, host string, lines array<string>")
    assert all(r["dropped"] == 0 for r in linededup.without_boilerplate(df).collect())


def test_html_lines(spark):
    page = "<html><script>var a='<p>x</p>'</script><body><p>One  two<b>three</b></p><!-- c --><ul><li>a<li>b</ul>tail<br>end</body>"
    df = spark.createDataFrame([(1, "http://h/x", page), (2, None, None)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in linededup.cleaned_pages(df).collect()}
    assert got == {1: "One twothree\na\nb\ntail\nend", 2: ""}


def test_many_hosts_are_joined_by_salted_copies(spark, monkeypatch):
    from tallyglass.llm import store

    df = spark.createDataFrame([(i, f"h{i % 3}", ["menu", f"own {i}"]) for i in range(60)], "id long, host string, lines array<string>")
    want = sorted(map(tuple, linededup.without_boilerplate(df).select("id", "dropped").collect()))
    monkeypatch.setattr(store, "BROADCAST_BYTES", -1)
    assert sorted(map(tuple, linededup.without_boilerplate(df).select("id", "dropped").collect())) == want
    assert all(n == 1 for _, n in want)


def test_time_grows_with_the_page_only(spark):
    import time

    pages = [(k, f"http://h{k}/", "<p>head</p>" + piece * ((1 << 20) // len(piece))) for k, piece in enumerate(("<!--", "<script ", "<style ", "<!-- -", "</script ", "<p", "< ", "<!-->"))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(1)
    linededup.cleaned_pages(df.limit(0)).count()
    start = time.perf_counter()
    rows = {r["page_id"]: r["text"] for r in linededup.cleaned_pages(df).collect()}
    assert time.perf_counter() - start < 30
    assert [rows[k] for k in range(4)] == ["head"] * 4
