import random

from pyspark.sql import functions as F

from marlpit.functions import attribution, urls
from marlpit.operators import crawl, network
from marlpit.sources import tables


def test_url_identity(spark):
    cases = [
        ("HTTP://Example.COM:80/a?b=2&a=1&utm_source=x#top", "http://example.com/a?a=1&b=2"),
        ("https://example.com./%7euser/%e2", "https://example.com/~user/%E2"),
        ("https://u:p@example.com?q=a+b&x", "https://example.com/?q=a%20b&x="),
        ("https://example.com/?ASPSESSIONIDQWERTY=1&sidebar=2", "https://example.com/?sidebar=2"),
        ("mailto:a@b.c", None), ("#x", None), ("", None), ("https://e.test/" + "a" * 2050, None),
    ]
    df = urls.normalise_urls(spark.createDataFrame([(i, u) for i, (u, _) in enumerate(cases)], "i int, u string"), "u")
    got = {r.i: r.normalised for r in df.collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]
    assert {r.i: r.refusal for r in df.collect()}[7] == "too_long"


def test_relative_urls_resolve(spark):
    df = spark.createDataFrame([("/x/é?b=1", "https://e.test/a/b"), ("c", "https://e.test/a/b")], "u string, b string")
    assert [r.normalised for r in urls.normalise_urls(df, "u", "b").collect()] == ["https://e.test/x/%C3%A9?b=1", "https://e.test/a/c"]


def test_scope(spark):
    rows = [("https://a.test/x", "http://a.test"), ("http://a.test/", "http://a.test"), ("https://b.a.test/", "https://a.test"), ("https://nota.test/", "https://a.test")]
    df = spark.createDataFrame(rows, "u string, o string").select(urls.classify_scope(F.col("u"), F.col("o")).alias("s"))
    assert [r.s for r in df.collect()] == ["scheme_upgrade", "in_scope", "other_subdomain", "external"]


def test_source_order(spark):
    rows = [(1, "g", None, None, None, None, "https://m.facebook.com"), (2, None, None, None, None, None, "https://searchenginejournal.com"), (3, None, None, None, None, "spring", None), (4, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id int, gclid string, fbclid string, utm_medium string, utm_source string, utm_campaign string, referrer string")
    got = {r.id: (r.source_type, r.confidence) for r in attribution.classify_source(df).collect()}
    assert got == {1: ("paid_search", "declared"), 2: ("referral", "derived"), 3: ("unknown", "derived"), 4: ("direct", "inferred")}


def test_robots(spark):
    body = "User-agent: *\nAllow: /\n\nUser-agent: *\nDisallow: /admin # no\nDisallow /old\nAllow: /admin/open$\n"
    rules, _ = tables.parse_robots(spark.createDataFrame([("o", body)], "origin string, body string"))
    pages = spark.createDataFrame([("o", p, p) for p in ("/admin/x", "/admin/open", "/admin/open2", "/old/x", "/free")], "origin string, url string, path string")
    got = {r.url: r.allowed for r in crawl.robots_verdicts(pages, rules, "us").collect()}
    assert got == {"/admin/x": False, "/admin/open": True, "/admin/open2": False, "/old/x": False, "/free": True}


def test_robots_files_that_must_not_fail_open(spark):
    """Marks, line ends, blanks and cuts that could lose a rule or make one up."""
    long = "User-agent: *\nDisallow: /private\n"
    bodies = {
        "mark": "\ufeffUser-agent: *\nDisallow: /x",
        "cr": "User-agent: *\rDisallow: /x\r" + "# filler\r" * 100,
        "crlf": "User-agent:\t*\r\nDisallow:\t/x\t#c\r\n",
        "blank": "\u00a0User-agent\u3000: \u00a0*\nUserAgent: other\n\x0bDisallow \t /x",
        "stump": long + "#" * (60 - len(long)) + "\nAllow: /private-page\n",
        "line": "User-agent: *" + " " * 100 + "\nDisallow: /x",
        "nobody": "User-agent: a\nDisallow: /y\nUser-agent:\nDisallow: /x",
        "early": "Disallow: /x\nUser-agent: *\nCrawl-delay: 3\nDisallow: /y",
        "spaces": "User-agent: *\nDisallow /x y\nDisallow: /x y",
    }
    rules, _ = tables.parse_robots(spark.createDataFrame([*bodies.items()], "origin string, body string"), max_bytes=75)
    got = sorted((r.origin, r.agent, r.kind, r.pattern) for r in rules.collect())
    assert got == sorted([
        ("mark", "*", "disallow", "/x"), ("cr", "*", "disallow", "/x"), ("crlf", "*", "disallow", "/x"), ("blank", "*", "disallow", "/x"), ("blank", "other", "disallow", "/x"), ("stump", "*", "disallow", "/private"),
        ("nobody", "a", "disallow", "/y"), ("early", "*", "crawl-delay", "3"), ("early", "*", "disallow", "/y"), ("spaces", "*", "disallow", "/x y"),
    ])
    counted, maps = tables.parse_robots(spark.createDataFrame([("o", "User-agent: *\nCrawl-delay: 1\nDisallow: /abcdef\nAllow: /b\nSitemap: https://e.test/\nSitemap: /m")], "origin string, body string"), max_rules=1, max_pattern=4)
    assert sorted((r.kind, r.pattern) for r in counted.collect()) == [("crawl-delay", "1"), ("disallow", "/abc")] and [r.url for r in maps.collect()] == ["/m"]


def test_orphans_ignore_self_and_external_links(spark):
    pages = spark.createDataFrame([(1, k, f"u{k}", 0, "fetched") for k in (1, 2, 3, 4)], "crawl_id int, page_id int, url string, depth int, outcome string")
    links = spark.createDataFrame([(1, 1, "u1", "internal"), (1, 1, "u2", "internal"), (1, 1, "u3", "external"), (2, 9, "u4", "internal")], "crawl_id int, source_page_id int, target_url string, scope string")
    assert {r.page_id for r in crawl.orphan_pages(pages, links).collect()} == {1, 3, 4}


def test_links(spark):
    html = '<base href="/b/"><!-- <a href="/no">x</a> --><script><a href="/no2"></script><a rel="nofollow" href="c">One <b>two</b></a><a href="mailto:x@y.z">m</a>'
    got = crawl.extract_links(spark.createDataFrame([(1, "https://e.test/a", html, "https://e.test")], "page_id long, url string, html string, origin string")).collect()
    assert [(r.target_url, r.anchor_text, r.is_nofollow) for r in got] == [("https://e.test/b/c", "One two", True), (None, "m", False)]


def test_sitemaps(spark):
    docs = [("s", '<s:urlset xmlns:s="x"><s:url><s:loc>https://e.test/1</s:loc></s:url><s:url><s:loc>bad</s:loc></s:url></s:urlset>'), ("i", "<sitemapindex><sitemap><loc>https://e.test/s2</loc></sitemap></sitemapindex>"), ("n", "hello"), ("e", "")]
    entries, children, rejects = tables.parse_sitemaps(spark.createDataFrame(docs, "url string, body string"))
    assert [r["loc"] for r in entries.collect()] == ["https://e.test/1"]
    assert [r.child for r in children.collect()] == ["https://e.test/s2"]
    assert sorted((r.url, r.reason) for r in rejects.collect()) == [("e", "empty"), ("n", "not_a_sitemap"), ("s", "skipped")]


def test_addresses(spark):
    want = {
        "10.1.2.3": "private-a", "255.255.255.255": "broadcast", "8.8.8.8": "public", "169.254.169.254": "link-local", "::1": "loopback", "::": "unspecified", "fe80::1": "link-local", "2606:4700::1": "public",
        "::ffff:10.0.0.1": "private-a", "::ffff:7f00:1": "loopback", "::FFFF:8.8.8.8": "embedded-ipv4", "64:ff9b::a00:1": "private-a", "64:ff9b::8.8.8.8": "embedded-ipv4", "64:ff9b:1::a00:1": "public",
        "08.8.8.8": "invalid", "010.0.0.1": "invalid", "8.8.8.8 ": "invalid", "1:2:3:4:5:6:7::8": "invalid", "1:2:3:4:5:6:7:8:": "invalid", ":1:2:3:4:5:6:7:8": "invalid", "1:2:3:4:5:6:7": "invalid",
        "1:2:3:4:5:6:7::": "public", "::2:3:4:5:6:7:8": "public", "fe80::1%eth0": "link-local", "8.8.8.8%eth0": "invalid", "::ffff:010.0.0.1": "invalid", "1:2:3:4:5:6::1.2.3.4": "invalid", "1:2:3:4:5:6:10.0.0.1": "public",
        ":::": "invalid", ":": "invalid", "1.2.3.4::": "invalid", "0.0.0.0": "this-network", "0.0.0.0.0": "invalid", "10.0.0.0": "private-a", "10.255.255.255": "private-a", "172.15.255.255": "public", "172.16.0.0": "private-b",
        "172.31.255.255": "private-b", "172.32.0.1": "public", "100.63.255.255": "public", "100.64.0.0": "cgnat", "100.127.255.255": "cgnat", "100.128.0.1": "public", "169.253.255.255": "public", "169.255.0.1": "public",
        "198.19.255.255": "benchmarking", "198.20.0.0": "public", "223.255.255.255": "public", "224.0.0.1": "multicast", "fbff::1": "public", "fc00::": "unique-local", "fec0::1": "public", "2001:db8::1": "documentation",
        "2001:20::1": "orchid-v2", "2001::1": "teredo", "2002::1": "6to4", "64:ff9b::7f00:1": "loopback", "1::g": "invalid", "１.2.3.4": "invalid",
        "999.1.1.1": "invalid", "1.2.3": "invalid", "1::2::3": "invalid", "example.com": "invalid", "": "invalid", "12345::1": "invalid",
    }
    df = network.classify_addresses(spark.createDataFrame([(k,) for k in want], "ip string"), "ip")
    assert {r.ip: r.range_name for r in df.collect()} == want


def test_hosts_and_origins(spark):
    rows = [
        ("https://abc.test/x?y", "abc.test", "https://abc.test"), ("HTTPS://WWW.Abc.Test", "abc.test", "https://www.abc.test"), ("https:/\\evil.test", "evil.test", "https://evil.test"), ("\thttps://e.test", "e.test", "https://e.test"),
        ("http://abc.test:80/", "abc.test", "http://abc.test"), ("https://abc.test:8443", "abc.test", "https://abc.test:8443"), ("abc.test/contact", "abc.test", "https://abc.test"),
        ("https://allowed.test@evil.test/", "evil.test", "https://evil.test"), ("https://evil.test@abc.test", "abc.test", "https://abc.test"), ("https://a@b@c.test", "c.test", "https://c.test"),
        ("file:///etc/passwd", None, None), ("mailto:a@b.test", None, None), ("javascript:alert(1)", None, None), ("localhost:3000", None, None), ("abc.test:8080", None, None), ("/contact", None, None), ("//cdn.test", None, None),
        ("", None, None), (None, None, None), ("https://", None, None), ("https://a b.test", None, None), ("https://x.test:99999", None, None), ("https://x.test/" + "a" * 250, "x.test", None),
    ]
    df = spark.createDataFrame([(k, r[0]) for k, r in enumerate(rows)], "k int, u string")
    got = {r.k: (r.h, r.o) for r in df.select("k", urls.bare_host(F.col("u")).alias("h"), urls.normalise_origin(F.col("u")).alias("o")).collect()}
    assert [got[k] for k in range(len(rows))] == [r[1:] for r in rows]
    checks = [("https://abc.test", ["https://abc.test"], True), ("https://allowed.test@evil.test", ["https://allowed.test"], False), ("https://evil-abc.test", ["abc.test"], False), ("https://www.abc.test", ["abc.test"], False), ("null", [], True), ("null", ["null"], False)]
    df = spark.createDataFrame([(k, o, a) for k, (o, a, _) in enumerate(checks)], "k int, o string, a array<string>")
    assert [r.ok for r in df.select("k", urls.origin_allowed(F.col("o"), F.col("a")).alias("ok")).orderBy("k").collect()] == [c[2] for c in checks]


def test_hosts_as_browsers_read_them(spark):
    want = {
        "http://2130706433/": "127.0.0.1", "http://0x7f.1": "127.0.0.1", "http://0X7F000001:80/x": "127.0.0.1", "http://010.0.0.1": "8.0.0.1", "127.1": "127.0.0.1", "http://1.2.3.4.": "1.2.3.4", "http://10.0.0.0x": "10.0.0.0", "http://1.65535": "1.0.255.255",
        "http://256.1.1.1": None, "http://1.2.3.4.5": None, "http://1.2.3.08": None, "http://4294967296": None, "http://1..2": None, "http://a.test.09": None, "http://1.2.3.256": None, "http://1.a.test": "1.a.test",
        "https://Bücher.example/x": "xn--bcher-kva.example", "https://xn--bcher-kva.example": "xn--bcher-kva.example", "https://faß.de": "xn--fa-hia.de", "例え。テスト": "xn--r8jz45g.xn--zckzah", "https://www.münchen.test": "xn--mnchen-3ya.test",
        "https://ｅｘａｍｐｌｅ．test": "example.test", "https://ex%41mple.test": "example.test", "https://b%C3%BCcher.test": "xn--bcher-kva.test", "https://so\u00adft.test": "soft.test", "https://☃.test": "xn--n3h.test", "http://１２７.1": "127.0.0.1",
        "https://xn--a.test": None, "https://xn--.test": None, "https://a%2fb.test": None, "https://a%20b.test": None, "https://%ff.test": None, "https://\u0301a.test": None, "https://a\u200db.test": None,
        "http://[0:0:0:0:0:0:0:1]": "[::1]", "http://[::ffff:1.2.3.4]:8080": "[::ffff:102:304]", "http://[1:0:0:2:0:0:0:3]": "[1:0:0:2::3]", "http://[1:2:3:4:5:6:0:8]": "[1:2:3:4:5:6:0:8]", "http://[1::2::3]": None, "http://[1:2]": None, "http://[::]": "[::]", "http://[1:2:3:4:5:6:7:8:9]": None, "http://[::1.2.3]": None,
    }
    df = spark.createDataFrame([(u,) for u in want], "u string")
    assert {r.u: r.h for r in df.select("u", urls.bare_host(F.col("u")).alias("h")).collect()} == want
    checks = [("http://0x7f.1:8080", ["http://127.0.0.1:8080"], True), ("http://127.0.0.1", ["http://2130706433", None], True), ("https://bücher.test", ["https://a.test", "XN--BCHER-KVA.test"], True), ("https://bucher.test", ["bücher.test"], False), ("http://256.1", ["http://256.1"], False)]
    df = spark.createDataFrame([(k, o, a) for k, (o, a, _) in enumerate(checks)], "k int, o string, a array<string>")
    assert [r.ok for r in df.select("k", urls.origin_allowed(F.col("o"), F.col("a")).alias("ok")).orderBy("k").collect()] == [c[2] for c in checks]
    whole = {"http://0x7f.1/a": "http://127.0.0.1/a", "https://bücher.test/ü": "https://xn--bcher-kva.test/%C3%BC", "https://ex%41mple.test:8443/?b=1": "https://example.test:8443/?b=1", "http://1.2.3.256/": None, "http://[0::1]/": "http://[::1]/", "http://a.test/1.2": "http://a.test/1.2", "http://faß.de/": "http://xn--fa-hia.de/"}
    df = spark.createDataFrame([(u,) for u in whole], "u string")
    assert {r.u: r.normalised for r in urls.normalise_urls(df, "u").collect()} == whole


def test_policy(spark):
    want = {
        "https://a.test/?code=SPRING20&state=VIC&key=colour&id=1&design=2&tokenizer=3": None, "https://a.test:443/": None, "http://a.test:80/": None, "https://a.test/#?token=1": None, "https://@a.test/": None,
        "https://a.test/?access_token=1": "sensitive_query", "https://a.test/?PHPSESSID=1": "sensitive_query", "https://a.test/?x-amz-sig=1": "sensitive_query", "https://a.test/?email=a": "sensitive_query", "https://a.test/?a=1&reset=1": "sensitive_query",
        "https://a.test/?user%5Btoken%5D=1": "sensitive_query", "https://a.test/?unsubscribe": "sensitive_query", "https://u:p@a.test/": "credentials_present", "https://evil.test@10.0.0.1/": "credentials_present", "https://a.test:8443/": "port_not_allowed",
        "ftp://a.test/": "scheme_not_allowed", "file:///etc/passwd": "scheme_not_allowed", "not a url": "unparseable", "https://": "unparseable", "https://" + "a" * 254 + "/": "host_too_long", "https://a.test/" + "a" * 2048: "url_too_long",
    }
    df = spark.createDataFrame([(u,) for u in want], "u string")
    assert {r.u: r.p for r in df.select("u", urls.url_policy(F.col("u")).alias("p")).collect()} == want


def test_robots_details(spark):
    bodies = {
        "tie": "User-agent: *\nAllow: /ab\nDisallow: /ab$\nCrawl-delay: 2\nUser-agent: *\nCrawl-delay: 9\nCrawl-delay: banana",
        "named": "User-agent: US\nUser-agent: them\nDisallow: /a*b*c\nDisallow: /*.pdf$\nCrawl-delay: 90000\n\nUser-agent: *\nDisallow: /",
        "empty": "User-agent: *\nDisallow:\n",
    }
    rules, _ = tables.parse_robots(spark.createDataFrame([*bodies.items()], "origin string, body string"))
    asked = [("tie", "/ab"), ("tie", "/abc"), ("named", "/axbyc"), ("named", "/acb"), ("named", "/x.pdf"), ("named", "/x.pdfs"), ("empty", "/x"), ("none", "/x")]
    pages = spark.createDataFrame([(o, k, p) for k, (o, p) in enumerate(asked)], "origin string, url int, path string")
    got = {r.url: (r.allowed, r.reason, r.crawl_delay) for r in crawl.robots_verdicts(pages, rules, "us").collect()}
    assert [got[k] for k in range(len(asked))] == [
        (True, "allow_wins_tie", 9.0), (True, "longest_match", 9.0), (False, "longest_match", None), (True, "no_rule_matched", None), (False, "longest_match", None), (True, "no_rule_matched", None), (True, "empty_disallow", None), (True, "no_group_matched", None),
    ]


def test_link_report_matches_a_plain_count(spark):
    """Links in and out of small pages against dictionaries."""
    import re

    own = {1: ["/p/2", "/p/3", "https://x.test/"], 2: ["/p/2", "/p/1#top"], 3: ["/p/1", "/p/1", "mailto:a@b.c"], 4: []}
    rows = [(k, f"https://e.test/p/{k}", "".join(f"<a {'rel=nofollow ' if n == 0 else ''}href='{h}'>t</a>" for n, h in enumerate(hrefs)), "https://e.test") for k, hrefs in own.items()]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, origin string")
    got = {r.page_id: (r.links_out, r.internal_out, r.nofollow_out, r.links_in, r.is_orphan) for r in crawl.link_report(pages, crawl.extract_links(pages)).collect()}
    into = {k: sum(bool(re.fullmatch(f"/p/{k}(#.*)?", h)) for source, hrefs in own.items() if source != k for h in hrefs) for k in own}
    assert got == {k: (len(h), sum(x.startswith("/") for x in h), int(bool(h)), into[k], into[k] == 0) for k, h in own.items()}


def test_contacts_csv(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text('Name, Mail \n"A, B",a@b.c\n\nOnly\n')
    rows, report = tables.read_contacts_csv(spark, str(path))
    assert rows.columns == ["Name", "Mail"] and {tuple(r) for r in rows.collect()} == {("A, B", "a@b.c"), ("Only", "")}
    assert report.first().n_rows == 2


def test_ranks_within_keys_match_a_plain_sort(spark):
    """Keys of all sizes, a null one and one with most of all rows, ranked over ranges of few rows."""
    own = random.Random(7)
    rows = [(own.choice([None, "a", "b", "hot", "hot", "hot", "hot"]), own.randrange(50), k) for k in range(600)]
    df = spark.createDataFrame(rows, "key string, v int, id int").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.id: r.n for r in tables.ranked(df, ["key"], [F.col("v").desc(), F.col("id").asc()]).collect()}
        whole = {r.id: r.n for r in tables.ranked(df, [], [F.col("v").asc(), F.col("id").asc()]).collect()}
        none = tables.ranked(df.limit(0), ["key"], [F.col("v").asc()])
        assert none.columns == ["key", "v", "id", "n"] and none.isEmpty()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {}
    for key in {r[0] for r in rows}:
        for n, (_, _, k) in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2]))):
            want[k] = n + 1
    assert got == want
    assert whole == {k: n + 1 for n, (_, _, k) in enumerate(sorted(rows, key=lambda r: (r[1], r[2])))}
