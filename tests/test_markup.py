"""The HTML scanner: what it finds in odd pages, and that no page takes more than linear time."""

import time

import pandas as pd
import pytest

from marlpit.functions import markup
from marlpit.operators import crawl


def links(page):
    return [(href, text, rel) for _, href, text, rel in markup.scan_links(page)[1]]


def test_tags_and_attributes():
    assert links("<a href=x>One</a><A HREF='y' href=z rel='UGC a'>T <b>two</b>\n</A>") == [("x", "One", ""), ("y", "T two", "ugc a")]
    assert links('<a title="a > b" href="x" / >t</a>') == [("x", "t", "")]
    assert links("<a data-href=n x=href=m>t</a><a href>e</a>") == [("", "e", "")]
    assert links('<a href="x?a=1&amp;b=2&#38;c&copy;d&ltz">&lt;&nbsp;&#x41;&#0;</a>') == [("x?a=1&b=2&c&copy;d&ltz", "< A&#0;", "")]
    assert links("<abbr href=n><a\nhref = x>t</a\n>") == [("x", "t", "")]
    assert links("<a href=x>a <i") == [("x", "a <i", "")]
    assert links("1 < 2 <a href=x>t</a> < <3") == [("x", "t", "")]
    assert links("<a href=x>  </a><a href=y>" + "ab " * 200 + "</a>") == [("x", None, ""), ("y", ("ab " * 200)[:300], "")]
    assert links("<a href=İ>ǅ</a><a href=b>c</a>") == [("İ", "ǅ", ""), ("b", "c", "")]


def test_what_holds_no_links():
    for skipped in ("<!-- <a href=n>n</a> -->", "<script>'<a href=n>'</script>", "<STYLE x='>'><a href=n></style >", "<svg><a href=n></a></svg>", "<noscript><a href=n></noscript>", "<template><a href=n></a></template>"):
        assert links(f"<a href=x>t</a>{skipped}<a href=y>u</a>") == [("x", "t", ""), ("y", "u", "")]
    for open_end in ("<!-- <a href=n>", "<script><a href=n>", '<p title="<a href=n>'):
        assert links(f"<a href=x>t</a>{open_end}") == [("x", "t", "")]


def test_open_anchors_take_the_rest_of_the_page():
    assert links("<a href=x>one <a href=y>two</a> three") == [("x", "one two", "")]
    assert links("<a href=x>one <a href=y>two <b>three") == [("x", "one two three", ""), ("y", "two three", "")]
    assert links('<a href="p>q">one <i>&nbsp;</i><a href="r>s">two') == [("p>q", 'one s">two', ""), ("r>s", "two", "")]


def test_bases_count_from_where_they_stand(spark):
    page = '<a href="a">1</a><base href="javascript:x"><base target=t><base href="/b/"><base href="/c/"><a href="a">2</a>'
    frame = spark.createDataFrame([(1, "https://e.test/p/q", page, "https://e.test")], "page_id long, url string, html string, origin string")
    assert [r.target_url for r in crawl.extract_links(frame).collect()] == ["https://e.test/p/a", "https://e.test/b/a"]


def test_every_link_and_base_of_a_page_counts(spark):
    """pages of more than 5000 links, and of more than 16 base tags that are none."""
    page = '<base href="javascript:x">' * 30 + '<base href="/b/">' + "".join(f"<a href={k}>t</a>" for k in range(12_000))
    assert len(markup.scan_links(page)[1]) == 12_000
    frame = spark.createDataFrame([(1, "https://e.test/p/q", page, "https://e.test")], "page_id long, url string, html string, origin string")
    found = crawl.extract_links(frame).orderBy("place").collect()
    assert [r.target_url for r in found] == [f"https://e.test/b/{k}" for k in range(12_000)]
    assert [r.place for r in found] == list(range(12_000))


def test_metas():
    token = "0f" * 16
    good = f'<meta content=" {token} " name=" Own ">'
    metas = lambda page: [*markup.scan_metas(page, "own")]
    assert metas(f"<head>{good}</head>") == metas(f"<html><HEAD x>{good}") == metas(f"<head><svg/><title><head></title>{good}") == [token]
    for page in (good, f"<head></head>{good}", f"<head><!--{good}--></head>", f"<head><svg>{good}</svg></head>", f"<head><template><p></svg>{good}</template>", f"<head><body>{good}", f"<head><script>{good}</script>", f"<head><metadata content={token} name=own>", f"<head><meta data-name=own content={token}>", f"<head><title>{good}"):
        assert metas(page) == []
    assert metas(f"<head><template>{good}</head><head>{good}") == [token]
    assert metas(f"<head><math>{good}</math>{good}<meta name=own content=other><meta name=own name=x content>") == [token, "other", ""]


@pytest.mark.parametrize("part", ["<a ", "<meta ", "<a href=x ", '<a href="', "<meta name=own ", "<!--", "<", "&#", "a<"])
def test_hostile_pages_take_linear_time(part):
    """16 MB in about a second; twice that is allowed for a busy machine."""
    page = "<head>" + part * ((16 << 20) // len(part))
    began = time.thread_time()
    markup.scan_links(page)
    half = time.thread_time()
    assert list(markup.scan_metas(page, "own")) == []
    assert half - began < 3 and time.thread_time() - half < 3


@pytest.mark.parametrize("part", ["<a>", "<a href=x>", "<a href=x>y ", "<a href=x></a>", "<template>", "</a", "<title>", "<a href='>'>z"])
def test_many_tags_take_linear_time(part):
    took = []
    for n in (1 << 19, 1 << 21):
        page = "<head>" + part * (n // len(part))
        began = time.thread_time()
        markup.scan_links(page, most=10**9)
        list(markup.scan_metas(page, "own"))
        took.append(time.thread_time() - began)
    assert took[1] < 10 * max(took[0], 0.1)


def test_pages_come_and_links_go_in_small_batches(spark):
    """A worker holds neither many pages nor all their links."""
    frames = pd.DataFrame({"page_id": [1, 2], "url": ["https://a.b/", None], "origin": ["https://a.b", None], "html": ["<a href='/x'>x</a>" * 25, None]})
    out = [len(f) for f in crawl.link_batches(iter([frames]), most=10)]
    assert out == [10, 10, 5]
    pages = spark.range(0, 60, 1, 1).selectExpr("id as page_id", "'https://a.b/' as url", "'https://a.b' as origin", "concat('<a href=\"/x\">', repeat('y', 1000000), '</a>') as html")
    links = crawl.extract_links(pages)

    def sizes(batches):
        for b in batches:
            yield pd.DataFrame({"n": [len(b)]})

    seen = [r.n for r in pages.select("html").mapInPandas(sizes, "n long").collect()]
    assert sum(seen) == 60 and max(seen) <= 9 and links.count() == 60
