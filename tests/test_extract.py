"""Links and records of hand-made pages."""

import gc
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagelake.operators import extract as ex
from pagelake.plans import page_queries

LISTING = (
    '<div class="k2"><div><a href="sitemap_0.html">上一页</a><a href=" sitemap_2.html ">下一页</a></div></div>'
    '<div class="sousuolist x"><a href="/book_1.html?a=1&amp;b=2">A</a></div>'
    '<div class="sousuolist"><a href="">empty</a></div>'
)


def pages(spark, *htmls):
    rows = [(f"http://h.org/sitemap_{i + 1}.html", h) for i, h in enumerate(htmls)]
    return spark.createDataFrame(rows, "url string, html string")


def asked(spark, html):
    return sorted((r.kind, r.url) for r in ex.listing_requests(pages(spark, html)).collect())


def test_listing_page(spark):
    assert asked(spark, LISTING) == [
        ("detail", "http://h.org/book_1.html?a=1&b=2"),
        ("list", "http://h.org/sitemap_2.html"),
    ]


def test_listing_variants(spark):
    assert asked(spark, LISTING.replace("下一页", "其他")) == [("detail", "http://h.org/book_1.html?a=1&b=2")]
    two = LISTING.replace("上一页", "下一页")
    assert ("list", "http://h.org/sitemap_0.html") in asked(spark, two)
    assert [k for k, _ in asked(spark, two)].count("list") == 1
    assert asked(spark, LISTING.replace('class="k2"', 'class="k2 x"')) == [("detail", "http://h.org/book_1.html?a=1&b=2")]


def test_flat_and_container_links_agree_with_listing_requests(spark):
    df = pages(spark, LISTING)
    links = ex.container_links(df)
    forward = [r.href for r in ex.next_link(links).collect()]
    details = [r.href for r in ex.detail_links(links).collect()]
    assert forward == [" sitemap_2.html "] and details == ["/book_1.html?a=1&amp;b=2".replace("&amp;", "&")]
    flat = [(r.pos, r.text) for r in ex.extract_links(df).orderBy("pos").collect()]
    assert flat == [(0, "上一页"), (1, "下一页"), (2, "A"), (3, "empty")]


def test_links_skip_comments_and_scripts(spark):
    html = '<!-- <a href="/c">c</a> --><script>var s = "<a href=\'/s\'>"</script><p>x<div class="a"><br><A HREF=\'/y\'>t<b>u</b></A></div>'
    got = [(r.href, r.text, r.cls) for r in ex.container_links(pages(spark, html)).collect()]
    assert got == [("/y", "t", "a")]


STRAY = [
    """<a href=/a title=it's>A</a> <a href="/b">B</a><p>x</p><a href="/c">C</a>""",
    """<p title="<a href='/no'>">t<a x='>' href='/y>z'>q > r</a><a href>e</a><a href=>f</a><a/href="/s">s</a>
    <A HREF=/u/>U</A><abbr href=/n>n</abbr><a name=1><a href="/last">l</a><a href="/cut""",
    """<a href="/open>o</a><a href='/x'>x</a>""",
    """<style>a{}</style ><a href=1>1</a><script src="</script>">'<a href=2>2</a></script x><a href=3>3</a><!-- > <a href=4> --><a =href=5 href=6>6""",
]


def test_stray_quotes_in_tags(spark):
    df = pages(spark, *STRAY, None, "")
    flat = sorted((r.src_url[-6:-5], r.pos, r.href, r.text) for r in ex.extract_links(df).collect())
    tree = sorted((r.src_url[-6:-5], r.pos, r.href, r.text) for r in ex.container_links(df).collect())
    assert flat == tree
    assert [x[2:] for x in flat if x[0] == "1"] == [("/a", "A"), ("/b", "B"), ("/c", "C")]
    assert [x[2] for x in flat if x[0] == "2"] == ["/y>z", "", "/s", "/u/", "/last"]
    assert [x[2] for x in flat if x[0] == "3"] == []
    assert [x[2] for x in flat if x[0] == "4"] == ["1", "3", "6"]


def test_links_in_detail_pages_with_stray_quotes(spark):
    r = record(spark, "<p title=it's>x</p>" + NAME + AUTHOR + TEXT + COVER + HEAD + ROW.replace('href="http://s.org/"', "href=http://s.org/ x'"))
    assert r.reject is None and r.book_download[0].source_site == ["Site", "http://s.org/"]


@pytest.mark.parametrize(
    "html, text, title",
    [
        ("<div class='x'>one", "one", None),
        ('<div class="x" title="a>b">two</div>', "two", "a>b"),
        ("<div title='a' id=1 class=x>three</div><div class=x>no", "three", "a"),
        ("<!-- <div class=x>no</div> --><script><div class=x>no</script><p title='<div class=x>no'><DIV\nCLASS = x >four", "four", None),
        ("<div class='x y'>no</div><div class=xx>no</div><divx class=x>no</divx>", None, None),
        ("<div class=x><b>no</b></div><div class=x title=''>five", "five", ""),
    ],
)
def test_select_first_in_any_quoting(spark, html, text, title):
    got = pages(spark, html).select(
        ex.select_first(F.col("html"), "div", "x").alias("text"), ex.select_first(F.col("html"), "div", "x", "title").alias("title")
    )
    assert tuple(got.first()) == (text, title)
    found = [n for n in ex._elements(html) if n.tag == "div" and n.attribute("class") == "x"]
    assert next((n.text() for n in found if n.texts), None) == text


def test_select_first(spark):
    html = '<title>T &amp; U</title><h1>\nA</h1><div class="ad x">no</div><div id="1" class="ad">yes</div><img src="/i">'
    row = pages(spark, html).select(
        ex.select_first(F.col("html"), "title").alias("t"),
        ex.select_first(F.col("html"), "div", cls="ad").alias("d"),
        ex.select_first(F.col("html"), "img", attribute="src").alias("i"),
        ex.select_first(F.col("html"), "h2").alias("n"),
    ).first()
    assert tuple(row) == ("T &amp; U", "yes", "/i", None)


NAME, AUTHOR = '<div class="zizida">Name</div>', '<div class="xiaoxiao">12345 Author </div>'
TEXT, COVER = '<div class="lili"> text </div>', '<div class="hong"><img src="http://h.org/c.jpg"></div>'
HEAD = '<div class="xiazai_xiao head">header</div>'
ROW = (
    '<div class="xiazai_xiao"><div><a href="http://f.org/a.rar">1</a></div>'
    '<div><a href="http://f.org/a.rar">2</a></div><div>done</div><div>2013-04-17</div>'
    '<div><a href="http://s.org/">Site</a></div></div>'
)


def record(spark, html):
    return ex.extract_detail(pages(spark, html)).first()


def test_detail_page(spark):
    r = record(spark, NAME + AUTHOR + TEXT + COVER + HEAD + ROW)
    assert (r.book_name, r.author, r.book_description) == ("Name", ["Author"], "text")
    assert r.book_covor_image_url == "http://h.org/c.jpg" and r.reject is None
    assert r.original_url == "http://h.org/sitemap_1.html"
    (d,) = r.book_download
    assert (d.url, d.progress, d.update_time, d.source_site) == (
        ["http://f.org/a.rar"], "done", "2013-04-17", ["Site", "http://s.org/"],
    )


@pytest.mark.parametrize(
    "html, reason",
    [
        (NAME + TEXT + COVER + HEAD + ROW, "no-author"),
        (NAME + AUTHOR + COVER + HEAD + ROW, "no-description"),
        (NAME + AUTHOR + TEXT + HEAD + ROW.replace("<div>done</div>", ""), "short-download-row"),
        (AUTHOR + TEXT + HEAD + ROW, None),
        (NAME + AUTHOR + TEXT + HEAD, None),
    ],
)
def test_rejects(spark, html, reason):
    whole, lost = ex.split_rejects(ex.extract_detail(pages(spark, html)))
    assert [r.reason for r in lost.collect()] == ([reason] if reason else [])
    assert whole.count() == (0 if reason else 1)


def test_detail_variants(spark):
    assert record(spark, AUTHOR + TEXT + HEAD).book_name is None
    assert record(spark, NAME + AUTHOR + TEXT).book_covor_image_url is None
    assert record(spark, NAME + AUTHOR + TEXT + HEAD).book_download == []
    bare = ROW.replace('<a href="http://f.org/a.rar">1</a>', "").replace('<a href="http://f.org/a.rar">2</a>', "")
    assert record(spark, NAME + AUTHOR + TEXT + HEAD + bare).book_download[0].url == []
    # the first direct text counts, also behind a child; only the first div of a parent does
    assert record(spark, '<div class="zizida"><b>x</b>after</div>' + AUTHOR + TEXT).book_name == "after"
    two = '<div class="zizida"></div><div class="zizida">second</div><p><div class="zizida">third</div>'
    assert record(spark, "<body>" + two + AUTHOR + TEXT).book_name is None
    other = '<div class="zizida"></div><span><div class="zizida">inner</div></span>'
    assert record(spark, other + AUTHOR + TEXT).book_name == "inner"


DETAIL = (
    '<p>i<div class="zizida">Book &amp; 1</div><div class="hong"><div><img src="/no"></div><img alt=x src=/c.jpg></div>'
    '<div class="xiazai_xiao"><div>h</div></div><div class="xiazai_xiao"><div>t<a name=n></a><a href="/1">one</a>s</div>'
    "<DIV>a< b</DIV ><div><br>u</br>v</div></div>"
)


def test_a_parsed_page_leaves_no_cycles():
    gc.collect()
    gc.disable()
    try:
        for _ in range(20):
            ex._detail_of(DETAIL)
            ex._links_of(DETAIL)
        assert gc.collect() == 0
    finally:
        gc.enable()


def test_leaf_elements_and_their_text(spark):
    row = pages(spark, DETAIL, None).select(ex._parsed_detail(F.col("html")).alias("d")).collect()
    assert row[1].d is None and (row[0].d.name, row[0].d.cover) == ("Book & 1", "/c.jpg")
    cells = [[tuple(c) for c in r] for r in row[0].d.rows]
    assert cells == [[("h", None, None)], [("t", "/1", "one"), ("a< b", None, None), ("u", None, None)]]


def test_lone_brackets_take_linear_time():
    def seconds(n):
        start = time.perf_counter()
        ex._elements("<div>" + "< " * n)
        return time.perf_counter() - start

    assert seconds(400_000) < 20 * min(seconds(50_000) for _ in range(3))


def test_a_batch_is_read_a_few_pages_at_a_time(monkeypatch):
    sizes, read = [], ex._details
    monkeypatch.setattr(ex, "_details", lambda pages: sizes.append(len(pages)) or read(pages))
    some = [None if i % 7 == 0 else f'<div class="zizida">{i}</div>{DETAIL}' for i in range(1000)]
    found = ex._page_detail.func(pa.array([DETAIL, *some]).slice(1)).to_pylist()
    assert len(sizes) > 1 and sum(sizes) == 1000
    assert [d and d["name"] for d in found] == [None if h is None else str(i) for i, h in enumerate(some)]
    assert len(ex._page_detail.func(pa.array([], pa.string()))) == 0


@pytest.mark.parametrize("cores", [8, 12, 16])
def test_few_cores_wait_for_the_last_pages(cores):
    rounds = -(-page_queries.PARSE_TASKS // cores)
    assert page_queries.PARSE_TASKS >= 0.9 * rounds * cores


def test_first_attribute_by_a_short_way():
    assert ex.markup.attribute_of(' href="/a>b" href=/c', "href") == "/a>b"
    assert ex.markup.attribute_of(' hrefs="/a" href=\'/c"\'', "href") == '/c"'
    assert ex.markup.attribute_of(' HREF="/a"', "href") == "/a" and ex.markup.attribute_of(' href=""', "href") == ""
    assert ex.markup.attribute_of(' href="/a', "href") == ""
