"""Column functions against fixed cases and Python's own implementations."""

import random
from urllib.parse import urljoin, urlsplit

import pytest
from pyspark.sql import functions as F

from pagelake.functions import files, metrics, text, urls


def one(spark, column, **values):
    schema = ", ".join(f"{n} {t}" for n, (t, _) in values.items()) or "x int"
    row = tuple(v for _, v in values.values()) or (0,)
    return spark.createDataFrame([row], schema).select(column.alias("r")).first()["r"]


def test_list_first_item(spark):
    assert one(spark, text.list_first_item(F.col("a")), a=("array<string>", ["x", "y"])) == "x"
    assert one(spark, text.list_first_item(F.col("a")), a=("array<string>", [])) is None
    assert one(spark, text.list_first_item(F.col("a")), a=("array<string>", None)) is None


def test_strip_null(spark):
    a = ("array<string>", ["a", None, "null", "b"])
    assert one(spark, text.strip_null(F.col("a")), a=a) == ["a", "b"]
    assert one(spark, text.strip_null(F.col("a"), ["a"]), a=a) == [None, "null", "b"]
    m = ("map<string,string>", {"a": "1", "b": None, "c": "null"})
    assert one(spark, text.strip_null_map(F.col("m")), m=m) == {"a": "1"}


def test_deduplication_keeps_first_seen_order(spark):
    assert one(spark, text.deduplication(F.col("a")), a=("array<string>", list("baba"))) == ["b", "a"]


def test_clean_link(spark):
    assert one(spark, text.clean_link(F.col("a")), a=("string", "\t \"/x' \n")) == "/x"


@pytest.mark.parametrize(
    "given, wanted",
    [
        ("a&amp;b", "a&b"),
        ("&quot;x&quot; &copy;&middot;&hearts;", '"x" ©·♥'),
        ("&#65;&#x42;&#X43;&#128;", "ABC€"),
        ("&amp;copy;", "&copy;"),
        ("&bogus;z", "z"),
        ("a & b; &nosemi", "a & b; &nosemi"),
        ("&#1114112;x&#55296;y", "xy"),
        ("none", "none"),
        (None, None),
    ],
)
def test_remove_entities(spark, given, wanted):
    assert one(spark, text.remove_entities(F.col("a")), a=("string", given)) == wanted


def test_resolve_url_is_rfc_3986(spark):
    bases = ["http://a.org/x/y.html?q=1", "http://a.org/x/y", "http://a.org", "https://u@h:81/a/b/c/?z#f"]
    refs = (
        "z.html /z //h/z ?p=2 #f ../../../z mailto:a@b http://q/.. ./a/./b .. . a/../../b?x=/../y "
        "/a/../b /./ x/y ../.. /.. a/.. é/ü /é?a=b#c"
    ).split() + [""]
    rows = spark.createDataFrame([(b, r) for b in bases for r in refs], "b string, r string")
    for row in rows.select("b", "r", urls.resolve_url(F.col("b"), F.col("r")).alias("u")).collect():
        assert row.u == urljoin(row.b, row.r), row


def test_clean_url(spark):
    got = one(
        spark,
        urls.clean_url(F.col("b"), F.col("l")),
        b=("string", "http://h.org/sitemap_1.html"),
        l=("string", " \t'/book_1.html?a=1&amp;b=2\" \n"),
    )
    assert got == "http://h.org/book_1.html?a=1&b=2"


@pytest.mark.parametrize(
    "url", ["http://down.sjtxt.com:8199/a.rar", "https://u:p@h/x", "//h/x", "http://a b/c", "nothing", "mailto:a@b", "http://h"]
)
def test_netloc_is_the_authority(spark, url):
    assert one(spark, urls.netloc(F.col("u")), u=("string", url)) == urlsplit(url).netloc


def test_url_key(spark):
    got = one(spark, urls.url_key(F.col("u"), "_"), u=("string", "http://h:1/a"))
    assert got == "h:1_" + __import__("hashlib").sha1(b"http://h:1/a").hexdigest()


def test_cache_url_round_trip(spark):
    cached = urls.to_cache_url(F.col("u"), ["h.org"])
    listed = one(spark, cached, u=("string", "http://h.org/a"))
    assert listed.endswith("cache:http://h.org/a")
    assert one(spark, cached, u=("string", "http://i.org/a")) == "http://i.org/a"
    back = urls.from_cache_url(F.col("u"), F.col("f"))
    assert one(spark, back, u=("string", listed), f=("boolean", True)) == "http://h.org/a"
    assert one(spark, back, u=("string", listed), f=("boolean", None)) == listed


def test_fingerprint_ignores_query_order_and_fragment(spark):
    fp = urls.fingerprint(F.col("u"), F.col("m"), F.col("b"))

    def of(u, m="GET", b=None):
        return one(spark, fp, u=("string", u), m=("string", m), b=("binary", b))

    assert of("http://h/a?x=1&y=2#f") == of("http://h/a?y=2&x=1")
    assert of("http://h") == of("http://h/")
    assert len({of("http://h/a"), of("http://h/a", "POST"), of("http://h/a", "POST", b"z"), of("http://h/b")}) == 4


@pytest.mark.parametrize(
    "url, header, name, failed",
    [
        ("http://h/a.zip", 'attachment; filename="b.txt"', "b.txt", False),
        ("http://h/a.zip", "attachment; filename*=UTF-8''b.txt", None, True),
        ("http://h/q", "filename=" + b"\xd6\xd0.txt".decode("latin-1"), "中.txt", False),
        ("http://h/x.txt", "filename=" + b"\xd6".decode("latin-1"), None, True),
        ("http://h/a.ZIP", None, "a.ZIP", False),
        ("http://h/a.zip?x=1", None, None, False),
        ("http://h/a?x=b.zip", None, "a?x=b.zip", False),
        ("http://h/.zip", None, None, False),
        ("http://h/a+b%20c.txt", "", "a+b c.txt", False),
        ("http://h/%zz%41.txt", None, "%zzA.txt", False),
        ("http://h/a.txt", "inline", "a.txt", False),
        ("http://down.wmtxt.com/x/%A1%B6%D3%F6%BC%FB%C4%E3%A1%B7.rar", None, "《遇见你》.rar", False),
        ("http://down.wmtxt.com/%A1.rar", None, None, True),
        ("http://h/%D6%D0.rar", 'x; filename=""', "���.rar", False),
    ],
)
def test_file_name(spark, url, header, name, failed):
    got = one(spark, files.file_name(F.col("u"), F.col("h")), u=("string", url), h=("string", header))
    if name and "�" in name:
        assert got["name"].endswith(".rar") and not got["failed"]
    else:
        assert (got["name"], got["failed"]) == (name, failed)


def test_utf8_header_hosts(spark):
    raw = "中.txt".encode().decode("latin-1")
    got = one(spark, files.header_name(F.col("r"), F.col("h"), ["u.org"]), r=("string", raw), h=("string", "u.org"))
    assert got == "中.txt"


@pytest.mark.parametrize("name, ext", [(".zip", ""), ("a.tar.GZ", "gz"), ("..a.Txt", "txt"), ("none", ""), ("a.", "")])
def test_file_ext(spark, name, ext):
    assert one(spark, files.file_ext(F.col("n")), n=("string", name)) == ext


@pytest.mark.parametrize(
    "body, encoding, wanted",
    [
        (b"\xd6\xd0", "gbk", "中"),
        (b"a\xc3\xa9", "utf-8", "aé"),
        (b"\xff", "UTF8", None),
        (b"\xe9", "latin-1", "é"),
        (b"a", "no-such", None),
        (b"a", None, "a"),
        (None, "gbk", None),
    ],
)
def test_decode_body(spark, body, encoding, wanted):
    column = text.decode_body(F.col("b"), F.col("e"), extra=True)
    assert one(spark, column, b=("binary", body), e=("string", encoding)) == wanted


def test_wide_charsets_in_the_jvm(spark):
    """As Python decodes them: marks, byte orders, pairs, lone surrogates, numbers too large, cut units, long texts."""
    rng = random.Random(5)
    bodies = [b"", b"a", b"\xff\xfe", b"\xfe\xff", b"\xff\xfe\0\0", b"\0\0\xfe\xff"]
    for sample in ("aé中😀\ufeff", "\ufeffx", "\ud7ff\ue000\uffff\U00010000\U0010ffff", "中😀" * 20000):
        for name in ("utf-16", "utf-16-le", "utf-16-be", "utf-32", "utf-32-le", "utf-32-be"):
            bodies += [sample.encode(name), sample.encode(name)[:-1]]
    for code in (0xD800, 0xDBFF, 0xDC00, 0xDFFF):
        for pair in ([code], [code, 0x41], [0x41, code], [code, 0xDC00], [0xD83D, code], [0xD83D, 0xDE00, code]):
            bodies += [b"".join(c.to_bytes(n, order) for c in pair) for n in (2, 4) for order in ("big", "little")]
    bodies += [c.to_bytes(4, order) for c in (0x10FFFF, 0x110000, 0x1000041, 0xFFFFFFFF) for order in ("big", "little")]
    bodies += [rng.randbytes(rng.randrange(13)) for _ in range(60)]
    names = ["utf-16", "UTF16", "utf_16_le", "utf-16le", "UTF-16BE", "utf-16-be", "utf-32", "utf32", "utf-32-le", "utf-32be", "U16"]
    rows = [(i, b, n) for i, (b, n) in enumerate((b, n) for b in bodies for n in names)]
    df = spark.createDataFrame(rows, "i int, b binary, e string").select("i", text.decode_body(F.col("b"), F.col("e")).alias("t"))
    got = {r.i: r.t for r in df.collect()}
    assert [(b[:40], n) for i, b, n in rows if got[i] != text.decoded_or_none(b, n)] == []


def test_label_value_strips_unicode_space(spark):
    padded = "12345 　 Author \n"
    assert one(spark, text.label_value(F.col("a"), 5), a=("string", padded)) == "Author"


def test_fmt_g_prints_like_c(spark):
    rng = random.Random(7)
    xs = [1234567.0, 3.0, 0.00001234, 100000.0, 0.0, -12.31, 999999.5, 9999995.0, 1234565.0, 1234575.0]
    xs += [12345.65, 12345.55, 12345.75, 0.00012345678, 1e-5, 1e100, 1e20, 99999.95, 9.9999951e-5]
    xs += [rng.uniform(0, 10 ** rng.randint(-4, 6)) for _ in range(2000)]
    xs += [round(rng.uniform(1, 999999), rng.randint(0, 5)) for _ in range(2000)]
    xs += [rng.randint(-(8 * 10**5), 8 * 10**5) / 8 for _ in range(1000)]
    xs += [float(rng.randint(10**5, 10**12)) for _ in range(1000)]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", text.fmt_g(F.col("x")).alias("g"))
    assert [(r.x, r.g) for r in rows.collect() if r.g != "%g" % r.x] == []


def test_metric_name(spark):
    name = metrics.metric_name(F.col("k"), F.col("s"))
    assert one(spark, name, k=("string", "a_count"), s=("string", "w")) == "scrapy.spider.w.a_count"
    assert one(spark, name, k=("string", "a_count"), s=("string", None)) == "scrapy.a_count"
