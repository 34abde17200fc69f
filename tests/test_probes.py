"""Inputs that the test tables lack: malformed markup, nulls, mixed letter case, long numbers."""

import time

import pytest
from pyspark.sql import functions as F

from pagelake.functions.metrics import metric_line
from pagelake.functions.text import decode_body, remove_entities
from pagelake.functions.urls import resolve_url
from pagelake.operators import extract as ex
from pagelake.operators import media as md
from pagelake.sources import blobs
from pagelake.sources.metric_lines import metric_lines

MALFORMED = {
    "comments": "<!-- x ",
    "scripts": "<script>a;",
    "tags": "<a ",
    "quotes": "<a \"'",
    "foreign ends": "<b></i>",
}


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("name", list(MALFORMED))
def test_malformed_pages_take_linear_time(name):
    def seconds(n):
        page = MALFORMED[name] * n if name != "foreign ends" else "<b>" * n + "</i>" * n
        start = time.perf_counter()
        ex._elements(page)
        return time.perf_counter() - start

    seconds(2000)
    assert seconds(64000) < 30 * max(seconds(8000), 0.002)


def test_links_in_any_quoting(spark):
    html = """<a data-href="/wrong" href="/right">r</a><a href='/single'>s</a><a class=x href=/bare>b</a>
    <!-- <a href="/comment">c</a> --><script>"<a href='/script'>"</script><a title="href='/t'">n</a><a name=q href>e</a>
    <A HREF = "/upper" >u</A><a href="/last"""
    pages = spark.createDataFrame([("http://h/", html), ("http://h/none", None), ("http://h/empty", "")], "url string, html string")
    got = [(r.pos, r.href, r.text) for r in ex.extract_links(pages).orderBy("pos").collect()]
    assert got == [(0, "/right", "r"), (1, "/single", "s"), (2, "/bare", "b"), (3, "/upper", "u")]


def test_attribute_of_an_element_with_a_class(spark):
    html = F.lit('<img src="/a.png"><img alt="" class="cover" src="/b.png">')
    assert one(spark, ex.select_first(html, "img", "cover", "src")) == "/b.png"


def test_numeric_entities_with_leading_zeros(spark):
    assert one(spark, remove_entities(F.lit("x&#00000065;y&#x000041;z&#99999999999999999999;"))) == "xAyAz"


def test_empty_path_segments_stay(spark):
    assert one(spark, resolve_url(F.lit("http://h/a//b/c"), F.lit("d"))) == "http://h/a//b/d"


def test_ascii_is_strict(spark):
    body = F.lit("é".encode())
    assert one(spark, decode_body(body, F.lit("ascii"))) is None
    assert one(spark, decode_body(body, F.lit("utf-8"))) == "é"


def test_points_without_a_value_give_no_line(spark):
    points = spark.createDataFrame([("n", None), ("m", 1.0)], "name string, value double").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    assert [r.line for r in metric_lines(points).collect()] == ["m 1 1704067200"]
    assert one(spark, metric_line(F.lit("n"), F.lit(None).cast("double"))) is None


def test_null_download_rows_are_skipped(spark):
    kind = "original_url string, book_download array<struct<url:array<string>>>"
    items = spark.createDataFrame([("o", [(None,), (["u", None],), None]), ("p", None)], kind)
    assert [tuple(r) for r in md.candidate_urls(items).collect()] == [("o", 0, "u")]


def test_header_names_ignore_case(spark):
    rows = spark.createDataFrame([({"content-type": "a", "X": "b"},)], "headers map<string,string>")
    assert rows.select(md.header("Content-Type").alias("v"), md.header("none").alias("n")).first() == ("a", None)


def test_images_without_a_size(spark):
    items = spark.createDataFrame([("o", "u")], "original_url string, book_covor_image_url string")
    images = spark.createDataFrame([("u", True, "p.jpg", None, None)], "url string, ok boolean, path string, width int, height int")
    assert md.attach_cover(items, images, "/b").first().book_covor_image_path == "/b/p.jpg"
    assert md.attach_cover(items, images, "/b", min_width=1).first().book_covor_image_path == ""


def test_chunks_of_an_interrupted_call_are_not_read(spark, tmp_path):
    path = str(tmp_path)
    one = spark.createDataFrame([(1, "k", "a.txt", bytearray(b"hello"))], "seq int, key string, filename string, content binary")
    lost = blobs.blob_chunks(one, 2).withColumn("write_id", F.lit("ended early"))
    lost.write.parquet(f"{path}/chunks")
    for _ in range(2):
        blobs.write_blobs(one, path, 2)
    found = blobs.read_blobs(*blobs.read_blob_tables(spark, path)).collect()
    assert [(bytes(r.content), r.intact) for r in found] == [(b"hello", True)]
    plain = blobs.read_blobs(blobs.blob_files(one, 2), blobs.blob_chunks(one, 2)).first()
    assert (bytes(plain.content), plain.intact) == (b"hello", True)
