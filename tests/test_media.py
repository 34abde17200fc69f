"""Choosing one good file per record."""

import datetime as dt
import hashlib
import io
import random
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from pagelake.operators import media as md
from pagelake.schemas import CAPTURE, ITEM, MEDIA_RESULT

NOW = dt.datetime(2024, 1, 31)
ZIP = {"Content-Type": "application/zip"}


@pytest.mark.parametrize(
    "url, status, headers, body, flags, reason",
    [
        ("http://h/a.zip", 404, ZIP, b"", [], "download-error"),
        ("http://h/a.zip", 200, ZIP, b"", [], "empty-content"),
        ("http://h/a.zip", 200, ZIP, None, [], "empty-content"),
        ("http://h/a.zip", 200, {"Content-Type": "text/html"}, b"x", [], "invalid-content_type"),
        ("http://h/a.zip", 200, {"Content-Type": "text/plain; charset=gbk"}, b"x", [], "invalid-content_type"),
        ("http://h/a.zip", 200, {"Content-Type": "Application/Zip"}, b"x", [], "invalid-content_type"),
        ("http://h/a.zip", 200, {}, b"x", [], "invalid-content_type"),
        ("http://h/a.zip", 200, None, b"x", None, "invalid-content_type"),
        ("http://h/a", 200, ZIP, b"x", [], "noaccess-filename"),
        ("http://h/a.zip", 200, {**ZIP, "Content-Disposition": "filename*=a.zip"}, b"x", [], "unreadable-filename"),
        ("http://h/a.zip", 200, ZIP, b"x", [], "downloaded"),
        ("http://h/a.zip", 200, ZIP, b"x", ["cached"], "cached"),
        ("http://h/a.zip", None, None, None, None, "Error downloading"),
    ],
)
def test_reasons(spark, url, status, headers, body, flags, reason):
    capture = spark.createDataFrame([(url, status, headers, "utf-8", body, flags, NOW)], CAPTURE)
    got = md.classify_fetch(capture).first()
    assert got.reason == reason and got.ok == (reason in ("downloaded", "cached"))


def test_results_carry_key_and_checksum(spark):
    rows = [("http://h/a.zip", 200, ZIP, "utf-8", b"x", [], NOW), ("http://h/b.zip", 500, ZIP, "utf-8", b"x", [], NOW)]
    got = md.media_results(md.classify_fetch(spark.createDataFrame(rows, CAPTURE))).orderBy("url").collect()
    assert got[0].key.startswith("h_") and got[0].checksum and (got[1].key, got[1].checksum) == (None, None)
    assert [f.name for f in MEDIA_RESULT] == got[0].__fields__


def items(spark, **downloads):
    """url lists per record: None for a record without downloads."""
    rows = []
    for name, lists in downloads.items():
        rows.append(
            {"original_url": name, "book_download": None if lists is None else [{"url": u} for u in lists]}
        )
    return spark.createDataFrame(rows, ITEM)


def test_candidates(spark):
    df = items(spark, a=[["u2", "u1"], [], ["u1", "u3"]], b=[[], []], c=None)
    got = [(r.original_url, r.pos, r.url) for r in md.candidate_urls(df).orderBy("original_url", "pos").collect()]
    assert got == [("a", 0, "u2"), ("a", 1, "u1"), ("a", 2, "u3")]


def test_freshness_limits(spark):
    def days(n):
        return NOW - dt.timedelta(days=n)

    files = spark.createDataFrame(
        [("new", days(29.9), "c1"), ("edge", days(30), "c2"), ("old", days(30.1), "c3"), ("undated", None, "c4")],
        "key string, upload_date timestamp, checksum string",
    )
    asked = spark.createDataFrame([(k,) for k in ("new", "edge", "old", "undated", "absent")], "key string")
    got = {r.key: (r.state, r.checksum) for r in md.freshness(asked, files, F.lit(NOW)).collect()}
    assert got == {
        "new": ("uptodate", "c1"), "edge": ("uptodate", "c2"), "old": ("stale", None),
        "undated": ("missing", None), "absent": ("missing", None),
    }


def test_store_keys(spark):
    files = spark.createDataFrame([("a", "1"), ("b", "1"), ("b", "2")], "key string, filename string")
    valid, broken = md.valid_store_keys(files)
    assert [tuple(r) for r in valid.collect()] == [("a", "1")]
    assert [tuple(r) for r in broken.collect()] == [("b", 2)]


def test_fallback_against_a_loop(spark):
    rng = random.Random(2)
    urls = [f"u{i}" for i in range(30)]
    ok = {u: rng.random() < 0.3 for u in urls}
    books = {f"b{i}": [rng.sample(urls, 2) for _ in range(rng.randint(1, 4))] for i in range(40)}
    books["none"] = [[]]
    outcomes = spark.createDataFrame(
        [(ok[u], u, "k" + u if ok[u] else None, "c" + u, None) for u in urls], MEDIA_RESULT
    )
    df = items(spark, **books)
    chosen, tried = {}, set()
    for book, lists in books.items():
        chosen[book] = None
        for url in dict.fromkeys(u for part in lists for u in part):
            tried.add((book, url))
            if ok[url]:
                chosen[book] = url
                break
    candidates = md.candidate_urls(df)
    got = md.attach_file(df, md.first_success(candidates, outcomes))
    assert {r.original_url: r.book_file_url for r in got.collect()} == chosen
    assert {(r.original_url, r.url) for r in md.attempts(candidates, outcomes).collect()} == tried


def test_fetch_plan(spark):
    df = items(spark, a=[["http://h/1", "http://h/2"]], b=[["http://h/2", "http://h/3"]], c=[["http://h/4", "http://h/5"]])
    key = lambda u: "h_" + __import__("hashlib").sha1(u.encode()).hexdigest()
    files = spark.createDataFrame(
        [(key("http://h/2"), NOW, "c"), (key("http://h/1"), NOW - dt.timedelta(days=90), "c")],
        "key string, upload_date timestamp, checksum string",
    )
    captured = spark.createDataFrame([("http://h/4", False)], "url string, ok boolean")
    got = md.fetch_plan(df, files, captured, F.lit(NOW))
    assert sorted(r.url for r in got.collect()) == ["http://h/1", "http://h/5"]


def test_covers(spark):
    rows = [("a", "http://i/1"), ("b", "http://i/2"), ("c", ""), ("d", None), ("e", "http://i/3")]
    df = spark.createDataFrame(rows, "original_url string, book_covor_image_url string")
    images = spark.createDataFrame(
        [("http://i/1", True, "full/1.jpg", 10, 10), ("http://i/2", False, "full/2.jpg", 10, 10), ("http://i/3", True, "full/3.jpg", 1, 10)],
        "url string, ok boolean, path string, width int, height int",
    )
    got = md.attach_cover(df, images, "/srv/c/", min_width=5)
    assert {r.original_url: r.book_covor_image_path for r in got.collect()} == {
        "a": "/srv/c/full/1.jpg", "b": "", "c": "", "d": "", "e": "",
    }


def test_covers_are_reused(spark):
    """Fresh covers are not asked for again; missing, stale and undated ones are, each once."""
    urls = [f"http://i/{n}" for n in range(5)]
    df = spark.createDataFrame(
        [(f"r{n}", u) for n, u in enumerate([*urls, urls[2]])] + [("none", None), ("empty", "")],
        "original_url string, book_covor_image_url string",
    )
    stored = spark.createDataFrame(
        [("http://i/0", NOW - dt.timedelta(days=30)), ("http://i/1", NOW - dt.timedelta(days=30, seconds=1)), ("http://i/3", None), (None, NOW)],
        "url string, upload_date timestamp",
    ).select(
        md.blob_key(F.col("url")).alias("key"), "url", "upload_date", F.lit("c").alias("checksum"),
        F.concat(F.lit("old/"), F.coalesce("url", F.lit("-"))).alias("path"), F.lit(9).alias("width"), F.lit(9).alias("height"),
    )
    now = F.lit(NOW)
    plan = md.cover_plan(df, stored, now)
    assert sorted((r.url, r.state) for r in plan.collect()) == [
        ("http://i/1", "stale"), ("http://i/2", "missing"), ("http://i/3", "missing"), ("http://i/4", "missing"),
    ]
    images = spark.createDataFrame(
        [("http://i/1", True, "new/1", 9, 9), ("http://i/2", False, None, None, None)],
        "url string, ok boolean, path string, width int, height int",
    )
    got = md.attach_cover(df, md.reused_covers(images, stored, now), "/c")
    assert {r.original_url: r.book_covor_image_path for r in got.collect()} == {
        "r0": "/c/old/http://i/0", "r1": "/c/new/1", "r2": "", "r3": "", "r4": "", "r5": "", "none": "", "empty": "",
    }


def test_attempts_keep_repeated_candidates(spark):
    rows = [("a", 1, "x"), ("a", 1, "x"), ("a", 2, "y"), ("a", 3, "z"), ("b", 1, "z"), ("b", 2, "z"), (None, 1, "y"), (None, 2, "x")]
    candidates = spark.createDataFrame(rows, "original_url string, pos int, url string")
    outcomes = spark.createDataFrame([("x", False), ("y", True), ("z", None)], "url string, ok boolean")
    got = sorted((r.original_url or "", r.pos, r.url) for r in md.attempts(candidates, outcomes).collect())
    assert got == [("", 1, "y"), ("a", 1, "x"), ("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"), ("b", 2, "z")]
    assert md.attempts(candidates.limit(0), outcomes).count() == 0


def test_status_counts(spark):
    df = spark.createDataFrame([("downloaded",)] * 3 + [("cached",), ("uptodate",), ("download-error",)], "reason string")
    assert {r.key: r.value for r in md.media_status_counts(df, "f").collect()} == {
        "f_file_count": 5, "f_file_status_count/downloaded": 3, "f_file_status_count/cached": 1, "f_file_status_count/uptodate": 1,
    }


def test_fetch_plan_sorts_no_candidates_for_their_judgement(spark):
    df = items(spark, a=[["http://h/1", "http://h/2"]], b=[["http://h/2", "http://h/3"]])
    df = df.unionByName(df).unionByName(df.withColumn("original_url", F.lit(None).cast("string")))
    none = spark.createDataFrame([], "key string, upload_date timestamp, checksum string")
    captured = spark.createDataFrame([("http://h/1", False), ("http://h/3", True)], "url string, ok boolean")
    got = md.fetch_plan(df, none, captured, F.lit(NOW))
    out = io.StringIO()
    with redirect_stdout(out):
        got.explain()
    assert "ShuffledHashJoin [url" in out.getvalue() and "BuildLeft" not in out.getvalue()
    assert [(r.key, r.url) for r in got.collect()] == [("h_" + hashlib.sha1(b"http://h/2").hexdigest(), "http://h/2")]
