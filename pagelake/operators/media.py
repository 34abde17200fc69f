"""Records and the files fetched for them.

``candidates`` are ``(original_url, pos, url)``; ``outcomes`` are
``(ok, url, key, checksum, reason)``, one row per URL. None of these operators reads a
response body except ``classify_fetch``, which only looks at its length.

The optimizer sizes an exploded table by the file it comes from, and might broadcast one
that is many times larger. Inner joins of candidates therefore ask for a merge join, or for
a hash join by the judgements of ``fetch_plan``, one small row per distinct URL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake import fixed_values as fixed
from pagelake.functions.files import file_name
from pagelake.functions.urls import url_key


def candidate_urls(items: DataFrame) -> DataFrame:
    """Every distinct file URL of a record, in order: ``(original_url, pos, url)``.

    Null rows of the list and rows without URLs are skipped.
    """
    lists = F.filter(F.transform("book_download", lambda d: d["url"]), lambda u: u.isNotNull())
    urls = F.array_distinct(F.flatten(lists))
    return items.select("original_url", F.posexplode(F.filter(urls, lambda u: u.isNotNull())).alias("pos", "url"))


def allowed_type(content_type: Column, allowed: list[str] = fixed.FILE_CONTENT_TYPES) -> Column:
    """Whether the whole header is a listed type; a missing header is not."""
    return F.coalesce(content_type, F.lit("")).isin(allowed)


def header(name: str) -> Column:
    """The first header of that name, in any letter case; null when absent."""
    same = F.map_filter("headers", lambda k, v: F.lower(k) == name.lower())
    return F.get(F.map_values(same), F.lit(0))


def blob_key(url: Column) -> Column:
    """Key of a file in the blob store."""
    return url_key(url, "_")


def classify_fetch(
    captures: DataFrame,
    accept: Callable[[Column], Column] = allowed_type,
    name: Callable[[Column, Column], Column] = file_name,
) -> DataFrame:
    """Captures with ``reason``, ``filename`` and ``ok``.

    The tests run in a fixed order: status, body, type, name. ``accept`` replaces the test
    of the type header, ``name`` the rule that finds the file name from URL and header.
    """
    named = captures.withColumn("_file", name(F.col("url"), header("Content-Disposition")))
    no_name = F.coalesce(F.col("_file.name"), F.lit("")) == ""
    reason = (
        F.when(F.col("status").isNull(), fixed.TRANSPORT_ERROR)
        .when(F.col("status") != 200, fixed.DOWNLOAD_ERROR)
        .when(F.coalesce(F.octet_length("body"), F.lit(0)) == 0, fixed.EMPTY_CONTENT)
        .when(~accept(header("Content-Type")), fixed.INVALID_TYPE)
        .when(F.col("_file.failed"), fixed.UNREADABLE_NAME)
        .when(no_name, fixed.NO_FILENAME)
        .when(F.coalesce(F.array_contains("flags", fixed.CACHED), F.lit(False)), fixed.CACHED)
        .otherwise(fixed.DOWNLOADED)
    )
    return (
        named.withColumns({"filename": F.col("_file.name"), "reason": reason})
        .drop("_file")
        .withColumn("ok", F.col("reason").isin(fixed.CACHED, fixed.DOWNLOADED))
    )


def media_results(
    classified: DataFrame, key: Callable[[Column], Column] = blob_key
) -> DataFrame:
    """Outcomes of classified captures: ``(ok, url, key, checksum, reason)``."""
    return classified.select(
        "ok",
        "url",
        F.when(F.col("ok"), key(F.col("url"))).alias("key"),
        F.when(F.col("ok"), F.md5("body")).alias("checksum"),
        "reason",
    )


def freshness(
    requests: DataFrame, files: DataFrame, now: Column, days: int = fixed.EXPIRES_DAYS
) -> DataFrame:
    """Requests ``(.., key)`` with ``state`` and the stored ``checksum`` of reused files.

    ``missing`` without a file or date, ``stale`` when older than ``days``, else
    ``uptodate``. ``files`` has one row per ``key``.
    """
    stored = files.select("key", "upload_date", F.col("checksum").alias("_checksum"))
    age = (F.unix_micros(now) - F.unix_micros(F.col("upload_date"))) / F.lit(86400e6)
    state = (
        F.when(F.col("upload_date").isNull(), "missing")
        .when(age > days, "stale")
        .otherwise(fixed.UPTODATE)
    )
    return (
        requests.join(stored, "key", "left")
        .withColumn("state", state)
        .withColumn("checksum", F.when(F.col("state") == fixed.UPTODATE, F.col("_checksum")))
        .select(*requests.columns, "state", "checksum")
    )


def valid_store_keys(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """E5: files whose key holds just them, and ``(key, n_files)`` of broken keys."""
    rest = [c for c in files.columns if c != "key"]
    # the value is taken only where there is one row, so any_value is exact
    counted = files.groupBy("key").agg(
        F.count("*").alias("n_files"), F.any_value(F.struct(*rest)).alias("_file")
    )
    valid = counted.where("n_files = 1").select("key", "_file.*").select(*files.columns)
    return valid, files.groupBy("key").agg(F.count("*").alias("n_files")).where("n_files > 1")


def first_success(candidates: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``(original_url, book_file_id, book_file_url, checksum)`` of the first good file.

    Records without any success are absent; ``attach_file`` keeps them.
    """
    good = candidates.hint("merge").join(
        outcomes.where("ok").select("url", "key", "checksum"), "url"
    )
    chosen = F.min_by(F.struct("key", "url", "checksum"), "pos").alias("_f")
    return good.groupBy("original_url").agg(chosen).select(
        "original_url",
        F.col("_f.key").alias("book_file_id"),
        F.col("_f.url").alias("book_file_url"),
        F.col("_f.checksum").alias("checksum"),
    )


def attach_file(items: DataFrame, chosen: DataFrame) -> DataFrame:
    """Records with their file; null columns where every candidate failed."""
    kept = items.drop("book_file_id", "book_file_url")
    return kept.join(
        chosen.select("original_url", "book_file_id", "book_file_url"), "original_url", "left"
    )


def attempts(candidates: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Candidates up to and including the first success of their record.

    Candidates are read once: those of a record meet as a set, bounded by its row, and a
    candidate that is repeated, with its record or alone, is one member with a number.
    """
    counted = candidates.groupBy(*candidates.columns).agg(F.count("*").alias("_times"))
    tried = counted.hint("merge").join(outcomes.select("url", F.col("ok").alias("_ok")), "url", "left")
    rest = [c for c in counted.columns if c != "original_url"]
    records = tried.groupBy("original_url").agg(
        F.min(F.when(F.col("_ok"), F.col("pos"))).alias("_first_ok"),
        F.collect_set(F.struct(*rest)).alias("_all"),
    )
    made = F.filter("_all", lambda c: F.col("_first_ok").isNull() | (c["pos"] <= F.col("_first_ok")))
    chosen = records.select("original_url", F.inline(made))
    again = F.explode(F.sequence(F.lit(1).cast("bigint"), "_times")).alias("_time")
    return chosen.select(*candidates.columns, again).drop("_time")


def fetch_plan(
    items: DataFrame,
    files: DataFrame,
    captured: DataFrame,
    now: Column,
    days: int = fixed.EXPIRES_DAYS,
    key: Callable[[Column], Column] = blob_key,
) -> DataFrame:
    """``(key, url)`` still to fetch: missing or stale, and not fetched already.

    ``captured(url, ok)``: outcomes of this run. A record that already has a good or a
    reusable file asks for nothing behind it.
    """
    candidates = candidate_urls(items)
    # a URL many records share is judged once
    urls = candidates.select("url").distinct()
    tried = captured.select("url", F.col("ok").alias("_ok"))
    known = urls.join(tried, "url", "left").withColumn("key", key(F.col("url")))
    aged = freshness(known, files, now, days)
    reused = F.col("state") == fixed.UPTODATE
    # what failed in this run is neither usable nor wanted, and decides nothing
    judged = aged.select(
        "url",
        (reused | F.coalesce(F.col("_ok"), F.lit(False))).alias("usable"),
        (~reused & F.col("_ok").isNull()).alias("wanted"),
    ).where("usable or wanted")
    # a URL has few judgements, so the many candidates need not be sorted to meet them
    met = candidates.join(judged.hint("shuffle_hash"), "url")
    # page URLs begin alike: a hash before them makes most comparisons of a sort short.
    # A set of a record's own candidates is bounded by its row, however often that is repeated
    records = met.groupBy(F.xxhash64("original_url").alias("_hash"), "original_url").agg(
        F.min(F.when(F.col("usable"), F.col("pos"))).alias("_usable_at"),
        F.collect_set(F.when(F.col("wanted"), F.struct("pos", "url"))).alias("_wanted"),
    )
    open_ones = F.filter(
        "_wanted", lambda w: F.col("_usable_at").isNull() | (w["pos"] < F.col("_usable_at"))
    )
    found = records.select(F.inline(open_ones)).select("url").distinct()
    return found.select(key(F.col("url")).alias("key"), "url")


def cover_plan(
    items: DataFrame,
    covers: DataFrame,
    now: Column,
    days: int = fixed.EXPIRES_DAYS,
    key: Callable[[Column], Column] = blob_key,
) -> DataFrame:
    """``(key, url, state)`` of covers to fetch, each once: those that are missing or stale by E4.

    ``covers(key, upload_date, checksum)``: the stored ones, one row per key.
    """
    urls = items.select(F.col("book_covor_image_url").alias("url")).where("url <> ''").distinct()
    aged = freshness(urls.select(key(F.col("url")).alias("key"), "url"), covers, now, days)
    return aged.where(F.col("state") != fixed.UPTODATE).select("key", "url", "state")


def reused_covers(
    images: DataFrame,
    covers: DataFrame,
    now: Column,
    days: int = fixed.EXPIRES_DAYS,
    key: Callable[[Column], Column] = blob_key,
) -> DataFrame:
    """The images of a run with those of ``covers`` that are fresh by E4; input of ``attach_cover``.

    ``covers(key, url, upload_date, checksum, path, width, height)``. A cover that was not
    asked for, being fresh, counts as fetched; where there is an image of this run, that one counts.
    """
    stored = covers.where("url <> ''").select(key(F.col("url")).alias("key"), "url", "path", "width", "height")
    fresh = freshness(stored, covers, now, days).where(F.col("state") == fixed.UPTODATE)
    columns = ["url", "ok", "path", "width", "height"]
    old = fresh.withColumn("ok", F.lit(True)).select(*columns, F.lit(1).alias("_age"))
    both = images.select(*columns, F.lit(0).alias("_age")).unionByName(old)
    chosen = both.groupBy("url").agg(F.min_by(F.struct(*columns[1:]), "_age").alias("_image"))
    return chosen.select("url", "_image.*")


def attach_cover(
    items: DataFrame, images: DataFrame, base: str, min_width: int = 0, min_height: int = 0
) -> DataFrame:
    """``book_covor_image_path`` of records: absolute path of the cover, else ``''``.

    ``images(url, ok, path, width, height)``, one row per URL. An image without a size is
    refused only where a minimum is set. ``reused_covers`` adds the stored covers that are fresh.
    """
    large = F.lit(True)
    for side, least in (("width", min_width), ("height", min_height)):
        if least:
            large = large & (F.col(side) >= least)
    good = images.where(F.col("ok") & large).select(F.concat(F.lit("url "), "url").alias("_cover"), F.col("path").alias("_path"))
    # records without a cover get a key of their own: as one key they could be a third of all
    url = F.coalesce("book_covor_image_url", F.lit(""))
    asked = F.when(url != "", F.concat(F.lit("url "), url)).otherwise(
        F.concat(F.lit("none "), "original_url")
    )
    path = F.when(F.col("_path").isNotNull(), F.concat(F.lit(base.rstrip("/") + "/"), "_path"))
    return (
        items.drop("book_covor_image_path")
        .join(good, asked == F.col("_cover"), "left")
        .withColumn("book_covor_image_path", F.coalesce(path, F.lit("")))
        .drop("_cover", "_path")
    )


def media_status_counts(outcomes: DataFrame, media: str = "file") -> DataFrame:
    """``(key, value)`` counters: per success or reuse one for the media and one for
    its status. ``outcomes`` needs ``reason``; failures do not count."""
    counted = outcomes.where(
        F.col("reason").isin(fixed.CACHED, fixed.DOWNLOADED, fixed.UPTODATE)
    ).groupBy("reason").agg(F.count("*").alias("n"))
    both = F.array(
        F.lit(f"{media}_file_count"),
        F.concat(F.lit(f"{media}_file_status_count/"), "reason"),
    )
    return counted.select(F.explode(both).alias("key"), "n").groupBy("key").agg(
        F.sum("n").alias("value")
    )
