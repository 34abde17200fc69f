"""URL expressions. All stay in the JVM and never fail on a malformed URL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelake.fixed_values import CACHE_PREFIX
from pagelake.functions.text import clean_link, remove_entities

_SCHEME = r"[A-Za-z][A-Za-z0-9+.\-]*:"


def resolve_url(base: Column, ref: Column) -> Column:
    """``ref`` read relative to ``base`` (RFC 3986); with a scheme it is absolute."""
    root = F.regexp_extract(base, f"^({_SCHEME}//[^/?#]*)", 1)
    base_path = F.regexp_extract(base, f"^{_SCHEME}//[^/?#]*([^?#]*)", 1)
    directory = F.regexp_extract(base_path, r"^(.*/)", 1)
    directory = F.when(directory == "", "/").otherwise(directory)
    path = F.regexp_extract(ref, r"^([^?#]*)", 1)
    tail = F.regexp_extract(ref, r"(?s)^[^?#]*(.*)$", 1)
    beside = F.concat(directory, path)
    return (
        F.when(ref.isNull() | (ref == ""), F.when(ref.isNotNull(), base))
        .when(ref.rlike("^" + _SCHEME), ref)
        .when(ref.startswith("//"), F.concat(F.regexp_extract(base, f"^({_SCHEME})", 1), ref))
        .when(ref.startswith("/"), F.concat(root, _without_dots(path), tail))
        .when(ref.startswith("?"), F.concat(F.regexp_extract(base, r"^([^?#]*)", 1), ref))
        .when(ref.startswith("#"), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), ref))
        .otherwise(F.concat(root, _without_dots(beside), tail))
    )


def _without_dots(path: Column) -> Column:
    """The path with ``.`` and ``..`` segments worked out."""
    dots = r"(^|/)\.\.?(/|$)"
    kept = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    joined = F.concat(
        F.array_join(kept, "/"), F.when(path.rlike(r"(^|/)\.\.?$"), "/").otherwise("")
    )
    rooted = F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))
    return F.when(path.rlike(dots), rooted).otherwise(path)


def clean_url(base: Column, link: Column) -> Column:
    """A link as found in a page, trimmed, unescaped and resolved.

    The cleaned link is bound once, since resolving names it many times.
    """
    cleaned = F.array(remove_entities(clean_link(link)))
    return F.get(F.transform(cleaned, lambda ref: resolve_url(base, ref)), F.lit(0))


def netloc(url: Column) -> Column:
    """Host with port and user, empty when the URL has none."""
    return F.regexp_extract(url, f"^(?:{_SCHEME})?//([^/?#]*)", 1)


def url_key(url: Column, sep: str = "/") -> Column:
    """Content address of a URL: ``/`` for paths, ``_`` for blob ids."""
    return F.concat(netloc(url), F.lit(sep), F.sha1(url))


def to_cache_url(url: Column, hosts: list[str], prefix: str = CACHE_PREFIX) -> Column:
    """The URL in the page cache when its host is listed."""
    return F.when(netloc(url).isin(hosts), F.concat(F.lit(prefix), url)).otherwise(url)


def from_cache_url(url: Column, from_cache: Column, prefix: str = CACHE_PREFIX) -> Column:
    """The original URL of a response that the page cache served."""
    plain = F.substring(url, len(prefix) + 1, 2**31 - 1)
    return F.when(F.coalesce(from_cache, F.lit(False)), plain).otherwise(url)


def canonical_url(url: Column) -> Column:
    """The URL without fragment, with its query parameters sorted and a path of at least ``/``."""
    place = F.regexp_extract(url, r"^([^?#]*)", 1)
    place = F.when(place.rlike(f"^{_SCHEME}//[^/]*$"), F.concat(place, F.lit("/"))).otherwise(place)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    ordered = F.array_join(
        F.sort_array(F.filter(F.split(query, "&"), lambda p: p != "")), "&"
    )
    return F.when(query == "", place).otherwise(F.concat(place, F.lit("?"), ordered))


def fingerprint(url: Column, method: Column | None = None, body: Column | None = None) -> Column:
    """The identity of a request: sha1 of method, canonical URL and body."""
    method = F.lit("GET") if method is None else F.coalesce(method, F.lit("GET"))
    head = F.concat(method, canonical_url(url))
    if body is None:
        return F.sha1(head)
    return F.sha1(F.concat(head.cast("binary"), F.coalesce(body, F.lit("").cast("binary"))))
