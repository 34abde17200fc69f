"""File-name expressions. Names are GBK for some hosts; only those rows reach Python."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.fixed_values import FILE_EXTENSIONS, GBK_URL_HOSTS, UTF8_HEADER_HOSTS
from pagelake.functions.text import decoded_or_none
from pagelake.functions.urls import netloc

_EXTENSION = r"(?s)^\.*[^.].*?(\.[^.]*)$"


def filename_from_disposition(header: Column) -> Column:
    """``struct(raw, failed)`` for an attachment header.

    The first part that mentions ``filename`` counts. Written ``filename*=`` it has no
    readable name, and the fetch fails.
    """
    part = F.get(F.filter(F.split(header, ";"), lambda p: p.contains("filename")), F.lit(0))
    value = F.get(F.split(part, "filename="), F.lit(1))
    return F.struct(
        F.btrim(value, F.lit(" \n'\"")).alias("raw"),
        (part.isNotNull() & value.isNull()).alias("failed"),
    )


def extension(name: Column) -> Column:
    """The extension with its dot; empty when there is none or the name only starts with dots."""
    return F.regexp_extract(name, _EXTENSION, 1)


def filename_from_url(url: Column, extensions: list[str] = FILE_EXTENSIONS) -> Column:
    """Last segment of the whole URL, still escaped, when its extension is listed.

    The query string is part of that segment, as is the extension test of it.
    """
    name = F.substring_index(url, "/", -1)
    return F.when(F.lower(extension(name)).isin(extensions), name)


def file_ext(name: Column) -> Column:
    """C14: lower-case extension without the dot."""
    return F.lower(F.substring(extension(name), 2, 2**31 - 1))


def percent_decode(text: Column) -> Column:
    """Percent-escapes read as UTF-8; ``+`` and a lone ``%`` stay as they are."""
    safe = F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25")
    safe = F.replace(safe, F.lit("+"), F.lit("%2B"))
    return F.when(text.contains("%"), F.try_url_decode(safe)).otherwise(text)


@F.arrow_udf(T.StringType())
def _gbk_batch(body: pa.Array) -> pa.Array:
    return pa.array([decoded_or_none(b, "gbk") for b in body.to_pylist()], pa.string())


def _escaped_bytes(text: Column) -> Column:
    """Bytes of a percent-escaped text.

    Each escape is two hex digits; every other character adds the hex of its UTF-8 bytes.
    """
    tokens = F.regexp_extract_all(text, F.lit(r"(?s)%[0-9A-Fa-f]{2}|."), F.lit(0))
    hexes = F.transform(
        tokens,
        lambda t: F.when(F.length(t) == 3, F.substring(t, 2, 2)).otherwise(F.hex(t)),
    )
    return F.unhex(F.array_join(hexes, ""))


def header_name(raw: Column, host: Column, utf8_hosts: list[str] = UTF8_HEADER_HOSTS) -> Column:
    """Text of a header file name; null when its bytes do not fit.

    ``raw`` holds the header bytes one character per byte (Latin-1), as HTTP delivers them.
    Names in ASCII are the same in either charset and stay in the JVM.
    """
    plain = raw.rlike(r"^[\x00-\x7f]*$")
    sent = F.encode(F.when(~plain & raw.rlike(r"^[\x00-\xff]*$"), raw), "ISO-8859-1")
    utf8 = host.isin(utf8_hosts) if utf8_hosts else F.lit(False)
    return (
        F.when(plain, raw)
        .when(utf8, F.try_validate_utf8(sent))
        .otherwise(_gbk_batch(F.when(~plain & ~utf8, sent)))
    )


def url_name(name: Column, host: Column, gbk_hosts: list[str] = GBK_URL_HOSTS) -> Column:
    """Text of a percent-escaped name; null when its bytes do not fit."""
    gbk = host.isin(gbk_hosts) & name.rlike(r"%[89A-Fa-f][0-9A-Fa-f]|[^\x00-\x7f]")
    return F.when(gbk, _gbk_batch(F.when(gbk, _escaped_bytes(name)))).otherwise(
        percent_decode(name)
    )


def file_name(
    url: Column,
    disposition: Column,
    extensions: list[str] = FILE_EXTENSIONS,
    gbk_hosts: list[str] = GBK_URL_HOSTS,
    utf8_hosts: list[str] = UTF8_HEADER_HOSTS,
) -> Column:
    """``struct(name, failed)``: header name first, else the name in the URL.

    ``failed`` marks names that cannot be read (C12, C15); a null name with ``failed``
    false means that there is none.
    """
    host = netloc(url)
    header = filename_from_disposition(disposition)
    raw = header["raw"]
    from_header = F.coalesce(raw, F.lit("")) != ""
    guess = filename_from_url(url, extensions)
    name = F.when(from_header, header_name(raw, host, utf8_hosts)).otherwise(
        url_name(guess, host, gbk_hosts)
    )
    unreadable = name.isNull() & (from_header | guess.isNotNull())
    return F.struct(
        F.when(~header["failed"], name).alias("name"),
        (header["failed"] | unreadable).alias("failed"),
    )
