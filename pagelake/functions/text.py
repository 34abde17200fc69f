"""Text and collection expressions. All but ``decode_body(extra=True)`` stay in the JVM."""

from __future__ import annotations

import math
from collections.abc import Callable
from fractions import Fraction
from html.entities import name2codepoint

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.fixed_values import LINK_TRIM, NULL_TOKENS

# Unicode white space, as both ends of a text are trimmed of it.
_SPACE = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
_ENTITY = r"&#?[^&;\s]+;"
# The named entities of HTML 4, and what browsers read for the numbers 128 to 159.
_NAMED = "\n".join(f"{name}={chr(code)}" for name, code in name2codepoint.items())
_CP1252 = bytes(range(0x80, 0xA0)).decode("cp1252", "replace").replace("\ufffd", "?")


def list_first_item(arr: Column) -> Column:
    """First element; null for an empty or null array."""
    return F.get(arr, F.lit(0))


def strip_null(arr: Column, nulls=NULL_TOKENS) -> Column:
    """The array without null tokens."""
    keep = _not_null_token(nulls)
    return F.filter(arr, keep)


def strip_null_map(entries: Column, nulls=NULL_TOKENS) -> Column:
    """The map without entries whose value is a null token."""
    keep = _not_null_token(nulls)
    return F.map_filter(entries, lambda _, v: keep(v))


def _not_null_token(nulls):
    words = [t for t in nulls if t is not None]

    def keep(x: Column) -> Column:
        listed = x.isin(words) if words else F.lit(False)
        if None in nulls:
            return x.isNotNull() & ~listed
        return x.isNull() | ~listed

    return keep


def deduplication(arr: Column) -> Column:
    """C4: distinct elements, in order of first appearance."""
    return F.array_distinct(arr)


def clean_link(link: Column) -> Column:
    """The link without white space and quotes at its ends."""
    return F.btrim(link, F.lit(LINK_TRIM))


def remove_entities(text: Column) -> Column:
    """HTML entities replaced by their characters; unknown ones vanish.

    The text is cut at its entities, each entity is looked up, and the pieces are joined
    again. Texts without ``&`` skip all of it.
    """
    pieces = F.split(text, _ENTITY)
    entities = F.regexp_extract_all(text, F.lit(_ENTITY), F.lit(0))
    decoded = F.zip_with(
        pieces, entities, lambda p, e: F.concat(p, F.coalesce(_entity_char(e), F.lit("")))
    )
    return F.when(text.contains("&"), F.array_join(decoded, "")).otherwise(text)


def _entity_char(entity: Column) -> Column:
    body = F.substring(entity, F.lit(2), F.length(entity) - 2)
    digits = F.regexp_extract(body, r"^#0*([0-9]+)$", 1)
    hexits = F.regexp_extract(body, r"^#[xX]0*([0-9A-Fa-f]+)$", 1)
    # longer numbers, without leading zeros, are beyond the last code point
    number = F.when((digits != "") & (F.length(digits) <= 7), digits.cast("bigint")).when(
        (hexits != "") & (F.length(hexits) <= 6), F.conv(hexits, 16, 10).cast("bigint")
    )
    low = F.substring(F.lit(_CP1252), (number - 0x7F).cast("int"), F.lit(1))
    numeric = F.when(number.between(0x80, 0x9F), F.nullif(low, F.lit("?"))).when(
        (number < 0xD800) | number.between(0xE000, 0x10FFFF), _char(number)
    )
    common = F.when(body == "amp", F.lit("&")).when(body == "quot", F.lit('"'))
    table = F.str_to_map(F.lit(_NAMED), F.lit("\n"), F.lit("="))
    return F.when(body.startswith("#"), numeric).otherwise(
        common.otherwise(F.try_element_at(table, body))
    )


def _char(code_point: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code_point), 8, "0")), "UTF-32")


def checksum(body: Column) -> Column:
    """C11: md5 of the stored bytes."""
    return F.md5(body)


def decode_body(body: Column, encoding: Column, extra: bool = False) -> Column:
    """Text of ``body`` in the encoding its row names; null where bytes do not fit.

    UTF-8, ASCII, Latin-1, UTF-16 and UTF-32 are decoded in the JVM. ``extra=True`` adds every other charset
    through an Arrow batch function, which then sees only the rows that need it.
    """
    charset = F.lower(F.coalesce(encoding, F.lit("utf-8")))
    utf8 = charset.isin("utf-8", "utf8")
    ascii7 = charset.isin("ascii", "us-ascii")
    latin = charset.isin("iso-8859-1", "latin-1", "latin1")
    known = F.when(utf8 | (ascii7 & F.hex(body).rlike("^([0-7].)*$")), F.try_validate_utf8(body)).when(latin, F.decode(body, "ISO-8859-1"))
    spelled = F.regexp_replace(F.regexp_replace(charset, "[^0-9a-z]+", "_"), "^(utf|u)_?(?=16|32)", "utf_")
    wide = spelled.rlike("^utf_(16|32)(_?[bl]e)?$")
    known = known.when(wide, _decoded_wide(body, spelled))
    if not extra:
        return known
    other = ~utf8 & ~ascii7 & ~latin & ~wide
    decoded = _decode_batch(F.when(other, body), F.when(other, charset))
    return F.when(other, decoded).otherwise(known)


def _decoded_wide(body: Column, charset: Column) -> Column:
    """Text of UTF-16 or UTF-32 bytes; null for a lone surrogate, a number above 10FFFF or a cut unit.

    A name without a byte order follows the mark at the beginning, which goes, or else is
    little-endian; with a byte order, a mark is a character like any other. Units are judged in
    hex, spaced apart, so that a pattern sees whole units only.
    """
    width = F.when(charset.contains("16"), 2).otherwise(4)
    start = F.struct(
        width.alias("width"),
        F.hex(F.substring(body, 1, width)).alias("mark"),
        (~charset.rlike("[bl]e$")).alias("free"),
        charset.endswith("be").alias("big"),
    )

    def ordered(s: Column) -> Column:
        small = s["width"] == 2
        big_mark = s["free"] & (s["mark"] == F.when(small, "FEFF").otherwise("0000FEFF"))
        marked = big_mark | (s["free"] & (s["mark"] == F.when(small, "FFFE").otherwise("FFFE0000")))
        units = F.when(marked, F.substring(body, s["width"] + 1, F.octet_length(body))).otherwise(body)
        return F.struct(small.alias("small"), (s["big"] | big_mark).alias("big"), units.alias("units"))

    def spaced(s: Column) -> Column:
        two, four = "(..)(..)", "(..)(..)(..)(..)"
        code = F.hex(s["units"])
        return (
            F.when(s["small"] & s["big"], F.regexp_replace(code, two, "$1$2 "))
            .when(s["small"], F.regexp_replace(code, two, "$2$1 "))
            .when(s["big"], F.regexp_replace(code, four, "$1$2$3$4 "))
            .otherwise(F.regexp_replace(code, four, "$4$3$2$1 "))
        )

    def decoded(s: Column) -> Column:
        lone = "D[89AB].. (?!D[C-F])|(?<!D[89AB].. )D[C-F].. "
        none = "(?!0000[0-9A-CEF]|0000D[0-7]|000[1-9A-F]|0010).{8} "
        width = F.when(s["small"], 2).otherwise(4)
        cut = F.octet_length(s["units"]) % width != 0
        # UTF-32 is one charset of the JVM, told its byte order by a mark
        mark = F.when(s["big"], F.unhex(F.lit("0000FEFF"))).otherwise(F.unhex(F.lit("FFFE0000")))
        return (
            F.when(cut | _with(spaced(s), lambda code: F.when(s["small"], code.rlike(lone)).otherwise(code.rlike(none))), None)
            .when(s["small"] & s["big"], F.decode(s["units"], "UTF-16BE"))
            .when(s["small"], F.decode(s["units"], "UTF-16LE"))
            .otherwise(F.decode(F.concat(mark, s["units"]), "UTF-32"))
        )

    return _with(start, lambda s: _with(ordered(s), decoded))


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once for a row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


@F.arrow_udf(T.StringType())
def _decode_batch(body: pa.Array, charset: pa.Array) -> pa.Array:
    return pa.array(
        [decoded_or_none(b, c) for b, c in zip(body.to_pylist(), charset.to_pylist())],
        pa.string(),
    )


def decoded_or_none(body: bytes | None, charset: str | None) -> str | None:
    if body is None or charset is None:
        return None
    try:
        return body.decode(charset)
    except (UnicodeDecodeError, LookupError):
        return None


def label_value(text: Column, width: int) -> Column:
    """C17: the text after a label of fixed width, trimmed."""
    return strip(F.substring(text, width + 1, 2**31 - 1))


def strip(text: Column) -> Column:
    """C17: the text without white space (Unicode included) at its ends."""
    return F.regexp_replace(F.regexp_replace(text, "^" + _SPACE, ""), _SPACE + "$", "")


def fmt_g(x: Column) -> Column:
    """C20: the number with six significant digits, as C prints ``%g``.

    The size of the number selects a format with the decimals that are left for it. Numbers
    are first rounded by their exact binary value, ties to even. (Below 1e-4, a number
    whose seventh and last digit is 5 is rounded up.) The number is bound once by
    ``transform``: written out, its many uses make a method the JVM does not compile.
    """
    return F.get(F.transform(F.array(x.cast("double")), _six_digits), F.lit(0))


def _six_digits(x: Column) -> Column:
    size = F.abs(x)

    whole = size.try_cast("bigint")
    rounded = F.when(size < 1e7, F.bround(whole, -1))
    for power in range(8, 16):
        rounded = rounded.when(size < float(10**power), F.bround(whole, 6 - power))
    even = F.when((size < 1e15) & (size == whole), rounded.otherwise(whole).cast("double"))
    scientific = F.format_string("%.5e", F.when(size >= 1e6, F.coalesce(even, size)).otherwise(size))

    decimals = F.when(size >= _at_least("99999.95"), 0)
    for count in range(1, 10):
        decimals = decimals.when(size >= _at_least(f"9.999995e{4 - count}"), count)
    fixed = F.get(F.transform(F.array(decimals), lambda d: _with_decimals(size, d)), F.lit(0))
    short = F.regexp_replace(fixed, r"\.0+$|(\.[0-9]*[1-9])0+$", "$1")

    far = (size >= 999999.5) | (size < _at_least("9.999995e-5"))
    body = F.when(far, F.regexp_replace(scientific, r"\.?0+e", "e")).otherwise(short)
    sign = F.when(x < 0, "-").otherwise("")
    return (
        F.when(F.isnan(x), F.lit("nan"))
        .when(size == float("inf"), F.concat(sign, F.lit("inf")))
        .when(size == 0, F.lit("0"))
        .otherwise(F.concat(sign, body))
    )


def _at_least(decimal: str) -> float:
    """The smallest double that is not below the decimal number."""
    nearest = float(decimal)
    return nearest if Fraction(nearest) >= Fraction(decimal) else math.nextafter(nearest, math.inf)


def _with_decimals(size: Column, decimals: Column) -> Column:
    pattern = F.concat(F.lit("%."), decimals.cast("string"), F.lit("f"))
    return F.printf(pattern, _rounded(size, F.pow(F.lit(10.0), decimals)))


def _rounded(size: Column, scale: Column) -> Column:
    """``size`` (1e-4 to 1e6) as a multiple of ``1 / scale``, by its exact value, ties to even.

    The number is split at 2**-20, so that its distance to the midpoint comes out exact.
    """
    low = F.floor(size * scale).cast("double")
    high = F.floor(size * 1048576.0) / F.lit(1048576.0)
    beyond = (high * scale - (low + 0.5)) + (size - high) * scale
    return (low + F.when(beyond > 0, 1.0).when(beyond == 0, low % 2).otherwise(0.0)) / scale
