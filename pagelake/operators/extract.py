"""Pages to links and records.

Flat elements are read with regular expressions in the JVM. Where containers matter, one
small pass over the tags of a page returns raw text and attributes, and every rule about
them is a column expression.
"""

from __future__ import annotations

from functools import lru_cache
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake import fixed_values as fixed
from pagelake.functions import markup
from pagelake.functions.text import (
    clean_link,
    deduplication,
    label_value,
    remove_entities,
    strip,
    strip_null,
)
from pagelake.functions.urls import resolve_url

def extract_links(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """B1: every anchor with an href: ``(src_url, pos, href, text)`` in document order, and the
    ``keep`` columns of its page. The href may stand in double, single or no quotes; comments,
    scripts, styles and values of other attributes hold no anchors. One search goes over the
    page, and the markup ends in the scan stage."""
    anchors = F.filter(F.regexp_extract_all("html", F.lit(markup.EACH_LINK), F.lit(1)), lambda a: a != "")
    found = pages.select(
        F.col("url").alias("src_url"),
        *keep,
        # outer: an inner explode would test the array first, and so search the page twice
        F.posexplode_outer(anchors).alias("pos", "_a"),
    ).where(F.col("pos").isNotNull())
    return found.select(
        "src_url",
        *keep,
        "pos",
        _unquoted(F.regexp_extract("_a", markup.LINK_PARTS, 1)).alias("href"),
        F.regexp_extract("_a", markup.LINK_PARTS, 2).alias("text"),
    )


def _unquoted(value: Column) -> Column:
    """An attribute value without the quotes around it."""
    return F.regexp_replace(value, r"""(?s)\A(["'])(.*)\1\z""", "$2")


def container_links(pages: DataFrame) -> DataFrame:
    """B1 with containers: also ``cls`` and ``outer_cls``, the classes of the element around
    the anchor and of the one around that; null where that element is not a ``div``."""
    found = pages.select(F.col("url").alias("src_url"), _parsed_links(F.col("html")).alias("links"))
    return found.select("src_url", F.posexplode("links").alias("pos", "link")).select(
        "src_url", "pos", "link.*"
    )


def next_link(
    links: DataFrame, text: str = fixed.NEXT_TEXT, outer_cls: str | None = fixed.NEXT_OUTER_CLASS
) -> DataFrame:
    """B2: ``(src_url, href)`` of the first anchor with exactly this text, one per page.

    With ``outer_cls`` the anchor must sit in a div inside a div of exactly that class.
    """
    chosen = links.where(F.col("text") == text)
    if outer_cls is not None:
        chosen = chosen.where((F.col("outer_cls") == outer_cls) & F.col("cls").isNotNull())
    return chosen.groupBy("src_url").agg(F.min_by("href", "pos").alias("href")).where("href <> ''")


def detail_links(links: DataFrame, cls_part: str | None = fixed.DETAIL_CLASS_PART) -> DataFrame:
    """Non-empty hrefs inside divs whose class contains ``cls_part``."""
    chosen = links.where(F.col("href") != "")
    if cls_part is not None:
        chosen = chosen.where(F.col("cls").contains(cls_part))
    return chosen.select("src_url", "pos", "href")


def resolved(links: DataFrame) -> DataFrame:
    """Links with ``url``: the href cleaned and resolved against its page."""
    cleaned = links.withColumn("_ref", remove_entities(clean_link(F.col("href"))))
    return cleaned.withColumn("url", resolve_url(F.col("src_url"), F.col("_ref"))).drop("_ref")


def listing_requests(
    pages: DataFrame,
    text: str = fixed.NEXT_TEXT,
    outer_cls: str = fixed.NEXT_OUTER_CLASS,
    cls_part: str = fixed.DETAIL_CLASS_PART,
) -> DataFrame:
    """B2 and B3 at once: what listing pages ask for: ``(src_url, url, kind)``.

    ``kind`` is ``list`` for the next page and ``detail`` for the others. Each page is
    parsed once and its links chosen inside their array, so nothing is shuffled.
    """
    parsed = pages.select(F.col("url").alias("src_url"), _parsed_links(F.col("html")).alias("links"))
    onward = F.filter(
        "links",
        lambda a: (a["text"] == text) & (a["outer_cls"] == outer_cls) & a["cls"].isNotNull(),
    )
    listed = F.filter("links", lambda a: a["cls"].contains(cls_part))

    def asked(links: Column, kind: str) -> Column:
        return F.transform(links, lambda a: F.struct(a["href"].alias("href"), F.lit(kind).alias("kind")))

    both = F.concat(asked(F.slice(onward, 1, 1), "list"), asked(listed, "detail"))
    found = parsed.select("src_url", F.inline(F.filter(both, lambda a: a["href"] != "")))
    return resolved(found).select("src_url", "url", "kind")


def select_first(html: Column, tag: str, cls: str | None = None, attribute: str | None = None) -> Column:
    """Leading text (or ``attribute``) of the first ``tag`` element that has it; null when absent.

    ``cls`` asks for exactly that class attribute, in any quoting and before or after the other
    attributes. For elements whose text comes before any child; ``extract_detail`` reads nested ones.
    """
    opened = rf"<{tag}(?=[\t\n\f\r />])"
    if cls is not None:
        opened += rf"(?={markup.attribute_first('class', markup.literal(cls))})"
    if attribute is None:
        wanted = rf"{opened}{markup.ATTRIBUTES}>([^<]++)"
    else:
        wanted = rf"{opened}{markup.attribute_first(attribute, f'({markup.VALUE})')}{markup.ATTRIBUTES}>"
    # inside the pattern's look-ahead the group is another one
    found = F.regexp_extract_all(html, F.lit(markup.up_to(wanted)), F.lit(3))
    value = F.get(found, F.lit(0))
    return value if attribute is None else _unquoted(value)


def extract_detail(pages: DataFrame) -> DataFrame:
    """The record of each detail page, with a ``reject`` reason (null when whole)."""
    raw = pages.select("url", _parsed_detail(F.col("html")).alias("d"))
    author, description, rows = F.col("d.author"), F.col("d.description"), F.col("d.rows")
    rows = F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))
    short = F.exists(rows, lambda r: F.size(r) < 5)
    reject = (
        F.when(author.isNull(), "no-author")
        .when(description.isNull(), "no-description")
        .when(short, "short-download-row")
    )
    return raw.select(
        F.col("d.name").alias("book_name"),
        F.when(author.isNotNull(), F.array(label_value(author, fixed.AUTHOR_LABEL_WIDTH))).alias("author"),
        strip(description).alias("book_description"),
        F.col("d.cover").alias("book_covor_image_url"),
        F.transform(rows, _download).alias("book_download"),
        F.col("url").alias("original_url"),
        reject.alias("reject"),
    )


def _download(cells: Column) -> Column:
    def cell(i: int) -> Column:
        return F.get(cells, F.lit(i))

    hrefs = F.array(cell(0)["href"], cell(1)["href"])
    return F.struct(
        strip_null(deduplication(hrefs)).alias("url"),
        cell(2)["text"].alias("progress"),
        cell(3)["text"].alias("update_time"),
        F.array(cell(4)["link_text"], cell(4)["href"]).alias("source_site"),
    )


def split_rejects(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Whole records, and ``(original_url, reason)`` of those a missing part rejects.

    Store the result of ``extract_detail`` first when both are used; the pages are parsed
    once then.
    """
    whole = records.where(F.col("reject").isNull()).drop("reject")
    lost = records.where(F.col("reject").isNotNull()).select(
        "original_url", F.col("reject").alias("reason")
    )
    return whole, lost


_LINKS = T.ArrayType(
    T.StructType(
        [T.StructField(n, T.StringType()) for n in ("href", "text", "cls", "outer_cls")]
    )
)
_CELL = T.StructType([T.StructField(n, T.StringType()) for n in ("text", "href", "link_text")])
_DETAIL = T.StructType(
    [
        *[T.StructField(n, T.StringType()) for n in ("name", "author", "description", "cover")],
        T.StructField("rows", T.ArrayType(T.ArrayType(_CELL))),
    ]
)

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SELF_CLOSING = frozenset("p li tr td th option dt dd".split())
class _Node:
    """An element: tag, source of its attributes, parent, pieces of its first text node, what its children add to.

    Elements name their parents only, never the reverse, so that a page is freed as soon as it is done.
    """

    __slots__ = ("tag", "source", "parent", "texts", "row", "cell", "images")

    def __init__(self, tag, source, parent):
        self.tag, self.source, self.parent = tag, source, parent
        self.texts = self.row = self.cell = self.images = None

    def attribute(self, wanted):
        value = markup.attribute_of(self.source, wanted) if self.source else None
        return unescape(value) if value and "&" in value else value

    def text(self):
        texts = self.texts
        if texts is None:
            return None
        text = texts[0] if len(texts) == 1 else "".join(texts)
        return unescape(text) if "&" in text else text


def _elements(html: str) -> list[_Node]:
    """Elements of a page in document order. Forgives unclosed and unopened tags.

    An end tag is looked for only while an element of that tag is open, so the time is linear.
    """
    top = _Node("", "", None)
    found, still_open = [], {}
    pieces = None  # of the text that goes on
    for end, tag, source, closed, lone, text, left, behind in markup.TOKEN_WITH_TEXT.findall(html):
        if lone:  # it goes on with the text around it; a tag or comment cuts that
            text = "<" + text
        else:
            pieces = None
            if closed:  # else a comment, script or style, or a tag that the page's end cuts off
                tag = tag.lower()
                if end:
                    if still_open.get(tag):
                        shut = None
                        while shut != tag:
                            shut = top.tag
                            still_open[shut] -= 1
                            top = top.parent
                else:
                    above = top.tag
                    if (above == tag and tag in _SELF_CLOSING) or (above == "p" and tag == "div"):
                        still_open[above] -= 1
                        top = top.parent
                    node = _Node(tag, source, top)
                    found.append(node)
                    if left:
                        holder = top if tag in _VOID else node
                        if text and holder.texts is None:
                            holder.texts = [text]
                        text = behind
                    elif tag not in _VOID:
                        still_open[tag] = still_open.get(tag, 0) + 1
                        top = node
        if text:
            if pieces is not None:
                pieces.append(text)
            else:
                pieces = [text]
                if top.texts is None:
                    top.texts = pieces
    return found


def _links_of(html: str | None) -> list[dict] | None:
    if html is None:
        return None


    def cls(node):
        return (node.attribute("class") or "") if node is not None and node.tag == "div" else None

    found = []
    for node in _elements(html):
        href = node.attribute("href") if node.tag == "a" else None
        if href is not None:
            parent = node.parent
            found.append(
                {"href": href, "text": node.text(), "cls": cls(parent), "outer_cls": cls(parent.parent)}
            )
    return found


def _first(values):
    return next((v for v in values if v is not None), None)


@lru_cache(4096)
def _class_of(source: str) -> tuple[str | None, bool]:
    """The class in the source of attributes, and whether it is that of a table of downloads; sites repeat theirs."""
    cls = _Node("", source, None).attribute("class")
    return cls, cls is not None and fixed.DOWNLOAD_CLASS_PART in cls


def _detail_of(html: str | None) -> tuple | None:
    """Name, author, description, cover and rows of cells of a detail page, in one pass over its elements."""
    if html is None:
        return None
    # for every parent, its first div of exactly this class
    firsts = {c: [] for c in (fixed.NAME_CLASS, fixed.AUTHOR_CLASS, fixed.DESCRIPTION_CLASS, fixed.COVER_CLASS)}
    seen, images, rows = set(), [], []
    for node in _elements(html):
        tag, above = node.tag, node.parent
        if tag == "div":
            if above.row is not None:
                node.cell = cell = [node.text(), None, None]
                above.row.append(cell)
            source = node.source
            if not source:
                continue
            cls, table = (_class_of if len(source) < 256 else _class_of.__wrapped__)(source)
            if table:
                node.row = []
                rows.append(node.row)
            if cls in firsts and (cls, above) not in seen:
                seen.add((cls, above))
                firsts[cls].append(node)
                if cls == fixed.COVER_CLASS:
                    node.images = []
                    images.append(node.images)
        elif tag == "a":
            cell = above.cell
            if cell is not None:
                if cell[1] is None:
                    cell[1] = node.attribute("href")
                if cell[2] is None:
                    cell[2] = node.text()
        elif tag == "img" and above.images == []:
            src = node.attribute("src")
            if src is not None:
                above.images.append(src)
    return (
        _first_text(firsts[fixed.NAME_CLASS]),
        _first_text(firsts[fixed.AUTHOR_CLASS]),
        _first_text(firsts[fixed.DESCRIPTION_CLASS]),
        _first(src for some in images for src in some),
        rows,
    )


def _first_text(nodes: list[_Node]) -> str | None:
    for node in nodes:
        if node.texts is not None:
            return node.text()
    return None


_ARROW_LINKS = pa.list_(pa.struct([(n, pa.string()) for n in ("href", "text", "cls", "outer_cls")]))


#: Pages that are read before their records are laid out as columns.
_PAGES = 256


# Marked as not deterministic, so that a filter on the result does not parse a page again.
@F.arrow_udf(_LINKS)
def _page_links(html: pa.Array) -> pa.Array:
    return pa.array([_links_of(h) for h in html.to_pylist()], _ARROW_LINKS)


@F.arrow_udf(_DETAIL)
def _page_detail(html: pa.Array) -> pa.Array:
    # a few pages at a time, so that what is read of them stays in the processor's caches
    starts = range(0, len(html), _PAGES) or [0]
    return pa.concat_arrays([_details(html.slice(i, _PAGES).to_pylist()) for i in starts])


def _details(pages: list[str | None]) -> pa.Array:
    details = [_detail_of(h) for h in pages]
    *texts, tables = zip(*((None, None, None, None, []) if d is None else d for d in details), strict=True) if details else [()] * 5
    rows = [row for table in tables for row in table]
    cells = list(zip(*(cell for row in rows for cell in row), strict=True)) or [()] * 3
    cell = pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in cells], _CELL.names)
    row = pa.ListArray.from_arrays(_starts(rows), cell)
    table = pa.ListArray.from_arrays(_starts(tables), row)
    columns = [*(pa.array(t, pa.string()) for t in texts), table]
    return pa.StructArray.from_arrays(columns, _DETAIL.names, mask=pa.array([d is None for d in details], pa.bool_()))


def _starts(lists) -> pa.Array:
    """Where each of the lists begins in all of them, and the end."""
    return pa.array([0, *accumulate(map(len, lists))], pa.int32())


_parsed_links = _page_links.asNondeterministic()
_parsed_detail = _page_detail.asNondeterministic()
