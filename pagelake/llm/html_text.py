"""Main text of web pages by equivalence classes of tokens.

Tokens of a page are its block elements, told apart by their path, and its blocks of text. Per
host, tokens with the same occurrence vector over its pages (how often each page has them) form a
class; Spark sums a fingerprint of each token's vector, so no vector is ever held. Classes of
frequent tokens whose order holds on a page, and which nest without crossing, are the template
there. What the template leaves are slots: their texts are the page's own. The elements around a
slot say what it is for (menus, adverts, comments), as do link shares summed over the host.

A block of text is one token, not one per word: taking single words out of sentences that share
them would lose text of the article.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from html import unescape
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.functions import markup
from pagelake.session import written

#: Elements that hold no text of an article, whatever the template.
ASIDE_TAGS = frozenset(
    "head title script style noscript template nav footer aside form button select textarea iframe object svg canvas "
    "audio video map dialog menu".split()
)
#: Words in class, id and role that say the same of any block element.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toolbar topbar masthead "
    "header footer contentinfo complementary copyright sidebar sidebars widget widgets "
    "cookie cookies consent gdpr notice notices notification notifications popup modal overlay dialog alert "
    "newsletter subscribe subscription signup login search share sharing social related recommended recommendations "
    "comment comments commentlist disqus respond reply replies".split()
)
#: Elements that end a block of text; all others are part of their line.
BLOCK_TAGS = frozenset(
    "html body article main section div p h1 h2 h3 h4 h5 h6 header hgroup address blockquote pre figure figcaption "
    "ul ol li dl dt dd table caption colgroup thead tbody tfoot tr td th fieldset legend details summary center hr "
    "search option optgroup".split()
) | (ASIDE_TAGS - {"svg", "canvas", "button", "select", "object", "audio", "video", "map", "iframe"})
KEPT_TAGS = BLOCK_TAGS | ASIDE_TAGS
#: Elements that a sibling of the same kind ends.
SIBLING_ENDS = frozenset("p li dt dd tr td th option".split())
VOID_TAGS = frozenset({"hr"})
CORE_TAGS = frozenset({"article", "main"})
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Share of a host's pages that a template token is on, and the least number of pages it is deduced from.
TEMPLATE_SHARE = 0.8
MIN_PAGES = 5
#: Tokens that a class needs to be more than a coincidence.
MIN_CLASS = 2
#: Outside an article element, places of a host with more of their text in links are menus.
LINK_SHARE = 0.66

ROOT = 0
TOKENS = "host string, role bigint, n int, page bigint, first int, chars bigint, link_chars bigint"
RESULT = "page_id bigint, url string, text string, n_chars bigint"


_UPPER_TAG = re.compile(r"</?[a-z0-9]*[A-Z]")


class Block(NamedTuple):
    """A block of text: its token, the token of the element around it, and where it stands."""

    text: str
    role: int
    place: int
    at: int
    link_chars: int
    aside: bool
    core: bool


class _Element:
    __slots__ = ("tag", "role", "aside", "core", "closed")

    def __init__(self, tag, role, aside, core, closed):
        self.tag, self.role, self.aside, self.core, self.closed = tag, role, aside, core, closed


def _hash(text: str) -> int:
    """A signed 63-bit value that no token shares with the root."""
    return (xxhash.xxh64_intdigest(text.encode("utf-8", "replace"), 42) >> 1) or 1


def _names(source: str) -> list[str]:
    found = [markup.attribute_of(source, name) for name in ("class", "id", "role")]
    return [unescape(n) for n in found if n] if source.strip() else []


def _says_aside(names: list[str], core: bool) -> bool:
    for name in " ".join(names).split():
        words = re.sub(r"([a-z])([A-Z])", r"\1 \2", name)
        words = re.split(r"[^a-z]+", words.lower())
        if words[0] in ("has", "with", "no", "without"):  # says what a page has, not what this is
            continue
        if any(w in ASIDE_WORDS and not (core and w == "header") for w in words):
            return True
    return False


@lru_cache(1 << 16)
def _opened(role: int, core: bool, tag: str, source: str) -> tuple[int, bool, bool]:
    """Of an element below one of this role: its own role, if it is set aside, and if by its kind alone."""
    names = _names(source)
    always = tag in ("nav", "aside", "footer")
    aside = tag in ASIDE_TAGS or (tag == "header" and not core)
    aside |= tag not in HEADINGS | {"html", "body"} and _says_aside(names, core)
    sign = re.sub(r"\d+", "0", " ".join(names))
    return _hash(f"{role} {tag} {sign}"), aside, always


def _ends(tokens: list[tuple]) -> tuple[set[int], set[int]]:
    """Start tags that an end tag closes, and those around the first article or main element."""
    stack: list[tuple[str, int]] = []
    still_open, closed, around = Counter(), set(), set()
    for i, (end, tag, _, whole, _) in enumerate(tokens):
        if tag not in KEPT_TAGS or not whole or tag in VOID_TAGS:
            continue
        if not end:
            if tag in CORE_TAGS and not around:
                around = {j for _, j in stack} | {i}
            stack.append((tag, i))
            still_open[tag] += 1
        while end and still_open[tag]:
            left, j = stack.pop()
            still_open[left] -= 1
            if left == tag:
                closed.add(j)
                break
    return closed, around


def parsed(html: str | None) -> tuple[list[tuple[int, int]], list[Block]]:
    """Tokens of a page as (role, position) and its blocks of text, in page order.

    An element without an end tag lasts as long as its parent; one that holds no article text
    also ends where an article or main element begins.
    """
    tokens = markup.TOKEN.findall(html or "")
    if _UPPER_TAG.search(html or ""):
        tokens = [(end, tag.lower(), source, whole, text) for end, tag, source, whole, text in tokens]
    closed, around = _ends(tokens)
    top = _Element("", ROOT, False, False, True)
    stack, still_open = [top], Counter()
    found: list[tuple[int, int]] = [(ROOT, 0)]
    blocks: list[Block] = []
    line: list[str] = []
    links, in_link, at = 0, 0, 0

    def flush() -> None:
        nonlocal links, at
        if not line:
            return
        text = " ".join(unescape("".join(line)).split())
        line.clear()
        if text:
            at += 1
            role = _hash(f"{top.role} {text}")
            found.append((role, at))
            blocks.append(Block(text, role, top.role, at, min(links, len(text)), top.aside, top.core))
        links = 0

    def leave() -> None:
        nonlocal top
        still_open[stack.pop().tag] -= 1
        top = stack[-1]

    for i, (end, tag, source, whole, text) in enumerate(tokens):
        if text:
            line.append(text)
            links += len(text.strip()) if in_link else 0
            continue
        if not whole:
            continue
        if tag not in KEPT_TAGS:
            in_link = max(0, in_link + (-1 if end else 1)) if tag == "a" else in_link
            if tag == "br":
                line.append(" ")
            continue
        flush()
        in_link = 0
        if end:
            while still_open[tag]:
                last = top.tag == tag
                leave()
                if last:
                    break
            continue
        if (top.tag == tag and tag in SIBLING_ENDS) or (top.tag == "p" and tag in BLOCK_TAGS):
            leave()
        while tag in CORE_TAGS and top.aside and not top.closed:
            leave()
        role, aside, always = _opened(top.role, top.core, tag, source)
        aside &= always or i not in around
        at += 1
        found.append((role, at))
        if tag not in VOID_TAGS:
            top = _Element(tag, role, aside or top.aside, tag in CORE_TAGS or top.core, i in closed)
            stack.append(top)
            still_open[tag] += 1
    flush()
    return found, blocks


def host_of(url: Column) -> Column:
    """Host and port of a URL, A-Z lower-cased; empty without one."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A[^/?#]*?://([^/?#]*)", 1))


def _tokens(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns: list[list] = [[] for _ in range(7)]
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found, blocks = parsed(html)
            page = _hash(html or "")
            counts, first = Counter(), {}
            for role, at in found:
                counts[role] += 1
                first.setdefault(role, at)
            chars, link_chars = Counter(), Counter()
            for b in blocks:
                chars[b.place] += len(b.text)
                link_chars[b.place] += b.link_chars
            for role, n in counts.items():
                row = (host, role, n, page, first[role], chars[role], link_chars[role])
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, names=["host", "role", "n", "page", "first", "chars", "link_chars"])


def templates(pages: DataFrame) -> DataFrame:
    """Per host with at least ``MIN_PAGES`` pages: its frequent tokens, each with its class.

    A token's occurrence vector is known by the sums, over the pages that have it, of two halves
    of a hash of (page, count), with the number of pages and occurrences: tokens with the same
    vector have the same sums. Counts are combined before the shuffle; the list of a host is as
    long as 1 / ``TEMPLATE_SHARE`` of a page at most.
    """
    hosts = pages.groupBy(host_of(F.col("url")).alias("host")).agg(F.count("*").alias("pages"))
    found = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string")).mapInArrow(_tokens, TOKENS)
    vector = F.xxhash64("page", "n")
    tokens = found.groupBy("host", "role").agg(
        F.count("*").alias("support"),
        F.sum(F.col("n").cast("bigint")).alias("total"),
        F.sum(F.shiftrightunsigned(vector, 32)).alias("high"),
        F.sum(vector.bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"),
        F.avg("first").alias("first"),
        F.sum("chars").alias("chars"),
        F.sum("link_chars").alias("link_chars"),
    )
    frequent = tokens.where("support > 1").join(hosts.where(F.col("pages") >= MIN_PAGES), "host")
    frequent = frequent.where(F.col("support") >= TEMPLATE_SHARE * F.col("pages"))
    token = F.struct(
        "role", F.xxhash64("support", "total", "high", "low").alias("class"), "support", "first",
        (F.col("link_chars") > LINK_SHARE * F.col("chars")).alias("menu"),
    )
    return frequent.groupBy("host").agg(F.collect_list(token).alias("template"))


def template_roles(tokens: list[tuple[int, int]], template: list[dict]) -> set[int]:
    """Roles of the classes that are valid on this page.

    A class is valid if its tokens come in the host's order, whole sequence after whole sequence,
    and each sequence lies between two neighbours of every class around it (those on more pages,
    fewer times a page).
    """
    classes: dict[int, list[dict]] = defaultdict(list)
    for token in sorted(template, key=lambda t: (t["first"], t["role"])):
        classes[token["class"]].append(token)
    rank = {t["role"]: (key, i) for key, own in classes.items() if len(own) >= MIN_CLASS for i, t in enumerate(own)}
    seen: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for role, at in tokens:
        if role in rank:
            key, place = rank[role]
            seen[key].append((place, at))
    accepted: list[list[int]] = []
    roles: set[int] = set()
    for key, places in sorted(seen.items(), key=lambda x: (-classes[x[0]][0]["support"], len(x[1]) / len(classes[x[0]]), x[0])):
        size = len(classes[key])
        spots = [at for _, at in places]
        ordered = len(places) % size == 0 and all(place == i % size for i, (place, _) in enumerate(places))
        if ordered and all(
            bisect_left(outer, spots[i]) == bisect_left(outer, spots[i + size - 1])
            for outer in accepted
            for i in range(0, len(spots), size)
        ):
            accepted.append(spots)
            roles.update(t["role"] for t in classes[key])
    return roles


def main_text(html: str | None, template: list[dict]) -> str:
    """The slots' texts that belong to the article, one block a line.

    Blocks in article or main elements, if any has text, else all blocks; without those in
    elements set aside, those of the template and, outside articles, menus. Template texts that
    make up more than half of what is left stay: such pages repeat an article, not a layout.
    """
    tokens, blocks = parsed(html)
    left = [b for b in blocks if not b.aside]
    core = [b for b in left if b.core]
    if not core:
        known = {t["role"]: t["menu"] for t in template}
        chars, links = Counter(), Counter()
        for b in left:
            chars[b.place] += len(b.text)
            links[b.place] += b.link_chars
        left = [b for b in left if not known.get(b.place, links[b.place] > LINK_SHARE * chars[b.place])]
    left = core or left
    fixed = template_roles(tokens, template) if template else set()
    own = [b for b in left if b.role not in fixed]
    if 2 * sum(len(b.text) for b in own) >= sum(len(b.text) for b in left):
        left = own
    return "\n".join(b.text for b in left)


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [
            main_text(html, template or [])
            for html, template in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
        ]
        sizes = pa.array([len(t) for t in found], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(found, pa.string()), sizes], names=["page_id", "url", "text", "n_chars"]
        )


def main_texts(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` (code points) of every page.

    Null and empty pages have an empty text; pages without a host are one host; repeated rows
    give a row each. Hosts with fewer than ``MIN_PAGES`` pages have no template: there the elements
    alone decide. ``<br>`` is white space. Pages meet the template of their host in a join with one
    row per host. These are stored first: by their size on disk Spark broadcasts few of them, so that pages
    are not shuffled, or else shuffles both sides alone, so that adaptive execution can split hot hosts. Further columns are not read.
    """
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"), host_of(F.col("url")).alias("host"),
    )
    met = rows.join(written(templates(pages), "page_templates"), "host", "left")
    return met.select("page_id", "url", "html", "template").mapInArrow(_texts, RESULT)
