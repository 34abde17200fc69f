"""The parts of HTML source as patterns that the JVM and Python read alike.

Each pattern goes by the states of an HTML tokenizer: a quote opens a value only right after
``=``, so a stray quote in a tag is a part of a name, and a ``>`` in a quoted value does not end
the tag. All loops are possessive: time is linear in the page, and neither engine recurses.
A tag that the page's end cuts off is no tag; a comment, script or style runs to the end.
"""

from __future__ import annotations

import re
from functools import cache

WS = r"[\t\n\f\r ]"
END = r"(?![\s\S])"
NAME = r"[^\t\n\f\r />][^\t\n\f\r />=]*+"
#: One value in double, single or no quotes, with its quotes.
VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\t\n\f\r >"'][^\t\n\f\r >]*+)"""
_OPEN_VALUE = r"""(?:"[^"]*+(?:"|(?![\s\S]))|'[^']*+(?:'|(?![\s\S]))|[^\t\n\f\r >"'][^\t\n\f\r >]*+)"""
_ATTRIBUTE = rf"{NAME}(?:{WS}*+={WS}*+{_OPEN_VALUE}?+)?+"
#: All attributes of a tag, up to the ``>``.
ATTRIBUTES = rf"(?:[\t\n\f\r /]++|{_ATTRIBUTE})*+"
COMMENT = rf"<!--(?:[^-]++|-(?!->))*+(?:-->|{END})"


def raw_text(tag: str) -> str:
    """An element without markup inside, like a script, up to its end tag."""
    return rf"<{tag}(?=[\t\n\f\r />]){ATTRIBUTES}(?:>(?:[^<]++|<(?!/{tag}[\t\n\f\r />]))*+(?:</{tag}{ATTRIBUTES}(?:>|{END})|{END})|{END})"


#: What holds neither elements nor text of the page.
HIDDEN = rf"{COMMENT}|{raw_text('script')}|{raw_text('style')}"
ANY_TAG = rf"</?+[a-z][^\t\n\f\r />]*+{ATTRIBUTES}(?:>|{END})"


def attribute_first(name: str, value: str) -> str:
    """Attributes up to and with the first one of this name, which must have this value."""
    others = rf"(?:[\t\n\f\r /]++|(?!{name}[\t\n\f\r =/>]){_ATTRIBUTE})*+"
    return rf"{others}{name}{WS}*+={WS}*+{value}"


def literal(value: str) -> str:
    """Exactly this value, in any quoting."""
    plain = re.escape(value)
    return rf"""(?:"{plain}"|'{plain}'|{plain}(?=[\t\n\f\r >]))"""


def up_to(wanted: str) -> str:
    """The page up to and with the first tag that matches ``wanted`` (a tag pattern).

    Comments, scripts, attribute values and all other tags before it are passed over whole.
    """
    return rf"(?i)\A(?:{HIDDEN}|(?!{wanted}){ANY_TAG}|[^<]++|(?!{wanted})<)*+{wanted}"


#: A page from one anchor with an href to the next: group 1 is the anchor and its leading text.
#: The last match of a page is empty, or the rest of the page without group 1.
_HREF = rf"(?:{VALUE}|(?=>))"
LINK = rf"<a(?=[\t\n\f\r /]){attribute_first('href', _HREF)}{ATTRIBUTES}>[^<]*+"
EACH_LINK = (
    rf"(?i)(?:{HIDDEN}|(?!<a[\t\n\f\r /]){ANY_TAG}|[^<]++|<(?!a[\t\n\f\r /]))*+(?:({LINK})|<a{ATTRIBUTES}(?:>|{END})|{END})"
)
#: Of such an anchor: the href with its quotes, and the text.
LINK_PARTS = rf"(?i)\A<a{attribute_first('href', f'({_HREF})')}{ATTRIBUTES}>([^<]*+)"

FLAGS = re.I | re.S | re.A
#: Groups: slash of an end tag, tag name, attributes, the closing ``>``; or text.
TOKEN = re.compile(rf"{HIDDEN}|<(/?+)([a-z][^\t\n\f\r />]*+)({ATTRIBUTES})(>|{END})|([^<]++|<)", FLAGS)
#: A tag, a comment, script or style, or a lone ``<``, each with the text behind it; or the text a page begins with.
#: A start tag goes with an end tag that follows its text, and with the text behind that.
#: Groups: as of ``TOKEN``, with the lone ``<`` and the text apart; then the end tag and its text.
TOKEN_WITH_TEXT = re.compile(
    rf"(?:<(?:(/)|(?!(?:script|style)[\t\n\f\r />]))([a-z][^\t\n\f\r />]*+)((?=>)|{ATTRIBUTES})(>|{END})|{HIDDEN}|(<)|(?=[^<]))"
    r"([^<]*+)(?(1)|(?:(</\2>)([^<]*+))?+)",
    FLAGS,
)


@cache
def _first_value(name: str) -> re.Pattern:
    """Attributes up to and with the first of this name. Groups: its value in double, single, no quotes."""
    value = r"""(?:"([^"]*+)"|'([^']*+)'|([^\t\n\f\r >"'][^\t\n\f\r >]*+))?+"""
    return re.compile(attribute_first(name, value), FLAGS)


def attribute_of(source: str, wanted: str) -> str | None:
    """The value of the first attribute of this name; None without it or without a ``=``.

    >>> attribute_of(" title=it's HREF = '/a>b' href=/c", "href")
    '/a>b'
    """
    begin = f' {wanted}="'
    if source.startswith(begin) and (end := source.find('"', len(begin))) >= 0:
        return source[len(begin) : end]
    found = _first_value(wanted).match(source)
    return found and (found[1] or found[2] or found[3] or "")
