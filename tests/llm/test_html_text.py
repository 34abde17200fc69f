"""Main text of made pages: template deduction, elements set aside, odd input."""

import random

import pytest

from pagelake.llm import html_text
from pagelake.llm.html_text import main_text, parsed, template_roles

PAGE = "page_id bigint, url string, html string, host string, template string, text string"


def prose(draw, n=40):
    return " ".join("".join(draw.choices("abcdefgh", k=draw.randint(2, 8))) for _ in range(n)) + "."


def laid_out(spark, rows):
    return spark.createDataFrame([(*r, "host", "template", "text") for r in rows], PAGE)


def texts_of(spark, rows):
    return {r.page_id: r.text for r in html_text.main_texts(laid_out(spark, rows)).collect()}


ARTICLE = """<!DOCTYPE html><html><head><title>t</title><style>p{{x}}</style></head><body class="has-sidebar">
<header><h2>Site</h2><p>{noise}</p></header><nav><ul><li><a href=/x>{noise}</a></ul></nav><div class="cookie-notice">We use cookies</div>
<main><article class="post-17 no-comments"><header><h1>{title}</h1></header><p>{one}<script>var t="</p>";</script><br>{two}
<div class="adBox">{noise}</div><ul><li>{three}<li>{title} &amp;amp; y</ul><form><input><p>{noise}</p></form>
<section id=comments><h3>3 comments</h3><article class=comment><p>{noise}</p></article></section></article>
<aside><p>{noise}</p></aside></main><footer>&copy; {noise}</footer></body></html>"""


def test_article_without_all_that_is_around_it(spark):
    draw = random.Random(1)
    rows, want = [], {}
    for i in range(5):
        parts = {k: prose(draw, 12) for k in ("title", "one", "two", "three", "noise")}
        rows.append((i, f"http://H{i % 2}.org/p{i}", ARTICLE.format(**parts)))
        want[i] = "\n".join([parts["title"], f"{parts['one']} {parts['two']}", parts["three"], f"{parts['title']} &amp; y"])
    assert texts_of(spark, rows) == want


def test_template_of_a_host_without_telling_names(spark):
    """Texts that all pages of a host share and lists of links go; what differs stays, one page's copy too."""
    draw = random.Random(2)
    rows, want = [], {}
    for i in range(8):
        one, two = prose(draw), prose(draw)
        more = "".join(f"<p>{prose(draw)}</p>" for _ in range(i % 3))
        links = "".join(f'<li><a href="/{i}{j}">{prose(draw, 2)}</a></li>' for j in range(4))
        rows.append((i, "http://h.org/", f"<div id=a1><ul>{links}</ul></div><div id=b{i}><h1>T{i}</h1><p>{one}</p>{more}<p>{two}</p><div>Tell a friend</div></div><div>All rights reserved by h.org</div>"))
        want[i] = [f"T{i}", one, two]
    got = texts_of(spark, rows)
    for i, (title, one, two) in want.items():
        lines = got[i].split("\n")
        assert lines[:2] == [title, one] and lines[-1] == two and len(lines) == 3 + i % 3


def test_copies_of_one_article_stay_whole(spark):
    draw = random.Random(3)
    body = "".join(f"<p>{prose(draw)}</p>" for _ in range(5))
    rows = [(i, "http://copy.org/a", f"<nav>n{i}</nav><article><h1>T</h1>{body}</article><footer>f</footer>") for i in range(6)]
    rows += rows[:2]
    got = html_text.main_texts(laid_out(spark, rows)).collect()
    assert len(got) == 8 and {r.text.count("\n") for r in got} == {5} and {r.n_chars == len(r.text) for r in got} == {True}


def test_order_and_nesting_decide_what_is_a_template():
    def token(role, key, first, support=9):
        return {"role": role, "class": key, "support": support, "first": first, "menu": False}

    outer, inner = [token(1, 10, 1), token(2, 10, 5)], [token(3, 20, 2, 8), token(4, 20, 3, 8)]
    assert template_roles([(1, 1), (3, 2), (4, 3), (3, 4), (4, 5), (2, 6)], outer + inner) == {1, 2, 3, 4}
    assert template_roles([(1, 1), (4, 2), (3, 3), (2, 6)], outer + inner) == {1, 2}  # not in order
    assert template_roles([(1, 1), (3, 2), (2, 3), (4, 4)], outer + inner) == {1, 2}  # across the outer class
    assert template_roles([(1, 1), (2, 2)], [token(1, 10, 1), token(2, 11, 2)]) == set()  # single tokens


def test_classes_are_the_tokens_with_equal_vectors(spark):
    rows = [(i, "http://v.org/", "<div><p>x" + "<p>y" * (i % 3) + f"</div><h1>{i}</h1><h2>z</h2>") for i in range(6)]
    found = html_text.templates(laid_out(spark, rows)).first().template
    vectors = {}
    for _, _, page in rows:
        for role in {r for r, _ in parsed(page)[0]}:
            vectors.setdefault(role, [])
    for role, vector in vectors.items():
        vector.extend(sum(r == role for r, _ in parsed(page)[0]) for _, _, page in rows)
    frequent = {r: tuple(v) for r, v in vectors.items() if sum(n > 0 for n in v) >= 0.8 * len(rows)}
    assert {t.role for t in found} == set(frequent)
    pairs = [(a, b) for a in found for b in found]
    assert all((a["class"] == b["class"]) == (frequent[a.role] == frequent[b.role]) for a, b in pairs)


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("plain &lt;text&gt;", "plain <text>"),
        ("<nav><p>menu</nav>", ""),
        ("<article><p>cut off by the end <b>of the pa", "cut off by the end of the pa"),
        ("<div class=ad>never closed<article><p>kept</article>", "kept"),
        ("<nav>never closed<article><p>kept</article><footer>f", "kept"),
        ("<ARTICLE><H1>A</H1>loose<P CLASS='notice'>n</P>tail</ARTICLE>", "A\nloose\ntail"),
        ("<form><article><p>in a page-wide form</article></form>", "in a page-wide form"),
        ("<aside><article><p>teaser</article></aside><p>text", "text"),
        ("<article><table><tr><td>a<td>b</table><pre>x\n  y</pre></article>", "a\nb\nx y"),
        ("<article><p>a<svg><text>s</svg><!-- c --><button>Share</button>z</article>", "a\nz"),
        ("</div></p><article></i>x</b></article></article>y", "x"),
    ],
)
def test_odd_pages(page, text):
    assert main_text(page, []) == text


def test_odd_rows(spark):
    long = "<article>" + "<p>lorem ipsum dolor</p>" * 30000 + "</article>"
    got = texts_of(spark, [(1, None, "<p>a"), (None, None, None), (2, "no host", "<p>b"), (3, "http://u/", long)])
    assert got[1] == "a" and got[None] == "" and got[2] == "b" and got[3].count("\n") == 29999
    assert html_text.main_texts(laid_out(spark, [(1, "u", "h")]).limit(0)).count() == 0
