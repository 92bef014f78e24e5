import html as entities
import math
import random
import re
from xml.etree import ElementTree

import pytest
from conftest import SMALL
from fixtures import prose

from lectern.llm import html
from lectern.session import table

PAGE = """<html><body class="page with-sidebar"><header><h1>Site</h1></header><nav><a href=x>Home</a></nav><div class="cookie-notice">We use cookies, a long
notice that nobody reads to the end of it.</div><div id="wrap"><article><h1>Title &amp; more</h1><p>First&nbsp;para with <a href="y">link</a> text, long enough.<p>Second para<br>line
two.</p><ul><li>One<li>Two</ul><div class="share-buttons">Share this</div><section id="comments"><p>Great post! I really loved this post and all that is in it so very much.</p></section></article></div>
<aside>About me, a long sidebar text.</aside><footer>(c)</footer></body></html>"""


def brute(page):
    found = re.search(r"<article>(.*?)(</article>|<footer|\Z)", page, re.S)
    parts = re.split(r"</?(?:p|h\d)[^>]*>", found[1]) if found else []
    texts = [re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]*>?", "", p.replace("<br>", " ")))).strip() for p in parts]
    return "\n\n".join(t for t in texts if t)


def test_whole_table(spark):
    pages = {r["page_id"]: r["html"] for r in table(spark, SMALL, "pages").collect()}
    for r in html.extract(table(spark, SMALL, "pages")).collect():
        assert r["text"] == brute(pages[r["page_id"]]) and r["n_chars"] == len(r["text"])


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p>", ""),
        ("plain <b>text</b> only", "plain text only"),
        ("a < b and <3", "a < b and <3"),
        ("<p>x<scr", "x"),
        ("<div><p>a</p></div>", "a"),
        ("<script>var t='<p>no</p>'</script><p>yes</p><!-- <p>no</p> -->", "yes"),
        ("<article><h1>T</h1><p>Alpha beta gamma delta.</p><section class='related-work'><p>Work one.</p></section><div class='notice-board'><p>Board two.</p></div><fieldset><p>Three.</p></fieldset></article>", "T\n\nAlpha beta gamma delta.\n\nWork one.\n\nBoard two.\n\nThree."),
        ("<div class='page-sidebar'><article><p>Inside a badly named box.</p></article><p>Beside.</p></div>", "Inside a badly named box."),
        ("<article><p>Text.</p><div id='comments'><article><p>Me too!</p></article></div><article class='comment'><p>And me.</p></article></article>", "Text."),
        ("<article><p>Text.</p><div class='share-buttons'>Share</div><div class='ad'>Buy</div><div class='cookie-notice'>Cookies</div><ul><li><a href=a>One source</a><li><a href=b>Another source</a></ul></article>", "Text.\n\nOne source\n\nAnother source"),
        ("<body><div class='left-sidebar'><p>Side text that is quite long, longer than what is beside it, really.</p></div><div class='has-sidebar content'><p>The main text of the page.</p><p>It goes on here.</p></div></body>", "The main text of the page.\n\nIt goes on here."),
        (PAGE, "Title & more\n\nFirst para with link text, long enough.\n\nSecond para line two.\n\nOne\n\nTwo"),
    ],
)
def test_single_pages(page, text):
    assert html.main_text(page) == text


def test_deep_and_long_pages(spark):
    deep = "<div>" * 5000 + "<p>deep text here</p>"
    rows = [(1, None, deep, 0), (1, None, deep, 0), (2, "u", "<p>" + "word " * 200000 + "</p>", 0)]
    found = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert sorted(r["n_chars"] for r in found) == [14, 14, 999999]


def paragraphs(seed, count):
    return "".join(f"<p>{prose(seed * 100 + k, 40)}</p>" for k in range(count))


def test_pages_without_an_article():
    links = "".join(f"<li><a href=x{k}>{prose(k, 3)}</a></li>" for k in range(12))
    body = f"<body><div><ul>{links}</ul></div><div><div>{paragraphs(1, 6)}</div><div><ul>{links}</ul></div></div><div>{prose(7, 12)}</div></body>"
    expected = "\n\n".join(prose(100 + k, 40) for k in range(6))
    assert html.main_text(f"<html>{body}</html>") == expected
    assert html.main_text(f"<table><tr><td><ul>{links}</ul></td><td>{paragraphs(1, 6)}</td></tr></table>") == expected


@pytest.mark.parametrize("part", ['div class="alert"', 'p class="social"', 'section id="search"', 'div class="tracking"', 'section id="login"', 'p class="share"', "label", 'div class="related"'])
def test_article_parts_by_any_name(part):
    """An article's own paragraphs stay whatever they are called; a menu of that name goes, and so do adverts and notices."""
    inner = f"<{part}>{prose(5, 30)}</{part.split()[0]}>"
    page = f"<body><article>{paragraphs(1, 2)}{inner}{paragraphs(2, 1)}</article></body>"
    assert html.main_text(page).split("\n\n") == [prose(100, 40), prose(101, 40), prose(5, 30), prose(200, 40)]
    for gone in ('<div class="share"><a href=1>One</a> <a href=2>Two</a></div>', '<div class="advert"><p>Buy this now</p></div>', '<p class="cookie-notice">We use them</p>', "<form><label>Name</label></form>"):
        assert html.main_text(page.replace(inner, inner + gone)) == html.main_text(page)


def test_references_without_an_article():
    """A list of long links belongs to the text; a menu of short ones does not."""
    entries = [f"{prose(300 + k, 9)}" for k in range(5)]
    listed = "<ol>" + "".join(f"<li><a href=r{k}>{t}</a></li>" for k, t in enumerate(entries)) + "</ol>"
    found = html.main_text(f"<body><div id=x>{paragraphs(1, 6)}{listed}</div></body>").split("\n\n")
    assert found == [*(prose(100 + k, 40) for k in range(6)), *entries]


def test_densities_against_recursion():
    """Counts and densities of a page's nodes against a plain recursion over another parser's tree."""
    draw = random.Random(5)

    def tree(depth):
        if depth == 0 or draw.random() < 0.2:
            return prose(draw.randrange(999), draw.randint(1, 9))
        tag = draw.choice(["div", "section", "span", "b", "a"])
        return f"<{tag}>" + "".join(tree(depth - 1) for _ in range(draw.randint(1, 4))) + f"</{tag}>"

    def count(element):
        texts = [element.text or "", *[child.tail or "" for child in element]]
        own = sum(len(t) - t.count(" ") for t in texts)
        inner = [count(child) for child in element]
        chars = own + sum(i[0] for i in inner)
        links = chars if element.tag == "a" else sum(i[2] for i in inner)
        return chars, sum(i[1] + 1 for i in inner), links, sum(i[3] + (child.tag == "a") for i, child in zip(inner, element))

    def density(element, whole):
        chars, tags, links, link_tags = count(element)
        if not chars:
            return 0.0
        base = math.log(chars / max(chars - links, 1) * links + whole * chars + math.e)
        return chars / max(tags, 1) * math.log(chars / max(links, 1) * max(tags, 1) / max(link_tags, 1) + 1) / max(math.log(base + 1), 0.1)

    for _ in range(20):
        page = f"<body>{''.join(tree(5) for _ in range(4))}</body>"
        nodes = html.measure(html.parse(page))[1:]  # without the root above body
        elements = list(ElementTree.fromstring(page).iter())
        chars, _, links, _ = count(elements[0])
        whole = (links + 1) / (chars + 1)
        assert [n.tag for n in nodes] == [e.tag for e in elements]
        for node, element in zip(nodes, elements):
            assert (node.chars, node.tags, node.link_chars, node.link_tags) == count(element)
            assert node.density == pytest.approx(density(element, whole))
            assert node.sum == pytest.approx(sum(density(child, whole) for child in element))


def test_empty_table(spark):
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string, text int")).count() == 0
