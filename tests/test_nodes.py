"""The table of a page's elements against a plain stack of open tags, and what selectors find in it."""

import random
import re

import pytest
from html.entities import html5
from pyspark.sql import functions as F

from moodspark.functions.text import decode_entities
from moodspark.sources import nodes, pages
from moodspark.sources.nodes import Element


def found(spark, html):
    df = spark.createDataFrame([(html,)], "html string").select(nodes.page_nodes(F.col("html")).alias("p"))
    return [(n["name"], n["open"], n["close"]) for n in df.first()["p"]["nodes"] if n]


def plain(html):
    """The same for well-formed pages, by a stack."""
    stack, out = [], []
    for i, (slash, name) in enumerate(re.findall(r"<(/?)(\w+)[^>]*>", html)):
        if slash:
            name, at = stack.pop()
            out.append((name, at, i))
        elif name in nodes.VOID:
            out.append((name, i, i))
        else:
            stack.append((name, i))
    return sorted(out, key=lambda x: x[1])


def grown(draw, depth=0):
    out = ""
    for _ in range(draw.randrange(0, 5) if depth < 6 else 0):
        name = draw.choice(["div", "li", "a", "span", "b", "img", "br"])
        out += f"<{name} class='x'>t" + ("" if name in nodes.VOID else grown(draw, depth + 1) + f"</{name}>")
    return out


@pytest.mark.parametrize("seed", range(3))
def test_nodes_of_well_formed_pages(spark, seed):
    draw = random.Random(seed)
    html = "<body>" + "".join(grown(draw) for _ in range(30)) + "</body>"
    assert found(spark, html) == plain(html)


def test_stray_and_missing_tags(spark):
    assert found(spark, "</p><div><p>a</div></div><ul><li>b<li>c</ul><i>") == [
        ("div", 1, 3), ("p", 2, 3), ("ul", 5, 8), ("li", 6, 8), ("li", 7, 8), ("i", 9, 10),
    ]
    assert found(spark, "a < b <!-- <p> --><script>'<p>'</script><a title='x > y' href=\"<\">z</a> < c") == [("a", 0, 1)]
    assert found(spark, "") == [] and found(spark, "no tags") == []


def test_selectors_and_parents(spark):
    html = (
        "<div class='in'><li><b class='in x'><a id=n1 href='/1'>one <i>two</i> three</a></b></li></div><li><a id=m2>four</a></li>"
    )
    page = F.col("p")
    df = spark.createDataFrame([(html,)], "html string").select(nodes.page_nodes(F.col("html")).alias("p"))
    link = Element("a")

    def names(*paths):
        return [n["open"] for n in df.select(nodes.select(page["nodes"], *paths)).first()[0]]

    assert names((link,)) == [3, 11] and names((Element("div", "in"), Element("li"), link)) == [3]
    assert names((Element(css_class="in"),)) == [0, 2] and names((Element("a", id_start="n"),), (Element("li"),)) == [1, 3, 10]
    assert names((Element("b", not_class="x"),)) == []
    row = df.select(nodes.let(nodes.first(page["nodes"], (link,)), lambda a: F.struct(
        nodes.parent(page["nodes"], a)["name"].alias("parent"), nodes.inner_markup(page["pieces"], a).alias("inner"),
        nodes.attribute(a, "href").alias("href"), nodes.attribute(a, "class").alias("none"),
    ))).first()[0]
    assert tuple(row) == ("b", "one <i>two</i> three", "/1", None)


def test_a_parent_far_before_its_child(spark):
    html = "<div class='info_tit'>" + "<b>x</b>" * 400 + "<a href='/1'>far</a><img src='/i.png'></div>"
    rows = spark.createDataFrame([(1, "https://h.example/", html)], "page_id long, url string, html string")
    row = pages.extract_candidates(rows, pages.MOVIE_PAGE).first()
    assert (row["title"], row["image_url"], row["content_url"]) == ("far", "https://h.example/i.png", "https://h.example/1")


def test_every_named_entity(spark):
    names = sorted(n for n in html5 if n.endswith(";"))
    rows = spark.createDataFrame([(f"a&{n}b",) for n in names], "t string")
    assert [r[0] for r in rows.select(decode_entities(F.col("t"))).collect()] == [f"a{html5[n]}b" for n in names]


@pytest.mark.parametrize("given, due", [
    ("&amp;lt; &eacute;&Eacute; & &;", "&lt; éÉ & &;"), ("no&such;&#233;&#xe9;&#XE9", "no&such;éé&#XE9"), ("&#0;&#55296;&#38;amp;", "\ufffd\ufffd&amp;"),
    ("", ""), ("plain", "plain"), (None, None), ("a\n&nbsp;\nb", "a\n\u00a0\nb"),
])
def test_entities_are_read_once(spark, given, due):
    assert spark.createDataFrame([(given,)], "t string").select(decode_entities(F.col("t"))).first()[0] == due
