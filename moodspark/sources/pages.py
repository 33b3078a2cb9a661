"""Candidates from fetched result pages, by selectors that say where a page keeps its items."""

from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodspark.functions.text import absolute_url, decode_entities, java_trim, let, page_text
from moodspark.sources import nodes
from moodspark.sources.nodes import Element, Path


@dataclass(frozen=True)
class PageProfile:
    """Where the items of a kind of result page are: paths to elements, any of which will do.

    `items` leads to an item's element, the other paths look inside it; where one is empty, it is the item itself.
    With `around`, author, description and image are looked for in the element that the item is directly in.
    """

    source: str
    items: tuple[Path, ...]
    title: tuple[Path, ...] = ()
    link: tuple[Path, ...] = ()
    author: tuple[Path, ...] | None = None
    description: tuple[Path, ...] | None = None
    image: tuple[Path, ...] | None = None
    around: bool = False


def _is(name: str | None = None, css_class: str | None = None, **more: str) -> Element:
    return Element(name, css_class, **more)


# The names and classes that the three sites give their elements.
_BOOK_LINK, _SCOPE = _is("a", "prod_info"), _is("div", "coll_cont")
BOOK_PAGE = PageProfile(
    source="BOOK",
    items=((_is("div", "prod_area"),),),
    title=((_BOOK_LINK, _is("span", not_class="prod_category")), (_BOOK_LINK, _is("span", id_start="cmdtName"))),
    link=((_BOOK_LINK,),),
    author=((_is(None, "author"),),),
    description=((_is(None, "desc"),), (_is("p", "desc_area"),)),
    image=((_is(None, "img_box"), _is("img")),),
)
MOVIE_PAGE = PageProfile(
    source="MOVIE",
    items=((_SCOPE, _is("li"), _is("a", "link_txt")), (_is("div", "info_tit"), _is("a"))),
    description=((_is("p", "desc"),),),
    image=((_is("img"),),),
    around=True,
)
_ACTIVITY_LINK = ((_is("a", "link_txt"),), (_is("a", "f_link_b"),))
ACTIVITY_PAGE = PageProfile(
    source="ACTIVITY",
    items=((_SCOPE, _is("li")), (_is("div", "wrap_cont"),)),
    title=_ACTIVITY_LINK,
    link=_ACTIVITY_LINK,
    description=((_is("p", "desc"),), (_is("div", "desc"),)),
    image=((_is("img"),),),
)
# Any page: every link that holds nothing but text is an item.
LINK_PAGE = PageProfile(source="ACTIVITY", items=())
_PLAIN_LINK = r'<a href="([^"]*)">([^<]*)</a>'


def _attribute(node: Column, name: str) -> Column:
    return java_trim(decode_entities(nodes.attribute(node, name)))


def _item(found: Column, pieces: Column, item: Column, url: Column, profile: PageProfile) -> Column:
    def inside(holder: Column, paths: tuple[Path, ...] | None, body) -> Column:
        """body of the first element that the paths lead to."""
        if paths is None:
            return F.lit(None).cast("string")
        return body(item) if paths == () else let(nodes.first(nodes.within(found, holder), *paths), body)

    def text(node: Column) -> Column:
        return F.when(node.isNotNull(), page_text(nodes.inner_markup(pieces, node)))

    def picture(node: Column) -> Column:
        lazy = F.nullif(_attribute(node, "data-src"), F.lit(""))
        return absolute_url(url, F.coalesce(lazy, _attribute(node, "src")))

    def described(holder: Column) -> Column:
        return F.struct(
            inside(item, profile.title, text).alias("title"),
            inside(holder, profile.author, text).alias("author"),
            inside(holder, profile.description, text).alias("description"),
            inside(holder, profile.image, picture).alias("image_url"),
            inside(item, profile.link, lambda node: absolute_url(url, _attribute(node, "href"))).alias("content_url"),
        )

    return let(nodes.parent(found, item), described) if profile.around else described(item)


@cache
def _items(profile: PageProfile) -> Column:
    """The items of a page, an array, from its columns html and url. Some thousand expressions, so made once a profile."""
    html, url = F.col("html"), F.col("url")
    if profile.items:
        return let(nodes.page_nodes(html), lambda page: F.transform(
            nodes.select(page["nodes"], *profile.items), lambda item: _item(page["nodes"], page["pieces"], item, url, profile)
        ))
    links = F.regexp_extract_all(F.regexp_replace(html, nodes.NOT_MARKUP, ""), F.lit("(?is)" + _PLAIN_LINK), F.lit(0))
    none = F.lit(None).cast("string")
    return F.transform(links, lambda link: F.struct(
        page_text(F.regexp_extract(link, "(?is)" + _PLAIN_LINK, 2)).alias("title"), none.alias("author"), none.alias("description"),
        none.alias("image_url"), absolute_url(url, java_trim(decode_entities(F.regexp_extract(link, "(?is)" + _PLAIN_LINK, 1)))).alias("content_url"),
    ))


def _spread(pages: DataFrame) -> DataFrame:
    """Few partitions of pages dealt to all cores, as reading a page takes far longer than moving it; many as they are."""
    cores = pages.sparkSession.sparkContext.defaultParallelism
    if pages.isStreaming or pages.rdd.getNumPartitions() >= cores:
        return pages
    return pages.repartition(cores)


def extract_candidates(pages: DataFrame, profile: PageProfile) -> DataFrame:
    """One row per item of each page with its position: title, author, description, image, address.

    Missing elements are NULL, found but empty ones are empty. A page's tags are read once into a table of its elements;
    an element's parts are looked for among the tags between its first and its last. Items are read before they become
    rows, so that later filters work on the values and do not read the page again.
    """
    kept = [c for c in pages.columns if c not in ("html", "url")]
    items = _items(profile)
    return _spread(pages).select(*kept, F.col("url").alias("page_url"), F.posexplode(items).alias("pos", "item")).select(
        *kept, "page_url", "pos", F.lit(profile.source).alias("source"), "item.*"
    )
