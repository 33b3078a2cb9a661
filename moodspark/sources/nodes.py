"""The elements of a page as a table in columns: intervals of tags, and selectors as containment of intervals."""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from moodspark.functions.text import let

# Comments, scripts and styles hold no elements.
NOT_MARKUP = r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>"
# A tag with its attributes, and with the text up to the next tag.
_TAG = r"</?[A-Za-z](?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+>"
_PIECE = _TAG + r"(?:[^<]++|<(?![A-Za-z/!?]))*+"
_NAME = r"^</?([^\s/>]++)"
# Elements without an end tag.
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
# Tags that are counted together.
_CHUNK = 128
# Tags before an element among which its parent is looked for first.
_NEAR = 64


@dataclass(frozen=True)
class Element:
    """What an element must be: its name, one of its classes, a beginning of its id, a class that it must not have."""

    name: str | None = None
    css_class: str | None = None
    id_start: str | None = None
    not_class: str | None = None

    def holds(self, node: Column) -> Column:
        tests = [F.lit(True)]
        if self.name:
            tests.append(node["name"] == self.name)
        if self.css_class:
            tests.append(_has_class(node["piece"], self.css_class))
        if self.not_class:
            tests.append(~_has_class(node["piece"], self.not_class))
        if self.id_start:
            tests.append(F.coalesce(attribute(node, "id"), F.lit("")).startswith(self.id_start))
        return reduce(lambda a, b: a & b, tests)


# A path names an element and, before it, elements that it must be inside of, outermost first.
Path = tuple[Element, ...]


def _tag(piece: Column) -> Column:
    return F.regexp_extract(piece, "(?s)^" + _TAG, 0)


def attribute(node: Column, name: str) -> Column:
    """Value of an attribute as written, NULL without it."""
    start = rf"(?is)[\s\"'/]{name}\s*+=\s*+"
    found = F.regexp_extract(_tag(node["piece"]), start + r"(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++)", 0)
    value = F.regexp_replace(F.regexp_replace(found, start, ""), r"(?s)^([\"'])(.*)\1$", "$2")
    return F.when(node["piece"].rlike(rf"(?i)\s{name}\s*="), F.when(found != "", value))


def _has_class(piece: Column, css_class: str) -> Column:
    """Whether the class is one of those listed, in any case."""
    c = rf"(?:{css_class})"
    listed = rf"(?is)[\s\"'/]class\s*+=\s*+(?:\"(?:[^\"]*\s)?{c}(?:\s[^\"]*)?\"|'(?:[^']*\s)?{c}(?:\s[^']*)?'|{c}(?=[\s>]))"
    return F.lower(piece).contains(css_class) & _tag(piece).rlike(listed)


def page_nodes(markup: Column) -> Column:
    """`pieces`, the tags of a page, each with the text up to the next one, and `nodes`, its elements: an array with a
    place for each tag, NULL where a tag is not the beginning of an element.

    An element has `open` and `close`, the numbers of its tags, its `name` and its first `piece`; what it holds lies
    between the two numbers. Tags are matched by name: a closing tag closes the last element of its name that is open. An
    element that nothing closes ends with the one that it is in.
    """
    plain = let(markup, lambda m: F.when(m.rlike("(?i)<!--|<script|<style"), F.regexp_replace(m, NOT_MARKUP, "")).otherwise(m))
    return let(F.regexp_extract_all(plain, F.lit(_PIECE), F.lit(0)), lambda p: F.struct(p.alias("pieces"), _nodes(p).alias("nodes")))


def _nodes(pieces: Column) -> Column:
    named = F.transform(pieces, lambda p, i: F.struct(
        F.lower(F.regexp_extract(p, _NAME, 1)).alias("name"), i.alias("at"), p.startswith("</").alias("closing"), p.alias("piece")
    ))
    return let(named, lambda tags: F.zip_with(tags, let(_closes(tags), _ended), lambda t, close: F.when(close >= 0, F.struct(
        t["at"].alias("open"), close.alias("close"), t["name"].alias("name"), t["piece"].alias("piece")
    ))))


def _running_sums(steps: Column) -> Column:
    """For each number the sum up to it, chunk by chunk: a fold's state is copied at each step, so it must stay small."""

    def inner(chunk: Column) -> Column:
        empty = F.expr("cast(array() AS array<int>)")
        return F.aggregate(chunk, empty, lambda sums, x: F.concat(sums, F.array(F.coalesce(F.try_element_at(sums, F.lit(-1)), F.lit(0)) + x)))

    def joined(parts: Column) -> Column:
        before = F.aggregate(parts, F.expr("array(0)"), lambda sums, part: F.concat(
            sums, F.array(F.element_at(sums, -1) + F.element_at(part, -1))
        ))
        return F.flatten(F.zip_with(parts, F.slice(before, F.lit(1), F.size(parts)), lambda part, offset: F.transform(part, lambda x: x + offset)))

    def chunks(s: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(s), F.lit(_CHUNK))
        return F.when(F.size(s) > 0, F.transform(starts, lambda i: inner(F.slice(s, i, F.lit(_CHUNK))))).otherwise(F.expr("cast(array() AS array<array<int>>)"))

    return let(steps, lambda s: let(chunks(s), joined))


def _closes(tags: Column) -> Column:
    """For each tag the number of the tag that closes it, -2 if none does; its own if it needs none; -1 for closing tags.

    Tags are ordered by name and place and counted up and down, so an opening tag and the one that closes it have the
    same level, and are next to each other when ordered by name, level and place.
    """

    def paired(s: Column) -> Column:
        # Of one name and level, an opening tag is followed by the one that closes it.
        def close(a: Column, b: Column) -> Column:
            meets = b["closing"] & (a["name"] == b["name"]) & (a["level"] == b["level"])
            return F.struct(a["at"].alias("at"), F.when(a["closing"], -1).when(meets, b["at"]).otherwise(-2).alias("close"))

        return F.zip_with(s, F.concat(F.slice(s, F.lit(2), F.greatest(F.size(s), F.lit(1))), F.slice(s, 1, 1)), close)

    def matched(t: Column) -> Column:
        depths = _running_sums(F.transform(t, lambda tag: F.when(tag["closing"], -1).otherwise(1)))
        by_level = F.sort_array(F.zip_with(t, depths, lambda tag, depth: F.struct(
            tag["name"].alias("name"), F.when(tag["closing"], depth + 1).otherwise(depth).alias("level"), tag["at"].alias("at"),
            tag["closing"].alias("closing"),
        )))
        return let(by_level, paired)

    def holds_others(t: Column) -> Column:
        return ~t["name"].isin(VOID)

    some = F.sort_array(F.transform(
        F.filter(tags, holds_others), lambda t: F.struct(t["name"].alias("name"), t["at"].alias("at"), t["closing"].alias("closing"))
    ))
    voids = F.transform(F.filter(tags, lambda t: ~holds_others(t)), lambda t: F.struct(
        t["at"].alias("at"), F.when(t["closing"], -1).otherwise(t["at"]).alias("close")
    ))
    return F.transform(F.sort_array(F.concat(let(some, matched), voids)), lambda x: x["close"])


def _ended(closes: Column) -> Column:
    """The same with an end for elements that nothing closes: that of the innermost one around, or of the page."""

    def reaching(spans: Column) -> Column:
        def end(i: Column) -> Column:
            around = F.filter(spans, lambda s: (s["open"] < i) & (s["close"] > i))
            return F.coalesce(F.try_element_at(around, F.lit(-1))["close"], F.size(closes))

        return F.transform(closes, lambda c, i: F.when(c == -2, end(i)).otherwise(c))

    closed = F.filter(F.transform(closes, lambda c, i: F.struct(i.alias("open"), c.alias("close"))), lambda s: s["close"] > s["open"])
    return F.when(F.exists(closes, lambda c: c == -2), let(closed, reaching)).otherwise(closes)


def _inside(node: Column, outer: Column) -> Column:
    return (node["open"] > outer["open"]) & (node["close"] <= outer["close"])


def within(nodes: Column, outer: Column) -> Column:
    """The part of the array from an element's first tag to its last."""
    return F.slice(nodes, outer["open"] + 1, outer["close"] - outer["open"] + 1)


def _on_path(nodes: Column, path: Path) -> Column:
    found = F.filter(nodes, lambda x: x.isNotNull() & path[-1].holds(x))
    if len(path) == 1:
        return found
    return let(found, lambda some: F.when(F.size(some) > 0, let(
        _on_path(nodes, path[:-1]), lambda outer: F.filter(some, lambda x: F.exists(outer, lambda o: _inside(x, o)))
    )).otherwise(some))


def select(nodes: Column, *paths: Path) -> Column:
    """The elements that any of the paths leads to, in the order of the page."""
    found = _on_path(nodes, paths[0])
    return F.sort_array(F.array_union(found, select(nodes, *paths[1:]))) if len(paths) > 1 else found


def first(nodes: Column, *paths: Path) -> Column:
    """The first element that any of the paths leads to, NULL without one."""
    return F.get(select(nodes, *paths), F.lit(0))


def parent(nodes: Column, node: Column) -> Column:
    """The innermost element that holds this one, NULL at the top."""

    def last_around(part: Column) -> Column:
        return F.try_element_at(F.filter(part, lambda x: x.isNotNull() & _inside(node, x)), F.lit(-1))

    start = F.greatest(node["open"] - _NEAR, F.lit(0))
    near = last_around(F.slice(nodes, start + 1, node["open"] - start))
    return let(near, lambda p: F.when(p.isNotNull() | (start == 0), p).otherwise(last_around(F.slice(nodes, F.lit(1), start))))


def inner_markup(pieces: Column, node: Column) -> Column:
    """The markup between an element's tags, as written."""
    held = F.slice(pieces, node["open"] + 1, F.greatest(node["close"] - node["open"], F.lit(0)))
    return F.when(node.isNotNull(), F.regexp_replace(F.array_join(held, ""), "(?s)^" + _TAG, ""))
