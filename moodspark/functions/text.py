"""String helpers on columns. All are built-in expressions, so they stay inside the JVM."""

from functools import cache, reduce
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from moodspark import vocab

# Every character up to and including the blank.
_BLANKS = "".join(chr(code) for code in range(0x21))

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"
_SITE = r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)"

# All named entities of HTML, by name. Python's own table, less the names that count without a semicolon.
_ENTITIES = {name[:-1]: char for name, char in html5.items() if name.endswith(";")}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def java_trim(c) -> Column:
    """Strip blanks and control characters; other Unicode spaces stay."""
    return F.btrim(_col(c), F.lit(_BLANKS))


def is_blank(c) -> Column:
    """NULL, empty or nothing but blanks."""
    return F.coalesce(java_trim(c) == "", F.lit(True))


def cut(c, limit: int) -> Column:
    return F.substring(_col(c), 1, limit)


def snippet(c, limit: int) -> Column:
    c = _col(c)
    return F.when(F.length(c) > limit, F.concat(cut(c, limit), F.lit("..."))).otherwise(c)


def or_default(c, default: str) -> Column:
    return F.coalesce(_col(c), F.lit(default))


def join_parts(*parts) -> Column:
    return F.concat_ws(" | ", *[_col(p) for p in parts])


def title_key(c) -> Column:
    return F.lower(java_trim(c))


def contains_any(c, words: list[str]) -> Column:
    """True where the text holds one of the words, NULL for a NULL text."""
    return reduce(lambda a, b: a | b, [_col(c).contains(w) for w in words])


def form_encode(c) -> Column:
    """Form encoding: blanks become a plus sign."""
    return F.url_encode(_col(c))


def query_encode(c) -> Column:
    """Form encoding with %20 for blanks, as video search wants it."""
    return F.replace(form_encode(c), F.lit("+"), F.lit("%20"))


def watch_url(video_id) -> Column:
    return F.concat(F.lit(vocab.WATCH_PREFIX), _col(video_id))


def search_url(url, title) -> Column:
    """The address itself, or a movie search for the title where there is none."""
    fallback = F.concat(F.lit(vocab.MOVIE_SEARCH_PREFIX), form_encode(title), F.lit(vocab.MOVIE_SEARCH_SUFFIX))
    return F.coalesce(F.nullif(_col(url), F.lit("")), fallback)


def site_of(url) -> Column:
    """Scheme and host of an address, empty if it has none."""
    return F.regexp_extract(_col(url), _SITE, 1)


def _without_dot_segments(path: Column) -> Column:
    def step(kept, segment):
        return (
            F.when(segment == ".", kept)
            .when(segment == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(1))))
            .otherwise(F.concat(kept, F.array(segment)))
        )

    ended = F.when(path.rlike(r"/\.\.?$"), F.concat(path, F.lit("/"))).otherwise(path)
    segments = F.split(ended, "/")
    return F.array_join(F.aggregate(segments, F.expr("cast(array() as array<string>)"), step), "/")


def _resolve(base: Column, href: Column) -> Column:
    def from_path(path):
        # Address of the page without query and fragment, and the folder it is in.
        plain = F.regexp_extract(base, r"^([^?#]*)", 1)
        folder = F.regexp_extract(F.substr(plain, F.length(site_of(base)) + 1), r"^(.*/)", 1)
        beside = F.concat(F.coalesce(F.nullif(folder, F.lit("")), F.lit("/")), path)
        return let(
            F.when(path.startswith("/"), path).otherwise(beside),
            lambda t: F.when(t.rlike(r"/\.\.?(/|$)"), _without_dot_segments(t)).otherwise(t),
        )

    path = F.regexp_extract(href, r"^([^?#]*)", 1)
    tail = F.substr(href, F.length(path) + 1)
    return (
        F.when(href == "", base)
        .when(href.rlike(_SCHEME), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, _SCHEME, 0), href))
        .when(href.startswith("?"), F.concat(F.regexp_extract(base, r"^([^?#]*)", 1), href))
        .when(href.startswith("#"), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), href))
        .otherwise(F.concat(site_of(base), let(path, from_path), tail))
    )


def absolute_url(base, href) -> Column:
    """Resolve a link against the address of its page. An empty link is the page itself, NULL stays NULL."""
    base = _col(base)
    return let(_col(href), lambda h: _resolve(base, h))


@cache
def _entity_table() -> Column:
    """Code points of named entities, a map for each first letter, as one constant."""
    groups: dict[str, list[str]] = {}
    for name, char in sorted(_ENTITIES.items()):
        groups.setdefault(name[0], []).append(f"{name}={' '.join(str(ord(c)) for c in char)}")
    maps = ((F.lit(letter), F.str_to_map(F.lit(",".join(names)), F.lit(","), F.lit("="))) for letter, names in groups.items())
    return F.create_map(*[c for pair in maps for c in pair])


def _character(code: Column) -> Column:
    """The character of a number; the replacement character where there is none."""
    valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(F.lit("\ufffd"))


def _numbered(digits: Column, base: int) -> Column:
    """The character of a number written out. Any number of digits; one beyond the last character is as good as another."""
    plain = F.regexp_replace(digits, "^0+(?=.)", "")
    return _character(F.conv(F.when(F.length(plain) <= 7, plain).otherwise(F.lit("9999999")), base, 10).cast("bigint"))


def _named(name: Column) -> Column:
    """The characters of a named entity, NULL for an unknown name."""
    codes = F.try_element_at(F.try_element_at(_entity_table(), F.substring(name, 1, 1)), name)
    return F.array_join(F.transform(F.split(codes, " "), lambda c: _character(c.cast("bigint"))), "")


# An entity and the text up to the next one, or the text before the first.
_ENTITY = r"(?s)&(?:#[0-9]++;|#[xX][0-9A-Fa-f]++;|[A-Za-z][A-Za-z0-9]*+;)?[^&]*+|^[^&]++"


def _decode_piece(piece: Column) -> Column:
    def decoded(end: Column) -> Column:
        body = F.substring(piece, F.lit(2), end - 2)
        char = (
            F.when(body == "amp", F.lit("&")).when(body == "lt", F.lit("<")).when(body == "gt", F.lit(">"))
            .when(body == "quot", F.lit('"')).when(body == "nbsp", F.lit("\u00a0"))
            .when(body.rlike("^#[0-9]+$"), _numbered(F.substr(body, F.lit(2)), 10))
            .when(body.rlike("^#[xX][0-9A-Fa-f]+$"), _numbered(F.substr(body, F.lit(3)), 16))
            .when(body.rlike("^[A-Za-z][A-Za-z0-9]*$"), _named(body))
        )
        return F.coalesce(F.concat(char, F.substr(piece, end + 1)), piece)

    return F.when(piece.startswith("&") & piece.contains(";"), let(F.locate(";", piece), decoded)).otherwise(piece)


def decode_entities(text: Column) -> Column:
    """Entities, numbered and named, as the characters they stand for. One pass: what an entity gives is not read again."""
    pieces = F.regexp_extract_all(text, F.lit(_ENTITY), F.lit(0))
    return F.when(text.contains("&"), F.array_join(F.transform(pieces, _decode_piece), "")).otherwise(text)


def page_text(html) -> Column:
    """Text of a piece of markup: tags dropped, entities decoded, white space collapsed and trimmed."""
    text = decode_entities(F.regexp_replace(_col(html), r"<[^>]*>", ""))
    text = F.translate(text, "\u200b\u00ad", "")
    text = F.regexp_replace(text, "[ \\t\\n\\f\\r\u00a0]+", " ")
    return java_trim(text)
