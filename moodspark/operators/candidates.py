"""Cleaning harvested items into catalogue rows."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodspark import vocab
from moodspark.functions.text import (
    cut, java_trim, join_parts, or_default, search_url, snippet, title_key, watch_url,
)

# Columns of a clean candidate: where it comes from, its place in the harvest, the catalogue row, title keys.
CLEAN = [
    "source", "emotion", "ord", "category", "title", "description", "image_url", "content_url",
    "stored_key", "probe_key",
]


def harvest_order(source_order: list[str], emotion_order: list[str] = vocab.HARVEST_ORDER) -> Column:
    """Place of a candidate in the harvest: source, mood, phrase, page, position. Smaller is saved earlier.

    No two candidates of a harvest may share a place, so a page id must be one source's page for one phrase.
    """

    def rank(values: list[str], c: str) -> Column:
        place = F.array_position(F.array(*[F.lit(v) for v in values]), F.col(c)).cast("int")
        return F.when(place > 0, place).otherwise(F.lit(len(values) + 1))

    return F.struct(
        rank(source_order, "source").alias("source_rank"),
        rank(emotion_order, "emotion").alias("emotion_rank"),
        F.col("phrase_index").cast("int").alias("phrase_index"),
        F.col("page_id").cast("bigint").alias("page_id"),
        F.col("pos").cast("int").alias("pos"),
    )


def _shape(df: DataFrame, source: str) -> DataFrame:
    """The columns of a source's catalogue rows, before the width limits."""
    title = java_trim("title")
    short = cut(title, vocab.TITLE_LIMIT)
    image = java_trim(or_default("image_url", ""))
    url = java_trim("content_url") if "content_url" in df.columns else None
    if source in ("MUSIC", "MUSIC_RAW"):
        text = java_trim(or_default("description", vocab.NO_VIDEO_DESCRIPTION))
        url = watch_url("video_id")
    elif source == "BOOK":
        author = F.concat(F.lit(vocab.AUTHOR_PREFIX), java_trim(or_default("author", vocab.NO_AUTHOR)))
        about = java_trim(or_default(snippet("description", vocab.BOOK_SNIPPET), vocab.NO_DESCRIPTION))
        text = join_parts(short, author, about)
    elif source == "MOVIE":
        about = java_trim(or_default(snippet("description", vocab.MOVIE_SNIPPET), vocab.NO_SYNOPSIS))
        text = join_parts(short, about)
        url = search_url(or_default(url, ""), short)
    else:
        about = java_trim(or_default(snippet("description", vocab.ACTIVITY_SNIPPET), vocab.NO_DESCRIPTION))
        text = join_parts(short, about)
    return df.withColumns({
        "title": short, "description": cut(text, vocab.DESCRIPTION_LIMIT), "image_url": image, "content_url": url,
    })


def clean_candidates(df: DataFrame, profile: str, source_order: list[str] = vocab.FULL_RUN) -> DataFrame:
    """Catalogue rows from raw items of one source: MUSIC, MUSIC_RAW, BOOK, MOVIE or ACTIVITY.

    Items without a title are dropped, and those without an address unless the source can make one;
    activities also need a title of more than five characters. MUSIC_RAW keeps titles and texts as they come.
    Rows that the catalogue's columns cannot hold are dropped one by one.
    """
    category = "MUSIC" if profile == "MUSIC_RAW" else profile
    placed = df.withColumn("source", F.lit(category)).withColumn("ord", harvest_order(source_order))
    placed = placed.withColumn("probe_key", title_key("title"))
    if profile == "MUSIC_RAW":
        rows = placed.withColumn("content_url", watch_url("video_id"))
    else:
        if profile != "MUSIC":
            placed = placed.where(java_trim("title") != "")
        if profile in ("BOOK", "ACTIVITY"):
            placed = placed.where(java_trim("content_url") != "")
        if profile == "ACTIVITY":
            placed = placed.where(F.length(java_trim("title")) > vocab.SHORT_TITLE)
        rows = _shape(placed, profile)
    fits = (
        (F.length("title") <= vocab.TITLE_LIMIT)
        & F.col("description").isNotNull()
        & (F.coalesce(F.length("image_url"), F.lit(0)) <= vocab.URL_LIMIT)
        & (F.length("content_url") <= vocab.URL_LIMIT)
    )
    return rows.where(fits).withColumns({
        "category": F.lit(category),
        "stored_key": title_key("title"),
    }).select(*CLEAN)


def all_candidates(parts: list[DataFrame]) -> DataFrame:
    """The candidates of all sources; their order is in `ord`."""
    return reduce(DataFrame.unionByName, parts)


def to_catalogue(saved: DataFrame) -> DataFrame:
    """Saved candidates as catalogue rows without an id."""
    return saved.select("emotion", "category", "title", "description", "image_url", "content_url")
