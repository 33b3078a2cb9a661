"""Candidates from the answers of a video search."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodspark import schemas


def parse_video_search(responses: DataFrame, body: str = "body") -> DataFrame:
    """One row per item with its position; other columns stay. Answers without items give no rows.

    An item lacking an id, a title or thumbnails is dropped alone; the rest of its answer stays.
    """
    kept = [c for c in responses.columns if c != body]
    found = F.from_json(body, schemas.VIDEO_SEARCH, {"mode": "PERMISSIVE"})
    items = responses.select(*kept, F.posexplode(found["items"]).alias("pos", "item"))
    whole = (
        F.col("item.id.videoId").isNotNull()
        & F.col("item.snippet.title").isNotNull()
        & F.col("item.snippet.thumbnails.high").isNotNull()
    )
    return items.where(whole).select(
        *kept, "pos",
        F.col("item.id.videoId").alias("video_id"),
        F.col("item.snippet.title").alias("title"),
        F.col("item.snippet.description").alias("description"),
        F.col("item.snippet.thumbnails.high.url").alias("image_url"),
    )
