"""Reading diaries: filters, lookups, public views and their members."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodspark import vocab
from moodspark.functions import dates
from moodspark.plans.skew import hot_keys, only_wanted, salted_join

PUBLIC = {
    "diary": [
        "id", "member_id", "content", "emoji", "emotion", "sentiment_score", "ai_comment", "date", "status",
        "created_at", "updated_at",
    ],
    "recommendation": ["id", "category", "title", "description", "image_url", "content_url"],
    "member": ["id", "email", "nickname", "provider", "status", "created_at"],
}


def active(diaries: DataFrame) -> DataFrame:
    return diaries.where(F.col("status") == vocab.ACTIVE)


def active_diaries(diaries: DataFrame, member_id: int | None = None) -> DataFrame:
    """Active diaries of each member, or of one, oldest first."""
    rows = active(diaries)
    if member_id is not None:
        return rows.where(F.col("member_id") == member_id).orderBy("date", "id")
    return rows.orderBy("member_id", "date", "id")


def newest_first(diaries: DataFrame) -> DataFrame:
    """Active diaries of each member, newest first; diaries of one day keep their order."""
    return active(diaries).orderBy("member_id", F.col("date").desc(), "id")


def diaries_in_month(diaries: DataFrame, year: int, month: int) -> DataFrame:
    """Active diaries dated in a month. Tables laid out by month skip the other folders."""
    rows = active(diaries).where(dates.in_month("date", year, month))
    if "month" in diaries.columns:
        rows = rows.where(F.col("month") == F.lit(dates.month_range(year, month)[0]))
    return rows


def calendar_rows(diaries: DataFrame, year: int, month: int) -> DataFrame:
    """What the calendar needs of a month: filtered by diary date, keyed by the day of creation."""
    return diaries_in_month(diaries, year, month).select(
        F.col("id").alias("diary_id"), "member_id", dates.date_key("created_at").alias("created_at"), "emotion"
    )


def diary_detail(diaries: DataFrame, requests: DataFrame) -> DataFrame:
    """Answer (request_id, member_id, id) requests; `found` tells whether it is the member's active diary."""
    rows = active(diaries).select(
        "id", "member_id", "content", "emotion", "sentiment_score", "date", F.lit(True).alias("_found")
    )
    keys = ["id", "member_id"]
    wanted = only_wanted(rows, requests, keys)
    joined = salted_join(requests, wanted, keys, "left", ["request_id"], hot_keys(requests, keys))
    return joined.withColumn("found", F.coalesce("_found", F.lit(False))).drop("_found")


def diaries_with_member(diaries: DataFrame, members: DataFrame) -> DataFrame:
    """Each diary with its writer. A member with very many diaries is spread over the reducers."""
    people = members.select(F.col("id").alias("member_id"), "nickname", "provider")
    return salted_join(diaries, people, ["member_id"], "inner", ["id"], hot_keys(diaries, ["member_id"]))


def public_view(kind: str, df: DataFrame) -> DataFrame:
    """The columns shown to clients. Missing images of harvested and seeded rows look the same: NULL."""
    rows = df.select(*[c for c in PUBLIC[kind] if c in df.columns])
    if kind == "recommendation":
        rows = rows.withColumn("image_url", F.nullif("image_url", F.lit("")))
    return rows


def lookup(table: dict[str, str], key: Column, default: str) -> Column:
    """Value of a key in a small fixed table."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def with_emoji(diaries: DataFrame) -> DataFrame:
    """Mood shown on a diary card: neutral where none is stored, with its emoji."""
    shown = F.coalesce("emotion", F.lit(vocab.NEUTRAL))
    return diaries.withColumn("shown_emotion", shown).withColumn(
        "emotion_emoji", lookup(vocab.EMOTION_EMOJI, F.col("shown_emotion"), vocab.DEFAULT_EMOJI)
    )


def duplicate_days(diaries: DataFrame) -> DataFrame:
    """Days on which a member has more than one active diary."""
    return active(diaries).groupBy("member_id", "date").agg(F.count("*").alias("n")).where("n > 1")
