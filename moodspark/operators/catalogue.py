"""Reading the recommendation catalogue and picking from it."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodspark import vocab
from moodspark.functions import numbers
from moodspark.operators.diaries import active, lookup
from moodspark.plans.skew import hot_keys, keep_first, salted_join

# More (emotion, category) pairs than this are joined by shuffle instead of broadcast.
BROADCAST_PICKS = 10_000


def by_emotion(catalogue: DataFrame, emotion: str) -> DataFrame:
    return catalogue.where(F.col("emotion") == emotion)


def by_content_url(catalogue: DataFrame, url: str) -> DataFrame:
    return catalogue.where(F.col("content_url") == url)


def pick_per_category(catalogue: DataFrame, seed: int) -> DataFrame:
    """One item per mood and category, drawn by hash: uniform over seeds, the same for the same seed."""
    return keep_first(
        catalogue.withColumn("_draw", numbers.keyed_hash(seed, "id")),
        ["emotion", "category"], [F.col("_draw"), F.col("id")],
    ).drop("_draw")


def recommend_for_diaries(
    diaries: DataFrame, catalogue: DataFrame, seed: int, broadcast_picks: int = BROADCAST_PICKS
) -> DataFrame:
    """Recommendations shown with each active diary: the picks of its mood.

    Picking comes first, so the diaries meet one row per mood and category. Those are counted and
    broadcast while they are few; otherwise the diaries of a mood are spread over the reducers.
    """
    rows = active(diaries).where(F.col("emotion").isNotNull()).select(
        F.col("id").alias("diary_id"), "member_id", "emotion"
    )
    picks = pick_per_category(catalogue, seed).withColumnRenamed("id", "recommendation_id")
    pairs = catalogue.select("emotion", "category").distinct().limit(broadcast_picks + 1).count()
    if pairs <= broadcast_picks:
        return rows.join(F.broadcast(picks), "emotion")
    return salted_join(rows, picks, ["emotion"], "inner", ["diary_id"], hot_keys(rows, ["emotion"]))


def with_category_icon(catalogue: DataFrame) -> DataFrame:
    return catalogue.withColumn("icon", lookup(vocab.CATEGORY_ICON, F.col("category"), vocab.DEFAULT_ICON))


def emotion_coverage(diaries: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Moods of active diaries and of the catalogue side by side, with what either side lacks."""
    written = active(diaries).where(F.col("emotion").isNotNull()).groupBy("emotion").agg(
        F.count("*").alias("diaries")
    )
    offered = catalogue.groupBy("emotion").agg(F.count("*").alias("recommendations"))
    return written.join(offered, "emotion", "full").select(
        "emotion",
        F.coalesce("diaries", F.lit(0)).alias("diaries"),
        F.coalesce("recommendations", F.lit(0)).alias("recommendations"),
        F.when(F.col("recommendations").isNull(), "NO RECOMMENDATION")
        .when(F.col("diaries").isNull(), "NO DIARY")
        .otherwise("BOTH").alias("coverage"),
    )


def replace_category(catalogue: DataFrame, category: str, replacement: DataFrame) -> DataFrame:
    """The catalogue with one category's rows exchanged for others."""
    return catalogue.where(F.col("category") != category).unionByName(
        replacement.where(F.col("category") == category)
    )
