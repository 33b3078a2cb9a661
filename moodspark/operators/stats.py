"""Monthly mood statistics of every member."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from moodspark import vocab
from moodspark.functions import dates, numbers
from moodspark.operators.diaries import active, lookup
from moodspark.plans.skew import only_wanted

MONTH_KEY = ["member_id", "month_start"]


def by_month(diaries: DataFrame) -> DataFrame:
    """What the statistics need of the active diaries."""
    return active(diaries).select(
        "member_id", dates.month_start("date").alias("month_start"), "emotion", "sentiment_score"
    )


def emotion_counts(diaries: DataFrame) -> DataFrame:
    """Diaries per member, month and mood; those without a mood are left out."""
    known = by_month(diaries).where(F.col("emotion").isNotNull())
    return known.groupBy(*MONTH_KEY, "emotion").agg(F.count("*").alias("n"))


def _parts(rows: DataFrame) -> DataFrame:
    sums = numbers.sum_limbs(numbers.exact_limbs("sentiment_score"))
    return rows.groupBy(*MONTH_KEY, "emotion").agg(
        F.count("*").alias("n"),
        F.count("sentiment_score").alias("score_n"),
        *[c.alias(f"score_{k}") for k, c in sums.items()],
    )


def _sums() -> dict[str, Column]:
    """Sums over the stored sums."""
    return numbers.sum_limbs({k: F.col(f"score_{k}") for k in ("whole", "mid", "low", "huge")})


def mood_parts(diaries: DataFrame) -> DataFrame:
    """Sums per member, month and mood. Parts of several batches add up to the parts of all."""
    return _parts(by_month(diaries))


def _mean(sums: dict[str, Column], n: Column) -> Column:
    return numbers.half_up(numbers.from_limbs(sums) / F.nullif(n, F.lit(0)), 2)


def _records(moods: DataFrame) -> DataFrame:
    """The month record of each member from one row per mood: total, mean score and diaries per mood as a map."""
    entry = F.when(F.col("emotion").isNotNull(), F.struct("emotion", "n"))
    return moods.groupBy(*MONTH_KEY).agg(
        F.sum("n").alias("total_count"),
        _mean(_sums(), F.sum("score_n")).alias("average_score"),
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("emotion_counts"),
    )


def monthly_stats(diaries: DataFrame) -> DataFrame:
    """Month records with an open set of moods."""
    return _records(mood_parts(diaries))


def added_parts(parts: DataFrame) -> DataFrame:
    """The parts of several batches as those of one."""
    return parts.groupBy(*MONTH_KEY, "emotion").agg(
        *[F.sum(c).alias(c) for c in ("n", "score_n")], *[c.alias(f"score_{k}") for k, c in _sums().items()]
    )


def stats_from_parts(parts: DataFrame) -> DataFrame:
    """Month records from the parts of several batches."""
    return _records(added_parts(parts))


def monthly_stats_wide(diaries: DataFrame, emotions: list[str] = vocab.DIARY_EMOTIONS) -> DataFrame:
    """Month records with one count column per given mood, n_0 and on: one hash aggregation, one shuffle."""
    counts = [F.count_if(F.col("emotion") == e).alias(f"n_{i}") for i, e in enumerate(emotions)]
    sums = numbers.sum_limbs(numbers.exact_limbs("sentiment_score"))
    return by_month(diaries).groupBy(*MONTH_KEY).agg(
        F.count("*").alias("total_count"),
        _mean(sums, F.count("sentiment_score")).alias("average_score"),
        *counts,
    )


def requested_stats(requests: DataFrame, diaries: DataFrame) -> DataFrame:
    """Answer (member_id, year, month) requests; a month without diaries has total 0, no mean, an empty map.

    Few requests reach the diaries as a filter, so that only the asked months are added up.
    """
    asked = requests.select(
        "member_id", "year", "month", F.make_date("year", "month", F.lit(1)).alias("month_start")
    ).distinct()
    record = _records(_parts(only_wanted(by_month(diaries), asked, MONTH_KEY)))
    empty = F.expr("cast(map() as map<string, bigint>)")
    return asked.join(record, MONTH_KEY, "left").select(
        "member_id", "year", "month",
        F.coalesce("total_count", F.lit(0)).alias("total_count"),
        "average_score",
        F.coalesce("emotion_counts", empty).alias("emotion_counts"),
    )


def dominant_emotion(counts: DataFrame, order: list[str] = vocab.DOMINANT_ORDER) -> DataFrame:
    """Most frequent mood of each member's month; `order` breaks ties, moods outside it come last by name."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(e) for e in order]), F.col("emotion")), F.lit(0)),
                      F.lit(len(order) + 1))
    best = F.min_by("emotion", F.struct(-F.col("n"), rank, "emotion"))
    return counts.groupBy(*MONTH_KEY).agg(best.alias("emotion"), F.max("n").alias("n"))


def emotion_share(counts: DataFrame) -> DataFrame:
    """Slices of a member's month: share, whole percent, the label that 5 % or more get, and the slice's name."""
    month = W.partitionBy(*MONTH_KEY)
    share = F.col("n") / F.sum("n").over(month)
    return (
        counts.where("n > 0")
        .withColumn("share", share)
        .withColumn("percent", numbers.half_up(F.col("share") * 100).cast("int"))
        .withColumn("label", F.when(F.col("share") >= 0.05, F.concat(F.col("percent").cast("string"), F.lit("%"))))
        .withColumn("name", F.concat_ws(
            " ", lookup(vocab.DASHBOARD_EMOJI, F.col("emotion"), vocab.DEFAULT_EMOJI), "emotion"
        ))
    )


def score_gauge(stats: DataFrame, low: float = -1.0, high: float = 1.0) -> DataFrame:
    """Gauge position in percent and its band for months that have a mean score."""
    score = F.col("average_score")
    return stats.where(score.isNotNull()).select(
        *MONTH_KEY, "average_score",
        numbers.half_up((score - low) / (high - low) * 100).cast("int").alias("percent"),
        F.when(score >= 0.3, "HIGH").when(score >= -0.1, "MIDDLE").otherwise("LOW").alias("band"),
    )


def row_count(df: DataFrame, *by: str | Column) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))
