"""The month grid: whole weeks of cells with each day's diary."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodspark.functions import dates
from moodspark.operators.diaries import active
from moodspark.plans.skew import keep_first, only_wanted

MONTH_KEY = ["member_id", "month_start"]


def _rows(diaries: DataFrame, key: str) -> DataFrame:
    return active(diaries).select(
        "member_id", dates.month_start("date").alias("month_start"), "id", "emotion", "created_at",
        F.to_date(key).alias("day"),
    )


def _months(rows: DataFrame) -> DataFrame:
    """Members' months with their days as a map: the last diary (highest id) of each cell day.

    Rows without a mood or time, or of a day outside the month, are shown nowhere and only stand for their
    month; they go along as rows without a day, so that months and days come from one pass.
    """
    shown = (
        F.col("emotion").isNotNull()
        & F.col("created_at").isNotNull()
        & (dates.month_start("day") == F.col("month_start"))
    )
    dated = rows.withColumn("day", F.when(shown, F.col("day"))).drop("created_at")
    last = keep_first(dated, [*MONTH_KEY, "day"], [F.col("id").desc()])
    entry = F.struct("day", F.struct(F.col("id").alias("diary_id"), "emotion"))
    found = F.collect_list(F.when(F.col("day").isNotNull(), entry))
    return last.groupBy(*MONTH_KEY).agg(F.map_from_entries(found).alias("found"))


def month_grid(diaries: DataFrame, requests: DataFrame | None = None, key: str = "created_at") -> DataFrame:
    """Cells of each requested (member_id, month_start), padded to whole weeks from Sunday.

    Without requests, every month in which a member has an active diary. A member's month has at most 31
    days with a diary, so they travel as one small map and the cells are made after the join, not before
    it. Padding cells have no day.
    """
    rows = _rows(diaries, key)
    if requests is None:
        months = _months(rows)
    else:
        asked = requests.select(*MONTH_KEY).distinct()
        months = asked.join(_months(only_wanted(rows, asked, MONTH_KEY)), MONTH_KEY, "left")
    lead = dates.weekday("month_start")
    length = F.day(F.last_day("month_start"))
    cells = F.ceil((lead + length) / F.lit(7)).cast("int") * 7
    grid = (
        months.withColumn("cell", F.explode(F.sequence(F.lit(0), cells - 1)))
        .withColumn("offset", F.col("cell") - lead)
        .withColumn("day", F.when(F.col("offset").between(0, length - 1), F.date_add("month_start", F.col("offset"))))
        .withColumn("hit", F.when(F.col("day").isNotNull(), F.try_element_at("found", F.col("day"))))
    )
    return grid.select(
        "member_id", "month_start",
        F.floor(F.col("cell") / 7).cast("int").alias("week"),
        (F.col("cell") % 7).alias("dow"),
        "day", "hit.diary_id", "hit.emotion",
    )
