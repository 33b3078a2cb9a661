"""Diaries as they arrive: enriched, stored, and added to the monthly statistics.

Each batch writes folders of its own. A list says which folders count, for diaries, rejects and statistics at once, and
folders of many small batches are merged into sorted ones, so their number grows with the logarithm of the batches.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from moodspark.functions import dates
from moodspark.operators.sentiment import Classifier, enrich_diaries
from moodspark.operators.stats import added_parts, mood_parts, stats_from_parts
from moodspark.operators.validation import diary_rules, validate
from moodspark.sources.part_list import (
    FAN, KEEP_SECONDS, add_part, current, listed, merge_parts, new_part, part_folder, read_parts, run_id,
)
from moodspark.sources.sinks import by_folder

TABLES = ("rejects", "diaries", "mood_parts")
_DIARIES = (
    "id long, member_id long, content string, emoji string, emotion string, sentiment_score double, ai_comment string, "
    "date date, status string, created_at timestamp_ntz, updated_at timestamp_ntz, run string, batch_id long, month date"
)
_MOODS = (
    "member_id long, month_start date, emotion string, n long, score_n long, score_whole decimal(38,0), "
    "score_mid decimal(38,0), score_low decimal(38,0), score_huge double"
)


def _place(diaries: DataFrame, target: str) -> None:
    by_folder(diaries, "month", "member_id").write.partitionBy("month").parquet(target)


def _rejects(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """Their columns are those of the requests."""
    first = spark.read.parquet(part_folder(folder, "rejects", names[0]))
    return read_parts(spark, folder, "rejects", names, first.schema)


def _merge(spark: SparkSession, folder: str, names: list[str], target: str) -> None:
    """Diaries sorted into their months again, statistics added up, rejects put together."""
    _place(read_parts(spark, folder, "diaries", names, _DIARIES), part_folder(folder, "diaries", target))
    moods = added_parts(read_parts(spark, folder, "mood_parts", names, _MOODS))
    moods.write.parquet(part_folder(folder, "mood_parts", target))
    _rejects(spark, folder, names).hint("rebalance").write.parquet(part_folder(folder, "rejects", target))


def store_batch(
    requests: DataFrame, batch_id: int, folder: str, classifier: Classifier, run: str = "first", fan: int = FAN,
    keep: float = KEEP_SECONDS,
) -> None:
    """Write one batch: rejected requests, diaries, and its part of the statistics, then merge what has become many.

    A repeated batch takes the place of its earlier attempt, and one that is merged already stays as it is. `run` tells
    streams with different progress folders apart, whose batches are all numbered from 0. The statistics are made from the diaries
    as written: a classifier runs once per diary.
    """
    spark = requests.sparkSession
    if current(spark, folder).is_merged(run, batch_id):
        return
    part = new_part(run, batch_id)
    valid, rejected = validate(requests, diary_rules())
    rejected.write.parquet(part_folder(folder, "rejects", part.name))
    diaries = enrich_diaries(valid, classifier).withColumns({
        "run": F.lit(run), "batch_id": F.lit(batch_id).cast("long"), "month": dates.month_start("date"),
    })
    _place(diaries, part_folder(folder, "diaries", part.name))
    written = read_parts(spark, folder, "diaries", [part.name], _DIARIES)
    mood_parts(written).write.parquet(part_folder(folder, "mood_parts", part.name))
    now = add_part(spark, folder, TABLES, part, keep)
    merge_parts(spark, folder, TABLES, run, now, lambda names, target: _merge(spark, folder, names, target), fan, keep)


def start_diary_arrivals(
    requests: DataFrame, folder: str, checkpoint: str, classifier: Classifier, fan: int = FAN
) -> StreamingQuery:
    """Process what has arrived and stop. Statistics grow by sums, so no state is kept per member or month.

    A progress folder that is made anew is a run of its own, also at the path of an earlier one.
    """
    run = run_id(requests.sparkSession, checkpoint)
    return (
        requests.writeStream
        .foreachBatch(lambda batch, batch_id: store_batch(batch, batch_id, folder, classifier, run, fan))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stored_diaries(spark: SparkSession, folder: str) -> DataFrame:
    return read_parts(spark, folder, "diaries", listed(spark, folder), _DIARIES)


def stored_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """Rejected requests with their errors. There must have been a batch, which decides the columns."""
    return _rejects(spark, folder, listed(spark, folder))


def stored_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Month records over all batches so far."""
    return stats_from_parts(read_parts(spark, folder, "mood_parts", listed(spark, folder), _MOODS))
