"""Writing tables. Rows are laid out by the column that later reads filter on."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodspark.functions import dates


def by_folder(rows: DataFrame, folder: str, sorting: str) -> DataFrame:
    """The rows of a folder brought together, large ones split, so that each gets few files; sorted for file skipping."""
    return rows.hint("rebalance", folder).sortWithinPartitions(folder, sorting)


def append_catalogue(rows: DataFrame, path: str) -> None:
    """Append in folders per category, sorted by mood."""
    by_folder(rows, "category", "emotion").write.mode("append").partitionBy("category").parquet(path)


def seed_if_empty(existing: DataFrame, seed: DataFrame, path: str) -> bool:
    """Append the seed rows unless there are rows already."""
    if not existing.isEmpty():
        return False
    append_catalogue(seed, path)
    return True


def overwrite_category(rows: DataFrame, category: str, path: str) -> None:
    """Replace one category's folder and leave the others alone. No rows means an empty category."""
    chosen = rows.where(F.col("category") == category).drop("category")
    chosen.write.mode("overwrite").parquet(f"{path}/category={category}")


def append_diaries(rows: DataFrame, path: str) -> None:
    """Append diaries in folders per month of their date, sorted by member."""
    placed = by_folder(rows.withColumn("month", dates.month_start("date")), "month", "member_id")
    placed.write.mode("append").partitionBy("month").parquet(path)
