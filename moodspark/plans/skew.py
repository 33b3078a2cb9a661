"""Joins and first-per-key picks that hold up when one key has a third of all rows, and when one side is huge."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from moodspark.plans.session import cut_lineage

# A key is hot when it holds more than this share of the rows, so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 0.001
# Below this many rows one task copes with the key anyway.
HOT_FLOOR = 100_000
# Rows of a hot key that one reducer gets at most, whatever the size of the input.
PART_ROWS = 2_000_000
# Keys a sketch tells apart: its error stays well below HOT_SHARE. Sketches of the tasks are merged in groups.
SKETCH_ITEMS = 8_000
SKETCHES = 500

# Keys of up to this many bytes are broadcast.
BROADCAST_BYTES = 32 * 1024 * 1024


def only_wanted(
    table: DataFrame, rows: DataFrame, keys: list[str], limit: int = BROADCAST_BYTES
) -> DataFrame:
    """The table's rows whose key occurs in `rows`, if the keys of `rows` are measured to be few; else all.

    A left join or an anti join cannot broadcast its left side, however small. This goes before it and
    leaves of a large table what a small left side can meet, without a shuffle of the table.
    """
    text = F.concat_ws("", *[F.col(k).cast("string") for k in keys])
    size = rows.agg(F.sum(F.octet_length(text) + 32 * len(keys)).alias("bytes")).first()["bytes"] or 0
    if size > limit:
        return table
    return table.join(F.broadcast(rows.select(*keys).distinct()), keys, "left_semi")


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row of each key. Every task keeps one row per key before the shuffle."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


# Types that a join compares as one type, and this is it.
_COMPARED_AS = {
    **dict.fromkeys(["tinyint", "smallint", "int", "bigint"], "bigint"),
    **dict.fromkeys(["float", "double"], "double"), **dict.fromkeys(["date", "timestamp"], "timestamp"),
}


def _compared(df: DataFrame, keys: list[str]) -> list[str]:
    kinds = dict(df.dtypes)
    return [_COMPARED_AS.get(kinds[k], kinds[k]) for k in keys]


def _key_hash(df: DataFrame, keys: list[str]) -> Column:
    """The same for keys that a join takes as equal, though one side has them as INT and the other as BIGINT."""
    return F.xxhash64(*[F.col(k).cast(kind) for k, kind in zip(keys, _compared(df, keys))])


def hot_keys(
    rows: DataFrame, keys: list[str], floor: int = HOT_FLOOR, share: float = HOT_SHARE
) -> DataFrame | None:
    """Hashes of the keys with more than `share` of the rows and the parts to split each into, or None.

    The heavy keys come from frequent-item sketches, merged group by group, so the keys themselves are not
    shuffled. There are at most 1 / share of them, which makes them safe to broadcast; each is split into parts
    of at most PART_ROWS rows. Rows without a key count as a key. A sketch may differ from run to run,
    so the result is settled here: both sides of a join must see the same parts.
    """
    sketches = (
        rows.select(_key_hash(rows, keys).alias("_key"), F.pmod(F.spark_partition_id(), F.lit(SKETCHES)).alias("_group"))
        .groupBy("_group")
        .agg(F.expr(f"approx_top_k_accumulate(_key, {SKETCH_ITEMS})").alias("_sketch"), F.count("*").alias("_rows"))
    )
    # One group of its own, as combining no sketches at all is an error.
    merged = sketches.groupBy(F.lit("all")).agg(
        F.expr("approx_top_k_combine(_sketch)").alias("_sketch"), F.sum("_rows").alias("_rows")
    )
    top = merged.select("_rows", F.expr(f"inline(approx_top_k_estimate(_sketch, {min(SKETCH_ITEMS, round(1 / share))})) AS (_key, _n)"))
    part = F.greatest(F.lit(floor), F.least(F.col("_rows") * F.lit(share), F.lit(PART_ROWS)))
    parts = F.ceil(F.col("_n") / part).cast("int").alias("_parts")
    found = cut_lineage(top.where(F.col("_n") > part).select("_key", parts))
    return None if found.isEmpty() else found


def salted_join(
    rows: DataFrame, table: DataFrame, keys: list[str], how: str, salt_by: list[str], hot: DataFrame | None
) -> DataFrame:
    """Join that splits the hot keys of the left side, so that no reducer gets one whole.

    `table` repeats only the rows of hot keys, once per part. `salt_by` names columns that tell the rows of
    one key apart; the part depends on nothing else, so a retried task sends every row where it went before.
    Without hot keys it is the plain join, and so it is where the sides' keys have types, such as a number and a
    text, that Spark makes equal in ways of its own.
    """
    if hot is None or _compared(rows, keys) != _compared(table, keys):
        return rows.join(table, keys, how)
    marks = F.broadcast(hot)
    parts = F.coalesce("_parts", F.lit(1))
    left = rows.withColumn("_key", _key_hash(rows, keys)).join(marks, "_key", "left").withColumn(
        "_part", F.pmod(F.xxhash64(*salt_by), parts.cast("bigint")).cast("int")
    )
    right = table.withColumn("_key", _key_hash(table, keys)).join(marks, "_key", "left").withColumn(
        "_part", F.explode(F.sequence(F.lit(0), parts - 1))
    )
    return left.drop("_key", "_parts").join(right.drop("_key", "_parts"), [*keys, "_part"], how).drop("_part")
