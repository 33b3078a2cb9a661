"""What the plans look like, and that hot keys are spread."""

import datetime as dt
import random
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from moodspark import schemas
from moodspark.operators import catalogue, diaries, stats
from moodspark.plans.session import cut_lineage, shared_folder
from moodspark.plans.queries import QUERIES
from moodspark.plans.skew import hot_keys, keep_first, only_wanted, salted_join
from moodspark.sources import sinks
from moodspark.sources.fixtures import view
from tests.plans import executed


@contextmanager
def settings(spark, **values):
    names = {k.replace("__", "."): str(v) for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def skewed(spark, n=3000, share=0.4):
    draw = random.Random(1)
    rows = [(i, None if i % 10 == 0 else 1 if draw.random() < share else draw.randrange(2, 400)) for i in range(n)]
    return spark.createDataFrame(rows, "id bigint, k bigint").repartition(4, "id")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("floor", [0, 50, 1_000_000])
def test_salted_join_gives_what_the_join_gives(spark, how, floor):
    rows = skewed(spark)
    table = spark.createDataFrame([(k, f"v{k}") for k in [*range(1, 300, 2), 1, 3]] + [(None, "n")], "k bigint, v string")
    plain = rows.join(table, "k", how)
    hot = hot_keys(rows, ["k"], floor)
    assert (hot is None) == (floor > 1000)
    salted = salted_join(rows, table, ["k"], how, ["id"], hot).select(*plain.columns)
    assert sorted(map(tuple, salted.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)


@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_few_keys_reach_a_large_table_as_a_filter(spark, limit):
    table = spark.range(1000).selectExpr("id", "id % 7 AS k", "'x' AS v")
    wanted = spark.createDataFrame([(3, 3), (3, 3), (5, 6), (None, 1)], "id bigint, k bigint")
    kept = only_wanted(table, wanted, ["id", "k"], limit)
    assert kept.count() == (1 if limit else 1000)
    assert not limit or "BroadcastHashJoin" in executed(kept)


def test_hot_keys_are_few_and_known(spark):
    rows = skewed(spark)
    found = {r["_key"]: r["_parts"] for r in hot_keys(rows, ["k"], floor=100).collect()}
    one, none = spark.sql("SELECT xxhash64(1L), xxhash64(CAST(NULL AS BIGINT))").first()
    assert set(found) == {one, none}
    assert 8 <= found[one] <= 14 and 2 <= found[none] <= 4
    assert 0 < hot_keys(rows, ["k"], floor=0).count() <= 1000
    assert hot_keys(rows.where("k < 0"), ["k"]) is None
    assert hot_keys(rows, ["k"]) is None


def test_a_hot_key_is_spread_over_the_reducers(spark):
    off = {"spark__sql__adaptive__coalescePartitions__enabled": "false", "spark__sql__autoBroadcastJoinThreshold": "-1",
           "spark__sql__shuffle__partitions": "8"}
    with settings(spark, **off):
        rows, table = skewed(spark), spark.range(1, 400).withColumnRenamed("id", "k")

        def largest(df):
            sizes = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
            return max(r["n"] for r in sizes)

        spread = salted_join(rows, table, ["k"], "left", ["id"], hot_keys(rows, ["k"], floor=100))
        assert largest(rows.join(table, "k", "left")) > 1000
        assert largest(spread) < 700


def test_first_per_key_is_cut_down_before_the_shuffle(spark):
    plan = executed(keep_first(skewed(spark), ["k"], [F.col("id")]))
    before_shuffle = plan[plan.index("Exchange"):]
    assert "WindowGroupLimit" in before_shuffle and "Partial" in before_shuffle


def test_pick_is_cut_down_before_the_shuffle(spark, small):
    plan = executed(catalogue.pick_per_category(view(spark, small, "catalogue"), 1))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_month_record_is_one_shuffle_of_partial_sums(spark, small):
    plan = executed(stats.monthly_stats_wide(view(spark, small, "diaries")))
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("HashAggregate") == 2 and "SortAggregate" not in plan
    assert "props" not in plan


def test_month_filter_reaches_the_files(spark, tmp_path):
    path = str(tmp_path / "diaries")
    rows = [
        (i, 1, "t", None, None, None, None, dt.date(2024, m, 5), "ACTIVE", None, None) for i, m in enumerate([4, 5, 5, 6])
    ]
    sinks.append_diaries(spark.createDataFrame(rows, schemas.DIARIES), path)
    month = diaries.diaries_in_month(spark.read.parquet(path), 2024, 5)
    with settings(spark, spark__sql__maxMetadataStringLength=5000):
        plan = executed(month.select("id"))
    assert "GreaterThanOrEqual(date,2024-05-01)" in plan and "LessThan(date,2024-06-01)" in plan
    assert "PartitionFilters: [isnotnull(month" in plan
    assert "content" not in plan
    assert month.count() == 2


@pytest.mark.parametrize("compute", [stats.monthly_stats, stats.monthly_stats_wide, stats.emotion_counts])
def test_one_member_is_a_filter_on_the_scan(spark, tmp_path, compute):
    path = str(tmp_path / "diaries")
    rows = [(i, i % 3, "t", None, "x", 0.5, None, dt.date(2024, 5, 5), "ACTIVE", None, None) for i in range(9)]
    spark.createDataFrame(rows, schemas.DIARIES).write.parquet(path)
    one = compute(spark.read.parquet(path)).where("member_id = 2")
    with settings(spark, spark__sql__maxMetadataStringLength=5000):
        assert "EqualTo(member_id,2)" in executed(one)
    assert one.count() == 1


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith("stream_")])
def test_plans_stay_in_the_jvm_and_never_pair_everything(spark, small, name):
    plan = executed(entry_point.queries()[name](spark, small))
    for operator in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert operator not in plan


def test_lineage_is_cut_in_the_shared_folder(spark):
    rows = cut_lineage(spark.range(10).withColumn("x", F.rand()))
    assert rows.collect() == rows.collect()
    assert "FileScan parquet" in executed(rows)
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        assert shared_folder(spark) == folder
