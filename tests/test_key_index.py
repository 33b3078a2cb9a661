"""Bloom filters of stored keys, and a batch that reads only the buckets that may hold its keys."""

from pyspark.sql import functions as F

from moodspark.operators import candidates
from moodspark.sources import key_index
from moodspark.sources.fixtures import view
from moodspark.streaming import catalogue_arrivals
from tests.plans import executed


def keys(spark, first, last):
    return spark.range(first, last).select(F.concat(F.lit("k"), F.col("id")).alias("key"))


def test_filters_rule_out_no_held_key_and_most_others(spark):
    held = key_index.key_filters(keys(spark, 0, 5000), 4)
    assert key_index.maybe_held(keys(spark, 0, 5000), held, 4).count() == 5000
    assert key_index.maybe_held(keys(spark, 5000, 25000), held, 4).count() < 40
    some = spark.createDataFrame([("k1",), ("k1",), (None,), ("",)], "key string")
    assert [tuple(r) for r in key_index.maybe_held(some, held, 4).select("key").collect()] == [("k1",)]
    assert key_index.maybe_held(some, held.limit(0), 4).count() == 0


def test_merged_filters_are_those_of_all_keys(spark):
    parts = [key_index.key_filters(keys(spark, a, a + 300).unionByName(keys(spark, 0, 50)), 8) for a in (0, 300, 600)]
    every = key_index.key_filters(keys(spark, 0, 900), 8)
    for order in (parts, parts[::-1], [key_index.merged(*parts[:2]), parts[2]]):
        assert sorted(map(tuple, key_index.merged(*order).collect())) == sorted(map(tuple, every.collect()))


def clean(spark, rows):
    raw = spark.createDataFrame(
        [(1, k, 0, "기쁨", title, None, None, url) for k, (title, url) in enumerate(rows)],
        "page_id long, pos int, phrase_index int, emotion string, title string, description string, image_url string, content_url string",
    )
    return candidates.clean_candidates(raw, "ACTIVITY")


def test_a_batch_reads_the_buckets_of_its_keys_only(spark, small, tmp_path):
    out = str(tmp_path / "out")
    seed = view(spark, small, "catalogue")
    catalogue_arrivals.start_catalogue(seed, out)
    one = seed.where("content_url IS NOT NULL AND emotion = '기쁨'").first()
    asked = clean(spark, [("a title of its own", one["content_url"]), (one["title"].upper(), "https://new.example/1"), ("quite new", "https://new.example/2")])
    found = catalogue_arrivals.known_rows(asked, 0, out)
    same = seed.where((F.col("content_url") == one["content_url"]) | ((F.col("emotion") == "기쁨") & (F.lower("title") == one["title"].lower())))
    wanted = {tuple(r) for r in same.select("emotion", "title", "content_url").collect()}
    assert {tuple(r) for r in found.collect()} == wanted
    stored = len({f.split("bucket=")[1].split("/")[0] for f in spark.read.parquet(f"{out}_keys").inputFiles()})
    plan = executed(found)
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:200]
    read = {r["bucket"] for r in key_index.maybe_held(
        catalogue_arrivals._keys(asked, F.col("probe_key")), spark.read.parquet(f"{out}_filters").select("bucket", "word", "bits")).collect()}
    assert len(read) <= 4 < stored
    # Nothing of the batch itself or of later ones is known.
    assert catalogue_arrivals.known_rows(asked, -1, out).count() == 0


def test_an_empty_catalogue_and_an_empty_batch(spark, small, tmp_path):
    out = str(tmp_path / "out")
    catalogue_arrivals.start_catalogue(view(spark, small, "catalogue").limit(0), out)
    assert catalogue_arrivals.known_rows(clean(spark, [("some long title", "https://a.example/")]), 0, out).count() == 0
    assert catalogue_arrivals.known_rows(clean(spark, [("x", "y")]).limit(0), 0, out).count() == 0
