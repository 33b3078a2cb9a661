"""Key types in salted joins, unnamed sources, long and quoted addresses, entities, repeated streams."""

import pytest
from pyspark.sql import functions as F

from moodspark.functions.text import page_text
from moodspark.operators import dedup, validation
from moodspark.operators.sentiment import parse_model_answer
from moodspark.plans.skew import hot_keys, salted_join
from moodspark.sources import pages


@pytest.mark.parametrize("left, right", [
    ("int", "bigint"), ("bigint", "smallint"), ("date", "timestamp"), ("float", "double"), ("int", "string"), ("int", "decimal(12,2)"),
])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_with_unequal_types(spark, left, right, how):
    def keyed(df, kind, n):
        k = F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % n)
        day = F.date_add(F.lit("2024-01-01").cast("date"), k.cast("int"))
        return df.withColumn("k", (day if kind in ("date", "timestamp") else k).cast(kind))

    rows = keyed(spark.range(900), left, 11)
    table = keyed(spark.range(40), right, 9).groupBy("k").agg(F.count("*").alias("n"))
    hot = hot_keys(rows, ["k"], floor=20)
    assert hot is not None
    plain = rows.join(table, ["k"], how)
    salted = salted_join(rows, table, ["k"], how, ["id"], hot).select(*plain.columns)
    assert sorted(map(repr, salted.collect())) == sorted(map(repr, plain.collect()))


def test_share_sets_the_number_of_hot_keys(spark):
    rows = spark.range(6000).withColumn("k", F.col("id") % 3000)
    assert hot_keys(rows, ["k"], floor=1, share=1 / 4000).count() == 3000


def test_unnamed_sources_are_kept_last(spark):
    shape = "source string, emotion string, ord struct<n:int>, category string, title string, description string, image_url string, content_url string, stored_key string, probe_key string"
    rows = [(s, "e", (k,), "c", f"t{k}", "", "", u, f"t{k}", f"t{k}") for k, (s, u) in enumerate([("MUSIC", "a"), ("NEW", "b"), (None, "c"), ("NEW", "a")])]
    candidates = spark.createDataFrame(rows, shape)
    known = spark.createDataFrame([], "emotion string, title string, content_url string")
    assert sorted(r["content_url"] for r in dedup.harvest(candidates, known).collect()) == ["a", "b", "c"]


@pytest.mark.parametrize("address, valid", [
    ("a@b.c", True), ("a@" + "b." * 100_000 + "c", False), ("a." * 100_000 + "b@c", False), ("a@" + ".".join(["b" * 60] * 5), False),
    ('"a b"@example.com', True), ('"a@b"@example.com', True), ("u@[IPv6:::1]", True), ("u@[127.0.0.1]", True), ("a b@c.d", False),
    ("a@b@c", False), ("@b", False), ("a@", False), ("plain", False), ("a@" + ".".join(["b" * 60] * 4), True),
])
def test_addresses(spark, address, valid):
    rule = validation.email_format("email", "bad")
    rows = spark.createDataFrame([(address,)], "email string")
    assert validation.with_errors(rows, [rule]).first()["errors"] == (None if valid else "bad")


def test_texts_of_blanks_are_refused(spark):
    rows = spark.createDataFrame([("\u3000",), ("\x1c ",), (None,), ("a",)], "text string")
    errors = [r["errors"] is not None for r in validation.with_errors(rows, validation.text_rules()).collect()]
    assert errors == [True, True, True, False]


def test_entities_of_many_digits(spark):
    rows = spark.createDataFrame([("&#00000065;&#x0000042;&#99999999999;&#0;",)], "t string")
    assert rows.select(page_text("t")).first()[0] == "AB\ufffd\ufffd"


def test_the_last_of_two_equal_keys_counts(spark):
    answer = '{"emotion": "x", "emotion": "\uae30\uc068", "score": 0.1, "score": 0.7}'
    found = parse_model_answer(spark.createDataFrame([(answer,)], "answer string")).first()["sentiment"]
    assert (found["emotion"], found["score"]) == ("\uae30\uc068", 0.7)


def test_list_items_count_in_their_scope_and_every_link_is_an_item(spark):
    html = """<div><ul><li><a class="link_txt" href="/menu">menu</a></li></ul></div>
    <div class="coll_cont x"><div><ul><li><a class="link_txt" href="/1">one</a><a class="link_txt" href="/2">two</a></li></ul></div>
    <ul><li><div class="info_tit"><a href="/3">three</a> <a class="link_txt" href="/4">four</a></div><a href="/no">no</a></li></ul></div>
    <div><li><a class="link_txt" href="/after">after</a></li></div>
    <div class="info_tit"><a href="/5">five</a><a href="/6">six</a></div>"""
    rows = spark.createDataFrame(
        [(1, "https://h.example/", html), (2, "https://h.example/", "<li><a class=link_txt href=/x>x</a></li>"), (3, "https://h.example/", ""),
         (4, "https://h.example/", None)],
        "page_id bigint, url string, html string",
    )
    found = pages.extract_candidates(rows, pages.MOVIE_PAGE).orderBy("page_id", "pos").collect()
    assert [(r["page_id"], r["title"], r["content_url"]) for r in found] == [
        (1, t, f"https://h.example/{k}") for k, t in enumerate(["one", "two", "three", "four", "five", "six"], 1)
    ]
    found = pages.extract_candidates(rows, pages.ACTIVITY_PAGE).orderBy("page_id", "pos").collect()
    assert [(r["page_id"], r["title"]) for r in found] == [(1, "one"), (1, "four")]
