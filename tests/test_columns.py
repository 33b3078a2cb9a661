"""Column helpers on hand-made values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from moodspark.functions import dates, numbers, text


def one(spark, column, **values):
    schema = ", ".join(f"{k} {t}" for k, (_, t) in values.items()) or "x int"
    row = tuple(v for v, _ in values.values()) or (1,)
    return spark.createDataFrame([row], schema).select(column.alias("r")).first()["r"]


def string(spark, make, value):
    return one(spark, make(F.col("c")), c=(value, "string"))


@pytest.mark.parametrize("value, places, expected", [
    (1.005, 2, 1.0), (-0.125, 2, -0.12), (0.125, 2, 0.13), (2.5, 0, 3.0), (-2.5, 0, -2.0),
    (0.49999999999999994, 0, 0.0), (None, 2, None),
])
def test_rounding_goes_by_the_binary_value(spark, value, places, expected):
    assert one(spark, numbers.half_up("c", places), c=(value, "double")) == expected


@pytest.mark.parametrize("value, expected", [(1.5, 1.0), (-0.1, 0.0), (0.25, 0.25), (float("nan"), 1.0)])
def test_clamp(spark, value, expected):
    assert one(spark, numbers.clamp01("c"), c=(value, "double")) == expected


def test_seeded_score_is_repeatable_and_in_range(spark):
    rows = spark.range(500).select(numbers.seeded_score(7, "id").alias("s")).collect()
    again = spark.range(500).repartition(7).select("id", numbers.seeded_score(7, "id").alias("s")).orderBy("id").collect()
    scores = [r["s"] for r in rows]
    assert scores == [r["s"] for r in again]
    assert 0.7 <= min(scores) < 0.73 and 0.87 < max(scores) <= 0.9


@pytest.mark.parametrize("value, expected", [
    (" \t\r\n a b \x01", "a b"), (" a　", " a　"), ("", ""), ("\x00x", "x"), (None, None),
])
def test_trim_takes_control_characters_only(spark, value, expected):
    assert string(spark, text.java_trim, value) == expected


@pytest.mark.parametrize("limit", [80, 100])
def test_snippet_cuts_only_above_the_limit(spark, limit):
    assert string(spark, lambda c: text.snippet(c, limit), "x" * limit) == "x" * limit
    assert string(spark, lambda c: text.snippet(c, limit), "x" * (limit + 1)) == "x" * limit + "..."


def test_length_counts_code_points(spark):
    assert string(spark, lambda c: F.length(text.cut(c, 2)), "😊ab") == 2


def test_encoding(spark):
    assert string(spark, text.form_encode, "a b~*가") == "a+b%7E*%EA%B0%80"
    assert string(spark, text.query_encode, "a b+c") == "a%20b%2Bc"


def test_search_address_stands_in_for_a_missing_one(spark):
    made = one(spark, text.search_url("u", "t"), u=("", "string"), t=("a b", "string"))
    assert made == "https://search.daum.net/search?w=tot&q=a+b+영화"
    assert one(spark, text.search_url("u", "t"), u=("http://x", "string"), t=("a", "string")) == "http://x"


@pytest.mark.parametrize("href, expected", [
    ("", "http://h.example:8080/a/b/c?q=1#z"),
    (None, None),
    ("https://o.example/x", "https://o.example/x"),
    ("mailto:a@b", "mailto:a@b"),
    ("//cdn.example/x", "http://cdn.example/x"),
    ("/x?y=1", "http://h.example:8080/x?y=1"),
    ("x#f", "http://h.example:8080/a/b/x#f"),
    ("?q=2", "http://h.example:8080/a/b/c?q=2"),
    ("#top", "http://h.example:8080/a/b/c?q=1#top"),
    ("../x", "http://h.example:8080/a/x"),
    ("./x/./y", "http://h.example:8080/a/b/x/y"),
    ("../../../x", "http://h.example:8080/x"),
    ("..", "http://h.example:8080/a/"),
    ("x?u=/../z", "http://h.example:8080/a/b/x?u=/../z"),
])
def test_links_resolve_against_the_page(spark, href, expected):
    base = ("http://h.example:8080/a/b/c?q=1#z", "string")
    assert one(spark, text.absolute_url("b", "h"), b=base, h=(href, "string")) == expected


def test_link_of_a_page_without_path(spark):
    made = one(spark, text.absolute_url("b", "h"), b=("https://h.example", "string"), h=("x", "string"))
    assert made == "https://h.example/x"


@pytest.mark.parametrize("markup, expected", [
    ("  a <b>b</b>\n\t c ", "a b c"),
    ("x&nbsp;&nbsp;y", "x y"),
    ("&lt;b&gt; &amp;lt; &quot;q&quot;", '<b> &lt; "q"'),
    ("&#54620;&#x20;&#x1F60A;&#39;", "한 😊'"),
    ("&#38;lt;", "&lt;"),
    ("a​b­", "ab"),
    ("&#55296;", "�"),
    ("AT&T", "AT&T"),
])
def test_page_text(spark, markup, expected):
    assert string(spark, text.page_text, markup) == expected


def test_month_range_crosses_the_year():
    assert dates.month_range(2024, 12) == (dt.date(2024, 12, 1), dt.date(2025, 1, 1))


def test_seoul_day_is_nine_hours_ahead(spark):
    values = [(dt.datetime(2024, 2, 28, 14, 59), dt.date(2024, 2, 28)), (dt.datetime(2024, 2, 28, 15, 0), dt.date(2024, 2, 29))]
    for utc, day in values:
        assert one(spark, dates.kst_today("t"), t=(utc, "timestamp_ntz")) == day


def test_labels(spark):
    labels = dates.date_labels("d")
    day = (dt.date(2026, 4, 4), "date")
    assert one(spark, labels["calendar_label"], d=day) == "2026 년 4 월"
    assert one(spark, labels["month_label"], d=day) == "2026년 4월"
    assert one(spark, labels["long_label"], d=day) == "2026년 4월 4일 (토)"
    bounds = dates.month_bounds("d")
    assert one(spark, bounds["first_weekday"], d=day) == 3
    assert one(spark, bounds["days_in_month"], d=day) == 30
