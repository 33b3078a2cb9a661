"""Statistics, calendar and lookups on hand-made diaries."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from moodspark import schemas, vocab
from moodspark.functions import numbers
from moodspark.operators import calendar, catalogue, diaries, stats
from tests.plans import executed


def diary(id, member=1, emotion=None, score=None, date="2024-05-03", created=None, status="ACTIVE"):
    day = dt.date.fromisoformat(date)
    at = dt.datetime.fromisoformat(created) if created else dt.datetime.combine(day, dt.time(10))
    return (id, member, f"text {id}", None, emotion, score, None, day, status, at, at)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.DIARIES)


def test_counts_mean_and_total_treat_missing_values_differently(spark):
    rows = frame(
        spark, diary(1, emotion=vocab.JOY, score=0.5), diary(2, score=0.25), diary(3, emotion=vocab.JOY),
        diary(4, emotion=vocab.ANGER, score=1.0, status="DELETED"),
    )
    record = stats.monthly_stats(rows).first()
    assert record["total_count"] == 3
    assert record["emotion_counts"] == {vocab.JOY: 2}
    assert record["average_score"] == 0.38


def test_mean_on_a_tie_goes_up(spark):
    rows = frame(spark, diary(1, score=-0.25), diary(2, score=0.0))
    assert stats.monthly_stats(rows).first()["average_score"] == -0.12
    assert stats.monthly_stats_wide(rows).first()["average_score"] == -0.12


def test_month_without_diaries_is_answered(spark):
    asked = spark.createDataFrame([(1, 2024, 5), (1, 2024, 6)], "member_id bigint, year int, month int")
    rows = frame(spark, diary(1, emotion=vocab.JOY))
    answers = {r["month"]: r for r in stats.requested_stats(asked, rows).collect()}
    assert answers[5]["total_count"] == 1
    assert (answers[6]["total_count"], answers[6]["average_score"], answers[6]["emotion_counts"]) == (0, None, {})


def test_labels_outside_the_vocabulary_are_counted(spark):
    rows = frame(spark, diary(1, emotion="새벽"), diary(2, emotion="새벽"))
    assert stats.monthly_stats(rows).first()["emotion_counts"] == {"새벽": 2}


def test_parts_add_up(spark):
    first = frame(spark, diary(1, emotion=vocab.JOY, score=0.5), diary(2))
    second = frame(spark, diary(3, emotion=vocab.JOY), diary(4, emotion=vocab.ANGER, score=0.25))
    together = stats.monthly_stats(first.unionByName(second)).first()
    parts = stats.mood_parts(first).unionByName(stats.mood_parts(second))
    assert stats.stats_from_parts(parts).first() == together


def total(rows):
    limbs = numbers.sum_limbs(numbers.exact_limbs("sentiment_score"))
    kept = rows.agg(*[c.alias(k) for k, c in limbs.items()])
    return kept.select(numbers.from_limbs({k: F.col(k) for k in limbs}).alias("s")).first()["s"]


@pytest.mark.parametrize("scores", [
    [2.0 ** 52 + 0.5, 2.0 ** -60, -(2.0 ** 52), 1e-20, -0.1] * 30,
    [0.1] * 1000 + [-0.1] * 999,
    [2.0 ** 40, -1e-9, 3.3, -(2.0 ** 40)] * 50,
    [-1e-20, 1e-20, -0.3, 0.3],
])
def test_adverse_scores_add_up_exactly_in_any_order_and_grouping(spark, scores):
    expected = math.fsum(scores)
    for seed in range(3):
        random.Random(seed).shuffle(scores)
        rows = frame(spark, *[diary(i, score=s) for i, s in enumerate(scores)]).repartition(seed + 1)
        assert total(rows) == pytest.approx(expected, rel=2 ** -52, abs=2.0 ** -90)
        half = len(scores) // 2
        parts = stats.mood_parts(rows.where(f"id < {half}")).unionByName(stats.mood_parts(rows.where(f"id >= {half}")))
        sums = stats.added_parts(parts).select("score_whole", "score_mid", "score_low").first()
        assert sums == stats.mood_parts(rows).select("score_whole", "score_mid", "score_low").first()


def test_scores_beyond_the_limbs(spark):
    assert total(frame(spark, diary(1, score=1e300), diary(2, score=0.5))) == 1e300
    assert math.isnan(total(frame(spark, diary(1, score=math.nan), diary(2, score=0.5))))
    assert total(frame(spark, diary(1, score=math.inf))) == math.inf
    assert total(frame(spark, diary(1, score=None))) is None


def test_mean_does_not_depend_on_the_order_of_the_rows(spark):
    scores = [0.7, 0.71, 0.9, 0.83, 0.1, 0.2, 0.3] * 40 + [1e-9, 0.999999999]
    means = set()
    for seed in range(5):
        random.Random(seed).shuffle(scores)
        rows = frame(spark, *[diary(i, score=s) for i, s in enumerate(scores)]).repartition(seed + 1)
        assert total(rows) == math.fsum(scores)
        means.add(stats.monthly_stats(rows).first()["average_score"])
    assert len(means) == 1


def test_dominant_mood_breaks_ties_by_rank(spark):
    rows = frame(spark, *[diary(i, emotion=e) for i, e in enumerate([vocab.JOY, vocab.SADNESS] * 2 + ["x"] * 2)])
    counts = stats.emotion_counts(rows)
    assert stats.dominant_emotion(counts).first()["emotion"] == vocab.SADNESS
    assert stats.dominant_emotion(counts, [vocab.JOY]).first()["emotion"] == vocab.JOY


def test_small_slices_have_no_label(spark):
    rows = frame(spark, diary(0, emotion=vocab.JOY), *[diary(i, emotion=vocab.ANGER) for i in range(1, 25)])
    shares = {r["emotion"]: r for r in stats.emotion_share(stats.emotion_counts(rows)).collect()}
    assert (shares[vocab.JOY]["percent"], shares[vocab.JOY]["label"]) == (4, None)
    assert shares[vocab.ANGER]["label"] == "96%"


@pytest.mark.parametrize("score, percent, band", [(1.0, 100, "HIGH"), (0.3, 65, "HIGH"), (0.0, 50, "MIDDLE"), (-0.11, 45, "LOW")])
def test_gauge(spark, score, percent, band):
    rows = spark.createDataFrame([(1, dt.date(2024, 5, 1), score)], "member_id bigint, month_start date, average_score double")
    found = stats.score_gauge(rows).first()
    assert (found["percent"], found["band"]) == (percent, band)


def test_grid_is_whole_weeks_keyed_by_creation(spark):
    rows = frame(
        spark,
        diary(1, emotion=vocab.JOY, date="2024-05-10"),
        diary(2, emotion=vocab.ANGER, date="2024-05-10"),
        diary(3, emotion=vocab.SADNESS, date="2024-05-20", created="2024-05-21T08:00:00"),
        diary(4, date="2024-05-11"),
        diary(5, emotion=vocab.JOY, date="2024-05-12", created="2024-04-30T08:00:00"),
    )
    cells = calendar.month_grid(rows).orderBy("week", "dow").collect()
    assert len(cells) == 35
    assert [c["day"] for c in cells[:4]] == [None, None, None, dt.date(2024, 5, 1)]
    found = {c["day"]: c["diary_id"] for c in cells if c["diary_id"] is not None}
    assert found == {dt.date(2024, 5, 10): 2, dt.date(2024, 5, 21): 3}
    by_date = calendar.month_grid(rows, key="date").collect()
    assert "Join" not in executed(calendar.month_grid(rows))
    assert {c["day"].day: c["diary_id"] for c in by_date if c["diary_id"]} == {10: 2, 20: 3, 12: 5}


def test_grid_of_a_member_without_diaries(spark):
    asked = spark.createDataFrame([(9, dt.date(2015, 2, 1))], "member_id bigint, month_start date")
    cells = calendar.month_grid(frame(spark, diary(1, emotion=vocab.JOY)), asked).collect()
    assert len(cells) == 28 and all(c["diary_id"] is None for c in cells)


def test_calendar_row_shows_an_edited_diary_under_its_creation(spark):
    rows = frame(spark, diary(1, emotion=vocab.JOY, date="2024-05-02", created="2024-04-30T23:00:00"))
    assert diaries.calendar_rows(rows, 2024, 5).first()["created_at"] == "2024-04-30"
    assert diaries.calendar_rows(rows, 2024, 4).isEmpty()


def test_detail_needs_owner_and_active(spark):
    rows = frame(spark, diary(1, 1), diary(2, 2), diary(3, 1, status="DELETED"))
    asked = spark.createDataFrame(
        [(1, 1, 1), (2, 1, 2), (3, 1, 3), (4, 1, 99), (5, 1, 1)], "request_id bigint, member_id bigint, id bigint"
    )
    found = {r["request_id"]: r["found"] for r in diaries.diary_detail(rows, asked).collect()}
    assert found == {1: True, 2: False, 3: False, 4: False, 5: True}


def test_one_member_and_order(spark):
    rows = frame(spark, diary(1, 1, date="2024-05-04"), diary(2, 1), diary(3, 2), diary(4, 1, status="DELETED"))
    assert [r["id"] for r in diaries.active_diaries(rows, 1).collect()] == [2, 1]
    assert [r["id"] for r in diaries.newest_first(rows).collect()] == [1, 2, 3]


def test_emoji_defaults(spark):
    rows = frame(spark, diary(1), diary(2, emotion="새벽"), diary(3, emotion=vocab.ANXIETY))
    shown = {r["id"]: (r["shown_emotion"], r["emotion_emoji"]) for r in diaries.with_emoji(rows).collect()}
    assert shown == {1: (vocab.NEUTRAL, "😐"), 2: ("새벽", "🙂"), 3: (vocab.ANXIETY, "😰")}


def items(spark, *rows):
    return spark.createDataFrame(
        [(i, e, c, f"t{i}", "d", None, None) for i, e, c in rows], schemas.RECOMMENDATIONS
    )


def test_pick_is_one_per_category_and_varies_with_the_seed(spark):
    rows = items(spark, *[(i, vocab.JOY, "BOOK" if i % 2 else "MUSIC") for i in range(40)])
    picks = [
        {r["category"]: r["id"] for r in catalogue.pick_per_category(rows, seed).collect()} for seed in range(6)
    ]
    assert all(set(p) == {"BOOK", "MUSIC"} for p in picks)
    assert len({p["BOOK"] for p in picks}) > 1


def test_recommendations_are_the_same_by_broadcast_and_by_shuffle(spark):
    rows = frame(spark, *[diary(i, emotion=[vocab.JOY, vocab.NEUTRAL, None][i % 3]) for i in range(60)])
    offers = items(spark, (1, vocab.JOY, "BOOK"), (2, vocab.JOY, "BOOK"), (3, vocab.JOY, "MUSIC"), (4, vocab.LETHARGY, "BOOK"))
    small = catalogue.recommend_for_diaries(rows, offers, 1)
    large = catalogue.recommend_for_diaries(rows, offers, 1, broadcast_picks=1)
    assert sorted(small.select(*sorted(small.columns)).collect()) == sorted(large.select(*sorted(small.columns)).collect())
    assert small.count() == 40


def test_coverage_reports_both_gaps(spark):
    rows = frame(spark, diary(1, emotion=vocab.NEUTRAL), diary(2, emotion=vocab.JOY))
    offers = items(spark, (1, vocab.JOY, "BOOK"), (2, vocab.LETHARGY, "BOOK"))
    found = {r["emotion"]: r["coverage"] for r in catalogue.emotion_coverage(rows, offers).collect()}
    assert found == {vocab.NEUTRAL: "NO RECOMMENDATION", vocab.JOY: "BOTH", vocab.LETHARGY: "NO DIARY"}


def test_public_views_hide_what_they_should(spark):
    offers = items(spark, (1, vocab.JOY, "BOOK")).withColumn("image_url", F.lit(""))
    shown = diaries.public_view("recommendation", offers)
    assert "emotion" not in shown.columns and shown.first()["image_url"] is None
    people = spark.createDataFrame([], schemas.MEMBERS)
    assert set(diaries.public_view("member", people).columns) == {"id", "email", "nickname", "provider", "status", "created_at"}
