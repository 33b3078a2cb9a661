"""Reading answers, defaults, keyword rules and enrichment."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from moodspark import vocab
from moodspark.operators import sentiment

FAILED = (vocab.NEUTRAL, 0.0, "")
NO_ANSWER = (vocab.NEUTRAL, 0.0, None)
J = vocab.JOY


def answer(**fields):
    return json.dumps(fields, ensure_ascii=False)


CASES = [
    (answer(emotion=J, sentimentScore=0.8, aiComment=" 좋아요 "), (J, 0.8, "좋아요")),
    ("```json\n" + answer(emotion=J, score=0.5) + "\n```", (J, 0.5, "")),
    ("앞 " + answer(emotion=f" {J} ", sentimentScore=1) + " 뒤", (J, 1.0, "")),
    (answer(emotion=J, sentimentScore=None, score=0.9), FAILED),
    (answer(emotion=J, sentimentScore="0.8"), (J, 0.8, "")),
    (answer(emotion=J, sentimentScore=" 1e-1 "), (J, 0.1, "")),
    (answer(emotion=J, sentimentScore="1_0"), (J, 1.0, "")),
    (answer(emotion=J, sentimentScore="nan"), (J, 1.0, "")),
    (answer(emotion=J, sentimentScore="-inf"), (J, 0.0, "")),
    (answer(emotion=J, sentimentScore="0.5d"), FAILED),
    (answer(emotion=J, sentimentScore="높음"), FAILED),
    (answer(emotion=J, sentimentScore=True), (J, 1.0, "")),
    (answer(emotion=J, sentimentScore=[0.5]), FAILED),
    (answer(emotion=J, sentimentScore={"x": 1}), FAILED),
    (answer(emotion=J), (J, 0.0, "")),
    (answer(sentimentScore=0.75), (vocab.NEUTRAL, 0.75, "")),
    (answer(emotion="설렘", sentimentScore=0.25), (vocab.NEUTRAL, 0.25, "")),
    (answer(emotion=None, sentimentScore=0.25), (vocab.NEUTRAL, 0.25, "")),
    (answer(emotion=J, sentimentScore=1.5, aiComment=None), (J, 1.0, None)),
    (answer(emotion=J, sentimentScore=-3), (J, 0.0, "")),
    ("[" + answer(emotion=J, sentimentScore=0.5) + "]", NO_ANSWER),
    ("0.5", NO_ANSWER),
    ('"text"', NO_ANSWER),
    ("null", NO_ANSWER),
    ("", FAILED),
    ("no json", FAILED),
    (answer(emotion=J, sentimentScore=0.5) + answer(emotion=J), FAILED),
    (answer(emotion=J, sentimentScore=0.5) + ",", (J, 0.5, "")),
    (answer(emotion=J, sentimentScore=0.5) + "]", (J, 0.5, "")),
    (answer(emotion=J, sentimentScore=0.5) + "}", FAILED),
    (answer(emotion=J, sentimentScore=0.5) + "],[" + answer(emotion=J, sentimentScore=0.5), FAILED),
    (answer(emotion=J, sentimentScore=0.5) + ',"k":1', (J, 0.5, "")),
    (answer(emotion=J, sentimentScore=0.5) + f',"{sentiment._END}"],[' + answer(emotion=J), FAILED),
    (answer(emotion=J, sentimentScore=0.5, aiComment=sentiment._END), (J, 0.5, sentiment._END)),
    ('{"emotion": "' + J + '", "sentimentScore": NaN}', (J, 1.0, "")),
    ('{"emotion": "' + J + '", "sentimentScore":-Infinity, "aiComment": "a"}', (J, 0.0, "a")),
    ('{"emotion": "' + J + '", "score": Infinity}', (J, 1.0, "")),
    ('{"emotion": NaN, "sentimentScore": 0.5, "aiComment": -Infinity}', (vocab.NEUTRAL, 0.5, "-inf")),
    (answer(emotion=J, sentimentScore=float("nan"), aiComment='NaN "NaN" \\" NaN, \\\\'), (J, 1.0, 'NaN "NaN" \\" NaN, \\\\')),
    ('NaN "it is {"emotion": "' + J + '", "sentimentScore": NaN} NaN', (J, 1.0, "")),
    ('{"emotion": "' + J + '", "sentimentScore": -NaN}', FAILED),
    ('{"emotion": "' + J + '", "sentimentScore": +Infinity}', FAILED),
    ('{"emotion": "' + J + '", "sentimentScore": NaNs}', FAILED),
    ('{"emotion": "' + J + '", "sentimentScore": nan}', FAILED),
    ("NaN", NO_ANSWER),
    ("{'emotion': 1}", FAILED),
    (None, NO_ANSWER),
]


@pytest.fixture(scope="module")
def read(spark):
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(CASES)], "i int, answer string")
    return {r["i"]: tuple(r["sentiment"]) for r in sentiment.parse_model_answer(rows).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_answer(read, i):
    assert read[i] == CASES[i][1], CASES[i][0]


@pytest.mark.parametrize("envelope, expected", [
    ({"choices": [{"message": {"content": " " + answer(emotion=J, sentimentScore=0.123456) + "\n"}}]}, (J, 0.1235, "")),
    ({"choices": []}, FAILED),
    ({"error": "x"}, FAILED),
    ({"choices": [{"message": {"content": None}}]}, NO_ANSWER),
    ({"choices": [{"message": {"content": 5}}]}, NO_ANSWER),
    ({"choices": [{"message": {"content": "글"}}, {"message": {"content": "둘"}}]}, FAILED),
    ("truncated {", FAILED),
])
def test_envelope(spark, envelope, expected):
    body = envelope if isinstance(envelope, str) else json.dumps(envelope)
    rows = spark.createDataFrame([(body,)], "envelope string")
    assert tuple(sentiment.classify_answers(rows).first()["sentiment"]) == expected


def test_defaults_replace_unusable_results(spark):
    rows = spark.createDataFrame(
        [(1, True, (J, 0.5, "c")), (2, False, (J, 0.5, "c")), (3, True, (None, 0.5, "c")), (4, True, (J, None, "c")), (5, None, (J, 0.5, "c"))],
        "id int, ok boolean, sentiment struct<emotion string, score double, ai_comment string>",
    )
    found = {r["id"]: tuple(r["sentiment"]) for r in sentiment.apply_sentiment_defaults(rows, F.col("ok")).collect()}
    assert found == {1: (J, 0.5, "c"), 2: NO_ANSWER, 3: NO_ANSWER, 4: NO_ANSWER, 5: NO_ANSWER}


@pytest.mark.parametrize("text, mood", [
    ("오늘 기분 좋아", vocab.JOY), ("슬퍼서 행복", vocab.JOY), ("정말 짜증", vocab.SADNESS), ("그저 그런 날", vocab.NEUTRAL),
])
def test_keywords_in_order(spark, text, mood):
    rows = spark.createDataFrame([(text,)], "content string")
    found = sentiment.keyword_sentiment(rows).first()["sentiment"]
    assert found["emotion"] == mood and 0.7 <= found["score"] <= 0.9 and found["ai_comment"] is None


def test_new_diary_is_dated_today_in_seoul(spark):
    sent = dt.date(2020, 1, 1)
    rows = spark.createDataFrame(
        [(1, 2, "행복", None, sent, dt.datetime(2024, 3, 31, 16, 0))],
        "id bigint, member_id bigint, content string, emoji string, date date, ts timestamp_ntz",
    )
    made = sentiment.enrich_diaries(rows, sentiment.keyword_sentiment).first()
    assert made["date"] == dt.date(2024, 4, 1) and made["created_at"] == dt.datetime(2024, 4, 1, 1, 0)
    assert made["emotion"] == vocab.JOY and made["status"] == "ACTIVE"
    kept = sentiment.enrich_diaries(rows, sentiment.keyword_sentiment, respect_given_date=True).first()
    assert kept["date"] == sent
