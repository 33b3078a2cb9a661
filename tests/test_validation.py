"""Input rules."""

import pytest

from moodspark import vocab
from moodspark.operators import validation


def errors(spark, rules, **values):
    rows = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return validation.with_errors(rows, rules).first()["errors"]


def test_all_messages_are_joined(spark):
    found = errors(spark, validation.join_rules(), email="", password="", nickname=None)
    assert found == ", ".join([
        vocab.EMAIL_REQUIRED, vocab.PASSWORD_REQUIRED, vocab.PASSWORD_LENGTH, vocab.PASSWORD_PATTERN, vocab.NICKNAME_REQUIRED,
    ])


@pytest.mark.parametrize("email, good", [
    ("a@b", True), ("a.b+c@d-e.example", True), ("가@한.kr", True), ("a@[127.0.0.1]", True), ("x" * 64 + "@b", True),
    ("x" * 65 + "@b", False), ("a..b@c", False), ("a@-b", False), ("a@b-", False), ("a b@c", False), ("a@", False), ("@b", False),
    ("a@b@c", False),
])
def test_email(spark, email, good):
    found = errors(spark, validation.login_rules(), email=email, password="p")
    assert found == (None if good else vocab.EMAIL_FORMAT)


@pytest.mark.parametrize("password, found", [
    ("Synth3tic!", None), ("synthetic!", vocab.PASSWORD_PATTERN), ("s1!", f"{vocab.PASSWORD_LENGTH}, {vocab.PASSWORD_PATTERN}"),
    ("Synth3tic! ", vocab.PASSWORD_PATTERN), ("Synth3tic!" * 3, vocab.PASSWORD_LENGTH),
])
def test_password_rules_on_made_up_values(spark, password, found):
    assert errors(spark, validation.join_rules(), email="a@b", password=password, nickname="nn") == found


@pytest.mark.parametrize("nickname, found", [
    ("n", vocab.NICKNAME_LENGTH), ("n" * 21, vocab.NICKNAME_LENGTH), ("가나", None), ("  ", vocab.NICKNAME_REQUIRED),
])
def test_nickname(spark, nickname, found):
    assert errors(spark, validation.nickname_rules(), nickname=nickname) == found


def test_rows_are_split(spark):
    rows = spark.createDataFrame([(1, "글"), (2, " \t"), (3, None)], "id int, content string")
    valid, rejected = validation.validate(rows, validation.diary_rules())
    assert [r["id"] for r in valid.collect()] == [1] and valid.columns == ["id", "content"]
    assert sorted((r["id"], r["errors"]) for r in rejected.collect()) == [
        (2, vocab.DIARY_CONTENT_REQUIRED), (3, vocab.DIARY_CONTENT_REQUIRED),
    ]
