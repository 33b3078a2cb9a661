"""The change log against a plain loop, and member changes."""

import datetime as dt
import random

import pytest

from moodspark.operators import changes, members
from moodspark.plans.session import cut_lineage

SCHEMA = (
    "seq bigint, id bigint, member_id bigint, ts timestamp_ntz, op string, content string, emoji string, date date, "
    "emotion string, sentiment_score double, ai_comment string"
)
START = dt.datetime(2024, 1, 1, 14, 0)


def event(seq, id, member, op, content="text", emoji="e", date=dt.date(2024, 5, 1)):
    return (seq, id, member, START + dt.timedelta(hours=seq), op, f"{content}{seq}" if content.strip() else content, emoji, date, "기쁨", 0.5, "c")


def loop(log):
    state, rejects = {}, {}
    for seq, id, member, ts, op, content, emoji, date, emotion, score, comment in sorted(log):
        blank = content is None or not content.strip()
        current = state.get(id)
        reachable = current and current["member_id"] == member and current["status"] == "ACTIVE"
        at = ts + dt.timedelta(hours=9)
        if op != "DELETE" and blank:
            rejects[seq] = changes.BLANK
        elif op == "CREATE":
            if current:
                rejects[seq] = changes.REPEATED
            else:
                state[id] = dict(
                    id=id, member_id=member, content=content, emoji=emoji, emotion=emotion, sentiment_score=score,
                    ai_comment=comment, date=at.date(), status="ACTIVE", created_at=at, updated_at=at,
                )
        elif not reachable:
            rejects[seq] = changes.NOT_FOUND
        elif op == "DELETE":
            current.update(status="DELETED", updated_at=at)
        elif date is None:
            rejects[seq] = changes.NO_DATE
        else:
            current.update(content=content, emoji=emoji, date=date, updated_at=at)
    return state, rejects


def applied(spark, log, **options):
    current, rejects = changes.apply_changes(spark.createDataFrame(log, SCHEMA), **options)
    return {r["id"]: r.asDict() for r in current.collect()}, {r["seq"]: r["reason"] for r in rejects.collect()}


def test_each_rule(spark):
    log = [
        event(1, 1, 7, "UPDATE"), event(2, 1, 7, "CREATE"), event(3, 1, 8, "UPDATE"), event(4, 1, 7, "UPDATE", emoji=None),
        event(5, 1, 7, "UPDATE", date=None), event(6, 1, 7, "UPDATE", content=""), event(7, 1, 7, "CREATE"),
        event(8, 1, 8, "DELETE"), event(9, 1, 7, "DELETE"), event(10, 1, 7, "UPDATE"), event(11, 1, 7, "DELETE"),
        event(12, 2, 7, "CREATE", content=" "), event(13, 2, 9, "CREATE"),
    ]
    state, rejects = applied(spark, log)
    assert (state, rejects) == loop(log)
    assert state[1]["content"] == "text4" and state[1]["emoji"] is None and state[1]["emotion"] == "기쁨"
    assert state[1]["status"] == "DELETED" and state[2]["member_id"] == 9
    assert rejects[3] == rejects[10] == changes.NOT_FOUND


@pytest.mark.parametrize("seed, floor", [(1, 0), (2, 100_000), (3, 0), (4, 5)])
def test_same_as_the_loop(spark, seed, floor):
    draw = random.Random(seed)
    log = [
        event(
            seq, draw.choice([1, 1, 1, 2, 3, 4, 5]), draw.choice([7, 7, 7, 8]), draw.choice(["CREATE", "UPDATE", "UPDATE", "UPDATE", "DELETE"])
            if draw.random() < 0.5 else "UPDATE",
            draw.choice(["text", "text", "text", " "]), draw.choice(["e", None]), draw.choice([dt.date(2024, 5, 1), None, dt.date(2024, 6, 1)]),
        )
        for seq in range(1, 150)
    ]
    draw.shuffle(log)
    assert applied(spark, log, floor=floor) == loop(log)


def random_log(seed, n=150):
    draw = random.Random(seed)
    return [
        event(
            seq, draw.choice([1, 1, 2, 3, 4, 5, 6, 7, 8]), draw.choice([7, 7, 7, 8]),
            draw.choice(["CREATE", "UPDATE", "UPDATE", "UPDATE", "DELETE"]) if draw.random() < 0.4 else "UPDATE",
            draw.choice(["text", "text", "text", " "]), draw.choice(["e", None]), draw.choice([dt.date(2024, 5, 1), None]),
        )
        for seq in range(1, n)
    ]


@pytest.mark.parametrize("seed, floor, edges", [(5, 100_000, [40, 41]), (6, 0, [75])])
def test_parts_one_after_another(spark, seed, floor, edges):
    log = random_log(seed)
    state, rejects = spark.createDataFrame([], SCHEMA), {}
    for low, high in zip([0, *edges], [*edges, 1000]):
        part = spark.createDataFrame([e for e in log if low <= e[0] < high], SCHEMA)
        state, rejected = changes.advance(state, part, floor)
        rejects |= {r["seq"]: r["reason"] for r in rejected.collect()}
        state = spark.createDataFrame(state.collect(), state.schema).select(*part.columns)
    assert max(r["count"] for r in state.groupBy("id").count().collect()) <= 3
    current = {r["id"]: r.asDict() for r in changes.apply_changes(state, floor=floor)[0].collect()}
    assert (current, rejects) == loop(log)


@pytest.mark.parametrize("seed, edges", [(8, [30, 90])])
def test_parts_put_together_in_any_grouping(spark, seed, edges):
    log = random_log(seed)
    parts = [
        cut_lineage(changes.decisive(spark.createDataFrame([e for e in log if low <= e[0] < high], SCHEMA)))
        for low, high in zip([0, *edges], [*edges, 1000])
    ]
    left = parts[0]
    for part in parts[1:]:
        left = cut_lineage(changes.decisive(left.unionByName(part)))
    right = parts[-1]
    for part in reversed(parts[:-1]):
        right = cut_lineage(changes.decisive(part.unionByName(right)))
    for found in (left, right):
        assert {r["id"]: r.asDict() for r in changes.apply_changes(found)[0].collect()} == loop(log)[0]


def test_a_long_log_of_a_diary_keeps_few_events(spark):
    log = spark.createDataFrame([event(i, 1, 7, "UPDATE") for i in range(500)], SCHEMA)
    assert changes.decisive(log).count() == 1 and changes.decisive(log, True).count() == 0
    assert changes.decisive(log.limit(0)).count() == 0


def test_given_date_can_be_kept(spark):
    log = [event(1, 1, 7, "CREATE")]
    assert applied(spark, log)[0][1]["date"] == dt.date(2024, 1, 2)
    assert applied(spark, log, respect_given_date=True)[0][1]["date"] == dt.date(2024, 5, 1)


def test_first_request_for_an_address_is_admitted(spark):
    requests = spark.createDataFrame(
        [(1, "a@x", "n1"), (2, "b@x", "n2"), (3, "a@x", "n3"), (4, "c@x", "n4")], "request_id bigint, email string, nickname string"
    )
    present = spark.createDataFrame([(9, "b@x"), (10, "b@x")], "id bigint, email string")
    admitted, conflicts = members.admit_members(requests, present)
    assert sorted(r["request_id"] for r in admitted.collect()) == [1, 4]
    assert sorted(r["request_id"] for r in conflicts.collect()) == [2, 3]
    assert {(r["provider"], r["status"]) for r in members.new_members(admitted).collect()} == {("LOCAL", "ACTIVE")}


def test_latest_nickname_wins(spark):
    people = spark.createDataFrame([(1, "old"), (2, "same")], "id bigint, nickname string")
    log = spark.createDataFrame([(5, 1, "last"), (3, 1, "first"), (6, 9, "nobody")], "seq bigint, member_id bigint, nickname string")
    assert {r["id"]: r["nickname"] for r in members.change_nicknames(people, log).collect()} == {1: "last", 2: "same"}
