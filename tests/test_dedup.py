"""Address and title checks against a plain loop that saves row by row."""

import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from moodspark import vocab
from moodspark.operators import dedup
from moodspark.plans.session import cut_lineage
from tests.plans import executed

SCHEMA = (
    "source string, emotion string, "
    "ord struct<source_rank int, emotion_rank int, phrase_index int, page_id bigint, pos int>, "
    "category string, title string, description string, image_url string, content_url string, "
    "stored_key string, probe_key string"
)
KNOWN = "emotion string, category string, title string, content_url string"


def candidate(place, url, title, emotion=vocab.JOY, source="ACTIVITY", order=vocab.FULL_RUN):
    return (
        source, emotion, (order.index(source) + 1, 1, 0, place, 0), source, title[:200], "d", "", url,
        title[:200].strip().lower(), title.strip().lower(),
    )


def loop(rows, known, titles=("ACTIVITY",)):
    """Save row by row, each test seeing what was saved before."""
    urls = {k[3] for k in known if k[3] is not None}
    keys = {(k[0], k[2].strip().lower()) for k in known}
    saved = []
    for row in sorted(rows, key=lambda r: r[2]):
        if row[7] in urls or (row[0] in titles and (row[1], row[9]) in keys):
            continue
        urls.add(row[7])
        keys.add((row[1], row[8]))
        saved.append(row[2])
    return saved


def places(df):
    return sorted(tuple(r["ord"]) for r in df.select("ord").collect())


def frames(spark, rows, known):
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(known, KNOWN)


def test_dropped_by_title_does_not_hide_its_address(spark):
    rows = [candidate(1, "a", "Xxxxxx"), candidate(2, "b", "xxxxxx "), candidate(3, "b", "Yyyyyy")]
    new = dedup.new_by_url_and_title(*frames(spark, rows, []))
    assert [p[3] for p in places(new)] == [1, 3]


def test_long_chain_takes_many_rounds(spark):
    rows = [candidate(i, f"u{(i + 1) // 2}", f"title {i // 2}") for i in range(12)]
    new = dedup.new_by_url_and_title(*frames(spark, rows, []))
    assert places(new) == loop(rows, []) and len(places(new)) == 6


@pytest.mark.parametrize("length", [40, 160])
def test_steps_grow_with_the_logarithm_of_a_chain(spark, monkeypatch, length):
    cuts = []
    monkeypatch.setattr(dedup, "cut_lineage", lambda df: cuts.append(df) or cut_lineage(df))
    rows = [candidate(i, f"u{(i + 1) // 2}", f"title {i // 2}") for i in range(length)]
    new = dedup.new_by_url_and_title(*frames(spark, rows, []))
    assert places(new) == loop(rows, [])
    assert len(cuts) <= math.log2(length) + 5


def test_second_of_address_and_title_by_one_long_title(spark):
    rows = [candidate(1, "a", "b" * 201), candidate(2, "a", "b" * 200), candidate(3, "c", "b" * 200)]
    assert places(dedup.new_by_url_and_title(*frames(spark, rows, []))) == loop(rows, [])


def test_only_two_rows_of_a_key_are_shuffled(spark):
    rows = [candidate(i, "a", f"title {i}") for i in range(50)]
    lead = dedup._leading(frames(spark, rows, [])[0].select(*dedup._NARROW), 0, None)
    assert executed(lead).count("WindowGroupLimit") >= 4


def test_titles_above_the_limit_block_but_are_not_blocked(spark):
    long, short = "a" * 201, "A" * 200
    rows = [candidate(1, "a", long), candidate(2, "b", long), candidate(3, "c", short), candidate(4, "d", long)]
    new = dedup.new_by_url_and_title(*frames(spark, rows, []))
    assert places(new) == loop(rows, []) == sorted(rows[i][2] for i in (0, 1, 3))


def test_a_later_long_title_does_not_block_an_earlier_short_one(spark):
    rows = [candidate(1, "a", "b" * 200), candidate(2, "b", "b" * 201), candidate(3, "c", "b" * 200)]
    assert places(dedup.new_by_url_and_title(*frames(spark, rows, []))) == loop(rows, [])


def test_known_rows_block(spark):
    known = [(vocab.JOY, "BOOK", " Old Title ", None), (vocab.ANGER, "BOOK", "x", "k"), (vocab.ANGER, "BOOK", "y", "k")]
    rows = [candidate(1, "a", "old title"), candidate(2, "a", "old title", vocab.ANGER), candidate(3, "k", "zzzzzz")]
    assert places(dedup.new_by_url_and_title(*frames(spark, rows, known))) == loop(rows, known)
    by_url = dedup.new_by_url(*frames(spark, rows, known))
    assert [p[3] for p in places(by_url)] == [1]


def test_nothing_new(spark):
    rows = [candidate(1, "k", "zzzzzz")]
    known = [(vocab.ANGER, "BOOK", "y", "k")]
    assert dedup.new_by_url_and_title(*frames(spark, rows, known)).isEmpty()


title = st.sampled_from(["t one", "T ONE ", "t two", "t three", "t four", "l" * 200, "l" * 201, "L" * 205])
row = st.tuples(st.sampled_from("abcdef"), title, st.sampled_from([vocab.JOY, vocab.SADNESS]))
known_row = st.tuples(st.sampled_from(["a", "b", None, "z"]), title, st.sampled_from([vocab.JOY, vocab.SADNESS]))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture], derandomize=True)
@given(st.lists(row, min_size=1, max_size=40), st.lists(known_row, max_size=3), st.sampled_from([0, 100_000]))
def test_same_as_the_loop(spark, picked, known, floor):
    rows = [candidate(i, u, t, e) for i, (u, t, e) in enumerate(picked)]
    stored = [(e, "BOOK", t[:200], u) for u, t, e in known]
    new = dedup.new_by_url_and_title(*frames(spark, rows, stored), floor=floor)
    assert places(new) == loop(rows, stored)


@pytest.mark.parametrize("order", [vocab.FULL_RUN, vocab.DAILY_THEN_WEEKLY_RUN])
def test_sources_see_what_earlier_ones_saved(spark, order):
    draw = random.Random(3)
    rows = [
        candidate(i, f"u{draw.randrange(25)}", f"title {draw.randrange(12)}", draw.choice(vocab.CATALOGUE_EMOTIONS[:2]),
                  draw.choice(vocab.FULL_RUN), order)
        for i in range(80)
    ]
    known = [(vocab.JOY, "BOOK", "title 3", "u3")]
    new = dedup.harvest(*frames(spark, rows, known), order)
    assert places(new) == loop(rows, known)
    report = {(r["category"], r["emotion"]): r for r in dedup.harvest_report(spark.createDataFrame(rows, SCHEMA), new).collect()}
    assert sum(r["found"] for r in report.values()) == 80
    assert sum(r["saved"] for r in report.values()) == new.count()
    assert all(r["skipped"] == r["found"] - r["saved"] for r in report.values())


@pytest.mark.parametrize("limit", [0, 10, 10_000])
def test_a_small_harvest_meets_the_same_rows_of_the_catalogue(spark, limit):
    draw = random.Random(5)
    rows = [candidate(i, f"u{draw.randrange(40)}", f"title {draw.randrange(30)}", source=draw.choice(vocab.FULL_RUN)) for i in range(60)]
    known = [
        (draw.choice([vocab.JOY, vocab.ANGER]), "BOOK", f" TITLE {draw.randrange(60)}", draw.choice([None, f"u{draw.randrange(80)}"]))
        for _ in range(60)
    ]
    new = dedup.harvest(*frames(spark, rows, known), limit=limit)
    assert places(new) == loop(rows, known)
