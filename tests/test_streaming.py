"""Arrivals in several batches end where one batch ends, and repeated batches change nothing."""

import pytest
from pyspark.sql import functions as F

from moodspark import vocab
from moodspark.functions import numbers
from moodspark.operators import candidates, dedup, sentiment, stats
from moodspark.operators.validation import diary_rules, validate
from moodspark.plans import queries
from moodspark.sources import pages, part_list
from moodspark.sources.fixtures import shape, table, view
from moodspark.streaming import catalogue_arrivals, diary_arrivals

RULES = [(vocab.JOY, ["purchase", "signup"]), (vocab.ANGER, ["error"])]


def classifier(df):
    return sentiment.keyword_sentiment(df, "content", RULES, score=numbers.seeded_score(1, "id"))


def requests(events):
    return events.selectExpr(
        "event_id AS id", "user_id AS member_id", "CASE WHEN event_id % 9 = 0 THEN '' ELSE event_type END AS content",
        "CAST(NULL AS STRING) AS emoji", "CAST(NULL AS DATE) AS date", "ts",
    )


def rows(df, *columns):
    names = columns or sorted(df.columns)
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)


def test_diaries_in_batches(spark, small, tmp_path):
    events = table(spark, small, "events")
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    valid, rejected = validate(requests(events), diary_rules())
    expected = sentiment.enrich_diaries(valid, classifier)

    def arrive():
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
        diary_arrivals.start_diary_arrivals(requests(stream), out, progress, classifier).awaitTermination()

    early = events.where("event_id < 400")
    early.repartition(3).write.parquet(source)
    arrive()
    events.where("event_id >= 400").repartition(2).write.mode("append").parquet(source)
    arrive()
    stored = diary_arrivals.stored_diaries(spark, out)
    assert stored.select("batch_id").distinct().count() == 5
    assert rows(stored.select(*expected.columns)) == rows(expected)
    assert rows(diary_arrivals.stored_stats(spark, out)) == rows(stats.monthly_stats(expected))
    assert diary_arrivals.stored_rejects(spark, out).count() == rejected.count()


def test_a_repeated_diary_batch_replaces_itself(spark, small, tmp_path):
    out = str(tmp_path / "out")
    arrived = requests(table(spark, small, "events"))
    diary_arrivals.store_batch(arrived, 0, out, classifier)
    once = rows(diary_arrivals.stored_stats(spark, out))
    diary_arrivals.store_batch(arrived, 0, out, classifier)
    assert rows(diary_arrivals.stored_stats(spark, out)) == once


def test_merged_diary_batches_hold_the_same_rows(spark, small, tmp_path):
    out = str(tmp_path / "out")
    events = requests(table(spark, small, "events"))
    for batch_id in range(6):
        before = diary_arrivals.stored_diaries(spark, out)
        some = events.where(F.col("id") % 6 == batch_id)
        diary_arrivals.store_batch(some, batch_id, out, classifier, fan=2)
        # A reader of the list before goes on.
        assert before.count() == before.select("id").distinct().count()
    # The newest batch can be repeated; one that is merged already is not stored again.
    diary_arrivals.store_batch(events.where("id % 6 = 5"), 5, out, classifier, fan=2)
    diary_arrivals.store_batch(events.where("id % 6 = 0"), 0, out, classifier, fan=2)
    valid, rejected = validate(events, diary_rules())
    expected = sentiment.enrich_diaries(valid, classifier)
    listed = part_list.current(spark, out).parts
    assert len(listed) <= 3 and max(p.level for p in listed) == 2
    assert rows(diary_arrivals.stored_diaries(spark, out).select(*expected.columns)) == rows(expected)
    assert rows(diary_arrivals.stored_stats(spark, out)) == rows(stats.monthly_stats(expected))
    assert diary_arrivals.stored_rejects(spark, out).count() == rejected.count()


def test_a_progress_folder_made_anew_loses_nothing(spark, small, tmp_path):
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    events = table(spark, small, "events")
    total = 0
    for again, some in enumerate((events.where("event_id < 300"), events.where("event_id >= 300"))):
        some.coalesce(1).write.parquet(f"{source}{again}")
        stream = spark.readStream.schema(events.schema).parquet(f"{source}{again}")
        # The second time as if the folder had been deleted: another one, known under the same path.
        link = tmp_path / "progress"
        link.unlink(missing_ok=True)
        (tmp_path / f"progress{again}").mkdir()
        link.symlink_to(tmp_path / f"progress{again}")
        diary_arrivals.start_diary_arrivals(requests(stream), out, progress, classifier).awaitTermination()
        total += validate(requests(some), diary_rules())[0].count()
    stored = diary_arrivals.stored_diaries(spark, out)
    assert stored.count() == total and stored.select("run").distinct().count() == 2


@pytest.fixture()
def arrivals(spark, small):
    raw = table(spark, small, "pages")
    middle = raw.agg(F.expr("percentile(page_id, 0.5)")).first()[0]
    return raw.where(F.col("page_id") <= middle), raw.where(F.col("page_id") > middle)


COLUMNS = ("emotion", "category", "title", "content_url")


def test_catalogue_in_batches(spark, small, tmp_path, arrivals):
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    seed = view(spark, small, "catalogue")
    catalogue_arrivals.start_catalogue(seed, out)
    expected = seed.select(*COLUMNS)
    for part in arrivals:
        part.coalesce(1).write.mode("append").parquet(source)
        stream = shape(spark.readStream.schema(part.schema).parquet(source), "result_pages")
        catalogue_arrivals.start_catalogue_arrivals(stream, out, progress, pages.LINK_PAGE).awaitTermination()
        found = candidates.clean_candidates(
            pages.extract_candidates(shape(part, "result_pages"), pages.LINK_PAGE), "ACTIVITY"
        )
        expected = expected.unionByName(dedup.harvest(found, expected).select(*COLUMNS))
    stored = catalogue_arrivals.stored_catalogue(spark, out)
    assert stored.where("batch_id >= 0").count() > 0
    assert rows(stored, *COLUMNS) == rows(expected, *COLUMNS)


def test_a_repeated_catalogue_batch_replaces_itself(spark, small, tmp_path, arrivals):
    out = str(tmp_path / "out")
    catalogue_arrivals.start_catalogue(view(spark, small, "catalogue"), out)
    for batch_id, part in enumerate(arrivals):
        catalogue_arrivals.store_batch(shape(part, "result_pages"), batch_id, out, pages.LINK_PAGE)
    once = rows(catalogue_arrivals.stored_catalogue(spark, out))
    catalogue_arrivals.store_batch(shape(arrivals[1], "result_pages"), 1, out, pages.LINK_PAGE)
    assert rows(catalogue_arrivals.stored_catalogue(spark, out)) == once


def test_arrivals_are_written_by_as_many_tasks_as_read_the_pages(spark, small, tmp_path, monkeypatch):
    sf = tmp_path / "sf"
    table(spark, small, "pages").repartition(3, "page_id").write.parquet(str(sf / "pages.parquet"))
    table(spark, small, "part").write.parquet(str(sf / "part.parquet"))
    monkeypatch.setattr(queries, "scratch_folder", lambda spark, name: str(tmp_path / "here"))
    found = queries.QUERIES["stream_catalogue"](spark, str(sf))
    arrived = spark.read.parquet(str(tmp_path / "here" / "in")).select(F.input_file_name().alias("file")).distinct()
    read_by = table(spark, str(sf), "pages").rdd.getNumPartitions()
    assert read_by > 1 and arrived.count() == 3 * read_by
    # Each arrival is one batch, and the last two bring nothing new.
    stored = catalogue_arrivals.stored_catalogue(spark, str(tmp_path / "here" / "out"))
    assert (tmp_path / "here" / "progress" / "commits" / "2").exists() and not (tmp_path / "here" / "progress" / "commits" / "3").exists()
    assert rows(found, *COLUMNS) == rows(stored.where("batch_id = 0"), *COLUMNS) and not found.isEmpty()
