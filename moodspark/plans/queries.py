"""Named queries over the driver's tables, one or more per operator."""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodspark import schemas, vocab
from moodspark.functions import dates, numbers, text
from moodspark.operators import (
    calendar, candidates, catalogue, changes, dedup, diaries, members, sentiment, stats, validation,
)
from moodspark.plans.session import cut_lineage, scratch_folder
from moodspark.sources import csv_catalogue, frontier, pages, sinks, tables, video_search
from moodspark.sources.fixtures import shape, table, view
from moodspark.streaming import catalogue_arrivals, diary_arrivals

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

SEED = 42


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


# Reading diaries

@query
def active_diaries(spark, sf):
    return diaries.active_diaries(view(spark, sf, "diaries")).select("id", "member_id", "date", "emotion")


@query
def diaries_newest_first(spark, sf):
    return diaries.newest_first(view(spark, sf, "diaries")).select("id", "member_id", "date", "emotion")


@query
def diary_detail(spark, sf):
    requests = table(spark, sf, "events").selectExpr(
        "event_id AS request_id", "user_id AS member_id", "event_id + (event_id % 2) * 3 AS id"
    )
    return diaries.diary_detail(view(spark, sf, "diaries"), requests)


@query
def diaries_in_month(spark, sf):
    return diaries.diaries_in_month(view(spark, sf, "diaries"), 2024, 5).select("id", "member_id", "date")


@query
def calendar_rows(spark, sf):
    return diaries.calendar_rows(view(spark, sf, "diaries"), 2024, 5)


@query
def month_grid(spark, sf):
    return calendar.month_grid(view(spark, sf, "diaries"))


@query
def requested_grid(spark, sf):
    asked = table(spark, sf, "customer").selectExpr(
        "c_custkey AS member_id", "make_date(2024, CAST(c_custkey % 12 + 1 AS INT), 1) AS month_start"
    )
    return calendar.month_grid(view(spark, sf, "diaries"), asked, key="date")


@query
def diaries_with_member(spark, sf):
    rows = view(spark, sf, "diaries").select("id", "member_id", "date", "emotion")
    return diaries.diaries_with_member(rows, view(spark, sf, "members"))


@query
def diaries_emoji(spark, sf):
    return diaries.with_emoji(view(spark, sf, "diaries")).select("id", "shown_emotion", "emotion_emoji")


@query
def duplicate_days(spark, sf):
    return diaries.duplicate_days(view(spark, sf, "diaries"))


@query
def public_diaries(spark, sf):
    return diaries.public_view("diary", view(spark, sf, "diaries"))


@query
def public_recommendations(spark, sf):
    return diaries.public_view("recommendation", view(spark, sf, "catalogue"))


@query
def public_members(spark, sf):
    return diaries.public_view("member", view(spark, sf, "members"))


# Statistics

@query
def monthly_stats(spark, sf):
    return stats.monthly_stats_wide(view(spark, sf, "diaries"))


def _map_text(c: str):
    entries = F.transform(
        F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
    )
    return F.array_join(entries, ",")


@query
def monthly_stats_map(spark, sf):
    record = stats.monthly_stats(view(spark, sf, "diaries"))
    return record.withColumn("emotion_counts", _map_text("emotion_counts"))


@query
def requested_stats(spark, sf):
    asked = table(spark, sf, "customer").selectExpr(
        "c_custkey AS member_id", "2024 AS year", "CAST(c_custkey % 12 + 1 AS INT) AS month"
    )
    answers = stats.requested_stats(asked, view(spark, sf, "diaries"))
    return answers.withColumn("emotion_counts", _map_text("emotion_counts"))


@query
def emotion_counts(spark, sf):
    return stats.emotion_counts(view(spark, sf, "diaries"))


@query
def dominant_emotion(spark, sf):
    return stats.dominant_emotion(stats.emotion_counts(view(spark, sf, "diaries")))


@query
def emotion_share(spark, sf):
    shares = stats.emotion_share(stats.emotion_counts(view(spark, sf, "diaries")))
    return shares.withColumn("share", numbers.half_up("share", 4))


@query
def score_gauge(spark, sf):
    return stats.score_gauge(stats.monthly_stats_wide(view(spark, sf, "diaries")))


@query
def table_counts(spark, sf):
    views = {name: view(spark, sf, name) for name in ("diaries", "members", "catalogue")}
    named = [df.select(F.lit(name).alias("table_name")) for name, df in views.items()]
    return stats.row_count(candidates.all_candidates(named), "table_name")


# Catalogue

@query
def catalogue_by_emotion(spark, sf):
    return catalogue.by_emotion(view(spark, sf, "catalogue"), vocab.ANGER)


@query
def catalogue_by_url(spark, sf):
    return catalogue.by_content_url(view(spark, sf, "catalogue"), "https://shop.example.com/7")


@query
def category_counts(spark, sf):
    return stats.row_count(view(spark, sf, "catalogue"), "category")


@query
def catalogue_icons(spark, sf):
    return catalogue.with_category_icon(view(spark, sf, "catalogue")).select("id", "category", "icon")


@query
def pick_per_category(spark, sf):
    return catalogue.pick_per_category(view(spark, sf, "catalogue"), SEED)


@query
def recommend_for_diaries(spark, sf):
    found = catalogue.recommend_for_diaries(view(spark, sf, "diaries"), view(spark, sf, "catalogue"), SEED)
    return found.select("diary_id", "member_id", "emotion", "category", "recommendation_id", "title")


@query
def emotion_coverage(spark, sf):
    return catalogue.emotion_coverage(view(spark, sf, "diaries"), view(spark, sf, "catalogue"))


@query
def replace_category(spark, sf):
    return catalogue.replace_category(view(spark, sf, "catalogue"), "MUSIC", _song_rows(spark, sf))


@query
def csv_catalogue_rows(spark, sf):
    """Seed lines of many shapes made from the parts."""
    lines = table(spark, sf, "part").selectExpr("p_partkey AS id", f"{csv_line('STRING')} AS line")
    return csv_catalogue.parse_catalogue_lines(lines)


def csv_line(string_type: str) -> str:
    """A line by the part's key: plain, quoted commas, doubled quotes, too short, longer, cut-off quote, blank."""
    key = f"CAST(p_partkey AS {string_type})"
    return (
        "CASE p_partkey % 7 "
        f"WHEN 0 THEN concat('기쁨,MUSIC,', p_name, ',', p_brand, ',,https://a.example/', {key}) "
        f"WHEN 1 THEN concat('슬픔, BOOK ,\"', p_name, ', ', {key}, '\",\"a \"\"', p_brand, '\"\" b\",,') "
        "WHEN 2 THEN concat('분노,MOVIE,', p_name, ',', p_brand, ',') "
        f"WHEN 3 THEN concat('불안,HOBBY,\"\"\"', p_name, '\"\"\",', p_brand, ',i', {key}, ',u,extra,more') "
        "WHEN 4 THEN concat('기쁨,MUSIC,', p_name, ',\"', p_brand, ',,,') "
        "WHEN 5 THEN '   ' "
        "ELSE concat('슬픔,BOOK,x\"', p_name, ',y\"z,', p_brand, ',\"\"\"\",u') END"
    )


# Members

@query
def member_lookup(spark, sf):
    emails = table(spark, sf, "supplier").selectExpr("concat('user', CAST(s_suppkey AS STRING), '@example.com') AS email")
    return members.find_by_email(view(spark, sf, "members"), emails).select("id", "email")


@query
def admit_members(spark, sf):
    requests = table(spark, sf, "customer").selectExpr(
        "c_custkey AS request_id",
        "concat('user', CAST(c_custkey % 1000 AS STRING), '@example.com') AS email", "c_name AS nickname",
    )
    present = table(spark, sf, "supplier").selectExpr(
        "concat('user', CAST(s_suppkey * 3 AS STRING), '@example.com') AS email"
    )
    admitted, conflicts = members.admit_members(requests, present)
    return admitted.withColumn("outcome", F.lit("ADMITTED")).unionByName(
        conflicts.withColumn("outcome", F.lit("CONFLICT"))
    )


@query
def nickname_changes(spark, sf):
    log = table(spark, sf, "events").selectExpr(
        "event_id AS seq", "user_id AS member_id",
        "concat('nick ', event_type, ' ', CAST(event_id AS STRING)) AS nickname",
    )
    return members.change_nicknames(view(spark, sf, "members"), log).select("id", "email", "nickname")


JOIN_REQUEST = {
    "id": "c_custkey",
    "email": (
        "CASE c_custkey % 6 WHEN 0 THEN concat('a.b', CAST(c_custkey AS string_t), '@example.com') "
        "WHEN 1 THEN 'no-at-sign' WHEN 2 THEN '' WHEN 3 THEN 'two@@example.com' WHEN 4 THEN NULL "
        "ELSE 'x@host-1.example' END"
    ),
    "password": (
        "CASE c_custkey % 5 WHEN 0 THEN concat('abc!', CAST(c_custkey + 10000 AS string_t)) WHEN 1 THEN 'short1!' "
        "WHEN 2 THEN 'onlyletters' WHEN 3 THEN concat('long1!', c_name, c_name) ELSE '  ' END"
    ),
    "nickname": "CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN 'x' WHEN 2 THEN c_mktsegment ELSE ' ' END",
}


@query
def validate_rows(spark, sf):
    requests = table(spark, sf, "customer").selectExpr(
        *[f"{e.replace('string_t', 'STRING')} AS {c}" for c, e in JOIN_REQUEST.items()]
    )
    return validation.with_errors(requests, validation.join_rules()).select("id", "errors")


@query
def validate_texts(spark, sf):
    texts = view(spark, sf, "changes").select("seq", F.col("content").alias("text"))
    valid, rejected = validation.validate(texts, validation.text_rules())
    return valid.withColumn("errors", F.lit(None).cast("string")).unionByName(rejected)


# Harvest

def _links(spark, sf) -> DataFrame:
    return pages.extract_candidates(view(spark, sf, "result_pages"), pages.LINK_PAGE)


def _activities(spark, sf) -> DataFrame:
    return candidates.clean_candidates(_links(spark, sf), "ACTIVITY")


def _video_items(spark, sf) -> DataFrame:
    return video_search.parse_video_search(view(spark, sf, "videos")).select(
        F.col("id").alias("page_id"), "pos", F.lit(0).alias("phrase_index"), F.lit(vocab.JOY).alias("emotion"),
        "video_id", "title", "description", "image_url",
    )


def _songs(spark, sf, profile="MUSIC") -> DataFrame:
    return candidates.clean_candidates(_video_items(spark, sf), profile)


def _song_rows(spark, sf) -> DataFrame:
    return _songs(spark, sf).select(
        F.col("ord.page_id").alias("id"), "emotion", "category", "title", "description", "image_url", "content_url"
    )


def _earlier_harvest(spark, sf) -> DataFrame:
    """What a first harvest, of the pages without encryption, left in the catalogue."""
    plain = view(spark, sf, "result_pages").where(F.col("url").startswith("http://"))
    return candidates.clean_candidates(pages.extract_candidates(plain, pages.LINK_PAGE), "ACTIVITY")


@query
def harvest_links(spark, sf):
    return _links(spark, sf).select("page_id", "pos", "emotion", "title", "content_url")


def _clean_columns(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("ord.page_id").alias("page_id"), F.col("ord.pos").alias("pos"), "emotion", "category", "title",
        "description", "image_url", "content_url",
    )


@query
def clean_links(spark, sf):
    return _clean_columns(_activities(spark, sf))


@query
def clean_books(spark, sf):
    return _clean_columns(candidates.clean_candidates(_links(spark, sf), "BOOK"))


def _shop_items(spark, sf, html: str, profile: pages.PageProfile) -> DataFrame:
    found = pages.extract_candidates(
        view(spark, sf, "shop_pages").select("page_id", "url", "emotion", "phrase_index", F.col(html).alias("html")), profile
    )
    return _clean_columns(candidates.clean_candidates(found, profile.source))


@query
def book_pages(spark, sf):
    return _shop_items(spark, sf, "book_html", pages.BOOK_PAGE)


@query
def movie_pages(spark, sf):
    return _shop_items(spark, sf, "movie_html", pages.MOVIE_PAGE)


@query
def activity_pages(spark, sf):
    return _shop_items(spark, sf, "activity_html", pages.ACTIVITY_PAGE)


@query
def clean_movies(spark, sf):
    no_link = F.when(F.col("pos") % 3 == 0, F.lit("")).otherwise(F.col("content_url"))
    return _clean_columns(candidates.clean_candidates(_links(spark, sf).withColumn("content_url", no_link), "MOVIE"))


@query
def video_items(spark, sf):
    return _video_items(spark, sf)


@query
def clean_videos(spark, sf):
    return _clean_columns(_songs(spark, sf))


@query
def clean_videos_raw(spark, sf):
    return _clean_columns(_songs(spark, sf, "MUSIC_RAW"))


@query
def frontier_urls(spark, sf):
    """Search addresses for every product name, in the three encodings."""
    phrases = view(spark, sf, "catalogue").select("id", "emotion", F.col("title").alias("phrase"))
    found = [
        frontier.harvest_frontier(phrases, source, "https://api.example.com").withColumn("source", F.lit(source))
        if source == "MUSIC" else
        frontier.harvest_frontier(phrases, source).withColumn("source", F.lit(source))
        for source in ("MUSIC", "BOOK", "MOVIE", "ACTIVITY")
    ]
    return candidates.all_candidates(found)


@query
def new_by_url(spark, sf):
    known = candidates.to_catalogue(_earlier_harvest(spark, sf))
    return _clean_columns(dedup.new_by_url(_activities(spark, sf), known))


@query
def new_by_title(spark, sf):
    known = candidates.to_catalogue(_earlier_harvest(spark, sf))
    return _clean_columns(dedup.new_by_url_and_title(cut_lineage(_activities(spark, sf)), known))


def _all_sources(spark, sf) -> DataFrame:
    links = _links(spark, sf)
    return candidates.all_candidates([
        _songs(spark, sf),
        candidates.clean_candidates(links, "BOOK"),
        candidates.clean_candidates(links, "ACTIVITY"),
    ])


@query
def all_candidates(spark, sf):
    return _clean_columns(_all_sources(spark, sf))


@query
def harvest(spark, sf):
    found = cut_lineage(_all_sources(spark, sf))
    return _clean_columns(dedup.harvest(found, view(spark, sf, "catalogue")))


@query
def harvest_report(spark, sf):
    found = cut_lineage(_all_sources(spark, sf))
    return dedup.harvest_report(found, dedup.harvest(found, view(spark, sf, "catalogue")))


# Sentiment

@query
def model_answers(spark, sf):
    parsed = sentiment.parse_model_answer(view(spark, sf, "answers"))
    return sentiment.apply_sentiment_defaults(sentiment.rounded_score(parsed)).select("id", "sentiment.*")


@query
def envelope_answers(spark, sf):
    answers = view(spark, sf, "answers")
    message = F.struct(F.array(F.struct(F.struct(F.col("answer").alias("content")).alias("message"))).alias("choices"))
    envelope = F.when(F.col("id") % 10 == 0, F.lit('{"choices": []}')) \
        .when(F.col("id") % 10 == 1, F.lit('{"choices": [{"message": {"content": null}}]}')) \
        .otherwise(F.to_json(message))
    return sentiment.classify_answers(answers.select("id", envelope.alias("envelope"))).select("id", "sentiment.*")


# Words of the documents' four languages, tried in this order.
DOCUMENT_RULES = [(vocab.JOY, [" the ", " and "]), (vocab.SADNESS, [" der ", " und "]), (vocab.ANXIETY, [" les ", " el "])]


@query
def keyword_mood(spark, sf):
    texts = table(spark, sf, "documents").select("doc_id", "text")
    classified = sentiment.keyword_sentiment(
        texts, "text", DOCUMENT_RULES, score=numbers.seeded_score(SEED, "doc_id")
    )
    return classified.select("doc_id", "sentiment.*")


EVENT_RULES = [(vocab.JOY, ["purchase", "signup"]), (vocab.ANGER, ["error"])]


def _requests(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "event_id AS id", "user_id AS member_id",
        "CASE WHEN event_id % 19 = 0 THEN ' ' ELSE concat(event_type, ' ', props) END AS content",
        "CAST(NULL AS STRING) AS emoji", "DATE'2020-01-01' AS date", "ts",
    )


def _event_classifier(df: DataFrame) -> DataFrame:
    return sentiment.keyword_sentiment(df, "content", EVENT_RULES, score=numbers.seeded_score(SEED, "id"))


@query
def enriched_diaries(spark, sf):
    requests = _requests(table(spark, sf, "events"))
    valid, _ = validation.validate(requests, validation.diary_rules())
    return sentiment.enrich_diaries(valid, _event_classifier)


# Change log

@query
def current_diaries(spark, sf):
    return changes.apply_changes(view(spark, sf, "changes"))[0]


@query
def change_rejects(spark, sf):
    return changes.apply_changes(view(spark, sf, "changes"))[1]


def _parts_of_log(log, parts):
    """Stretches of the log of about the same length by number."""
    end = log.agg(F.max("seq")).first()[0] or 0
    edges = [end * i // parts for i in range(1, parts)]
    return [
        log.where((F.col("seq") > low if low is not None else F.lit(True)) & (F.col("seq") <= high if high is not None else F.lit(True)))
        for low, high in zip([None, *edges], [*edges, None])
    ]


def _advanced(spark, sf):
    log = cut_lineage(view(spark, sf, "changes"))
    state, rejected = log.limit(0), []
    for part in _parts_of_log(log, 3):
        state, rejects = changes.advance(state, part)
        state = cut_lineage(state)
        rejected.append(rejects)
    return state, rejected


@query
def diaries_by_parts(spark, sf):
    """The change log part after part: each updates the stored state of the parts before."""
    return changes.apply_changes(_advanced(spark, sf)[0])[0]


@query
def rejects_by_parts(spark, sf):
    return reduce(DataFrame.unionByName, _advanced(spark, sf)[1])


@query
def diaries_from_merged_parts(spark, sf):
    """Parts of the change log reduced each by itself, then put together."""
    log = cut_lineage(view(spark, sf, "changes"))
    return changes.apply_changes(reduce(DataFrame.unionByName, map(changes.decisive, _parts_of_log(log, 3))))[0]


# Column helpers

@query
def text_scalars(spark, sf):
    c = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id",
        text.java_trim(c).alias("trimmed"),
        text.cut(c, 200).alias("cut"),
        text.snippet(c, 100).alias("snippet"),
        text.title_key(c).alias("title_key"),
        text.form_encode(c).alias("form"),
        text.query_encode(c).alias("query"),
        text.join_parts("lang", "source").alias("joined"),
        text.contains_any(c, [" the ", " der "]).alias("hit"),
        F.length(c).alias("n_chars"),
        text.search_url(F.lit(""), "source").alias("search_url"),
        text.watch_url("lang").alias("watch_url"),
    )


@query
def page_titles(spark, sf):
    """Title of every page as text, with the address of its icon."""
    return table(spark, sf, "pages").select(
        "page_id",
        text.page_text(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"),
        text.absolute_url("url", F.lit("/favicon.ico")).alias("icon"),
        text.absolute_url("url", F.lit("//cdn.example.com/x.png")).alias("image"),
        text.site_of("url").alias("site"),
    )


@query
def date_scalars(spark, sf):
    rows = view(spark, sf, "diaries")
    parts = {**dates.month_of("date"), **dates.month_bounds("date"), **dates.date_labels("date")}
    return rows.select(
        "id", dates.date_key("date").alias("key"), dates.kst_today("created_at").alias("seoul_day"),
        *[c.alias(n) for n, c in parts.items()],
    )


@query
def number_scalars(spark, sf):
    rows = table(spark, sf, "events")
    return rows.select(
        "event_id",
        numbers.half_up(F.col("value") / 16, 2).alias("two_places"),
        numbers.half_up(F.col("value") - 10).alias("whole"),
        numbers.clamp01(F.col("value") / 16 - 0.5).alias("clamped"),
        numbers.round4(F.col("event_id") / 1024).alias("four_places"),
        numbers.seeded_score(SEED, "event_id").alias("score"),
    )


# Tables on disk

@query
def loaded_tables(spark, sf):
    """All ids of the three tables, written in their layouts and loaded again."""
    here = scratch_folder(spark, "tables")
    sinks.append_diaries(view(spark, sf, "diaries"), f"{here}/diaries")
    view(spark, sf, "members").write.parquet(f"{here}/members")
    sinks.append_catalogue(view(spark, sf, "catalogue"), f"{here}/recommendations")
    named = [df.select(F.lit(name).alias("table_name"), "id") for name, df in tables.load_tables(spark, here).items()]
    return candidates.all_candidates(named)


@query
def appended_diaries(spark, sf):
    """Diaries that arrived in two parts, with the month whose folder they are in."""
    path = f"{scratch_folder(spark, 'diaries')}/diaries"
    rows = view(spark, sf, "diaries")
    for part in (0, 1):
        sinks.append_diaries(rows.where(F.col("id") % 2 == part), path)
    return spark.read.parquet(path).select("id", "member_id", "date", F.col("month").cast("date").alias("month"))


@query
def seeded_catalogue(spark, sf):
    """Seed rows go into an empty catalogue and not into one that has rows."""
    path = f"{scratch_folder(spark, 'seed')}/catalogue"
    seed = csv_catalogue_rows(spark, sf)
    sinks.seed_if_empty(spark.createDataFrame([], schemas.RECOMMENDATIONS), seed, path)
    sinks.seed_if_empty(spark.read.parquet(path), seed, path)
    return spark.read.parquet(path).select(seed.columns)


@query
def overwritten_category(spark, sf):
    """The stored catalogue after the folder of its songs has been replaced."""
    path = f"{scratch_folder(spark, 'category')}/catalogue"
    rows = view(spark, sf, "catalogue")
    sinks.append_catalogue(rows, path)
    sinks.overwrite_category(_song_rows(spark, sf), "MUSIC", path)
    return spark.read.parquet(path).select(rows.columns)


# Arrivals

@query
def stream_diaries(spark, sf):
    """Events arrive as several files; statistics after all of them."""
    here = scratch_folder(spark, "diaries")
    events = table(spark, sf, "events")
    events.repartition(4, "event_id").write.parquet(f"{here}/in")
    arriving = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{here}/in")
    run = diary_arrivals.start_diary_arrivals(_requests(arriving), f"{here}/out", f"{here}/progress", _event_classifier)
    run.awaitTermination()
    record = diary_arrivals.stored_stats(spark, f"{here}/out")
    return record.withColumn("emotion_counts", _map_text("emotion_counts"))


@query
def stream_catalogue(spark, sf):
    """Pages arrive, some of them again in later batches, at a catalogue that an earlier harvest filled; its new rows."""
    here = scratch_folder(spark, "catalogue")
    known = dedup.new_by_url(_earlier_harvest(spark, sf), view(spark, sf, "catalogue"))
    catalogue_arrivals.start_catalogue(candidates.to_catalogue(known), f"{here}/out")
    raw = table(spark, sf, "pages")
    # What arrives at once is one batch, in as many files as the table is read by.
    for again in (raw, raw.where("page_id % 3 = 0"), raw.where("page_id % 3 = 1")):
        again.write.mode("append").parquet(f"{here}/in")
        arriving = shape(spark.readStream.schema(raw.schema).parquet(f"{here}/in"), "result_pages")
        catalogue_arrivals.start_catalogue_arrivals(
            arriving, f"{here}/out", f"{here}/progress", pages.LINK_PAGE
        ).awaitTermination()
    stored = catalogue_arrivals.stored_catalogue(spark, f"{here}/out")
    return stored.where("batch_id >= 0").select("emotion", "category", "title", "content_url")


