"""For each named query the SQL that gives the same rows, for DuckDB over the same tables."""

from moodspark import vocab
from moodspark.operators import validation
from moodspark.plans.queries import DOCUMENT_RULES, EVENT_RULES, JOIN_REQUEST, SEED, csv_line
from moodspark.sources.fixtures import LONG_TEXT, sql

# Blanks and control characters, as Java's trim takes them.
_BLANKS = "(" + " || ".join(f"chr({c})" for c in range(1, 33)) + ")"


def _trim(c: str) -> str:
    return f"trim({c}, {_BLANKS})"


def _half_up(c: str, places: int = 0) -> str:
    k = 10 ** places
    return f"CAST(floor(({c}) * {k} + 0.5) / {k} AS DOUBLE)"


def _form(c: str) -> str:
    return f"replace(replace(replace(url_encode({c}), '%20', '+'), '%2A', '*'), '~', '%7E')"


def _query(c: str) -> str:
    return f"replace(replace(url_encode({c}), '%2A', '*'), '~', '%7E')"


def _score(c: str) -> str:
    share = f"CAST(('0x' || substr(md5('{SEED}:' || CAST({c} AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0"
    return _half_up(f"CAST(0.7 AS DOUBLE) + CAST({share} AS DOUBLE) * CAST(0.2 AS DOUBLE)", 2)


def _case(column: str, table: dict[str, str], default: str) -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())
    return f"CASE {column} {arms} ELSE '{default}' END"


def _keyword_case(column: str, rules: list[tuple[str, list[str]]]) -> str:
    arms = " ".join(
        "WHEN " + " OR ".join(f"contains({column}, '{w}')" for w in words) + f" THEN '{mood}'" for mood, words in rules
    )
    return f"CASE {arms} ELSE '{vocab.NEUTRAL}' END"


ACTIVE = "active AS (SELECT *, CAST(date_trunc('month', date) AS DATE) AS month_start FROM diaries WHERE status = 'ACTIVE')"


def _with(head: str, tables: list[str], rest: str) -> str:
    return head.rstrip() + "".join(f", {t}" for t in tables) + " " + rest


def _diaries(rest: str, *names: str, more: str = "") -> str:
    """A query over the diaries, with a view of the active ones and further common tables."""
    return _with(sql("", "diaries", *names), [ACTIVE, *([more] if more else [])], rest)


_COUNTS = (
    "counts AS (SELECT member_id, month_start, emotion, count(*) AS n FROM active "
    "WHERE emotion IS NOT NULL GROUP BY ALL)"
)
_MEAN = _half_up("favg(sentiment_score)", 2)
_WIDE = ", ".join(
    f"CAST(count(*) FILTER (emotion = '{e}') AS BIGINT) AS n_{i}" for i, e in enumerate(vocab.DIARY_EMOTIONS)
)
_RECORD = (
    f"record AS (SELECT member_id, month_start, count(*) AS total_count, {_MEAN} AS average_score "
    "FROM active GROUP BY ALL), "
    "texts AS (SELECT member_id, month_start, string_agg(emotion || '=' || n, ',' ORDER BY emotion) AS emotion_counts "
    "FROM counts GROUP BY ALL)"
)
_DOMINANT = " ".join(f"WHEN '{e}' THEN {i}" for i, e in enumerate(vocab.DOMINANT_ORDER))

# Raw links of the pages, in page order.
_SITE = "regexp_extract(url, '^([^:]+://[^/?#]*)', 1)"
_PAGE_TEXT = (
    "replace(replace(replace(replace(replace(replace({c}, '&copy;', '©'), '&middot;', '·'), '&quot;', chr(34)), "
    "'&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
)
_TITLE = _trim("regexp_replace(" + _PAGE_TEXT.format(c="raw_title") + r", '[ \t\n\f\r]+', ' ', 'g')")
_LINKS = (
    "found AS (SELECT page_id, url, emotion, "
    """regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS hrefs, """
    """regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS titles FROM result_pages), """
    "pairs AS (SELECT page_id, url, emotion, generate_subscripts(hrefs, 1) - 1 AS place, unnest(hrefs) AS href, "
    "unnest(titles) AS raw_title FROM found), "
    f"links AS (SELECT page_id, url, CAST(place AS INTEGER) AS pos, emotion, {_TITLE} AS title, "
    f"CASE WHEN regexp_matches(href, '^https?:') THEN href ELSE {_SITE} || href END AS content_url FROM pairs)"
)
_CLEAN = (
    "clean AS (SELECT page_id, url, pos, emotion, 'ACTIVITY' AS category, substr(title, 1, 200) AS title, "
    f"substr(title, 1, 200) || ' | {vocab.NO_DESCRIPTION}' AS description, '' AS image_url, content_url, "
    f"lower(title) AS key, CASE emotion "
    + " ".join(f"WHEN '{e}' THEN {i}" for i, e in enumerate(vocab.HARVEST_ORDER))
    + " END AS place FROM links WHERE length(title) > 5 AND content_url <> '')"
)
_CLEAN_COLUMNS = "page_id, pos, emotion, category, title, description, image_url, content_url"
_EARLIER = "earlier AS (SELECT * FROM clean WHERE starts_with(url, 'http://'))"
_FIRST_URL = (
    "first_url AS (SELECT * FROM clean WHERE content_url NOT IN (SELECT content_url FROM {known}) "
    "QUALIFY row_number() OVER (PARTITION BY content_url ORDER BY place, page_id, pos) = 1)"
)
# An address has one title and one mood here, so that a pass by address and one by title are exact.
_FIRST_TITLE = (
    "first_title AS (SELECT * FROM first_url WHERE (emotion, key) NOT IN (SELECT emotion, key FROM {known}) "
    "QUALIFY row_number() OVER (PARTITION BY emotion, key ORDER BY place, page_id, pos) = 1)"
)


def _pages(rest: str, *tables: str) -> str:
    return _with(sql("", "result_pages"), [_LINKS, *tables], rest)


_VIDEOS = (
    "items AS (SELECT id AS page_id, 0 AS pos, 0 AS phrase_index, '" + vocab.JOY + "' AS emotion, "
    "json_extract_string(body, '$.items[0].id.videoId') AS video_id, "
    "json_extract_string(body, '$.items[0].snippet.title') AS title, "
    "json_extract_string(body, '$.items[0].snippet.description') AS description, "
    "json_extract_string(body, '$.items[0].snippet.thumbnails.high.url') AS image_url FROM videos), "
    f"songs AS (SELECT page_id, pos, emotion, 'MUSIC' AS category, {_trim('title')} AS title, "
    f"{_trim('description')} AS description, image_url, '{vocab.WATCH_PREFIX}' || video_id AS content_url FROM items)"
)
_BOOKS = (
    "books AS (SELECT page_id, pos, emotion, 'BOOK' AS category, title, "
    f"title || ' | {vocab.AUTHOR_PREFIX}{vocab.NO_AUTHOR} | {vocab.NO_DESCRIPTION}' AS description, "
    "'' AS image_url, content_url FROM links WHERE title <> '' AND content_url <> '')"
)
_MOVIES = (
    "movies AS (SELECT page_id, pos, emotion, 'MOVIE' AS category, title, "
    f"title || ' | {vocab.NO_SYNOPSIS}' AS description, '' AS image_url, "
    f"CASE WHEN pos % 3 = 0 THEN '{vocab.MOVIE_SEARCH_PREFIX}' || {_form('title')} || '{vocab.MOVIE_SEARCH_SUFFIX}' "
    "ELSE content_url END AS content_url FROM links WHERE title <> '')"
)
# Songs, short-titled links as books, and links as activities.
_SOURCES = [
    _LINKS, _CLEAN, _VIDEOS, _BOOKS,
    "every_book AS (SELECT * FROM books)",
    f"sources AS (SELECT {_CLEAN_COLUMNS} FROM songs UNION ALL SELECT {_CLEAN_COLUMNS} FROM every_book "
    f"UNION ALL SELECT {_CLEAN_COLUMNS} FROM clean)",
]
_MOOD_PLACE = "CASE emotion " + " ".join(f"WHEN '{e}' THEN {i}" for i, e in enumerate(vocab.HARVEST_ORDER)) + " END"
_HARVEST = [
    *_SOURCES,
    "known AS (SELECT emotion, title, lower(title) AS key, content_url FROM catalogue)",
    "by_url AS (SELECT * FROM sources WHERE category <> 'ACTIVITY' "
    "AND content_url NOT IN (SELECT content_url FROM known WHERE content_url IS NOT NULL) "
    "QUALIFY row_number() OVER (PARTITION BY content_url ORDER BY CASE category WHEN 'MUSIC' THEN 0 ELSE 1 END, "
    f"{_MOOD_PLACE}, page_id, pos) = 1)",
    "taken AS (SELECT emotion, key, content_url FROM known UNION ALL "
    "SELECT emotion, lower(title), content_url FROM by_url)",
    "fresh AS (SELECT * FROM clean WHERE content_url NOT IN (SELECT content_url FROM taken WHERE content_url IS NOT NULL) "
    "QUALIFY row_number() OVER (PARTITION BY content_url ORDER BY place, page_id, pos) = 1)",
    "activities AS (SELECT * FROM fresh WHERE (emotion, key) NOT IN (SELECT emotion, key FROM taken) "
    "QUALIFY row_number() OVER (PARTITION BY emotion, key ORDER BY place, page_id, pos) = 1)",
    f"saved AS (SELECT {_CLEAN_COLUMNS} FROM by_url UNION ALL SELECT {_CLEAN_COLUMNS} FROM activities)",
]


def _sources(rest: str, tables: list[str]) -> str:
    return _with(sql("", "result_pages", "videos", "catalogue"), tables, rest)


_KNOWN_LABEL = "(" + ", ".join(f"'{e}'" for e in vocab.DIARY_EMOTIONS) + ")"
_ANSWER_TABLES = [
    "parsed AS (SELECT id, CASE WHEN contains(answer, '```') THEN trim(replace(replace(answer, '```json', ''), "
    "'```', ''), chr(10)) WHEN starts_with(answer, '{') THEN answer END AS body FROM answers)",
    "fields AS (SELECT id, body, json_extract_string(body, '$.emotion') AS label, "
    "json_type(body, '$.sentimentScore') AS kind, "
    "coalesce(json_extract_string(body, '$.sentimentScore'), json_extract_string(body, '$.score')) AS score_text, "
    "json_extract_string(body, '$.aiComment') AS comment FROM parsed)",
    "answered AS (SELECT id, body IS NOT NULL AND coalesce(kind, '') <> 'NULL' AS usable, label, "
    "coalesce(comment, '') AS comment, CAST(score_text AS DOUBLE) AS score FROM fields)",
    f"sentiments AS (SELECT id, CASE WHEN usable AND label IN {_KNOWN_LABEL} THEN label ELSE '{vocab.NEUTRAL}' END AS emotion, "
    "CASE WHEN usable THEN greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), score)) ELSE CAST(0 AS DOUBLE) END AS score, "
    "CASE WHEN usable THEN comment ELSE '' END AS ai_comment FROM answered)",
]

_REQUESTS = (
    "requests AS (SELECT event_id AS id, user_id AS member_id, event_type || ' ' || props AS content, ts "
    "FROM events WHERE event_id % 19 <> 0), "
    f"written AS (SELECT id, member_id, content, {_keyword_case('content', EVENT_RULES)} AS emotion, "
    f"{_score('id')} AS sentiment_score, ts + INTERVAL 9 HOUR AS now FROM requests)"
)

_CHANGES = [
    "valid AS (SELECT *, trim(content) = '' AS blank FROM changes)",
    "created AS (SELECT id, min(seq) AS create_seq FROM valid WHERE op = 'CREATE' AND NOT blank GROUP BY id)",
    "opened AS (SELECT c.* , v.member_id AS owner, v.ts AS create_ts, v.content, v.emoji, v.emotion, "
    "v.sentiment_score, v.ai_comment FROM created c JOIN valid v ON v.seq = c.create_seq)",
    "ended AS (SELECT v.id, min(v.seq) AS delete_seq FROM valid v JOIN opened o ON o.id = v.id "
    "WHERE v.op = 'DELETE' AND v.member_id = o.owner AND v.seq > o.create_seq GROUP BY v.id)",
    "life AS (SELECT o.*, e.delete_seq FROM opened o LEFT JOIN ended e ON e.id = o.id)",
    "judged AS (SELECT v.*, CASE WHEN v.op <> 'DELETE' AND v.blank THEN 'BLANK CONTENT' "
    "WHEN v.op = 'CREATE' THEN CASE WHEN v.seq <> l.create_seq THEN 'REPEATED CREATE' END "
    "WHEN l.create_seq IS NULL OR v.member_id <> l.owner OR v.seq < l.create_seq OR v.seq > l.delete_seq "
    "THEN 'NOT FOUND' WHEN v.op = 'UPDATE' AND v.date IS NULL THEN 'NO DATE' END AS reason "
    "FROM valid v LEFT JOIN life l ON l.id = v.id)",
    "accepted AS (SELECT * FROM judged WHERE reason IS NULL)",
    "latest AS (SELECT id, max(seq) FILTER (op = 'UPDATE') AS edit_seq, max(seq) AS last_seq FROM accepted GROUP BY id)",
]

_PRODUCT_LINES = [
    f"lines AS (SELECT p_partkey AS id, p_partkey % 7 AS kind, p_name, p_brand, CAST(p_partkey AS VARCHAR) AS k, "
    f"{csv_line('VARCHAR')} AS line FROM part)",
]

_STREAM_STATS = (
    "WITH " + _REQUESTS + ", months AS (SELECT *, CAST(date_trunc('month', now) AS DATE) AS month_start FROM written), "
    "moods AS (SELECT member_id, month_start, emotion, count(*) AS n FROM months GROUP BY ALL), "
    "texts AS (SELECT member_id, month_start, string_agg(emotion || '=' || n, ',' ORDER BY emotion) AS emotion_counts "
    "FROM moods GROUP BY ALL), record AS (SELECT member_id, month_start, count(*) AS total_count, "
    + _half_up("fsum(sentiment_score) / count(*)", 2) + " AS average_score FROM months GROUP BY ALL) "
    "SELECT r.member_id, r.month_start, total_count, average_score, emotion_counts FROM record r "
    "JOIN texts t ON t.member_id = r.member_id AND t.month_start = r.month_start"
)

_PLAIN = {c: e.replace("string_t", "VARCHAR") for c, e in JOIN_REQUEST.items()}
_EMAIL = f"{validation.LOCAL[:-1]}@{validation.DOMAIN[1:]}".replace("*+", "*").replace("++", "+")
_EMAIL = _EMAIL.replace("\\u0080-\\uFFFF", "\\x{80}-\\x{FFFF}")


def _blank(c: str) -> str:
    return f"({c} IS NULL OR {_trim(c)} = '')"


_VALIDATE = (
    "WITH requests AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in _PLAIN.items()) + " FROM customer), "
    "messages AS (SELECT id, concat_ws(', ', "
    f"CASE WHEN {_blank('email')} THEN '{vocab.EMAIL_REQUIRED}' END, "
    f"CASE WHEN email <> '' AND NOT (regexp_matches(email, '{_EMAIL.replace(chr(39), chr(39) * 2)}') "
    f"AND length(split_part(email, '@', 1)) <= 64) THEN '{vocab.EMAIL_FORMAT}' END, "
    f"CASE WHEN {_blank('password')} THEN '{vocab.PASSWORD_REQUIRED}' END, "
    f"CASE WHEN length(password) NOT BETWEEN 8 AND 20 THEN '{vocab.PASSWORD_LENGTH}' END, "
    "CASE WHEN NOT (regexp_matches(password, '^[A-Za-z0-9@$!%*#?&]{8,}$') AND regexp_matches(password, '[A-Za-z]') "
    f"AND regexp_matches(password, '[0-9]') AND regexp_matches(password, '[@$!%*#?&]')) THEN '{vocab.PASSWORD_PATTERN}' END, "
    f"CASE WHEN {_blank('nickname')} THEN '{vocab.NICKNAME_REQUIRED}' END, "
    f"CASE WHEN length(nickname) NOT BETWEEN 2 AND 20 THEN '{vocab.NICKNAME_LENGTH}' END) AS errors FROM requests) "
    "SELECT id, nullif(errors, '') AS errors FROM messages"
)

def _grid(asked: str, day: str) -> str:
    return _diaries(
        "SELECT member_id, month_start, CAST(cell // 7 AS INTEGER) AS week, CAST(cell % 7 AS INTEGER) AS dow, day, "
        "hit.id AS diary_id, hit.emotion AS emotion FROM (SELECT c.*, h AS hit FROM cells c LEFT JOIN hits h "
        "ON h.member_id = c.member_id AND h.month_start = c.month_start AND h.day = c.day)",
        more=(
            "asked AS (SELECT member_id, month_start, CAST(dayofweek(month_start) AS INTEGER) AS lead, "
            f"CAST(day(last_day(month_start)) AS INTEGER) AS days FROM ({asked})), "
            "numbered AS (SELECT *, unnest(generate_series(0, CAST(ceil((lead + days) / 7.0) AS INTEGER) * 7 - 1)) AS cell "
            "FROM asked), "
            "cells AS (SELECT member_id, month_start, cell, CASE WHEN cell - lead BETWEEN 0 AND days - 1 THEN "
            "month_start + CAST(cell - lead AS INTEGER) END AS day FROM numbered), "
            f"hits AS (SELECT member_id, month_start, {day} AS day, max(id) AS id, "
            "arg_max(emotion, id) AS emotion FROM active WHERE emotion IS NOT NULL AND created_at IS NOT NULL GROUP BY 1, 2, 3)"
        ),
    )


ORACLES: dict[str, str] = {
    "active_diaries": _diaries("SELECT id, member_id, date, emotion FROM active ORDER BY member_id, date, id"),
    "diaries_newest_first": _diaries("SELECT id, member_id, date, emotion FROM active ORDER BY member_id, date DESC, id"),
    "diary_detail": _diaries(
        "SELECT r.event_id AS request_id, r.user_id AS member_id, r.event_id + (r.event_id % 2) * 3 AS id, d.content, "
        "d.emotion, d.sentiment_score, d.date, d.id IS NOT NULL AS found FROM events r LEFT JOIN active d "
        "ON d.id = r.event_id + (r.event_id % 2) * 3 AND d.member_id = r.user_id"
    ),
    "diaries_in_month": _diaries(
        "SELECT id, member_id, date FROM active WHERE year(date) = 2024 AND month(date) = 5"
    ),
    "calendar_rows": _diaries(
        "SELECT id AS diary_id, member_id, strftime(created_at, '%Y-%m-%d') AS created_at, emotion FROM active "
        "WHERE year(date) = 2024 AND month(date) = 5"
    ),
    "month_grid": _grid(
        "SELECT DISTINCT member_id, month_start FROM active",
        "CAST(created_at AS DATE)",
    ),
    "requested_grid": _grid(
        "SELECT c_custkey AS member_id, make_date(2024, CAST(c_custkey % 12 + 1 AS INTEGER), 1) AS month_start FROM customer",
        "date",
    ),
    "diaries_with_member": sql(
        "SELECT d.id, d.member_id, d.date, d.emotion, m.nickname, m.provider FROM diaries d "
        "JOIN members m ON m.id = d.member_id", "diaries", "members"
    ),
    "diaries_emoji": sql(
        "SELECT id, shown_emotion, " + _case("shown_emotion", vocab.EMOTION_EMOJI, vocab.DEFAULT_EMOJI)
        + f" AS emotion_emoji FROM (SELECT id, coalesce(emotion, '{vocab.NEUTRAL}') AS shown_emotion FROM diaries)",
        "diaries",
    ),
    "duplicate_days": _diaries("SELECT member_id, date, count(*) AS n FROM active GROUP BY ALL HAVING count(*) > 1"),
    "public_diaries": sql(
        "SELECT id, member_id, content, emoji, emotion, sentiment_score, ai_comment, date, status, created_at, updated_at "
        "FROM diaries", "diaries"
    ),
    "public_recommendations": sql(
        "SELECT id, category, title, description, nullif(image_url, '') AS image_url, content_url FROM catalogue",
        "catalogue",
    ),
    "public_members": sql("SELECT id, email, nickname, provider, status FROM members", "members"),
    "monthly_stats": _diaries(
        f"SELECT member_id, month_start, count(*) AS total_count, {_MEAN} AS average_score, {_WIDE} FROM active GROUP BY ALL"
    ),
    "monthly_stats_map": _diaries(
        "SELECT r.member_id, r.month_start, total_count, average_score, coalesce(emotion_counts, '') AS emotion_counts "
        "FROM record r LEFT JOIN texts t ON t.member_id = r.member_id AND t.month_start = r.month_start",
        more=f"{_COUNTS}, {_RECORD}",
    ),
    "requested_stats": _diaries(
        "SELECT a.member_id, a.year, a.month, coalesce(total_count, 0) AS total_count, average_score, "
        "coalesce(emotion_counts, '') AS emotion_counts FROM asked a "
        "LEFT JOIN record r ON r.member_id = a.member_id AND r.month_start = a.month_start "
        "LEFT JOIN texts t ON t.member_id = a.member_id AND t.month_start = a.month_start",
        more=(
            f"{_COUNTS}, {_RECORD}, asked AS (SELECT c_custkey AS member_id, 2024 AS year, "
            "CAST(c_custkey % 12 + 1 AS INTEGER) AS month, make_date(2024, CAST(c_custkey % 12 + 1 AS INTEGER), 1) AS month_start "
            "FROM customer)"
        ),
    ),
    "emotion_counts": _diaries("SELECT * FROM counts", more=_COUNTS),
    "dominant_emotion": _diaries(
        "SELECT member_id, month_start, emotion, n FROM counts QUALIFY row_number() OVER (PARTITION BY member_id, "
        f"month_start ORDER BY n DESC, CASE emotion {_DOMINANT} ELSE 99 END, emotion) = 1", more=_COUNTS
    ),
    "emotion_share": _diaries(
        f"SELECT member_id, month_start, emotion, n, {_half_up('exact', 4)} AS share, "
        "CAST(floor(exact * 100 + 0.5) AS INTEGER) AS percent, CASE WHEN exact >= 0.05 THEN "
        "CAST(CAST(floor(exact * 100 + 0.5) AS INTEGER) AS VARCHAR) || '%' END AS label, "
        + _case("emotion", vocab.DASHBOARD_EMOJI, vocab.DEFAULT_EMOJI) + " || ' ' || emotion AS name FROM (SELECT *, "
        "n / CAST(sum(n) OVER (PARTITION BY member_id, month_start) AS DOUBLE) AS exact FROM counts)", more=_COUNTS
    ),
    "score_gauge": _diaries(
        "SELECT member_id, month_start, average_score, "
        "CAST(floor((average_score + 1) / 2 * 100 + 0.5) AS INTEGER) AS percent, "
        "CASE WHEN average_score >= 0.3 THEN 'HIGH' WHEN average_score >= -0.1 THEN 'MIDDLE' ELSE 'LOW' END AS band "
        "FROM record WHERE average_score IS NOT NULL", more=f"{_COUNTS}, {_RECORD}"
    ),
    "table_counts": sql(
        "SELECT 'diaries' AS table_name, count(*) AS n FROM diaries UNION ALL SELECT 'members', count(*) FROM members "
        "UNION ALL SELECT 'catalogue', count(*) FROM catalogue", "diaries", "members", "catalogue"
    ),
    "catalogue_by_emotion": sql(f"SELECT * FROM catalogue WHERE emotion = '{vocab.ANGER}'", "catalogue"),
    "catalogue_by_url": sql("SELECT * FROM catalogue WHERE content_url = 'https://shop.example.com/7'", "catalogue"),
    "category_counts": sql("SELECT category, count(*) AS n FROM catalogue GROUP BY category", "catalogue"),
    "catalogue_icons": sql(
        "SELECT id, category, " + _case("category", vocab.CATEGORY_ICON, vocab.DEFAULT_ICON) + " AS icon FROM catalogue",
        "catalogue",
    ),
    "pick_per_category": sql(
        "SELECT * FROM catalogue QUALIFY row_number() OVER (PARTITION BY emotion, category "
        f"ORDER BY md5('{SEED}:' || CAST(id AS VARCHAR)), id) = 1", "catalogue"
    ),
    "recommend_for_diaries": _diaries(
        "SELECT d.id AS diary_id, d.member_id, d.emotion, p.category, p.id AS recommendation_id, p.title "
        "FROM active d JOIN picks p ON p.emotion = d.emotion", "catalogue",
        more=(
            "picks AS (SELECT * FROM catalogue QUALIFY row_number() OVER (PARTITION BY emotion, category "
            f"ORDER BY md5('{SEED}:' || CAST(id AS VARCHAR)), id) = 1)"
        ),
    ),
    "emotion_coverage": _diaries(
        "SELECT coalesce(w.emotion, o.emotion) AS emotion, coalesce(w.n, 0) AS diaries, coalesce(o.n, 0) AS recommendations, "
        "CASE WHEN o.n IS NULL THEN 'NO RECOMMENDATION' WHEN w.n IS NULL THEN 'NO DIARY' ELSE 'BOTH' END AS coverage "
        "FROM (SELECT emotion, count(*) AS n FROM active WHERE emotion IS NOT NULL GROUP BY emotion) w "
        "FULL JOIN (SELECT emotion, count(*) AS n FROM catalogue GROUP BY emotion) o ON o.emotion = w.emotion", "catalogue"
    ),
    "replace_category": _with(
        sql("", "catalogue", "videos"), [_VIDEOS],
        "SELECT * FROM catalogue WHERE category <> 'MUSIC' UNION ALL SELECT page_id AS id, emotion, category, title, "
        "description, image_url, content_url FROM songs",
    ),
    "csv_catalogue_rows": _with("WITH " + _PRODUCT_LINES[0], [], (
        "SELECT id, CASE kind WHEN 0 THEN '기쁨' WHEN 1 THEN '슬픔' ELSE '불안' END AS emotion, "
        "CASE kind WHEN 0 THEN 'MUSIC' WHEN 1 THEN 'BOOK' ELSE 'HOBBY' END AS category, "
        "CASE kind WHEN 1 THEN p_name || ', ' || k ELSE p_name END AS title, "
        "CASE kind WHEN 1 THEN 'a \"' || p_brand || '\" b' ELSE p_brand END AS description, "
        "CASE kind WHEN 3 THEN 'i' || k END AS image_url, "
        "CASE kind WHEN 0 THEN 'https://a.example/' || k WHEN 3 THEN 'u' END AS content_url "
        "FROM lines WHERE kind IN (0, 1, 3)"
    )),
    "member_lookup": sql(
        "SELECT id, email FROM members WHERE email IN (SELECT 'user' || CAST(s_suppkey AS VARCHAR) || '@example.com' "
        "FROM supplier)", "members"
    ),
    "admit_members": (
        "WITH requests AS (SELECT c_custkey AS request_id, 'user' || CAST(c_custkey % 1000 AS VARCHAR) || '@example.com' "
        "AS email, c_name AS nickname FROM customer), present AS (SELECT 'user' || CAST(s_suppkey * 3 AS VARCHAR) || "
        "'@example.com' AS email FROM supplier) SELECT request_id, email, nickname, CASE WHEN row_number() OVER "
        "(PARTITION BY email ORDER BY request_id) = 1 AND email NOT IN (SELECT email FROM present) THEN 'ADMITTED' "
        "ELSE 'CONFLICT' END AS outcome FROM requests"
    ),
    "nickname_changes": sql(
        "SELECT m.id, m.email, coalesce(l.nickname, m.nickname) AS nickname FROM members m LEFT JOIN (SELECT user_id, "
        "arg_max('nick ' || event_type || ' ' || CAST(event_id AS VARCHAR), event_id) AS nickname FROM events "
        "GROUP BY user_id) l ON l.user_id = m.id", "members"
    ),
    "validate_rows": _VALIDATE,
    "validate_texts": sql(
        f"SELECT seq, content AS text, CASE WHEN {_blank('content')} THEN '{vocab.TEXT_REQUIRED.replace(chr(39), chr(39) * 2)}' "
        "END AS errors FROM changes", "changes"
    ),
    "harvest_links": _pages("SELECT page_id, pos, emotion, title, content_url FROM links"),
    "clean_links": _pages(f"SELECT {_CLEAN_COLUMNS} FROM clean", _CLEAN),
    "clean_books": _pages(f"SELECT {_CLEAN_COLUMNS} FROM books", _BOOKS),
    "clean_movies": _pages(f"SELECT {_CLEAN_COLUMNS} FROM movies", _MOVIES),
    "video_items": _with(sql("", "videos"), [_VIDEOS], "SELECT * FROM items"),
    "clean_videos": _with(sql("", "videos"), [_VIDEOS], f"SELECT {_CLEAN_COLUMNS} FROM songs"),
    "clean_videos_raw": _with(
        sql("", "videos"), [_VIDEOS],
        "SELECT page_id, pos, emotion, 'MUSIC' AS category, title, description, image_url, "
        f"'{vocab.WATCH_PREFIX}' || video_id AS content_url FROM items",
    ),
    "frontier_urls": sql(
        " UNION ALL ".join(
            f"SELECT id, emotion, title AS phrase, '{base}{before}' || {encode('title')} || '{after}' AS url, "
            f"'{source}' AS source FROM catalogue"
            for source, base, encode in [
                ("MUSIC", "https://api.example.com", _query), ("BOOK", "", _form), ("MOVIE", "", _form),
                ("ACTIVITY", "", _form),
            ]
            for before, after in [vocab.SEARCH_ADDRESS[source]]
        ), "catalogue"
    ),
    "new_by_url": _pages(
        f"SELECT {_CLEAN_COLUMNS} FROM first_url", _CLEAN, _EARLIER, _FIRST_URL.format(known="earlier")
    ),
    "new_by_title": _pages(
        f"SELECT {_CLEAN_COLUMNS} FROM first_title", _CLEAN, _EARLIER, _FIRST_URL.format(known="earlier"),
        _FIRST_TITLE.format(known="earlier"),
    ),
    "all_candidates": _sources("SELECT * FROM sources", _SOURCES),
    "harvest": _sources("SELECT * FROM saved", _HARVEST),
    "harvest_report": _sources(
        "SELECT f.category, f.emotion, f.n AS found, coalesce(s.n, 0) AS saved, f.n - coalesce(s.n, 0) AS skipped FROM "
        "(SELECT category, emotion, count(*) AS n FROM sources GROUP BY ALL) f LEFT JOIN "
        "(SELECT category, emotion, count(*) AS n FROM saved GROUP BY ALL) s "
        "ON s.category = f.category AND s.emotion = f.emotion", _HARVEST
    ),
    "model_answers": _with(sql("", "answers"), _ANSWER_TABLES, "SELECT * FROM sentiments"),
    "envelope_answers": _with(
        sql("", "answers"), _ANSWER_TABLES,
        f"SELECT id, CASE WHEN id % 10 < 2 THEN '{vocab.NEUTRAL}' ELSE emotion END AS emotion, "
        "CASE WHEN id % 10 < 2 THEN CAST(0 AS DOUBLE) ELSE score END AS score, "
        "CASE id % 10 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE ai_comment END AS ai_comment FROM sentiments",
    ),
    "keyword_mood": (
        f"SELECT doc_id, {_keyword_case('text', DOCUMENT_RULES)} AS emotion, {_score('doc_id')} AS score, "
        "CAST(NULL AS VARCHAR) AS ai_comment FROM documents"
    ),
    "enriched_diaries": (
        f"WITH {_REQUESTS} SELECT id, member_id, content, CAST(NULL AS VARCHAR) AS emoji, emotion, sentiment_score, "
        "CAST(NULL AS VARCHAR) AS ai_comment, CAST(now AS DATE) AS date, 'ACTIVE' AS status, now AS created_at, "
        "now AS updated_at FROM written"
    ),
    "current_diaries": _with(
        sql("", "changes"), _CHANGES,
        "SELECT l.id, l.owner AS member_id, CASE WHEN e.seq IS NULL THEN l.content ELSE e.content END AS content, "
        "CASE WHEN e.seq IS NULL THEN l.emoji ELSE e.emoji END AS emoji, l.emotion, l.sentiment_score, l.ai_comment, "
        "CASE WHEN e.seq IS NULL THEN CAST(l.create_ts + INTERVAL 9 HOUR AS DATE) ELSE e.date END AS date, "
        "CASE WHEN l.delete_seq IS NULL THEN 'ACTIVE' ELSE 'DELETED' END AS status, "
        "l.create_ts + INTERVAL 9 HOUR AS created_at, z.ts + INTERVAL 9 HOUR AS updated_at FROM life l "
        "JOIN latest t ON t.id = l.id LEFT JOIN changes e ON e.seq = t.edit_seq JOIN changes z ON z.seq = t.last_seq",
    ),
    "change_rejects": _with(
        sql("", "changes"), _CHANGES, "SELECT seq, id, member_id, op, reason FROM judged WHERE reason IS NOT NULL"
    ),
    "text_scalars": (
        f"SELECT doc_id, {_trim('text')} AS trimmed, substr(text, 1, 200) AS cut, CASE WHEN length(text) > 100 THEN "
        f"substr(text, 1, 100) || '...' ELSE text END AS snippet, lower({_trim('text')}) AS title_key, "
        f"{_form('text')} AS form, {_query('text')} AS query, lang || ' | ' || source AS joined, "
        "contains(text, ' the ') OR contains(text, ' der ') AS hit, CAST(length(text) AS INTEGER) AS n_chars, "
        f"'{vocab.MOVIE_SEARCH_PREFIX}' || {_form('source')} || '{vocab.MOVIE_SEARCH_SUFFIX}' AS search_url, "
        f"'{vocab.WATCH_PREFIX}' || lang AS watch_url FROM documents"
    ),
    "page_titles": (
        f"SELECT page_id, {_TITLE} AS title, {_SITE} || '/favicon.ico' AS icon, "
        "regexp_extract(url, '^[^:]+:') || '//cdn.example.com/x.png' AS image, "
        f"{_SITE} AS site FROM (SELECT *, regexp_extract(html, '<title>([^<]*)</title>', 1) AS raw_title FROM pages)"
    ),
    "date_scalars": sql(
        "SELECT id, strftime(date, '%Y-%m-%d') AS key, CAST(created_at + INTERVAL 9 HOUR AS DATE) AS seoul_day, "
        "CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, "
        "CAST(date_trunc('month', date) AS DATE) AS first_day, CAST(day(last_day(date)) AS INTEGER) AS days_in_month, "
        "CAST(dayofweek(date_trunc('month', date)) AS INTEGER) AS first_weekday, "
        "CAST(date_trunc('month', date) - INTERVAL 1 MONTH AS DATE) AS previous_month, "
        "CAST(date_trunc('month', date) + INTERVAL 1 MONTH AS DATE) AS next_month, "
        "year(date) || ' 년 ' || month(date) || ' 월' AS calendar_label, "
        "year(date) || '년 ' || month(date) || '월' AS month_label, "
        "year(date) || '년 ' || month(date) || '월 ' || day(date) || '일 (' || "
        f"substr('{''.join(vocab.WEEKDAYS)}', CAST(dayofweek(date) AS INTEGER) + 1, 1) || ')' AS long_label FROM diaries",
        "diaries",
    ),
    "number_scalars": (
        f"SELECT event_id, {_half_up('value / 16', 2)} AS two_places, {_half_up('value - 10')} AS whole, "
        "greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), value / 16 - CAST(0.5 AS DOUBLE))) AS clamped, "
        f"round_even(event_id / CAST(1024 AS DOUBLE), 4) AS four_places, {_score('event_id')} AS score FROM events"
    ),
    "stream_diaries": _STREAM_STATS,
    "stream_catalogue": _with(
        sql("", "result_pages", "catalogue"),
        [
            _LINKS, _CLEAN, _EARLIER,
            "seeded AS (SELECT * FROM earlier WHERE content_url NOT IN "
            "(SELECT content_url FROM catalogue WHERE content_url IS NOT NULL))",
            _FIRST_URL.format(known="seeded"), _FIRST_TITLE.format(known="seeded"),
        ],
        "SELECT emotion, category, title, content_url FROM first_title",
    ),
}

# What is stored is what was given.
ORACLES["loaded_tables"] = sql(
    "SELECT 'diaries' AS table_name, id FROM diaries UNION ALL SELECT 'members', id FROM members "
    "UNION ALL SELECT 'recommendations', id FROM catalogue", "diaries", "members", "catalogue"
)
ORACLES["appended_diaries"] = sql(
    "SELECT id, member_id, date, CAST(date_trunc('month', date) AS DATE) AS month FROM diaries", "diaries"
)
ORACLES["seeded_catalogue"] = ORACLES["csv_catalogue_rows"]
ORACLES["overwritten_category"] = ORACLES["replace_category"]

# Parts of the change log give what the whole gives.
ORACLES["diaries_by_parts"] = ORACLES["diaries_from_merged_parts"] = ORACLES["current_diaries"]
ORACLES["rejects_by_parts"] = ORACLES["change_rejects"]


def _shop(category: str, limit: int, *items: str) -> str:
    """Clean rows from the parts themselves; an item is its place, title, what precedes the text, text, image, address."""
    about = "CASE WHEN length(about) > {0} THEN substr(about, 1, {0}) || '...' ELSE about END".format(limit)
    found = " UNION ALL ".join(f"SELECT p_partkey AS page_id, {item} FROM part" for item in items)
    return (
        f"SELECT page_id, pos, '기쁨' AS emotion, '{category}' AS category, title, "
        f"title || ' | ' || before || {about} AS description, image_url, content_url FROM ({found})"
    )


def _shop_item(pos: int, title: str, before: str, about: str, image: str, url: str) -> str:
    return (
        f"{pos} AS pos, {title} AS title, {before} AS before, {about} AS about, {image} AS image_url, {url} AS content_url"
    )


_SHOP = "'https://shop.example.com/"
_KEY = " || CAST(p_partkey AS VARCHAR)"
ORACLES["book_pages"] = _shop(
    "BOOK", vocab.BOOK_SNIPPET,
    _shop_item(0, "p_name || ' in tail é'", f"'{vocab.AUTHOR_PREFIX}' || p_brand || ' | '", LONG_TEXT, f"{_SHOP}b/'{_KEY} || '.png'", f"{_SHOP}book/'{_KEY}"),
    _shop_item(1, "p_type || ' & more'", f"'{vocab.AUTHOR_PREFIX}{vocab.NO_AUTHOR} | '", f"'{vocab.NO_DESCRIPTION}'", "''", f"{_SHOP}more?p='{_KEY}"),
)
ORACLES["movie_pages"] = _shop(
    "MOVIE", vocab.MOVIE_SNIPPET,
    _shop_item(0, "p_name", "''", LONG_TEXT, f"{_SHOP}i/'{_KEY} || '.png'", f"{_SHOP}m/'{_KEY}"),
    _shop_item(1, "p_brand || ' & more'", "''", LONG_TEXT, f"{_SHOP}i/'{_KEY} || '.png'", f"{_SHOP}n/'{_KEY}"),
    # Image and text of this one's list item are not in the element that the link is in.
    _shop_item(2, "p_name || ' in tail'", "''", "p_type", "''", f"{_SHOP}q/'{_KEY}"),
    _shop_item(3, "p_brand", "''", f"'{vocab.NO_SYNOPSIS}'", "''", f"'https://o.example/'{_KEY}"),
)
ORACLES["activity_pages"] = _shop(
    "ACTIVITY", vocab.ACTIVITY_SNIPPET,
    _shop_item(0, "p_name", "''", LONG_TEXT, "''", f"{_SHOP}a/'{_KEY}"),
    _shop_item(2, "p_brand || ' box'", "''", f"'{vocab.NO_DESCRIPTION}'", f"{_SHOP}w.png'", f"{_SHOP}w/'{_KEY}"),
) + f" WHERE length(title) > {vocab.SHORT_TITLE}"
