"""The driver's tables in the shapes of the diary application.

Each view is a set of expressions that Spark and DuckDB both understand, so a query and its check
start from the same rows.
"""

from pyspark.sql import DataFrame, SparkSession

_SHIFTED = "ts + INTERVAL '9' HOUR + CAST(30 * (event_id % 12) AS INT) * INTERVAL '1' DAY"

LONG_TEXT = "CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE repeat(p_brand, 20) END"

# view -> (table, {column: expression}); string_t stands for the engine's string type
VIEWS = {
    "diaries": ("events", {
        "id": "event_id",
        "member_id": "user_id",
        "content": "concat('entry ', CAST(event_id AS string_t))",
        "emoji": "CASE WHEN event_id % 5 = 0 THEN NULL ELSE '📝' END",
        "emotion": (
            "CASE WHEN event_id % 13 = 0 THEN NULL ELSE CASE event_type WHEN 'purchase' THEN '기쁨' "
            "WHEN 'view' THEN '슬픔' WHEN 'error' THEN '분노' WHEN 'signup' THEN '불안' "
            "WHEN 'click' THEN '중립' END END"
        ),
        "sentiment_score": (
            "CASE WHEN event_id % 7 = 0 THEN NULL ELSE least(CAST(1 AS DOUBLE), floor(value) / 128) END"
        ),
        "ai_comment": "CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('comment ', event_type) END",
        "date": f"CAST({_SHIFTED} AS DATE)",
        "status": "CASE WHEN event_id % 11 = 0 THEN 'DELETED' ELSE 'ACTIVE' END",
        "created_at": _SHIFTED,
        "updated_at": f"{_SHIFTED} + INTERVAL '1' HOUR",
    }),
    "members": ("customer", {
        "id": "c_custkey",
        "email": "concat('user', CAST(c_custkey % 1000 AS string_t), '@example.com')",
        "nickname": "c_name",
        "provider": (
            "CASE c_custkey % 4 WHEN 0 THEN 'LOCAL' WHEN 1 THEN 'GOOGLE' WHEN 2 THEN 'KAKAO' ELSE 'NAVER' END"
        ),
        "status": "CASE WHEN c_acctbal < 0 THEN 'INACTIVE' ELSE 'ACTIVE' END",
        "login_fail_count": "0",
    }),
    "catalogue": ("part", {
        "id": "p_partkey",
        "emotion": (
            "CASE p_partkey % 5 WHEN 0 THEN '기쁨' WHEN 1 THEN '슬픔' WHEN 2 THEN '분노' "
            "WHEN 3 THEN '불안' ELSE '무기력' END"
        ),
        "category": (
            "CASE p_type WHEN 'STANDARD' THEN 'MUSIC' WHEN 'PROMO' THEN 'MOVIE' WHEN 'SMALL' THEN 'BOOK' "
            "WHEN 'LARGE' THEN 'ACTIVITY' ELSE 'HOBBY' END"
        ),
        "title": "concat(p_name, ' ', CAST(p_partkey AS string_t))",
        "description": "p_brand",
        "image_url": "CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE concat('https://img.example.com/', p_brand) END",
        "content_url": (
            "CASE WHEN p_partkey % 6 = 0 THEN NULL "
            "ELSE concat('https://shop.example.com/', CAST(p_partkey % 900 AS string_t)) END"
        ),
    }),
    "answers": ("events", {
        "id": "event_id",
        "answer": (
            "CASE event_id % 6 "
            "WHEN 0 THEN concat('{\"emotion\": \"기쁨\", \"sentimentScore\": ', "
            "CAST(event_id % 150 AS string_t), 'e-2, \"aiComment\": \"c\"}') "
            "WHEN 1 THEN concat('```json', chr(10), '{\"emotion\": \"슬픔\", \"score\": 0.5, \"aiComment\": \"c\"}', "
            "chr(10), '```') "
            "WHEN 2 THEN 'no json here' "
            "WHEN 3 THEN '{\"emotion\": \"other\", \"sentimentScore\": 0.25}' "
            "WHEN 4 THEN '{\"sentimentScore\": \"0.75\"}' "
            "ELSE '{\"emotion\": \"불안\", \"sentimentScore\": null, \"score\": 0.9}' END"
        ),
    }),
    "videos": ("part", {
        "id": "p_partkey",
        "body": (
            "concat('{\"items\":[{\"id\":{\"videoId\":\"v', CAST(p_partkey % 1500 AS string_t), "
            "'\"},\"snippet\":{\"title\":\" ', p_name, ' \",\"description\":\"', p_brand, "
            "'\",\"thumbnails\":{\"high\":{\"url\":\"https://img.example.com/', "
            "CAST(p_partkey AS string_t), '.jpg\"}}}}]}')"
        ),
    }),
    "changes": ("events", {
        "seq": "event_id",
        "id": "event_id % 400",
        "member_id": "CASE WHEN event_id % 17 = 0 THEN user_id ELSE (event_id % 400) % 150 END",
        "ts": "ts",
        "op": (
            "CASE WHEN event_type = 'signup' THEN 'DELETE' WHEN event_type = 'purchase' THEN 'CREATE' "
            "ELSE 'UPDATE' END"
        ),
        "content": (
            "CASE WHEN event_id % 29 = 0 THEN '  ' ELSE concat('text ', CAST(event_id AS string_t)) END"
        ),
        "emoji": "CASE WHEN event_id % 3 = 0 THEN NULL ELSE '📝' END",
        "date": "CASE WHEN event_id % 31 = 0 THEN NULL ELSE CAST(ts AS DATE) END",
        "emotion": "CASE event_id % 4 WHEN 0 THEN '기쁨' WHEN 1 THEN '슬픔' WHEN 2 THEN '중립' ELSE NULL END",
        "sentiment_score": "CAST(event_id % 128 AS DOUBLE) / 128",
        "ai_comment": "event_type",
    }),
    "result_pages": ("pages", {
        "page_id": "page_id",
        "url": "url",
        "html": "html",
        # One mood per site, by the length of its address.
        "emotion": (
            "CASE length(regexp_extract(url, '^([^:]+://[^/?#]*)', 1)) % 5 WHEN 0 THEN '기쁨' WHEN 1 THEN '슬픔' "
            "WHEN 2 THEN '분노' WHEN 3 THEN '불안' ELSE '무기력' END"
        ),
        "phrase_index": "0",
    }),
    # Result pages as the three sites lay them out: menus outside the scope, lazy images, several links, missing parts.
    "shop_pages": ("part", {
        "page_id": "p_partkey",
        "url": "'https://shop.example.com/list?q=1'",
        "emotion": "'기쁨'",
        "phrase_index": "0",
        "book_html": (
            "concat('<div class=\"prod_area x\"><div class=\"img_box\"><img src=\"/s.png\" data-src=\"/b/', "
            "CAST(p_partkey AS string_t), '.png\"></div><a class=\"prod_info\" href=\"/book/', CAST(p_partkey AS string_t), "
            "'\"><span class=\"prod_category\">[x]</span><span id=\"cmdtName_1\">', p_name, ' <span>in</span> tail &eacute;</span></a>"
            "<span class=\"author\">', p_brand, '</span><p class=\"desc\">', " + LONG_TEXT + ", '</p></div>"
            "<div class=\"prod_area\"><a class=\"prod_info\" href=\"more?p=', CAST(p_partkey AS string_t), '\"><span>', "
            "p_type, ' &amp; more</span></a></div><div class=\"prod_area\"><a class=\"prod_info\"><span>no address</span></a></div>')"
        ),
        "movie_html": (
            "concat('<div><ul><li><a class=\"link_txt\" href=\"/menu\">menu</a></li></ul></div><div class=\"coll_cont\"><div><ul>"
            "<li><img src=\"/s.png\" data-src=\"/i/', CAST(p_partkey AS string_t), '.png\"><a class=\"link_txt\" href=\"/m/', "
            "CAST(p_partkey AS string_t), '\">', p_name, '</a><a href=\"/no\">no</a><a class=\"f link_txt\" href=\"n/', "
            "CAST(p_partkey AS string_t), '\">', p_brand, ' &amp; more</a><p class=\"desc\">', " + LONG_TEXT + ", "
            "'</p></li><li><div><img src=\"/far.png\"></div><p class=\"desc\">far</p><span><a class=\"link_txt\" href=\"/q/', "
            "CAST(p_partkey AS string_t), '\">', p_name, ' <b><i>in</i></b> tail</a><b><p class=\"desc\">', p_type, '</p></b></span></li>"
            "</ul></div></div><div class=\"info_tit\"><a href=\"//o.example/', CAST(p_partkey AS string_t), '\">', "
            "p_brand, '</a></div>')"
        ),
        "activity_html": (
            "concat('<div><ul><li><a class=\"link_txt\" href=\"/menu\">menu of things</a></li></ul></div><div class=\"coll_cont\">"
            "<ul><li><a class=\"f_link_b\" href=\"/a/', CAST(p_partkey AS string_t), '\">', p_name, '</a><div class=\"desc\">', "
            + LONG_TEXT + ", '</div></li><li><a class=\"link_txt\" href=\"/s\">short</a></li></ul></div>"
            "<div class=\"wrap_cont\"><a class=\"link_txt\" href=\"/w/', CAST(p_partkey AS string_t), '\">', p_brand, "
            "' box</a><img src=\"w.png\"></div>')"
        ),
    }),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shape(df: DataFrame, name: str) -> DataFrame:
    """The view's columns computed from a driver table; works on a stream too."""
    columns = VIEWS[name][1]
    return df.selectExpr(*[f"{e.replace('string_t', 'STRING')} AS {c}" for c, e in columns.items()])


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return shape(table(spark, sf_dir, VIEWS[name][0]), name)


def view_sql(name: str) -> str:
    """The same view as a DuckDB query."""
    source, columns = VIEWS[name]
    selected = ", ".join(f"{e.replace('string_t', 'VARCHAR')} AS {c}" for c, e in columns.items())
    return f"SELECT {selected} FROM {source}"


def sql(query: str, *names: str) -> str:
    """A DuckDB query over views, spelled out as common table expressions."""
    return "WITH " + ", ".join(f"{n} AS ({view_sql(n)})" for n in names) + " " + query
