"""Seed files, result pages, video answers, search addresses, tables and sinks."""

import json

import pytest
from pyspark.sql import functions as F

from moodspark import schemas, vocab
from moodspark.operators.candidates import clean_candidates
from moodspark.sources import csv_catalogue, frontier, pages, sinks, tables, video_search

HEADER = "emotion,category,title,description,imageUrl,contentUrl"


def parsed(spark, tmp_path, *lines):
    path = tmp_path / "seed.csv"
    path.write_text("\n".join([HEADER, *lines]) + "\n", encoding="utf-8")
    return [tuple(r) for r in csv_catalogue.read_catalogue_csv(spark, str(path)).collect()]


@pytest.mark.parametrize("line, expected", [
    ("a,b,c,d,e,f", ("a", "b", "c", "d", "e", "f")),
    (" a , b ,\tc, d ,,", ("a", "b", "c", "d", None, None)),
    ('a,b,"c, c","d ""d"" d",,f', ("a", "b", "c, c", 'd "d" d', None, "f")),
    ("a,b,c,d,e,f,g", ("a", "b", "c", "d", "e", "f")),
    ("a,b,c,d,e", None),
    ('a,b,"""x""",d,e,f', ("a", "b", "x", "d", "e", "f")),
    ('a,b,"""",d,e,f', None),
    ('"""",b,c,d,e,f', ('"', "b", "c", "d", "e", "f")),
    ('a,b,c,"d,e,f', None),
    ('a,b,c,d,e,"f,g', ("a", "b", "c", "d", "e", "f,g")),
    ('a,b,x"c,c"y,d,e,f', ("a", "b", "xc,cy", "d", "e", "f")),
    ("   ", None),
    ("", None),
    (",,,,,", ("", "", "", "", None, None)),
    ("\\,b,\"c\\\",d,e,f", ("\\", "b", "c\\", "d", "e", "f")),
    ("#a,b,c,d,e,f", ("#a", "b", "c", "d", "e", "f")),
])
def test_csv_line(spark, tmp_path, line, expected):
    assert parsed(spark, tmp_path, line) == ([expected] if expected else [])


def test_csv_keeps_every_line_and_long_fields(spark, tmp_path):
    long = "가" * 200_000
    rows = parsed(spark, tmp_path, f'a,b,"{long}",d,,', "", *[f"a,b,t{i},d,," for i in range(50)])
    assert len(rows) == 51 and max(len(r[2]) for r in rows) == 200_000


def test_seeding_happens_once(spark, tmp_path):
    path = str(tmp_path / "catalogue")
    none = spark.createDataFrame([], schemas.RECOMMENDATIONS)
    seed = spark.createDataFrame([(1, vocab.JOY, "BOOK", "t", "d", None, None)], schemas.RECOMMENDATIONS)
    assert sinks.seed_if_empty(none, seed, path)
    stored = spark.read.parquet(path)
    assert not sinks.seed_if_empty(stored, seed, path)
    assert spark.read.parquet(path).count() == 1


def test_one_category_is_replaced(spark, tmp_path):
    path = str(tmp_path / "catalogue")
    rows = spark.createDataFrame(
        [(i, vocab.JOY, c, "t", "d", None, None) for i, c in enumerate(["BOOK", "BOOK", "MUSIC"])], schemas.RECOMMENDATIONS
    )
    sinks.append_catalogue(rows, path)
    sinks.overwrite_category(rows.limit(1).withColumn("id", F.lit(7).cast("bigint")), "BOOK", path)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [2, 7]


def test_tables_load_with_fixed_schemas(spark, tmp_path):
    for name, schema in schemas.TABLES.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / name))
    loaded = tables.load_tables(spark, str(tmp_path))
    assert {n: df.columns for n, df in loaded.items()} == {n: s.fieldNames() for n, s in schemas.TABLES.items()}


def test_database_reads_never_name_the_password():
    options = tables.database_options("jdbc:x", "members", 1, 1000, 8)
    assert "password" not in options["dbtable"] and options["partitionColumn"] == "id"
    with pytest.raises(ValueError):
        tables.database_options("jdbc:x", "members; drop", 1, 2, 1)


BOOKS = """
<div class="prod_area horizontal"><div class="img_box"><img src="/s.png" data-src="/lazy.png"></div>
<a class="prod_info" href="/book/1"><span class="prod_category">[국내]</span><span id="cmdtName_1">첫 &amp; 책</span></a>
<span class="author rep">글쓴이</span><p class="desc">짧은 <b>글</b></p></div>
<div class="prod_area"><a href='https://o.example/2' class='prod_info'><span>둘째</span></a>
<div class="img_box"><a href="#"><img src="x.png"></a></div><p class="desc_area">{long}</p></div>
<div class="prod_area"><a class="prod_info"><span>주소 없음</span></a></div>
<div class="prod_area"><a class="prod_info" href="/4"></a></div>
<div class="prod_areas"><a class="info" href="/5"><span>x</span></a></div>
"""
MOVIES = """
<div class="coll_cont"><ul>
<li><img src="/p.jpg"><a class="link_txt f" href="/m/1">첫 영화</a><p class="desc">줄거리</p></li>
<li><a class="other" href="/no">아님</a></li>
<!-- <li><a class="link_txt" href="/c">주석</a></li> --><script>"<li><a class='link_txt'>x</a></li>"</script>
<LI><A CLASS=link_txt>주소 없는 영화</A></LI></ul></div>
<div class="info_tit"><strong>x</strong><a href=/m/2?a=1&amp;b=2>둘째</a></div>
"""
ACTIVITIES = """
<div class="coll_cont"><ul><li><a class="f_link_b" href="/a/1">여섯 글자야</a><div class="desc">설명</div></li>
<li><a class="link_txt" href="/a/2">다섯글자야</a></li></ul></div>
<div class="wrap_cont"><a href="/x">y</a><a class="link_txt" href="/a/3">상자 안의 활동</a><img data-src="//c.example/i.png"></div>
"""


def page(spark, html):
    return spark.createDataFrame(
        [(1, "https://h.example/s?q=1", html, vocab.JOY, 0)],
        "page_id bigint, url string, html string, emotion string, phrase_index int",
    )


def test_book_page(spark):
    found = pages.extract_candidates(page(spark, BOOKS.replace("{long}", "y" * 101)), pages.BOOK_PAGE).orderBy("pos")
    rows = [(r["title"], r["author"], r["description"], r["image_url"], r["content_url"]) for r in found.collect()]
    assert rows == [
        ("첫 & 책", "글쓴이", "짧은 글", "https://h.example/lazy.png", "https://h.example/book/1"),
        ("둘째", None, "y" * 101, "https://h.example/x.png", "https://o.example/2"),
        ("주소 없음", None, None, None, None),
        (None, None, None, None, "https://h.example/4"),
    ]
    clean = clean_candidates(found, "BOOK").orderBy("ord").collect()
    assert [r["title"] for r in clean] == ["첫 & 책", "둘째"]
    assert clean[0]["description"] == "첫 & 책 | 저자: 글쓴이 | 짧은 글"
    assert clean[1]["description"] == "둘째 | 저자: 저자 정보 없음 | " + "y" * 100 + "..."


def test_movie_page(spark):
    found = pages.extract_candidates(page(spark, MOVIES), pages.MOVIE_PAGE)
    clean = clean_candidates(found, "MOVIE").orderBy("ord").collect()
    assert [(r["title"], r["content_url"]) for r in clean] == [
        ("첫 영화", "https://h.example/m/1"),
        ("주소 없는 영화", "https://search.daum.net/search?w=tot&q=%EC%A3%BC%EC%86%8C+%EC%97%86%EB%8A%94+%EC%98%81%ED%99%94+영화"),
        ("둘째", "https://h.example/m/2?a=1&b=2"),
    ]
    assert (clean[0]["image_url"], clean[0]["description"]) == ("https://h.example/p.jpg", "첫 영화 | 줄거리")
    assert clean[2]["description"] == "둘째 | 줄거리 정보 없음"


def test_activity_page(spark):
    found = pages.extract_candidates(page(spark, ACTIVITIES), pages.ACTIVITY_PAGE)
    clean = clean_candidates(found, "ACTIVITY").orderBy("ord").collect()
    assert [(r["title"], r["image_url"]) for r in clean] == [
        ("여섯 글자야", ""), ("상자 안의 활동", "https://c.example/i.png"),
    ]
    assert clean[0]["description"] == "여섯 글자야 | 설명"


def test_long_pages_do_not_exhaust_the_stack(spark):
    filler = "<b>x</b>" * 60_000
    html = f'<div class="prod_area">{filler}<a class="prod_info" href="/1">{filler}<span>긴 책</span></a>{filler}</div>'
    found = pages.extract_candidates(page(spark, html), pages.BOOK_PAGE).collect()
    assert [r["title"] for r in found] == ["긴 책"]
    html = f'<div class="coll_cont"><li>{filler}<a class="link_txt" href="/1">긴 영화</a></li><div class="info_tit">{filler}<a href="/2">z</a></div>'
    assert [r["title"] for r in pages.extract_candidates(page(spark, html), pages.MOVIE_PAGE).collect()] == ["긴 영화", "z"]


def item(**changes):
    whole = {
        "id": {"videoId": "v1"},
        "snippet": {"title": " 노래 ", "description": "글", "thumbnails": {"high": {"url": "i"}}},
    }
    return {**whole, **changes}


def test_video_answers(spark):
    bodies = [
        {"items": [item(), item(id={}), item(snippet={"title": "x"}), item(id={"videoId": "v2"})]},
        {"items": None}, {"items": []}, {"error": 1},
    ]
    rows = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies)] + [(9, "no json")], "id int, body string")
    found = video_search.parse_video_search(rows).collect()
    assert [(r["id"], r["pos"], r["video_id"]) for r in found] == [(0, 0, "v1"), (0, 3, "v2")]


def test_video_profiles(spark):
    rows = spark.createDataFrame(
        [
            (1, 0, 0, vocab.JOY, "a", " " + "t" * 250, None, None),
            (1, 1, 0, vocab.JOY, "b", " 노래 ", "d" * 1100, " i "),
            (1, 2, 0, vocab.JOY, "c", "  ", "x", "i"),
        ],
        "page_id bigint, pos int, phrase_index int, emotion string, video_id string, title string, description string, image_url string",
    )
    trimmed = {r["ord"]["pos"]: r for r in clean_candidates(rows, "MUSIC").collect()}
    assert len(trimmed[0]["title"]) == 200 and trimmed[0]["description"] == vocab.NO_VIDEO_DESCRIPTION
    assert trimmed[0]["image_url"] == "" and trimmed[1]["image_url"] == "i"
    assert (trimmed[1]["title"], len(trimmed[1]["description"])) == ("노래", 1000)
    assert trimmed[2]["title"] == ""
    raw = {r["ord"]["pos"]: r for r in clean_candidates(rows, "MUSIC_RAW").collect()}
    assert set(raw) == {1, 2} and raw[1]["title"] == " 노래 " and len(raw[1]["description"]) == 1100
    assert raw[1]["category"] == "MUSIC" and raw[1]["content_url"] == "https://www.youtube.com/watch?v=b"


@pytest.mark.parametrize("source, n", [("MUSIC", 100), ("MUSIC_RAW", 25), ("BOOK", 5), ("MOVIE", 5), ("ACTIVITY", 5)])
def test_frontier_of_the_fixed_phrases(spark, source, n):
    rows = frontier.harvest_frontier(frontier.default_phrases(spark, source), source, "").collect()
    assert len(rows) == n and len({r["url"] for r in rows}) == len({r["phrase"] for r in rows})
    assert all("key" not in r["url"].replace("keyword", "") and " " not in r["url"] for r in rows)
