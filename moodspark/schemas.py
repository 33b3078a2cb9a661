"""Schemas of the three tables and of the nested inputs. Passwords are never part of a schema."""

from pyspark.sql import types as T

DIARIES = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("member_id", T.LongType(), False),
    T.StructField("content", T.StringType(), False),
    T.StructField("emoji", T.StringType()),
    T.StructField("emotion", T.StringType()),
    T.StructField("sentiment_score", T.DoubleType()),
    T.StructField("ai_comment", T.StringType()),
    T.StructField("date", T.DateType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("updated_at", T.TimestampNTZType()),
])

MEMBERS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("email", T.StringType(), False),
    T.StructField("nickname", T.StringType(), False),
    T.StructField("provider", T.StringType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("login_fail_count", T.IntegerType(), False),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("updated_at", T.TimestampNTZType()),
])

RECOMMENDATIONS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("emotion", T.StringType(), False),
    T.StructField("category", T.StringType(), False),
    T.StructField("title", T.StringType(), False),
    T.StructField("description", T.StringType(), False),
    T.StructField("image_url", T.StringType()),
    T.StructField("content_url", T.StringType()),
])

TABLES = {"diaries": DIARIES, "members": MEMBERS, "recommendations": RECOMMENDATIONS}

SENTIMENT = "struct<emotion string, score double, ai_comment string>"

VIDEO_SEARCH = (
    "struct<items: array<struct<"
    "id: struct<videoId: string>, "
    "snippet: struct<title: string, description: string, "
    "thumbnails: struct<high: struct<url: string>>>>>>"
)
