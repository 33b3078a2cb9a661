"""Mood classification: keyword rules, answers of a language model, defaults and enrichment.

A classifier is any function that adds a `sentiment` struct (emotion, score, ai_comment) to a DataFrame.
"""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodspark import vocab
from moodspark.functions import dates, numbers
from moodspark.functions.text import contains_any

Classifier = Callable[[DataFrame], DataFrame]

# White space that a model's answer and its fields are stripped of.
SPACES = "".join(chr(c) for c in [
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F,
    0x205F, 0x3000,
])

# Texts that count as a number: digits with single underscores between them, or a special value.
_DIGITS = r"[0-9]+(?:_[0-9]+)*"
_NUMBER = rf"^[+-]?(?:(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?|(?i:inf|infinity|nan))$"


def _sentiment(emotion: Column, score: Column, comment: Column) -> Column:
    return F.struct(emotion.alias("emotion"), score.alias("score"), comment.alias("ai_comment"))


def _constant(comment: str | None) -> Column:
    return _sentiment(
        F.lit(vocab.DEFAULT_EMOTION), F.lit(vocab.DEFAULT_SCORE), F.lit(comment).cast("string")
    )


def _strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def keyword_sentiment(
    df: DataFrame,
    text: str = "content",
    rules: list[tuple[str, list[str]]] = vocab.KEYWORD_RULES,
    default: str = vocab.NEUTRAL,
    score: Column | None = None,
) -> DataFrame:
    """Mood by the first rule with a word in the text. Without `score` it depends on the text alone, so a repeated
    task gives the same."""
    mood = reduce(
        lambda otherwise, rule: F.when(contains_any(text, rule[1]), F.lit(rule[0])).otherwise(otherwise),
        reversed(rules), F.lit(default),
    )
    if score is None:
        score = numbers.seeded_score(0, F.coalesce(F.col(text), F.lit("")))
    return df.withColumn("sentiment", _sentiment(mood, score, F.lit(None).cast("string")))


# How a JSON value can start. Other texts are not worth an attempt.
_JSON_START = r'^(?:[{\["]|-?[0-9]|(?:true|false|null)$)'

# Ends the list that a text is parsed in. No answer holds it; one that did would be parsed twice.
_END = "\u2403 end of answer \u2403"


def _named_numbers(c: Column) -> Column:
    """The text with NaN, Infinity and -Infinity as texts, where they stand outside of JSON texts.

    With escapes out of the way, every second piece between quotes is outside. Nothing is done to a text without them.
    """
    backslash, quote = "\u0001", "\u0002"
    masked = F.replace(F.replace(c, F.lit("\\\\"), F.lit(backslash)), F.lit('\\"'), F.lit(quote))

    def outside(piece):
        for word, text in (("-Infinity", "-inf"), ("Infinity", "inf"), ("NaN", "nan")):
            piece = F.regexp_replace(piece, rf"(?<![\w.+-]){word}(?![\w.+-])", f'"{text}"')
        return piece

    pieces = F.transform(F.split(masked, '"'), lambda p, i: F.when(i % 2 == 0, outside(p)).otherwise(p))
    whole = F.array_join(pieces, '"')
    whole = F.replace(F.replace(whole, F.lit(quote), F.lit('\\"')), F.lit(backslash), F.lit("\\\\"))
    return F.when(c.rlike("NaN|Infinity") & ~c.rlike(f"[{backslash}{quote}]"), whole).otherwise(c)


def _with_value(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add the text, stripped of blanks, as one JSON value; NULL for anything else. NaN and infinities are read as texts.

    The parser ignores what follows a value, so the text is parsed as the first of two elements of a list:
    if the second one is not found where it should be, the text was more than one value. Each step is a
    column of its own, which is computed once.
    """
    c = F.col("_plain")
    listed = F.when(c.rlike(_JSON_START), F.try_parse_json(F.concat(F.lit("["), c, F.lit(f',"{_END}"]'))))
    named = F.try_parse_json(F.concat(F.lit('{"v":'), c, F.lit("}")))
    alone = F.try_variant_get("_list", "$[1]", "string") == _END
    alone = alone & F.try_variant_get("_list", "$[2]", "variant").isNull()
    alone = alone & (~c.contains(_END) | named.isNotNull())
    value = F.when(alone, F.try_variant_get("_list", "$[0]", "variant"))
    return df.withColumn("_plain", _named_numbers(F.col(text))).withColumn("_list", listed).withColumn(name, value).drop("_list", "_plain")


def with_envelope_text(df: DataFrame, envelope: str, name: str) -> DataFrame:
    """Add the message text of a completion answer: empty where the shape is another, NULL where it is no text."""
    content = F.try_variant_get("_envelope", "$.choices[0].message.content", "variant")
    text = F.when(F.schema_of_variant("_content") == "STRING", F.try_variant_get("_content", "$", "string"))
    return (
        _with_value(df.withColumn("_stripped", _strip(F.col(envelope))), "_stripped", "_envelope")
        .withColumn("_content", content)
        .withColumn(name, F.when(F.col("_content").isNull(), F.lit("")).otherwise(text))
        .drop("_stripped", "_envelope", "_content")
    )


def _number(value: str) -> Column:
    """A JSON number, boolean or numeric text as a double, else NULL."""
    text = _strip(F.try_variant_get(value, "$", "string"))
    plain = F.regexp_replace(F.replace(F.lower(text), F.lit("_"), F.lit("")), "^[+-](?=nan)", "")
    from_text = F.when(text.rlike(_NUMBER), plain.try_cast("double"))
    is_text = F.schema_of_variant(value) == "STRING"
    return F.when(is_text, from_text).otherwise(F.try_variant_get(value, "$", "double"))


def parse_model_answer(
    df: DataFrame, answer: str = "answer", emotions: list[str] = vocab.DIARY_EMOTIONS
) -> DataFrame:
    """Sentiment from a model's answer: the whole text as JSON, else what its outermost braces hold.

    Nothing readable gives neutral, 0 and an empty comment. An answer that is JSON but no object gives
    neutral, 0 and no comment, and so does a missing answer. A score that is there but null is not readable
    and does not fall back to the other key; no score at all is 0.
    """
    braces = F.nullif(F.regexp_extract("_text", r"(?s)\{.*\}", 0), F.lit(""))
    found = _with_value(df.withColumn("_text", _strip(F.col(answer))), "_text", "_whole")
    found = _with_value(
        found.withColumn("_braces", F.when(F.col("_whole").isNull(), braces)), "_braces", "_inner"
    )
    is_object = F.col("_text").startswith("{")
    raw = F.coalesce(
        F.try_variant_get("_value", "$.sentimentScore", "variant"), F.try_variant_get("_value", "$.score", "variant")
    )
    no_answer = F.col("_text").isNull() | (F.col("_whole").isNotNull() & ~is_object)
    unreadable = F.col("_value").isNull() | F.col("_score").isNull()
    emotion = F.when(F.col("_label").isin(emotions), F.col("_label")).otherwise(F.lit(vocab.NEUTRAL))
    comment = F.when(F.try_variant_get("_value", "$.aiComment", "variant").isNull(), F.lit("")).otherwise(
        _strip(F.try_variant_get("_value", "$.aiComment", "string"))
    )
    return (
        found
        .withColumn("_value", F.coalesce(F.when(is_object, F.col("_whole")), F.col("_inner")))
        .withColumn("_raw", raw)
        .withColumn("_label", _strip(F.try_variant_get("_value", "$.emotion", "string")))
        .withColumn("_score", F.when(F.col("_raw").isNull(), F.lit(0.0)).otherwise(_number("_raw")))
        .withColumn(
            "sentiment",
            F.when(no_answer, _constant(None))
            .when(unreadable, _constant(""))
            .otherwise(_sentiment(emotion, numbers.clamp01("_score"), comment)),
        )
        .drop("_text", "_whole", "_braces", "_inner", "_value", "_raw", "_label", "_score")
    )


def rounded_score(df: DataFrame) -> DataFrame:
    """The score as the classifying service reports it: four places."""
    return df.withColumn("sentiment", F.col("sentiment").withField("score", numbers.round4("sentiment.score")))


def apply_sentiment_defaults(df: DataFrame, success: Column | None = None) -> DataFrame:
    """Neutral, 0 and no comment where the call failed or mood or score are missing."""
    usable = F.col("sentiment.emotion").isNotNull() & F.col("sentiment.score").isNotNull()
    if success is not None:
        usable = usable & F.coalesce(success, F.lit(False))
    return df.withColumn("sentiment", F.when(usable, F.col("sentiment")).otherwise(_constant(None)))


def classify_answers(df: DataFrame, envelope: str = "envelope") -> DataFrame:
    """From completion envelopes to stored sentiments."""
    parsed = parse_model_answer(with_envelope_text(df, envelope, "_answer"), "_answer").drop("_answer")
    return apply_sentiment_defaults(rounded_score(parsed))


def enrich_diaries(requests: DataFrame, classifier: Classifier, respect_given_date: bool = False) -> DataFrame:
    """Diary rows from (id, member_id, content, emoji, date, ts) requests.

    The diary is dated today in Seoul, whatever date was sent, unless `respect_given_date` is set.
    """
    today = dates.kst_today("ts")
    now = dates.kst_now("ts")
    classified = apply_sentiment_defaults(classifier(requests))
    return classified.select(
        "id", "member_id", "content", "emoji",
        F.col("sentiment.emotion").alias("emotion"),
        F.col("sentiment.score").alias("sentiment_score"),
        F.col("sentiment.ai_comment").alias("ai_comment"),
        (F.coalesce("date", today) if respect_given_date else today).alias("date"),
        F.lit(vocab.ACTIVE).alias("status"),
        now.alias("created_at"),
        now.alias("updated_at"),
    )
