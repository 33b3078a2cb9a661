"""Search addresses to fetch: one per mood and phrase."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodspark import vocab
from moodspark.functions.text import form_encode, query_encode


def default_phrases(spark: SparkSession, source: str) -> DataFrame:
    """The fixed phrases of a source with their order."""
    rows = [
        (emotion, i, phrase) for emotion in vocab.HARVEST_ORDER for i, phrase in enumerate(vocab.PHRASES[source][emotion])
    ]
    return spark.createDataFrame(rows, "emotion string, phrase_index int, phrase string")


def harvest_frontier(phrases: DataFrame, source: str, base: str = "") -> DataFrame:
    """Add the address that searches a source for each phrase. `base` is the video service's own address."""
    before, after = vocab.SEARCH_ADDRESS["MUSIC" if source == "MUSIC_RAW" else source]
    encoded = query_encode("phrase") if source.startswith("MUSIC") else form_encode("phrase")
    return phrases.withColumn("url", F.concat(F.lit(base + before), encoded, F.lit(after)))
