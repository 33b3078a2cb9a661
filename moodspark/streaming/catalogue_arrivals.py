"""Result pages as they arrive: items cleaned and added to the catalogue unless it has them.

Beside the rows there are their keys, addresses and titles, in a folder for each bucket of a hash, and a Bloom filter for
each bucket. A batch asks the filters first and then reads the buckets alone that may hold a key of its own, so what it
reads follows the batch and not the catalogue.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from moodspark.functions.text import title_key
from moodspark.operators.candidates import clean_candidates
from moodspark.operators.dedup import harvest
from moodspark.plans.session import cut_lineage
from moodspark.sources.key_index import bucket_of, key_filters, maybe_held, merged
from moodspark.sources.pages import PageProfile, extract_candidates

STORED = "emotion string, category string, title string, description string, image_url string, content_url string"


def stored_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """All batches. Batch -1 holds what was there before the first one."""
    return spark.read.schema(f"{STORED}, batch_id int").parquet(folder)


_KEYED = "key string, emotion string, title string, content_url string"


def _keys(rows: DataFrame, title: Column) -> DataFrame:
    """The rows' keys, their addresses and their titles within a mood, with what is compared."""
    url = F.concat(F.lit("u"), "content_url")
    named = F.concat(F.lit("t"), "emotion", F.lit("\n"), title)
    return rows.select(F.explode(F.array(url, named)).alias("key"), "emotion", "title", "content_url").where("key IS NOT NULL")


def _store(rows: DataFrame, batch_id: int, folder: str) -> None:
    """Write a batch's rows, then their keys and filters. A repeated batch replaces all three."""
    spark = rows.sparkSession
    rows.select(*[c.split()[0] for c in STORED.split(", ")]).write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")
    written = spark.read.schema(STORED).parquet(f"{folder}/batch_id={batch_id}")
    keys = _keys(written, title_key("title"))
    placed = keys.withColumn("bucket", bucket_of(F.col("key"))).repartition("bucket").sortWithinPartitions("bucket", "key")
    placed.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(
        f"{folder}_keys/batch_id={batch_id}"
    )
    key_filters(keys.select("key")).write.mode("overwrite").parquet(f"{folder}_filters/batch_id={batch_id}")


def known_rows(candidates: DataFrame, batch_id: int, folder: str) -> DataFrame:
    """emotion, title, content_url of the rows of older batches that share an address or a title with the candidates."""
    spark = candidates.sparkSession
    older = F.col("batch_id") < batch_id
    filters = spark.read.schema("bucket int, word int, bits long, batch_id int").parquet(f"{folder}_filters").where(older)
    maybe = cut_lineage(maybe_held(_keys(candidates, F.col("probe_key")), merged(filters)))
    # At most as many as there are buckets.
    buckets = [row["bucket"] for row in maybe.select("bucket").distinct().collect()]
    keys = spark.read.schema(f"{_KEYED}, batch_id int, bucket int").parquet(f"{folder}_keys")
    return keys.where(older & F.col("bucket").isin(buckets)).join(maybe.select("key"), "key", "left_semi").select(
        "emotion", "title", "content_url"
    )


def start_catalogue(seed: DataFrame, folder: str) -> None:
    """Lay down the catalogue that arrivals are compared with."""
    _store(seed, -1, folder)


def store_batch(pages: DataFrame, batch_id: int, folder: str, profile: PageProfile) -> None:
    """Add a batch's new items. Only older batches count as known, so a repeated batch replaces itself."""
    candidates = cut_lineage(clean_candidates(extract_candidates(pages, profile), profile.source))
    _store(harvest(candidates, known_rows(candidates, batch_id, folder), [profile.source]), batch_id, folder)


def start_catalogue_arrivals(
    pages: DataFrame, folder: str, checkpoint: str, profile: PageProfile
) -> StreamingQuery:
    """Process what has arrived and stop. Batches of an earlier stream must go on from its own progress folder."""
    spark = pages.sparkSession
    progress = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
    known = progress.getFileSystem(spark._jsc.hadoopConfiguration()).exists(progress)
    if not known and not stored_catalogue(spark, folder).where("batch_id >= 0").isEmpty():
        raise ValueError("the catalogue has batches of another stream; go on from its progress folder")
    return (
        pages.writeStream
        .foreachBatch(lambda batch, batch_id: store_batch(batch, batch_id, folder, profile))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
