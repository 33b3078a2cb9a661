"""Which keys a stored table may hold: a Bloom filter for each bucket of key hashes, merged as rows are added."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of 64 bits in a bucket's filter, and bits that a key sets.
WORDS = 4096
PROBES = 5
# Buckets that keys are dealt to, each with 2^18 bits: up to some eight million keys one false hit in 50; beyond, more buckets.
BUCKETS = 256


# The column `bit` in its word.
_MASK = "shiftleft(1L, pmod(bit, 64))"


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(F.lit(1), key), F.lit(buckets)).cast("int")


def _bits(key: Column) -> Column:
    """Numbers of the bits that a key sets: an array."""
    first, second = (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(2**40)) for seed in (2, 3))
    return F.transform(F.sequence(F.lit(0), F.lit(PROBES - 1)), lambda k: F.pmod(first + second * k, F.lit(WORDS * 64)).cast("int"))


def key_filters(keys: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, word, bits: the words of all filters that are not zero, for the column `key`.

    Bits are joined by `or` in each task before they are shuffled, so a filter is no more than its words however
    often a key occurs.
    """
    bit = keys.where("key IS NOT NULL").select(bucket_of(F.col("key"), buckets).alias("bucket"), F.explode(_bits(F.col("key"))).alias("bit"))
    return bit.groupBy("bucket", F.floor(F.col("bit") / 64).cast("int").alias("word")).agg(
        F.bit_or(F.expr(_MASK)).alias("bits")
    )


def merged(*filters: DataFrame) -> DataFrame:
    """The filters of all keys that any of them was made of."""
    rows = filters[0]
    for more in filters[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("bucket", "word").agg(F.bit_or("bits").alias("bits"))


def maybe_held(keys: DataFrame, filters: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """key, bucket of the keys that the filters do not rule out: all that are held, and few others."""
    asked = keys.where("key IS NOT NULL").select("key").distinct().select(
        "key", bucket_of(F.col("key"), buckets).alias("bucket"), F.explode(_bits(F.col("key"))).alias("bit")
    ).select(
        "key", "bucket", F.floor(F.col("bit") / 64).cast("int").alias("word"),
        F.expr(_MASK).alias("mask"),
    )
    hit = asked.join(filters, ["bucket", "word"]).where(F.col("bits").bitwiseAND(F.col("mask")) != 0)
    # A key that sets one bit twice asks for it twice.
    return hit.groupBy("key", "bucket").agg(F.count("*").alias("n")).where(F.col("n") == PROBES).select("key", "bucket")
