"""Connected components of a graph of pairs, in rounds of joins and aggregations."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodspark.plans.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """key, root for every end of the edges a, b; the root is the smallest key that can be reached.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until nothing changes. Each is a minimum for
    every key, added up before the shuffle, and a join back, so a key with very many edges is not gathered anywhere.
    """

    def settle(df):
        return cut_lineage(df.where("a <> b").distinct())

    def mark(df):
        row = df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        return row["n"], row["x"]

    every = cut_lineage(edges.select("a", "b").distinct())
    # An edge goes from the larger end to the smaller.
    now = settle(every.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    before = None
    while (state := mark(now)) != before:
        before = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = settle(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        now = settle(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))))
    keys = every.select(F.col("a").alias("key")).unionByName(every.select(F.col("b").alias("key"))).distinct()
    return keys.join(now.select(F.col("a").alias("key"), F.col("b").alias("root")), "key", "left").select(
        "key", F.coalesce("root", "key").alias("root")
    )
