"""Document fingerprints: every shingle hash below a fixed fraction of the hash range, as columns only."""

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from moodspark.llm.common import whole_text

WIDTH = 5
# One hash in so many is kept; of a short text at least the LEAST smallest.
SCALE = 16
LEAST = 32

_BOUND = -(2**63) + 2**64 // SCALE
_BLANKS = " \t\n\x0b\f\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def shingles(text: Column, width: int = WIDTH) -> Column:
    """Hashes of the text's word shingles; of all its words if they are fewer; none for a text without words."""
    words = F.split(F.btrim(F.lower(text), F.lit(_BLANKS)), r"\s+")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def run(h):
        last = F.size(h) - width
        many = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[h[i + k] for k in range(width)]))
        return F.when(last >= 0, many).otherwise(F.array(F.xxhash64(h)))

    none = F.array().cast("array<bigint>")
    return F.when(F.btrim(text, F.lit(_BLANKS)) == "", none).otherwise(let(hashes, run))


def sketch(text: Column) -> Column:
    """The fingerprint: sorted distinct hashes below the bound, or the smallest ones if these are too few."""

    def run(every):
        low = F.array_sort(F.array_distinct(F.filter(every, lambda h: h < _BOUND)))
        return let(low, lambda kept: F.when(F.size(kept) >= LEAST, kept).otherwise(
            F.slice(F.array_sort(F.array_distinct(every)), 1, LEAST)
        ))

    return let(shingles(text), run)


def merge(a: Column, b: Column) -> Column:
    """The fingerprint of two texts' shingles together, from the fingerprints of each."""
    both = F.array_sort(F.array_union(a, b))
    low = F.filter(both, lambda h: h < _BOUND)
    return F.when(F.size(low) >= LEAST, low).otherwise(F.slice(both, 1, LEAST))


def _reach(print_: Column) -> Column:
    """Up to which hash the fingerprint holds all of its text's shingles."""
    return F.when(F.size(print_) < LEAST, F.lit(2**63 - 1)).otherwise(F.greatest(F.element_at(print_, -1), F.lit(_BOUND - 1)))


def likeness(a: Column, b: Column) -> Column:
    """Struct of the estimated Jaccard likeness and of the share of either text that the other contains.

    Only hashes that both fingerprints would hold are compared. Two texts without words are alike.
    """

    def run(top):
        return let(F.struct(F.filter(a, lambda h: h <= top).alias("a"), F.filter(b, lambda h: h <= top).alias("b")), compare)

    def compare(s):
        return let(F.struct(
            F.size(F.array_intersect(s["a"], s["b"])).alias("n"), F.size(s["a"]).alias("a"), F.size(s["b"]).alias("b")
        ), shares)

    def shares(s):
        total = s["a"] + s["b"] - s["n"]
        same = F.when(a == b, F.lit(1.0)).otherwise(F.lit(0.0))
        return F.struct(
            F.when(total > 0, s["n"] / total).otherwise(same).alias("jaccard"),
            F.when(s["a"] > 0, s["n"] / s["a"]).otherwise(same).alias("a_in_b"),
            F.when(s["b"] > 0, s["n"] / s["b"]).otherwise(same).alias("b_in_a"),
        )

    return let(F.least(_reach(a), _reach(b)), run)


def printed(print_: Column) -> Column:
    return F.array_join(F.transform(print_, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def edited(text: Column, following: Column) -> Column:
    """The text with its last half replaced by as many first code points of the next one, or by all it has."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


# Rows that one task puts in order, and ranges of ids at most; ids beyond that make the ranges larger.
RANGE_ROWS = 5_000
RANGES = 65_536
_STEP = 256


def _range_of(key: Column, bounds: list[int]) -> Column:
    """The number of bounds up to the key, looked up in two steps."""
    coarse = F.array(*[F.lit(b) for b in bounds[::_STEP]]).cast("array<bigint>")
    every = F.lit(bounds).cast("array<bigint>")
    first = F.size(F.filter(coarse, lambda b: b <= key))
    low = F.greatest(first - 1, F.lit(0)) * _STEP
    return low + F.size(F.filter(F.slice(every, low + 1, F.lit(_STEP)), lambda b: b <= key))


def with_next(docs: DataFrame, columns: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """Every row of doc_id, text and `columns`, with those of the next row in `next`; the first follows the last.

    Rows are in order of doc_id, then text, those without an id first. Ids are cut into ranges of about equal size
    at approximate quantiles, so that every range is put in order by itself; the first row of a range is repeated
    at the end of the one before.
    """
    spark = docs.sparkSession
    rows = docs.count()
    count = max(1, min(RANGES, math.ceil(rows / range_rows)))
    bounds = []
    if count > 1:
        at = [k / count for k in range(1, count)]
        found = docs.agg(F.percentile_approx("doc_id", at, 20 * count).alias("q")).first()["q"]
        bounds = sorted(set(found or []))
    key = _range_of(F.col("doc_id"), bounds) if bounds else F.lit(0)
    placed = docs.withColumn("_range", key)
    # One row for each range.
    starts = placed.groupBy("_range").agg(
        F.min("doc_id").alias("first"), F.count_if(F.col("doc_id").isNull()).alias("blank")
    ).orderBy("_range").collect()
    if not starts:
        return placed.drop("_range").withColumn("next", F.struct(*columns)).where(F.lit(False))
    firsts = [(None if s["blank"] else s["first"]) for s in starts]
    ends = spark.createDataFrame(
        [(s["_range"], firsts[(k + 1) % len(starts)]) for k, s in enumerate(starts)], "_range int, _first long"
    )
    one = docs.join(F.broadcast(ends), docs["doc_id"].eqNullSafe(ends["_first"]))
    order = ["text", *[c for c in columns if c != "text"]]
    ends = one.groupBy("_range").agg(F.min(F.struct(*order)).alias("row")).select(
        F.lit(None).cast("long").alias("doc_id"), *[F.col(f"row.{c}").alias(c) for c in order], "_range", F.lit(1).alias("_end")
    )
    every = placed.select("doc_id", *order, "_range", F.lit(0).alias("_end")).unionByName(ends)
    w = W.partitionBy("_range").orderBy("_end", F.asc_nulls_first("doc_id"), "text")
    return every.select(
        "doc_id", *order, "_end", F.struct(*[F.lead(c).over(w).alias(c) for c in columns]).alias("next")
    ).where("_end = 0").drop("_end")


def fingerprint_documents(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Fingerprints of every row's text and of its edited text, and how alike they are, to each other and to the next.

    The edited text has its last half replaced from the next row's text. A null text counts as empty; an empty text
    has an empty fingerprint. Repeated rows and rows of one id follow each other, in order of their texts; a single
    row follows itself. Other columns are not read; an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    rows = rows.withColumn("print", sketch(F.col("text")))
    text = F.col("text")
    pairs = with_next(rows, ["text", "print"], range_rows).select(
        "doc_id", F.length(text).cast("long").alias("n_chars"), "print", edited(text, F.col("next.text")).alias("edited"),
        F.col("next.print").alias("next_print"),
    )
    prints = pairs.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "print",
        sketch(F.col("edited")).alias("edited_print"), "next_print",
    )
    alike = prints.select(
        "*", likeness(F.col("print"), F.col("edited_print")).alias("to_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("to_next"),
    )
    return alike.select(
        "doc_id", "n_chars", "edited_sha256", printed(F.col("print")).alias("fingerprint"),
        printed(F.col("edited_print")).alias("edited_fingerprint"), F.col("to_edited.jaccard").alias("near_edited"),
        F.col("to_next.jaccard").alias("near_next"), F.col("to_edited.a_in_b").alias("contained_in_edited"),
        F.col("to_next.a_in_b").alias("contained_in_next"),
    )
