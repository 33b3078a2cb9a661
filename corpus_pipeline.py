"""From documents to packed training sequences: five operators, one after the other."""

from pyspark.sql import DataFrame, SparkSession

from moodspark.llm import decontamination, line_dedup, ngram_join, packing, quality
from moodspark.llm.common import read
from moodspark.plans.session import cut_lineage

# A document goes if it is less likely than this to be a good one.
LEAST_QUALITY = 0.5


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text the classifier takes for good; a null text is judged as an empty one."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"), LEAST_QUALITY)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows without the lines that an earlier line matches; a row of which nothing is left for that goes."""
    return line_dedup.drop_repeated_lines(docs)


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies, told by id and text; rows without an id stay."""
    return ngram_join.keep_one_each(docs)


def without_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that hold no item of the benchmark."""
    return decontamination.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of the texts' pieces in training sequences; an empty text is its end alone."""
    import public_tokenizers

    return packing.pack_documents(
        docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    )


STAGES = [
    ("quality", good_documents),
    ("line_dedup", fresh_lines),
    ("ngram_join", one_of_each_class),
    ("decontamination", without_test_items),
    ("packing", packed),
]

# Neither the classifier nor the tokenizer can be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents, each written as Parquet before the next one reads it.

    Null texts count as empty, rows of one id are judged each by its own text, of rows that share both one stays, and
    other columns pass through whatever their names. No documents give no pieces.
    """
    rows = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        rows = cut_lineage(stage(spark, rows, sf_dir))
    return STAGES[-1][1](spark, rows, sf_dir)
