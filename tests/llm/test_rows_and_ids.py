"""No clean row is lost and no test item is missed where ids repeat, columns clash, or values are long."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from moodspark.llm import decontamination, line_dedup, ngram_join, packing, pii, warc

DOCS = "doc_id long, text string"


def words(seed, n=60):
    return " ".join(f"w{k}" for k in np.random.default_rng(seed).integers(0, 5000, n))


def test_one_row_of_each_class_stays(spark):
    a, b, c = words(1), words(2), words(3)
    near = a.replace(a.split()[30], "other", 1) + " more"
    rows = [(1, a), (1, a), (2, a), (3, b), (3, a), (4, near), (5, c), (5, c), (None, a), (None, a), (6, ""), (6, ""), (7, None), (8, "")]
    df = spark.createDataFrame(rows, DOCS).select("*", F.lit(1).alias("own"), F.lit(2).alias("class_id"), F.lit(3).alias("_own"))
    kept = ngram_join.keep_one_each(df)
    assert kept.columns == df.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr)
    assert got == sorted([(1, a), (3, b), (5, c), (None, a), (None, a), (6, ""), (7, None), (8, "")], key=repr)
    assert ngram_join.keep_one_each(df.limit(0)).count() == 0


def test_both_texts_of_an_item_are_found(spark):
    items = [(1, words(11)), (1, words(12)), (1, words(12)), (2, words(13)), (None, words(14))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([
        (1, "before " + items[0][1] + " after"), (2, items[1][1]), (3, items[3][1] + " " + items[0][1] + " " + items[1][1]),
        (4, words(15)), (5, items[4][1]),
    ], DOCS)
    got = sorted((r["doc_id"], r["item_id"]) for r in decontamination.find_contaminated(docs, benchmark).collect())
    assert got == [(1, 1), (2, 1), (3, 1), (3, 2)]
    assert sorted(r["doc_id"] for r in decontamination.drop_contaminated(docs, benchmark).collect()) == [4, 5]
    # Parts of the index give the same.
    many = decontamination.indexes(benchmark, shard_terms=40)
    assert len(many) > 1 and sorted(i for x in many for i in x.items.tolist()) == [1, 1, 2]


@pytest.mark.parametrize("ranks", ["byte_bpe_50k.tiktoken", None])
def test_ids_are_those_of_the_plain_call(ranks):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y", "<|endoftext", "", "plain words, no token", "é <|endoftext|>\n\n z"]
    got = packing.tokenizer(path, ranks and public_tokenizers.path(ranks))(texts)
    assert [x.tolist() for x in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert 50256 in plain.encode(texts[0], add_special_tokens=False).ids


def test_lines_beside_clashing_columns(spark):
    line = "one two three four five six"
    rows = [(1, f"{line}\nfirst"), (2, f"second\n{line}"), (3, line), (4, None)]
    names = ["_lines", "_doc", "_n_taken", "_n_lines", "__lines", "line", "word", "key"]
    df = spark.createDataFrame(rows, DOCS).select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])
    left = line_dedup.drop_repeated_lines(df)
    assert left.columns == df.columns
    assert {(r["doc_id"], r["text"], r["_lines"], r["key"]) for r in left.collect()} == {(1, f"{line}\nfirst", 0, 7), (2, "second", 0, 7), (4, "", 0, 7)}


def test_short_lines_take_part_by_default(spark):
    df = spark.createDataFrame([(1, "Read more\nx y z"), (2, "a b c\nread More")], DOCS)
    assert sorted((r["doc_id"], r["line"]) for r in line_dedup.repeated_lines(df).collect()) == [(2, 1)]


def test_many_repeated_lines_in_one_text(spark):
    lines = [f"line number {k} of many" for k in range(4000)]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(lines[::-1]) + "\nlast words that stay here now")], DOCS)
    left = {r["doc_id"]: r["text"] for r in line_dedup.drop_repeated_lines(df).collect()}
    assert left[2] == "last words that stay here now"


def test_long_secrets_and_names_in_all_letters():
    token = "".join("abcdefghijklmnopqrstuvwxyzABCDEF0123456789"[k] for k in np.random.default_rng(2).integers(0, 42, 2000))
    secret, name = (dict(pii._LOOSE)[k] for k in ("secret", "name"))
    assert secret.search(f"token {token} end")[0] == token
    assert secret.search("key " + "0123456789abcdef" * 20)[0] == "0123456789abcdef" * 20
    for who in ("José Muñoz", "Jürgen Groß", "Anna Smith", "Élodie Lefèvre"):
        assert name.search(f"by {who}, today")[0] == who
        assert pii._LOOSE_HINT.search(who)
    assert pii._LOOSE_HINT.search("x" * 32)


def test_archives_without_a_scheme_are_in_the_default_file_system(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a", "x" * 200), (2, "http://b", "x" * 200)], "page_id long, url string, html string")
    got = {r["page_id"]: r["record_type"] for r in warc.archive_pages(pages, str(tmp_path / "w")).collect()}
    assert got == {1: "response", 2: "revisit"}
