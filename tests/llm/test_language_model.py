"""LM scores against counts in plain dictionaries; the filter against the levels of its n-grams."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from moodspark.llm import language_model as lm
from moodspark.llm.queries import LLM_QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
END = object()


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def plain_tokens(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*WORD.findall(lower), END]


def shown(c):
    """The count that its level stands for."""
    level = 1 + math.floor(math.log(c) / math.log(lm.BASE) + 1e-9)
    same = [k for k in range(1, 2 * c + 2) if 1 + math.floor(math.log(k) / math.log(lm.BASE) + 1e-9) == level]
    return (same[0] + same[-1]) / 2


def plain(rows, order=2):
    """doc_id -> the row due, its score without any false hit of the filter."""
    counts = [Counter() for _ in range(order)]
    for doc_id, text in rows:
        if not held(doc_id):
            line = [END, *plain_tokens(text)]
            for i in range(1, len(line)):
                counts[0][(line[i],)] += 1
                for k in range(1, order):
                    if i - k >= 0:
                        counts[k][tuple(line[i - k:i + 1])] += 1
    total, distinct = sum(counts[0].values()), len(counts[0])
    level = [{g: shown(c) for g, c in x.items()} for x in counts]
    out = []
    for doc_id, text in rows:
        line = [END, *plain_tokens(text)]
        base = score = 0.0
        for i in range(1, len(line)):
            base += math.log10((counts[0][(line[i],)] + 0.1) / (total + 0.1 * (distinct + 1)))
            seen = level[0].get((line[i],), 0)
            p = (seen + 0.1) / (total + 0.1 * (distinct + 1))
            for k in range(1, min(order, i + 1)):
                history = level[k - 1].get(tuple(line[i - k:i]), 0)
                seen = min(level[k].get(tuple(line[i - k:i + 1]), 0), seen, history)
                p = (seen + lm.PRIOR * p) / (history + lm.PRIOR)
            score += math.log10(p)
        out.append((doc_id, held(doc_id), len(line) - 1, sum(counts[0][(w,)] > 0 for w in line[1:]), total, base, score))
    return out


def same(got, want, slack):
    got, want = (sorted(x, key=lambda r: (str(r[0]), r[2:6])) for x in (map(tuple, got), want))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-10, atol=1e-9)
    off = [abs(a[6] - b[6]) / a[2] for a, b in zip(got, want)]
    assert np.mean(off) <= slack, np.mean(off)
    return got


def test_query_against_plain_counts(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = LLM_QUERIES["op13_language_model"](spark, small)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got = same(got.collect(), plain(rows), 0.02)
    # Texts that were not learnt from are likelier under the model than under single tokens.
    unseen = [r for r in got if r[1]]
    assert sum(r[6] for r in unseen) > sum(r[5] for r in unseen)


@pytest.mark.parametrize("order, filter_bytes, segment_bytes", [(1, 1 << 20, 1 << 20), (2, 1 << 20, 20_000), (3, 1 << 20, 50_000), (2, 9_000, 20_000), (3, 1, 50_000)])
def test_parts_segments_and_orders(spark, small, order, filter_bytes, segment_bytes, monkeypatch):
    """Parts of the filter and many segments give what one gives; with tokens asked for as well."""
    monkeypatch.setattr(lm, "HEAVY_WORDS", 50)
    docs = spark.read.parquet(f"{small}/documents.parquet").where("doc_id < 60")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = lm.score_language(docs, order, filter_bytes=filter_bytes, segment_bytes=segment_bytes)
    same(got.collect(), plain(rows, order), 0.02)
    if filter_bytes < 10_000:
        assert len(lm.count_grams(docs, order, filter_bytes, segment_bytes).bounds) > 3


def test_filter_holds_levels():
    draw = np.random.default_rng(5)
    keys = np.unique(draw.integers(1, 2**63, 40_000).astype(np.uint64))
    counts = np.maximum(1, draw.pareto(0.7, len(keys)) * 2).astype(np.int64)
    data = lm.fill_segment(keys, counts)
    held = lm.CountFilter(data, np.array([0, len(data)]), 0, 1)
    got, due = held.levels(keys), lm.level_of(counts)
    assert (got >= due).all() and (got == due).mean() > 0.8 and (got - due).mean() < 0.2
    other = draw.integers(1, 2**63, 40_000).astype(np.uint64)
    assert (held.levels(other) > 0).mean() < 0.008
    assert np.unpackbits(data).mean() < 0.52
    assert (held.levels(np.zeros(5, np.uint64)) == 0).all()


def test_levels_stand_for_their_counts():
    counts = np.arange(1, 3000)
    middle = lm.count_of(lm.level_of(counts))
    assert np.array_equal(middle[:3], [1, 2, 3]) and (np.diff(middle) >= 0).all()
    assert (np.abs(middle - counts) / counts).max() <= 0.26
    assert np.array_equal(middle, [shown(int(c)) for c in counts])


def test_model_is_a_distribution():
    """Over all tokens, the probabilities after a history add up to about one where levels are exact counts."""
    model = lm.Smoothed(100, 3, int(lm.level_of(np.array([10]))[0]))
    first = np.array([3, 2, 3, 0])  # levels whose counts are 3, 2, 3
    start = np.arange(5)
    chance = 10 ** model.log10([first, np.zeros(4, int)], start)
    alone = 10 ** model.log10([first], start)
    shown_end = lm.count_of(np.array([model.end_level]))[0]
    assert np.allclose(chance, lm.PRIOR * alone / (shown_end + lm.PRIOR))


def test_tokens_of_slices():
    texts = pa.array(["skip", "A b\tÀ B", None, " \n", "x\x1fy  Z ", "ab"])
    for part in (texts, texts.slice(1), texts.slice(2, 3)):
        line, start = lm.tokens(part)
        want = [plain_tokens(t) for t in part.to_pylist()]
        assert np.diff(start).tolist() == [len(x) for x in want]
        names = {}
        for key, token in zip(line.tolist(), [t for x in want for t in x]):
            assert names.setdefault(token, key) == key
        assert len(set(names.values())) == len(names)


def test_edges(spark):
    shape = "doc_id long, text string"
    long = "word " * 30_000 + "Other"
    rows = [(1, None), (2, ""), (3, "a B a"), (3, "a B a"), (None, "a c"), (11, long), (14, "a new b"), (25, " ")]
    out = next(k for k in range(100, 1000) if held(k))
    rows += [(out, "a b never"), (out, None)]
    df = spark.createDataFrame(rows, shape).select("*", *[F.lit(1).alias(c) for c in ("row", "segment", "levels", "base", "keys")])
    same(lm.score_language(df).collect(), plain(rows), 0.05)
    assert lm.score_language(spark.createDataFrame([], shape)).collect() == []
    only = lm.score_language(spark.createDataFrame([(out, "nothing learnt")], shape)).collect()
    assert [tuple(r) for r in only] == [(out, True, 3, 0, 0, 0.0, 0.0)]


def test_a_key_is_hashed_once_a_level_not_once_a_probe(monkeypatch):
    keys = lm.mix(np.arange(1, 20_001))
    counts = np.where(np.arange(len(keys)) % 10 == 0, 40, 1)
    segment = lm.segment_of(keys, 3)
    blobs = [lm.fill_segment(keys[segment == s], counts[segment == s]) for s in range(3)]
    held = lm.CountFilter(np.concatenate(blobs), np.r_[0, np.cumsum([len(b) for b in blobs])], 0, 3)
    mixed = []
    plain = lm.mix
    monkeypatch.setattr(lm, "mix", lambda x, seed=0: (mixed.append(len(x)), plain(x, seed))[1])
    found = held.levels(keys)
    levels = lm.level_of(counts)
    assert (found >= levels).all() and (found == levels).mean() > 0.9
    # The segment, and two numbers a level: that of the count and the one above, which is missing.
    assert sum(mixed) < 1.1 * (len(keys) + 2 * (levels + 1).sum())
    missing = held.levels(plain(np.arange(100_001, 120_001)))
    assert (missing == 0).mean() > 0.98


def test_texts_are_written_as_often_however_small_the_parts(spark, small, monkeypatch):
    """A filter of many parts took a pass over all texts for each."""
    docs = spark.read.parquet(f"{small}/documents.parquet").where("doc_id < 60")
    written, sent = [], []
    cut, part = lm.cut_lineage, lm.CountTable.part
    monkeypatch.setattr(lm, "cut_lineage", lambda df: (written.append(df.columns), cut(df))[1])
    monkeypatch.setattr(lm.CountTable, "part", lambda table, k: (sent.append(k), part(table, k))[1])
    table = lm.count_grams(docs, 2, 9_000, 20_000)
    assert len(table.bounds) > 4
    for filter_bytes in (30_000, 9_000, 1):
        written.clear()
        assert lm.score_language(docs, filter_bytes=filter_bytes, segment_bytes=20_000).count() == docs.count()
        assert len(written) == 2 and sum("texts" in c or "text" in c for c in written) == 1
    assert not sent


ODD = [
    (1, None), (2, ""), (3, "a B a"), (3, "a B a"), (None, "a c"), (None, None), (11, "word " * 3000 + "Other"), (14, "a new b"), (25, " "),
    (26, "x\x1fy  Z "), *[(k, f"a B w{k % 7} w{k} the the end") for k in range(100, 200)],
]


@pytest.mark.parametrize("order, segment_bytes, parcel_bytes", [(1, 1 << 20, 1 << 20), (2, 2_000, 3_000), (3, 1_000, 300), (4, 20_000, 1 << 20)])
def test_segments_answer_what_the_filter_says(spark, order, segment_bytes, parcel_bytes):
    """Row for row the scores of the broadcast filter, false hits too; also with more segments than n-grams of a parcel."""
    docs = spark.createDataFrame(ODD, "doc_id long, text string").repartition(3)
    learnt = ~lm.split_by_crc(10, 0)
    train = docs.where(learnt).select("text")
    table = lm.count_grams(train, order, segment_bytes=segment_bytes)
    due = lm.score_texts(docs, table).collect()
    got, n = lm.score_by_segment(docs, learnt, lm._text_bytes(train), order, segment_bytes, parcel_bytes)
    assert n == table.tokens and got.columns == ["doc_id", "n_tokens", "n_known", "base_score", "score"]
    by_row = [sorted(map(tuple, x), key=lambda r: (str(r[0]), r[1:])) for x in (got.collect(), due)]
    assert [r[:3] for r in by_row[0]] == [r[:3] for r in by_row[1]]
    assert np.allclose([r[3:] for r in by_row[0]], [r[3:] for r in by_row[1]], rtol=1e-12, atol=1e-12)
    rows = [(*r[:1], held(r[0]), *r[1:3], n, *r[3:]) for r in by_row[0]]
    same(rows, plain(ODD, order), 0.05)


def test_parts_of_a_filter_are_still_scored(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").where("doc_id < 60")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    table = lm.count_grams(docs.where(~lm.split_by_crc(10, 0)), 2, 9_000, 20_000)
    assert len(table.bounds) > 3
    got = lm.score_texts(docs, table).collect()
    same([(r["doc_id"], held(r["doc_id"]), r["n_tokens"], r["n_known"], table.tokens, r["base_score"], r["score"]) for r in got], plain(rows), 0.02)


def test_keys_and_counts_come_back_from_what_is_sent():
    draw = np.random.default_rng(3)
    keys = np.r_[draw.integers(1, 2**64 - 1, 3000, np.uint64), np.uint64(1), np.uint64(2**64 - 1)]
    keys = np.r_[keys, keys[:500]]
    for segments in (1, 3, 70_000):
        segment, rank, place = lm._asked(keys, segments)
        assert len(rank) == 3002 and (np.diff(segment) >= 0).all()
        back = np.concatenate([lm._key_of(s, lm._of_steps(lm._steps(rank[segment == s])), segments) for s in np.unique(segment).tolist()])
        assert np.array_equal(back[place], keys) and np.array_equal(lm.segment_of(back, segments), segment)
    for counts in ([], [0, 1, 254, 255, 256, 2**40, 0], [300]):
        assert lm._of_short(lm._short(np.array(counts, np.int64)), len(counts)).tolist() == counts
