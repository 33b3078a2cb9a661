"""Quality, toxicity and personal data: edge cases, held-out accuracy, plain patterns."""

import hashlib
import math
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from moodspark.llm import common, line_dedup, pii, quality, toxicity
from moodspark.llm.common import isotonic

DOCS = "doc_id long, text string, lang string, source string, n_chars long, label int, score double, _range int"


@pytest.fixture(scope="module")
def odd(spark):
    """Null columns, empty and very long texts, repeated rows, clashing names."""
    rows = [
        (1, "The cat sat on the mat and looked at a dog.", "en"), (1, "The cat sat on the mat and looked at a dog.", "en"),
        (2, "", None), (3, None, None), (4, "x" * 300_000, "en"), (5, "word " * 40_000, "en"), (None, "no id here", None),
        (6, "you idiot, you m0r0n", "en"), (7, "\n \t", "en"),
    ]
    return spark.createDataFrame([(*r, None, None, 7, 0.5, 3) for r in rows], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(k, k % 2, k % 2) for k in range(1, 8)] + [(1, 1, 1), (8, None, None), (None, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_quality_of_odd_rows(spark, odd, labels):
    found = quality.score_quality(odd, labels).collect()
    assert len(found) == 9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in found)
    assert not [r for r in found if r["doc_id"] is None][0]["held_out"]
    assert quality.score_quality(odd.limit(0), labels).count() == 0
    assert {r["score"] for r in quality.score_quality(odd, labels.limit(0)).collect()} == {0.5}
    kept = quality.keep_good(odd, labels, 0.0)
    assert kept.columns == odd.columns and kept.count() == 9


def test_quality_held_out(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    found = quality.score_quality(docs, labels).where("held_out").join(labels, "doc_id").toPandas()
    assert (found["predicted"] == found["quality"]).mean() > 0.9


def test_isotonic_is_rising_and_near_the_shares():
    hits, counts = np.array([0, 5, 3, 10, 9]), np.array([10, 10, 10, 10, 10])
    level = isotonic(hits, counts)
    assert (np.diff(level) >= 0).all() and level[0] < 0.1 and level[-1] > 0.85


def test_toxicity_of_odd_rows(spark, odd, labels):
    found = toxicity.score_toxicity(odd, labels).collect()
    assert len(found) == 9 and all(0 <= r["score"] <= 1 for r in found)
    assert toxicity.score_toxicity(odd.limit(0), labels).count() == 0
    assert len({r["score"] for r in toxicity.score_toxicity(odd, labels.where("toxic = 0")).collect()}) == 1


def test_lexicon_finds_disguises_and_spares_exceptions():
    matcher = toxicity.Lexicon({toxicity.fold("moron"): 3.0, toxicity.fold("trash"): 2.0}, ("trash can",)).matcher()

    def weight(text):
        return toxicity.toxic_weight(matcher, toxicity.fold(text))

    assert weight("what a moron") == weight("WHAT A M0R0N!") == weight("м​оrοn") == 3.0
    assert weight("oxymorons") == 0 and weight("the trash can") == 0 and weight("trash, can you") == 0
    assert weight("trash and a moron") == 5.0
    assert toxicity.raw_score(3, 10) > toxicity.raw_score(3, 1000)


def test_time_grows_with_the_matches():
    matcher = toxicity.Lexicon({toxicity.fold("moron"): 3.0, toxicity.fold("trash"): 2.0}, ("trash can",)).matcher()
    folded = toxicity.fold("a trash can and a moron, " * 60_000)
    start = time.monotonic()
    assert toxicity.toxic_weight(matcher, folded) == 180_000.0
    assert time.monotonic() - start < 10


def test_automaton_finds_what_a_plain_search_finds():
    draw = random.Random(4)
    words = ["ab", "abc", "bca", "cab", "abcab", "b", "can"]
    weights = {f" {w} ": float(k + 1) for k, w in enumerate(words[:3])} | {" abca": 9.0, " ca": 0.5}
    phrases = ("abc can", "b cab b")
    matcher = toxicity.Lexicon(weights, phrases).matcher()
    for _ in range(300):
        text = toxicity.fold(" ".join(draw.choice(words) for _ in range(draw.randrange(12))))
        # The blank that ends a phrase begins the next word, which is outside.
        spared = [(m, m + len(f) - 1) for f in map(toxicity.fold, phrases) for m in range(len(text)) if text.startswith(f, m)]
        plain = sum(
            max((w for p, w in weights.items() if text.startswith(p, at)), default=0.0)
            for at in range(len(text)) if not any(a <= at < b for a, b in spared)
        )
        assert toxicity.toxic_weight(matcher, text) == pytest.approx(plain)


def test_lexicon_as_counted_plainly(spark):
    draw = random.Random(6)
    clean = [" ".join(draw.choice(["plain", "words", "here", "zubbiq"] if draw.random() < 0.1 else ["plain", "words"])
                      for _ in range(8)) + f" {k}x" for k in range(900)]
    toxic = [t + draw.choice([" grobnak", " zubbiq", " wexxer grobnak"]) for t in clean[:300]]
    rows = [(k, t, int(k >= len(clean))) for k, t in enumerate(clean + toxic)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int")
    found = toxicity.learn_lexicon(docs.drop("label"), docs.select("doc_id", "label")).weights
    for pattern, weight in found.items():
        bad, good = (sum(pattern in toxicity.fold(t) for t in texts) for texts in (toxic, clean))
        assert bad >= 5 and weight == pytest.approx(math.log2((bad / len(toxic)) / ((good + 0.5) / (len(clean) + 1))))
        assert weight >= 3
    assert {" grob", " wexx"} <= set(found) and " plain " not in found


def test_a_rare_toxic_word_is_learnt_however_many_labels_there_are(spark):
    rows = [(k, f"some plain words here w{k % 50} " + ("grobnak" if k % 3 == 0 else "")) for k in range(6000)]
    rows += [(6000 + k, f"some plain words here zubbiq w{k}") for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("text", F.concat_ws(" ", "text", "doc_id"))
    labels = docs.select("doc_id", F.expr("CAST(text LIKE '%grobnak%' OR text LIKE '%zubbiq%' AS INT) AS label"))
    found = toxicity.learn_lexicon(docs, labels)
    assert found.weights[" zubb"] > 3 and " plai" not in found.weights
    sample = toxicity.learn_lexicon(docs, labels, most_labels=2000)
    assert " grob" in sample.weights and " plai" not in sample.weights


def test_accidents_are_not_learnt():
    # A thousand patterns by chance, one far from it: the one alone is taken. Nothing to test, nothing taken.
    steps = {8 * 2: 900, 8 * 5: 100, 8 * 40: 1}
    assert toxicity._least_unlikely(steps, 0.02) == 8 * 40
    assert toxicity._least_unlikely({}, 0.02) > toxicity._CHANCES


def test_toxicity_learns(spark):
    rows = [(k, ("some plain words here " * 3) + ("grobnikei " if k % 4 == 0 else "") + f"w{k}", k % 4 == 0) for k in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], int(r[2])) for r in rows], "doc_id long, toxic int")
    found = toxicity.score_toxicity(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (found["predicted"] == found["toxic"]).all()


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            fits = {
                "email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m.group().split(".")),
                "card": lambda: 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": lambda: 9 <= len(digits) <= 15,
            }[kind]()
            if fits:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], list(PATTERNS).index(s[0])))


@pytest.mark.parametrize("seed", range(4))
def test_base_spans_are_those_of_the_patterns(seed):
    rng = np.random.default_rng(seed)
    parts = ["a@b.c", "@", "x", "é", ".", "-", " ", "1", "255", "+1", "4539 1488 0343 6467", "(", ")", "256.1.1.1", "10.0.0.1", "%", "+49 30 1234567"]
    for _ in range(400):
        text = "".join(rng.choice(parts, rng.integers(1, 14)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_long_runs_take_linear_time():
    assert pii.base_spans("a" * 500_000 + "@" + "1" * 500_000 + "+" * 1000) == []
    assert pii.base_spans("1." * 200_000) is not None


def test_personal_data_of_odd_rows(spark, odd):
    found = pii.find_personal_data(odd).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert len(found) == 9 and all(r["base_sha256"] == empty for r in found)
    assert pii.find_personal_data(odd.limit(0)).count() == 0


def test_labelers_add_secrets_and_keep_base_spans(spark):
    rows = [(k, f"mail a{k}@b.org token = 3f9ac0d41e77b2a85c6d0e1f{k:04x} end") for k in range(60)]
    rows += [(100 + k, "plain words only, deadbeefdeadbeefdead") for k in range(20)]
    found = {r["doc_id"]: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[k]["n_email"] == 1 and "email:5:" in found[k]["spans"] and "secret:" in found[k]["spans"] for k in range(60))
    assert all(found[100 + k]["spans"] == "" for k in range(20))


def test_string_hashes():
    words = pa.array(["", "a", "b", "ab", "ba", "가", "x" * 300, "x" * 299, "a", "x" * 300, "\0", "\0\0"], pa.large_string())
    hashes = common.string_hashes(words)
    assert [int(h) == 0 for h in hashes] == [w == "" for w in words.to_pylist()]
    assert len(set(hashes.tolist())) == 10 and hashes[1] == hashes[8] and hashes[6] == hashes[9]
    assert (common.string_hashes(words[2:7]) == hashes[2:7]).all() and not len(common.string_hashes(words[:0]))
    many = pa.array([f"w{k}" for k in range(200_000)], pa.large_string())
    assert len(np.unique(common.string_hashes(many))) == 200_000


def test_word_order_is_that_of_counts_then_hashes():
    known = np.array([1 << 33, (1 << 33) + 5, 7, 9 << 40, 3], np.uint64)
    for often in ([2, 2, 1, 1, 5], [0, 3, 9, 8, 1]):
        often = np.array(often, np.float32)
        assert line_dedup._rarest_first(known, often).tolist() == np.lexsort((known, often)).tolist()


def test_word_keys_tell_the_words_apart_that_word_codes_does():
    every = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    texts = [f"Word{c}word" for c in every]
    texts += [None, "", " ", "\u3000", "\u00a0a\u2003 b\u3000", "a", "a\0", "a\0\0", "\0", "Ü ü", "\u0660\u2028\u3001", "x\u0085", "e", "\u20ac \u00e9"]
    texts += [f"{'y' * k} {'y' * k}z z{'y' * k}" for k in (7, 8, 9, 15, 16, 17, 255, 256, 257, 300, 5000)]
    for part in (pa.array(texts), pa.array(texts, pa.large_string()).slice(5), pa.array(texts[-11:])):
        codes, start, known = common.word_codes(part)
        keys, first = common.word_keys(part)
        assert first.tolist() == start.tolist()
        # As many different words, and as many pairs of a word's code and key.
        assert len(np.unique(keys)) == len(np.unique(codes)) == len({*zip(codes.tolist(), keys.tolist())})
    for empty in (pa.array([], pa.string()), pa.array([None, "", "\n"], pa.string())):
        keys, first = common.word_keys(empty)
        assert not len(keys) and first.tolist() == [0] * (len(empty) + 1)
    many = pa.array([f"w{k} {k}-long-word-{k}" for k in range(200_000)])
    assert len(np.unique(common.word_keys(many)[0])) == 400_000


def test_lines_are_counted_without_splitting_texts(spark):
    texts = [None, "", "\n", "a", "a\n", "\na\r\nb\n\n", "\u3000\u2028b\nc"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found, n_lines, _ = line_dedup.without_lines(docs, spark.createDataFrame([(5, 1)], "doc_id long, line int"))
    assert {r["doc_id"]: r[n_lines] for r in found.collect()} == {k: len((t or "").split("\n")) for k, t in enumerate(texts)}
    plan = found.select(n_lines)._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan
