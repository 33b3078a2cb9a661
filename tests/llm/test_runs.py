"""Periodic runs against a plain search period by period, and LCE queries against comparing word by word."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from moodspark.llm import runs
from moodspark.llm.queries import LLM_QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words):
    """start, length, smallest period of every run: for each period the stretches of equal words one period apart."""
    codes = {w: k for k, w in enumerate(dict.fromkeys(words))}
    line, n, found = np.array([codes[w] for w in words], int), len(words), {}
    for p in range(1, n // 2 + 1):
        same = np.r_[False, line[p:] == line[:-p], False].astype(int)
        for a, b in zip(np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1)):
            if b - a + p >= max(12, 2 * p):
                found.setdefault((int(a), int(b - a + p)), p)
    return sorted((s, length, p) for (s, length), p in found.items())


def plain_row(doc_id, text, plant=True):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if plant and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    gone = {i for s, length, p in found for i in range(s + p, s + length)}
    best = max(found, key=lambda r: (r[1], -r[0], -r[2])) if found else (None, None, None)
    return (
        doc_id, len(found), *best, best[1] * 1000 // best[2] if found else None,
        hashlib.sha256("".join(f"{s},{length},{p}\n" for s, length, p in found).encode()).hexdigest(),
        hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest(),
    )


def test_query_against_plain_search(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    got = LLM_QUERIES["op12_periodic_runs"](spark, small)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = sorted(tuple(r) for r in got.collect())
    want = sorted(plain_row(r["doc_id"], r["text"]) for r in docs)
    assert got == want
    assert sum(r[1] for r in want) > 5


def sequences():
    draw = random.Random(3)
    fibonacci = ["a", "b"]
    while len(fibonacci[-1]) < 400:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    yield list(fibonacci[-1])
    yield ["a"] * 300
    yield list("ab" * 90 + "a")
    yield list("abcabcabcabcab" + "x" + "abcabcabcabcab")
    thue = [bin(k).count("1") % 2 for k in range(256)]
    yield [str(k) for k in thue]
    for letters in ("ab", "abc", "abcdefgh"):
        for _ in range(25):
            yield [draw.choice(letters) for _ in range(draw.randrange(0, 160))]
    for _ in range(40):
        block = [draw.choice("abcdef") for _ in range(draw.randrange(1, 30))]
        line = []
        for _ in range(draw.randrange(1, 5)):
            line += [draw.choice("abcdefgh") for _ in range(draw.randrange(0, 20))]
            line += (block * draw.randrange(1, 7))[:draw.randrange(1, 90)]
        yield line
    yield []


def test_runs_of_many_shapes():
    lines = list(sequences())
    names = {}
    codes = np.array([names.setdefault(w, len(names)) for line in lines for w in line])
    start = np.r_[0, np.cumsum([len(x) for x in lines])]
    found = [[] for _ in lines]
    for text, s, length, p in zip(*(x.tolist() for x in runs.word_runs(codes, start))):
        found[text].append((s, length, p))
    assert found == [plain_runs(line) for line in lines]


@pytest.mark.parametrize("letters", [1, 2, 5, 1000])
def test_extensions(letters):
    draw = np.random.default_rng(letters)
    body = draw.integers(0, letters, 700)
    body[300:500] = body[100:300]
    line = np.r_[letters, body, letters + 1]
    grammar = runs.Grammar(line)
    a, b = draw.integers(1, 701, (2, 20_000))
    a, b = a[a != b], b[a != b]
    a, b = np.r_[a, 101:250], np.r_[b, 301:450]
    for step in (1, -1):
        def plain(x, y):
            k = 0
            while line[x + step * k] == line[y + step * k]:
                k += 1
            return k

        assert np.array_equal(grammar.extension(a, b, step), [plain(x, y) for x, y in zip(a, b)])


def test_grammar_shrinks_and_stands_for_the_words():
    line = np.r_[5, np.random.default_rng(1).integers(0, 4, 5000), 6]
    grammar = runs.Grammar(line)
    assert len(grammar.symbols) < 90 and len(grammar.symbols[-1]) <= 8
    # Equal symbols of a level stand for the same words.
    spans = np.arange(len(line) + 1)
    for symbols, first in zip(grammar.symbols[1:], grammar.firsts):
        spans = spans[first]
        words = {}
        for s, a, b in zip(symbols, spans[:-1], spans[1:]):
            assert words.setdefault(int(s), line[a:b].tolist()) == line[a:b].tolist()


def test_edges(spark):
    long = " ".join(f"w{k}" for k in range(60_000)) + " end" * 5000
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (None, "a b " * 8), (4, "x y " * 12), (5, "a " * 11), (6, "a " * 12), (7, long), (6, "a " * 12),
        (8, "  b\x1fc " * 9), (9, "A a " * 3 + "a A " * 3),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(1).alias(c) for c in ("runs", "n_words", "collapsed", "_best")])
    got = sorted((tuple(r) for r in runs.describe_runs(runs.periodic_runs(df)).collect()), key=repr)
    assert got == sorted((plain_row(*r, plant=False) if r[0] != 7 else (
        7, 1, 60_000, 5000, 1, 5_000_000, hashlib.sha256(b"60000,5000,1\n").hexdigest(),
        hashlib.sha256(" ".join([f"w{k}" for k in range(60_000)] + ["end"]).encode()).hexdigest(),
    ) for r in rows), key=repr)
    assert runs.periodic_runs(df.where("doc_id = 6")).first()["runs"] == [(0, 12, 1)]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert runs.describe_runs(runs.periodic_runs(empty, runs.planted_tails)).count() == 0
    # A row without id is left as it is.
    assert runs.periodic_runs(df.where("doc_id IS NULL"), runs.planted_tails).first()["runs"] == [(0, 16, 2)]
