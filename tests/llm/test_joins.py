"""Line dedup, n-gram join, decontamination, fingerprints and chats against plain loops."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from moodspark.llm import chat, common, decontamination, fingerprints, line_dedup, ngram_join
from moodspark.llm.components import components
from moodspark.llm.queries import LLM_QUERIES


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def altered(rng, base, changes):
    out = list(base)
    for _ in range(changes):
        out[rng.randrange(len(out))] = f"n{rng.randrange(10**6)}"
    return out


@pytest.fixture(scope="module")
def corpus():
    """Families of near copies, exact copies, short, empty and null texts."""
    rng = random.Random(5)
    texts = []
    for _ in range(12):
        base = words(rng, rng.randrange(20, 120))
        texts += [" ".join(altered(rng, base, rng.randrange(0, 4))) for _ in range(rng.randrange(2, 9))]
    texts += [" ".join(words(rng, rng.randrange(1, 60))) for _ in range(40)]
    line = " ".join(words(rng, 14))
    texts += [f"{line}\n{' '.join(words(rng, 9))}\n{' '.join(altered(rng, line.split(), 1))}" for _ in range(30)]
    texts += ["", None, "one two", "one two", " \n\t ", "A b C d e", "a B c D E"]
    rng.shuffle(texts)
    return [(k, t) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    rows = [(*r, "en", 1, 2) for r in corpus] + [(None, "row without an id but with words", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long, line int")


def plain_lines(corpus, least=1):
    seen, gone = [], set()
    for d, t in corpus:
        for k, line in enumerate((t or "").split("\n")):
            s = frozenset(line.lower().split())
            if len(s) >= least:
                if any(10 * len(s & o) >= 8 * len(s | o) for o in seen):
                    gone.add((d, k))
                seen.append(s)
    return gone


@pytest.mark.parametrize("cell", [line_dedup.CELL_LINES, 3])
def test_lines_are_those_of_the_loop(docs, corpus, cell):
    for least in (1, 5):
        found = {(r["doc_id"], r["line"]) for r in line_dedup.repeated_lines(docs, least=least, cell_lines=cell).collect()}
        assert found == plain_lines(corpus, least)


def test_lines_in_a_second_pass(docs, corpus, monkeypatch):
    for name, value in (("REPORTS", 0), ("SMALL", 2), ("HEADS", 1), ("TASK_WORDS", 500)):
        monkeypatch.setattr(line_dedup, name, value)
    found = {(r["doc_id"], r["line"]) for r in line_dedup.repeated_lines(docs).collect()}
    assert found == plain_lines(corpus)


def test_texts_without_lines(docs, corpus):
    gone = plain_lines(corpus)
    found = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs).collect()}
    for d, t in corpus:
        assert found[d]["text"] == "\n".join(x for k, x in enumerate((t or "").split("\n")) if (d, k) not in gone)
    assert found[None]["n_removed"] == 0
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0
    stage = line_dedup.drop_repeated_lines(docs)
    assert stage.columns == docs.columns


def test_the_query_takes_short_lines_too(spark, tmp_path):
    rows = [
        (1, "Read more\nMenu\na b c d\n\n"), (2, "read  MORE\nmenu\na b c d e\na b c\n"), (3, "more read\nread\na b c\na b d\n \nMenu"),
        (4, None), (None, "Menu\nRead more"),
    ]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r["text"] for r in LLM_QUERIES["op8_line_dedup"](spark, str(tmp_path)).collect()}
    assert found[None] == "Menu\nRead more"
    words_only = [(d, t) for d, t in rows if d is not None]
    gone = plain_lines(words_only, least=1)
    assert {(2, 0), (2, 1), (2, 2), (3, 0), (3, 2), (3, 5)} == gone
    for d, t in words_only:
        assert found[d] == "\n".join(x for k, x in enumerate((t or "").split("\n")) if (d, k) not in gone)


def plain_links(corpus):
    sets = {}
    for d, t in corpus:
        w = (t or "").lower().split()
        if w:
            s = frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) or frozenset([tuple(w)])
            sets.setdefault(s, []).append(d)
    keys = list(sets)
    near = {k: [j for j, o in enumerate(keys) if j != k and 10 * len(s & o) >= 8 * len(s | o)] for k, s in enumerate(keys)}
    out = {d: (d, 1, 0) for d, t in corpus if not (t or "").split()}
    for k, s in enumerate(keys):
        reached, front = {k}, [k]
        while front:
            front = [j for f in front for j in near[f] if j not in reached]
            reached.update(front)
        for d in sets[s]:
            out[d] = (min(min(sets[keys[j]]) for j in reached), len(sets[s]), len(near[k]))
    return out


@pytest.mark.parametrize("options", [{}, {"leaf": 2, "bucket_rows": 3, "cell_rows": 2}])
def test_links_are_those_of_the_loop(docs, corpus, options):
    found = {r["doc_id"]: (r["class_id"], r["copies"], r["n_links"]) for r in ngram_join.near_duplicates(docs, **options).collect()}
    assert found == plain_links(corpus)


def test_recall_of_pairs_that_meet_in_large_buckets_only(spark):
    """Every bucket is large, one set of a pair contains the other, and they are just alike enough."""
    rng = random.Random(8)
    rows = []
    for k in range(0, 1200, 2):
        text = [f"p{k}w{rng.randrange(10**9)}" for _ in range(104)]
        rows += [(k, " ".join(text)), (k + 1, " ".join(text[:84]))]
    pairs = spark.createDataFrame(rows, "doc_id long, text string")
    found = ngram_join.near_duplicates(pairs, leaf=1).where("doc_id <> class_id").count()
    assert found == 600


def test_one_of_each_class_stays(docs, corpus):
    plain = plain_links(corpus)
    kept = ngram_join.keep_one_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted(d for d, c in plain.items() if c[0] == d)
    assert kept.where("doc_id is null").count() == 1
    assert ngram_join.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 100), (200, 150)], "a long, b long")
    found = {r["key"]: r["root"] for r in components(edges).collect()}
    assert found == {**dict.fromkeys(range(41), 0), 100: 100, 150: 150, 200: 150}


ITEMS = [
    (1, "What is the tallest mountain on the continent called by those who live near it? It is called Akunara."),
    (2, "Name the river that runs through the old town of Brell. Answer follows here.\nAnswer: the Ostrel river"),
    (3, ""), (4, None), (None, "an item without an id that would match"), (1, "What is the tallest mountain on the continent called by those who live near it? It is called Akunara."),
    (5, "Short item."),
]


def test_contaminated_texts_are_found_whole_and_in_passages(spark):
    rng = random.Random(3)
    filler = " ".join(words(rng, 3000))
    rows = [
        (1, f"{filler} {ITEMS[0][1].upper()} {filler}"), (2, ITEMS[1][1].replace("\n", "  ")), (3, filler), (4, None), (5, ""),
        (6, "What is the tallest mountain on the continent called by those who live near it?"), (None, ITEMS[0][1]),
        (7, "It is a short item."), (2, ITEMS[1][1]),
    ]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, item_id int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = sorted((r["doc_id"] or 0, r["item_id"]) for r in decontamination.find_contaminated(docs, items).collect())
    assert found == [(0, 1), (1, 1), (2, 2), (2, 2), (7, 5)]
    kept = decontamination.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 6]
    assert decontamination.find_contaminated(docs.limit(0), items).count() == 0
    assert decontamination.find_contaminated(docs, items.limit(0)).count() == 0


def test_changed_words_in_items_with_and_without_answers(spark):
    """One changed word in the last sentence, or in a short answer; other answers beside the question do not count."""
    rng = random.Random(4)
    first, last = words(rng, 60, 10**6), words(rng, 6, 10**6)
    question, answer = words(rng, 30, 10**6), words(rng, 7, 10**6)
    items = [(1, f"{' '.join(first)}. {' '.join(last)}."), (2, f"{' '.join(question)}?\nAnswer: {' '.join(answer)}")]
    near, far = [*answer[:3], "else", *answer[4:]], [*answer[:3], "quite", "else", *answer[5:]]
    rows = [
        (1, f"{' '.join(first)}. {' '.join([*last[:3], 'else', *last[4:]])}."), (2, f"{' '.join(question)} {' '.join(near)}"),
        (3, f"{' '.join(question)} {' '.join(far)}"), (4, " ".join(question)),
        (5, f"{' '.join(near)} {' '.join(words(rng, 90, 10**6))} {' '.join(question)}"), (6, " ".join(first[:40])),
    ]
    found = decontamination.find_contaminated(
        spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    )
    assert sorted((r["doc_id"], r["item_id"]) for r in found.collect()) == [(1, 1), (2, 2)]


def test_passages_lose_no_item(spark, small):
    docs, items = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    exact = {(d["doc_id"], i["item_id"]) for d in docs.collect() for i in items.collect() if i["text"] in d["text"]}
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.find_contaminated(docs, items).collect()}
    assert exact and exact <= found


def plain_edit(texts):
    out = []
    for k, t in enumerate(texts):
        after = texts[(k + 1) % len(texts)]
        half = len(t) // 2
        out.append(t[:len(t) - half] + after[:half])
    return out


@pytest.mark.parametrize("rows", [3, 10_000])
def test_edited_texts_and_likeness(spark, corpus, rows):
    docs = spark.createDataFrame([(d * d - 9, t) for d, t in corpus], "doc_id long, text string")
    found = sorted(fingerprints.fingerprint_documents(docs, rows).collect(), key=lambda r: r["doc_id"])
    texts = [t or "" for _, t in sorted((d * d - 9, t) for d, t in corpus if d >= 0)]
    assert [r["edited_sha256"] for r in found] == [hashlib.sha256(t.encode()).hexdigest() for t in plain_edit(texts)]
    assert [r["n_chars"] for r in found] == [len(t) for t in texts]
    by_text = {}
    for r, t in zip(found, texts):
        assert by_text.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert fingerprints.fingerprint_documents(docs.limit(0)).count() == 0
    one = fingerprints.fingerprint_documents(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).collect()
    assert one[0]["near_next"] == 1.0


def test_sketch_estimates_unequal_texts(spark):
    rng = random.Random(1)
    long = words(rng, 6000, 10**6)
    rows = [(1, " ".join(long), " ".join(long[:3000])), (2, " ".join(long), " ".join(words(rng, 500, 10**6)))]
    df = spark.createDataFrame(rows, "k int, a string, b string").select("k", fingerprints.sketch(_c("a")).alias("a"), fingerprints.sketch(_c("b")).alias("b"))
    found = {r["k"]: r["s"] for r in df.select("k", fingerprints.likeness(_c("a"), _c("b")).alias("s")).collect()}
    assert abs(found[1]["jaccard"] - 0.5) < 0.12 and found[1]["b_in_a"] > 0.9 and found[2]["jaccard"] < 0.05


def _c(name):
    from pyspark.sql import functions as F

    return F.col(name)


def test_only_maximal_chats_stay(spark):
    def talk(conv, n, other=None):
        return [(conv, k, "user" if k % 2 == 0 else "assistant", other if other and k == n - 1 else f"t{k}", 1) for k in range(n)]

    rows = talk(1, 2) + talk(2, 5) + talk(3, 5) + talk(4, 4, "else") + talk(5, 3) + [(5, 0, "user", "t0", 1)]
    rows += [(6, None, None, None, 1), (None, 0, "user", "t0", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n long")
    for parts, floor in ((512, 10**6), (2, 1)):
        found = chat.format_chats(df, parts, floor).orderBy("conv_id", "part").collect()
        assert [(c, "".join(r["text"] for r in found if r["conv_id"] == c)) for c in (4,)] == [
            (4, "<|user|>\nt0\n<|assistant|>\nt1\n<|user|>\nt2\n<|assistant|>\nelse\n")]
        assert {(r["conv_id"], r["n_turns"], r["copies"]) for r in found} == {(2, 5, 2), (4, 4, 1), (6, 1, 1)}
    assert chat.format_chats(df.limit(0)).count() == 0


def test_words_of_a_line_are_one_each_and_rarest_first():
    lines = ["b a b", "", "c c", " x\ty x ", None, "a b c"]
    # One counter for all words; then as many as there are hashes, so that those differ.
    for counts in (np.ones(1, np.float32), np.arange(1, 4098, dtype=np.float32)):
        words, start = line_dedup._sets(pa.array(lines), counts)
        order = {}
        for k, line in enumerate(lines):
            keys, _ = common.word_keys(pa.array([line], pa.string()))
            found = words[start[k]:start[k + 1]]
            assert sorted(found.tolist()) == sorted({*keys.tolist()})
            rare = counts[(found % np.uint64(len(counts))).astype(int)].view(np.uint32) >> 15
            order[k] = [*zip(rare.tolist(), found.tolist())]
            assert order[k] == sorted(order[k])


def test_words_that_begin_with_the_same_bits_stay_apart(monkeypatch):
    keys = np.array([5, 6, 5, 6, 6, 4], np.uint64)
    monkeypatch.setattr(line_dedup, "word_keys", lambda lines: (keys, np.array([0, 3, 3, 6])))
    words, start = line_dedup._sets(pa.array(["", "", ""]), np.ones(1, np.float32))
    assert words.tolist() == [5, 6, 4, 6] and start.tolist() == [0, 2, 2, 4]


@pytest.mark.parametrize("batch", [3, 10_000])
def test_copies_of_a_set_are_all_but_its_first_line(spark, batch, monkeypatch):
    monkeypatch.setattr(line_dedup, "TASK_WORDS", 20)
    rows = [(d, line, (7 * d + line) % 9, (d * line) % 2) for d in range(-20, 20) for line in range(3)] + [(0, 0, 0, 0), (5, 1, 6, 0)]
    df = spark.createDataFrame(rows, "doc_id long, line int, k1 long, k2 long").repartition(3)
    first = {}
    for d, line, *k in rows:
        first[*k] = min(first.get((*k,), (d, line)), (d, line))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        copies = line_dedup._copies(df, len(rows))
        assert {(*r,) for r in copies.collect()} == {(d, line) for d, line, *k in rows if (d, line) != first[*k]}
        assert not line_dedup._copies(df.limit(0), 0).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = copies._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan


@pytest.mark.parametrize("small, reports", [(48, 6), (0, 6), (0, None), (48, None)])
def test_lines_of_a_word_are_tried_with_those_of_a_like_length_only(small, reports, monkeypatch):
    monkeypatch.setattr(line_dedup, "SMALL", small)
    tried = []
    find = line_dedup._pairs_within

    def counted(cols, who, low, high, threshold):
        tried.append(np.maximum(high - low, 0).sum())
        return find(cols, who, low, high, threshold)

    monkeypatch.setattr(line_dedup, "_pairs_within", counted)
    rng = np.random.default_rng(1)
    entries = np.zeros(3000, line_dedup._ENTRY)
    n = np.r_[rng.integers(1, 3000, 2980), [4094, 4095, 4096, 5000, 6000] * 4]
    pos = np.minimum(rng.integers(0, 40, len(n)), n - 1)
    word = np.where(np.arange(len(n)) % 5 == 0, 1 << 20, 9 << 40).astype(np.uint64)
    entries["doc_id"], entries["line"], entries["n"], entries["pos"], entries["probe"] = rng.permutation(len(n)), 1, n, pos, True
    entries["bits"] = rng.integers(0, 2**63, len(n), np.uint64)
    entries["key"] = line_dedup._key(word, n)
    batch = pa.RecordBatch.from_arrays([pa.array([entries[:700].tobytes(), entries[700:].tobytes()], pa.binary())], ["entries"])
    found = [(r["doc_id"], r["doc_id2"]) for b in line_dedup._candidates(0.8, reports)(iter([batch])) for r in b.to_pylist()]
    i, j = np.triu_indices(len(n), 1)
    left = np.minimum(n[i] - pos[i], n[j] - pos[j])
    near = (word[i] == word[j]) & (1.8 * left >= 0.8 * (n[i] + n[j]) - 1e-9)
    i, j = i[near], j[near]
    cols = {c: entries[c] for c in entries.dtype.names}
    alike = line_dedup._alike_enough(cols, i, j, 0.8)
    doc = entries["doc_id"]
    wanted = {(max(doc[a], doc[b]), min(doc[a], doc[b])) for a, b in zip(i[alike], j[alike])}
    assert wanted and set(found) <= wanted
    if reports is None:
        assert set(found) == wanted and len(found) == len(wanted)
    else:
        assert {late for late, _ in found} == {late for late, _ in wanted}
    # By far the most pairs of lines of a word have too different lengths.
    assert sum(tried) < 0.3 * len(n) * (len(n) - 1) / 2
