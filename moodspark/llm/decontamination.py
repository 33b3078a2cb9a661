"""Benchmark decontamination: every passage of every text queries a BM25 index of the test items."""

import re
from bisect import bisect_left
from dataclasses import dataclass, fields, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from moodspark.llm.common import batches, giving_back, letter_words, shingle_hashes, whole_text, word_hashes
from moodspark.plans.session import cut_lineage

K1, B = 1.2, 0.75
# Items of a block share the bound by which they are skipped together.
BLOCK = 8
# Terms of items that one pass over the corpus holds as an index; more are done in more passes.
SHARD_TERMS = 1_000_000
WIDTH = 5

_ANSWER = re.compile(r"\n\s*(?:answer|antwort|réponse|respuesta)\s*[:.]", re.I)


def question_and_answer(text: str) -> tuple[str, str]:
    """An item's question and answer: what follows an answer mark or the last question mark; else all is the question."""
    marked = _ANSWER.search(text)
    if marked:
        return text[:marked.start()], text[marked.end():]
    asked = text.rfind("?")
    if 0 <= asked and text[asked + 1:].strip():
        return text[:asked + 1], text[asked + 1:]
    return text, ""


def item_terms(benchmark: DataFrame) -> DataFrame:
    """item_id, term, weight: BM25 weights, in shares of the score that an item has for its own text.

    So one threshold fits items of any length, and a passage that holds all of an item scores 1. Repeated rows of an
    item count once; items without words have no terms.
    """

    def run(rows):
        for batch in batches(rows):
            values, start = word_hashes(letter_words(batch["text"]))
            owner = np.repeat(np.arange(batch.num_rows), np.diff(start))
            order = np.lexsort((values, owner))
            owner, values = owner[order], values[order]
            first = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])]) if len(values) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays(
                [batch["item_id"].take(pa.array(owner[first])), pa.array(values[first].view(np.int64)),
                 pa.array(np.diff(np.r_[first, len(values)])), pa.array(np.diff(start)[owner[first]])],
                ["item_id", "term", "tf", "words"],
            )

    texts = item_texts(benchmark).select(F.col("key").alias("item_id"), "text")
    terms = cut_lineage(texts.mapInArrow(run, "item_id long, term long, tf long, words long"))
    size = terms.select("item_id", "words").distinct().agg(F.count("*").alias("items"), F.avg("words").alias("mean"))
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("items") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("words") / F.col("mean")))
    scored = terms.join(df, "term").join(F.broadcast(size)).select("item_id", "term", (idf * tf).alias("score"))
    return scored.withColumn("weight", F.col("score") / F.sum("score").over(W.partitionBy("item_id"))).drop("score")


@dataclass(frozen=True)
class Index:
    """An inverted index of some items, with the largest weight of each term by block and over all."""

    terms: np.ndarray  # sorted
    weights: np.ndarray  # terms x items, in blocks of BLOCK
    block_max: np.ndarray  # terms x blocks
    term_max: np.ndarray
    items: np.ndarray
    questions: list[tuple[int, np.ndarray]]  # words in a shingle, shingles
    answers: list[tuple[int, np.ndarray]]
    lengths: list[int]  # words of question and answer
    answer_words: list[np.ndarray]
    reach: int

    @classmethod
    def build(cls, items: np.ndarray, term: np.ndarray, weight: np.ndarray, texts: dict[int, str]) -> "Index":
        ids, at = np.unique(items, return_inverse=True)
        terms, t = np.unique(term, return_inverse=True)
        wide = -(-len(ids) // BLOCK) * BLOCK
        matrix = np.zeros((len(terms), wide), np.float32)
        matrix[t, at] = weight
        block_max = matrix.reshape(len(terms), -1, BLOCK).max(2)
        parts = [question_and_answer(texts[i]) for i in ids.tolist()]
        sizes = np.diff(word_hashes(letter_words(pa.array([texts[i] for i in ids.tolist()])))[1])
        sets = [[_shingles_of(p) for p in part] for part in parts]
        own = [np.unique(word_hashes(letter_words(pa.array([answer])))[0]) for _, answer in parts]
        return cls(terms, matrix, block_max, block_max.max(1), ids, [s[0] for s in sets], [s[1] for s in sets], sizes.tolist(), own, int(sizes.max()))


def _shingles_of(part: str) -> tuple[int, np.ndarray]:
    """Width and hashes of a question's or answer's shingles; fewer words than the usual width are one shingle."""
    words = letter_words(pa.array([part]))
    width = min(WIDTH, max(1, len(word_hashes(words)[0])))
    return width, np.unique(shingle_hashes(words, width)[0])


def passages(starts: np.ndarray, owner: np.ndarray, place: np.ndarray, step: int) -> np.ndarray:
    """The passages that each word is in: those of a text begin every `step` words and have twice as many.

    So any `step` words in a row are in one passage together. The last passage of a text may be shorter.
    """
    own = place // step
    before = own > 0
    return np.r_[starts[owner] + own, starts[owner[before]] + own[before] - 1], before


def retrieve(index: Index, values: np.ndarray, start: np.ndarray, threshold: float) -> list[tuple[int, int, float]]:
    """Text, item and score of every passage and item that score at least the threshold together.

    Bounds work as in block-max WAND, for all passages of a batch at once: a passage whose terms' largest weights add
    up to less has no pivot and is skipped; then blocks whose largest weights add up to less are skipped; items of
    the blocks left are scored in full. No item at or above the threshold is lost.
    """
    n = np.diff(start)
    count = -(-n // index.reach)
    first = np.r_[0, np.cumsum(count)]
    term = np.searchsorted(index.terms, values.view(np.int64))
    term[term == len(index.terms)] = 0
    hit = np.flatnonzero(index.terms[term] == values.view(np.int64))
    owner = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(values)) - np.repeat(start[:-1], n)
    at, before = passages(first[:-1], owner[hit], place[hit], index.reach)
    pairs = np.unique(at * len(index.terms) + np.r_[term[hit], term[hit][before]])
    passage, term = pairs // len(index.terms), pairs % len(index.terms)
    found = []
    if not len(pairs):
        return found
    heads = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
    slack = np.float32(threshold - 1e-4)
    bound = np.add.reduceat(index.term_max[term], heads)
    sizes = np.diff(np.r_[heads, len(passage)])
    keep = bound >= slack
    live = np.repeat(keep, sizes)
    passage, term, sizes = passage[live], term[live], sizes[keep]
    ends = np.cumsum(sizes)
    text_of = np.searchsorted(first, np.arange(first[-1]), "right") - 1
    step = max(1, 4_000_000 // index.block_max.shape[1])
    low = 0
    while low < len(sizes):
        base = ends[low] - sizes[low]
        high = max(low + 1, int(np.searchsorted(ends, base + step, "right")))
        rows = slice(int(base), int(ends[high - 1]))
        starts_here = ends[low:high] - sizes[low:high] - base
        blocks = np.add.reduceat(index.block_max[term[rows]], starts_here, axis=0)
        for p, b in zip(*np.nonzero(blocks >= slack)):
            a = int(ends[low + p] - sizes[low + p])
            scores = index.weights[term[a:a + sizes[low + p]], b * BLOCK:(b + 1) * BLOCK].sum(0)
            for k in np.flatnonzero(scores >= slack):
                found.append((int(text_of[passage[a]]), int(b * BLOCK + k), float(scores[k])))
        low = high
    return found


def verified(index: Index, texts: pa.Array, found: list[tuple[int, int, float]], least: float) -> list[tuple[int, int, float, float, float]]:
    """Text, item, score, question and answer overlap of those whose two overlaps reach `least`.

    The overlap is the share of the question's, or answer's, word shingles that the text has. An answer so short that
    one other word can spoil too many of its shingles is judged by its words beside the question too, and the larger
    share counts. An item without an answer, or in which none is marked, is judged by all its shingles together.
    """
    best: dict[tuple[int, int], float] = {}
    for row, item, score in found:
        best[row, item] = max(score, best.get((row, item), 0.0))
    if not best:
        return []
    rows = sorted({r for r, _ in best})
    words = texts.take(pa.array(rows))
    grams, plain = {}, word_hashes(words)
    out = []
    for (row, item), score in best.items():
        k = bisect_left(rows, row)
        shares = []
        for width, part in (index.questions[item], index.answers[item]):
            if width not in grams:
                grams[width] = shingle_hashes(words, width)
            values, start = grams[width]
            shares.append(float(np.isin(part, values[start[k]:start[k + 1]]).mean()) if len(part) else 1.0)
        answer = index.answers[item][1]
        if shares[0] >= least > shares[1] and len(answer) * (1 - least) < WIDTH:
            width, question = index.questions[item]
            values, start = grams[width]
            at = np.flatnonzero(np.isin(values[start[k]:start[k + 1]], question))
            near = _beside(plain[0][plain[1][k]:plain[1][k + 1]], at, width, index.lengths[item])
            shares[1] = max(shares[1], float(np.isin(index.answer_words[item], near).mean()))
        if min(shares) >= least:
            out.append((row, item, score, *shares))
    return out


def _beside(words: np.ndarray, at: np.ndarray, width: int, reach: int) -> np.ndarray:
    """The words up to `reach` words after the begin of any shingle of the question, without those of its shingles."""
    edges = np.zeros((2, len(words) + 1), np.int64)
    for row, length in zip(edges, (reach, width)):
        np.add.at(row, at, 1)
        np.add.at(row, np.minimum(at + length, len(words)), -1)
    close, inside = np.cumsum(edges, axis=1)[:, :-1] > 0
    return words[close & ~inside]


def item_texts(benchmark: DataFrame) -> DataFrame:
    """key, item_id, text of every different text of every item with an id; the key is a hash of both."""
    texts = benchmark.select(F.col("item_id").cast("long").alias("item_id"), whole_text().alias("text")).where("item_id IS NOT NULL").distinct()
    return texts.select(F.xxhash64("item_id", "text").alias("key"), "item_id", "text")


def indexes(benchmark: DataFrame, shard_terms: int = SHARD_TERMS) -> list[Index]:
    """The index of all items, cut into as many as are needed for none to hold more than about `shard_terms` terms.

    Each text of an item is indexed by itself, under the item's id; all texts of an item are in the same part.
    """
    texts = cut_lineage(item_texts(benchmark))
    terms = cut_lineage(item_terms(benchmark).join(texts.select(F.col("key").alias("item_id"), F.col("item_id").alias("of")), "item_id"))
    shards = -(-terms.count() // shard_terms)
    out = []
    for k in range(shards):
        # Bounded: a shard's terms, and the texts they come from.
        rows = terms.where(F.pmod(F.xxhash64("of"), F.lit(shards)) == k).toPandas()
        if len(rows):
            held = texts.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == k).collect()
            built = Index.build(
                rows["item_id"].to_numpy(), rows["term"].to_numpy(), rows["weight"].to_numpy(), {r["key"]: r["text"] for r in held}
            )
            ids = {r["key"]: r["item_id"] for r in held}
            out.append(replace(built, items=np.array([ids[key] for key in built.items.tolist()], np.int64)))
    return out


def astuple(index: Index) -> tuple:
    """The index as plain arrays, which every executor can read without this module."""
    return tuple(getattr(index, f.name) for f in fields(index))


def _matches(index: Index, texts: pa.Array, threshold: float, least: float):
    words = letter_words(texts)
    values, start = word_hashes(words)
    return verified(index, words, retrieve(index, values, start, threshold), least)


def find_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, least: float = 0.8) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap for every text and item it holds.

    Words are compared in lower case and without punctuation. A null, empty or wordless text holds nothing, nor does
    a wordless item match; a row without an id is reported without one. Repeated rows are reported each, a repeated
    item once; different texts under one item id are looked for each. Other columns are not read; an empty table on either side gives an empty result. Texts are looked at
    whole, in passages; if the items do not fit one index, the corpus is passed over once for each.
    """
    shape = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    out = None
    for index in indexes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(astuple(index))

        def run(rows, shared=shared):
            index = Index(*shared.value)
            for batch in batches(rows, 2 << 20):
                # Of several texts of an item that a row holds, the one with the best score counts.
                best = {}
                for row, item, *numbers in _matches(index, batch["text"], threshold, least):
                    key = row, int(index.items[item])
                    best[key] = max(best.get(key, (row, item, *numbers)), (row, item, *numbers), key=lambda f: f[2:])
                row, item, *numbers = zip(*best.values()) if best else [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].take(pa.array(row, pa.int64())), pa.array(index.items[list(item)] if item else [], pa.int64()),
                     *[pa.array(x, pa.float64()) for x in numbers]],
                    ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"],
                )

        part = texts.mapInArrow(giving_back(run), shape)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], shape) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, least: float = 0.8) -> DataFrame:
    """The rows of `docs` whose text holds no test item, with all their columns, judged in the pass that keeps them."""
    for index in indexes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(astuple(index))

        def run(rows, shared=shared):
            index = Index(*shared.value)
            for batch in batches(rows, 2 << 20):
                bad = np.zeros(batch.num_rows, bool)
                bad[[f[0] for f in _matches(index, batch["text"], threshold, least)]] = True
                yield batch.filter(pa.array(~bad))

        docs = docs.mapInArrow(giving_back(run), docs.schema)
    return docs
