"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text, normalised by length."""

import math
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodspark.llm.common import BINS, batches, isotonic, measured, one_label, partition_sums, split_by_crc, whole_text
from moodspark.plans.session import cut_lineage

# Letters of other scripts, digits and signs that stand for a Latin letter. L, I and 1 look alike and
# fold to the same letter.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "к": "k", "м": "m", "т": "t", "в": "b",
    "н": "h", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ѵ": "v", "ԝ": "w", "α": "a", "ο": "o", "ρ": "p",
    "ε": "e", "ι": "i", "κ": "k", "ν": "v", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "η": "n", "σ": "o", "ω": "w",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʀ": "r", "ᴏ": "o", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s",
    "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "|": "i", "l": "i", "€": "e", "£": "i", "¡": "i",
}
_INVISIBLE = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])

# Phrases in which a word of the lexicon is harmless.
EXCEPTIONS = ("trash can", "trash bin", "take out the trash", "clown fish", "clown car", "class clown", "pond scum",
              "soap scum", "sore loser", "stupid simple", "worthless stock")


def _folds() -> dict[int, str | None]:
    table: dict[int, str | None] = {ord(a): b for a, b in LOOKALIKES.items()}
    for letter, base in LOOKALIKES.items():
        table.setdefault(ord(letter.upper()), base)
    for code in range(0xFF01, 0xFF5F):  # full-width forms
        table[code] = chr(code - 0xFEE0).lower()
        table[code] = LOOKALIKES.get(table[code], table[code])
    for code in range(0x1D400, 0x1D7FF):  # styled letters
        plain = unicodedata.normalize("NFKC", chr(code)).lower()
        table[code] = "".join(LOOKALIKES.get(x, x) for x in plain)
    for code in range(0x250):  # everything else that isn't a letter ends a word
        if not chr(code).isalnum() and code not in table:
            table[code] = " "
    return table | _INVISIBLE


FOLDS = _folds()
# One in this many labelled rows calibrates scores by the lexicon of the others.
CALIBRATED = 4


def fold(text: str) -> str:
    """The text in lower case, with look-alikes and digits as the letters they stand for and words between blanks."""
    return f" {' '.join(text.lower().translate(FOLDS).split())} "


@dataclass(frozen=True)
class Lexicon:
    """Weights of patterns, folded; a pattern begins with a blank, and ends with one if it is a whole word."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS

    def matcher(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for pattern, weight in self.weights.items():
            found.add_word(pattern, (len(pattern), weight))
        for phrase in self.exceptions:
            folded = fold(phrase)
            found.add_word(folded, (len(folded), 0.0))
        if len(found):
            found.make_automaton()
        return found


def toxic_weight(matcher, folded: str) -> float:
    """Weights of the words that match, the highest for each word, but none within an exception phrase."""
    if not len(matcher):
        return 0.0
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (length, weight) in matcher.iter(folded):
        start = end - length + 1
        if weight:
            best[start] = max(weight, best.get(start, 0.0))
        else:
            spared.append((start, end))
    # Both by place, with the furthest end of a phrase so far: time grows with the matches, however long the text.
    spared.sort()
    total, reach, phrase = 0.0, -1, 0
    for at in sorted(best):
        while phrase < len(spared) and spared[phrase][0] <= at:
            reach = max(reach, spared[phrase][1])
            phrase += 1
        if at >= reach:
            total += best[at]
    return total


def raw_score(weight: float, words: int) -> float:
    """Matched weight for the length: a long text needs more to count as much."""
    return weight / np.sqrt(max(words, 1) + 20.0)


def _bins(raw: np.ndarray) -> np.ndarray:
    """Bins of equal ratio, the first for texts without any match."""
    return np.where(raw > 0, np.clip(64 * np.log2(np.maximum(raw, 1e-9)) + BINS // 2, 1, BINS - 1), 0).astype(np.int64)


# Steps of the logarithm of a chance, and chances told apart: below exp(-400) all are alike.
_CHANCE_STEPS, _CHANCES = 8, 3200
# Patterns a task counts before it passes them on.
_COUNTED = 200_000


def _unlikely(bad: int, good: int) -> Column:
    """Steps of -log of the chance, or a bound above it, that a pattern is in this many toxic texts by accident.

    By accident each text that holds the pattern is toxic as often as any text is. The Chernoff bound of the
    binomial tail is the chance itself where no other text has the pattern.
    """
    share = F.lit(bad / (bad + good))
    seen = F.col("bad") + F.col("good")
    toxic = F.col("bad") / seen
    other = F.when(F.col("good") > 0, (1 - toxic) * F.ln((1 - toxic) / (1 - share))).otherwise(F.lit(0.0))
    bits = F.when(toxic > share, seen * (toxic * F.ln(toxic / share) + other)).otherwise(F.lit(0.0))
    return F.least(F.floor(bits * _CHANCE_STEPS), F.lit(_CHANCES))


def _least_unlikely(steps: dict[int, int], false_share: float) -> int:
    """The step from which on at most `false_share` of the patterns are expected to be there by accident.

    Benjamini and Hochberg's rule over all patterns that were tested, on steps instead of sorted chances.
    """
    tested, found, least = sum(steps.values()), 0, _CHANCES + 1
    for step in sorted(steps, reverse=True):
        found += steps[step]
        if math.exp(-step / _CHANCE_STEPS) * tested <= false_share * found:
            least = step
    return least


def learn_lexicon(
    docs: DataFrame, known: DataFrame, shortest: int = 4, longest: int = 9, least_texts: int = 5,
    least_ratio: float = 8.0, false_share: float = 0.02, most_labels: int = 4_000_000,
    exceptions: tuple[str, ...] = EXCEPTIONS,
) -> Lexicon:
    """Words and beginnings of words that labelled toxic texts have many times as often as the others.

    A pattern must occur in `least_texts` toxic texts, however many there are, and in `least_ratio` times the share
    of the others; its weight is the logarithm of that ratio. Of the patterns that are there often enough, only those too
    unlikely to be an accident are taken, so that at most `false_share` of them are expected to be one. Equal texts
    count once; counts are added up in each task before they are shuffled, and only patterns that pass every test
    reach the driver. Learnt from all labelled rows, or beyond `most_labels` of them from a sample of about that
    size by hash of the id, which bounds the lexicon. Without toxic rows, or without others, the lexicon is empty.
    """

    def patterns(text):
        out = set()
        for w in set(fold(text).split()):
            out.add(f" {w} ")
            out.update(f" {w[:k]}" for k in range(shortest, min(longest, len(w)) + 1))
        return out

    def counted(rows):
        counts: tuple[dict[str, int], dict[str, int]] = ({}, {})

        def told():
            names = list(counts[0].keys() | counts[1].keys())
            columns = [pa.array([c.get(p, 0) for p in names], pa.int64()) for c in counts]
            for c in counts:
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *columns], ["pattern", "good", "bad"])

        for batch in batches(rows):
            for t, label in zip(batch["text"].to_pylist(), batch["label"].to_pylist()):
                of_label = counts[label]
                for p in patterns(t):
                    of_label[p] = of_label.get(p, 0) + 1
                if len(counts[0]) + len(counts[1]) > _COUNTED:
                    yield told()
        yield told()

    labelled = docs.select("doc_id", whole_text().alias("text")).join(measured(known, 16), "doc_id")
    once = labelled.groupBy(F.xxhash64("text").alias("same"), F.length("text").alias("size")).agg(F.min("doc_id").alias("doc_id"))
    texts = labelled.join(measured(cut_lineage(once.select("doc_id").distinct()), 8), "doc_id", "left_semi")

    def totals():
        total = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count("*").alias("n")).collect()}
        return total.get(1, 0), total.get(0, 0)

    bad, good = totals()
    if bad + good > most_labels:
        place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("lexicon")), F.lit(1 << 20))
        texts = texts.where(place < F.lit(int(most_labels / (bad + good) * (1 << 20))))
        bad, good = totals()
    if not bad or not good:
        return Lexicon({}, exceptions)
    told = texts.select("text", F.col("label").cast("int").alias("label")).mapInArrow(
        counted, "pattern string, good long, bad long"
    )
    sums = told.groupBy("pattern").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    ratio = (F.col("bad") / bad) / ((F.col("good") + 0.5) / (good + 1))
    often = cut_lineage(sums.where(F.col("bad") >= least_texts).withColumns({"ratio": ratio, "step": _unlikely(bad, good)}))
    steps = {r["step"]: r["n"] for r in often.groupBy("step").agg(F.count("*").alias("n")).collect()}
    chosen = often.where((F.col("ratio") >= least_ratio) & (F.col("step") >= _least_unlikely(steps, false_share)))
    weights = {r["pattern"]: math.log2(r["ratio"]) for r in chosen.select("pattern", "ratio").collect()}
    # A pattern that a shorter one with as much weight already finds adds nothing.
    kept = {p: w for p, w in weights.items()
            if not any(weights.get(p[:k], 0.0) >= w for k in range(shortest + 1, len(p)))}
    return Lexicon(kept, exceptions)


def _raw(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    def run(rows):
        matcher = lexicon.matcher()
        for batch in batches(rows):
            raw = []
            for t in batch["text"].to_pylist():
                folded = fold(t)
                raw.append(raw_score(toxic_weight(matcher, folded), folded.count(" ") - 1))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(raw, pa.float64())], ["doc_id", "raw"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(
        run, "doc_id long, raw double"
    )


def score_toxicity(
    docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, threshold: float = 0.7,
    exceptions: tuple[str, ...] = EXCEPTIONS,
) -> DataFrame:
    """doc_id, held_out, score, predicted, raw of every row of `docs`, learnt from labelled rows that aren't held out.

    The lexicon is learnt from all of those rows. What matched weight for length says about a text is learnt from one in
    four of them by a lexicon of the other three, so that words which are toxic by accident count for what they are
    worth in texts that gave no word. A null or
    empty text matches nothing and gets the lowest score. Repeated rows are scored each; rows without an id are
    scored and never learnt from. A document's repeated labels count once, null labels not at all. Other columns
    are not read. An empty table gives an empty result; without toxic labels no text scores higher than another.
    """
    apart = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("calibration")), F.lit(CALIBRATED)) == 0
    known = cut_lineage(one_label(labels, "toxic").where(~split_by_crc(modulus, held)).withColumn("apart", apart))
    judged = measured(known.where("apart").drop("apart"), 16)
    unseen = _raw(docs.join(judged.select("doc_id"), "doc_id", "left_semi"),
                  learn_lexicon(docs, known.where("NOT apart").drop("apart"), exceptions=exceptions))

    def counted(batch):
        at, y = _bins(batch["raw"].to_numpy(zero_copy_only=False)), batch["label"].to_numpy(zero_copy_only=False)
        return np.r_[np.bincount(at, y, BINS), np.bincount(at, minlength=BINS)]

    table = partition_sums(unseen.join(judged, "doc_id").select("raw", "label"), 2 * BINS, counted)
    levels = isotonic(table[:BINS], table[BINS:])
    raw = _raw(docs, learn_lexicon(docs, known.drop("apart"), exceptions=exceptions))

    def run(rows):
        for batch in rows:
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["raw"], pa.array(levels[_bins(batch["raw"].to_numpy(zero_copy_only=False))])],
                ["doc_id", "raw", "score"],
            )

    return raw.mapInArrow(run, "doc_id long, raw double, score double").select(
        "doc_id", split_by_crc(modulus, held).alias("held_out"), "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), "raw",
    )
