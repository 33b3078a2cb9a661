"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration."""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodspark.llm.common import BINS, batches, giving_back, isotonic, one_label, partition_sums, split_by_crc, whole_text
from moodspark.plans.session import cut_lineage

STATISTICS = [
    "log_chars", "log_words", "word_length", "longest_word", "upper", "digits", "punctuation", "symbols", "spaces",
    "other_bytes", "entropy", "distinct_words", "top_word", "loud_words", "marked_words", "bare_words", "lines",
    "line_length", "repeated_lines", "wordy_lines",
]

_UPPER, _LOWER = slice(65, 91), slice(97, 123)
_SYMBOLS = np.frombuffer(b"#$%&*+/<=>@[\\]^_`{|}~", np.uint8)
_PUNCTUATION = np.frombuffer(b"!\"'(),-.:;?", np.uint8)


def text_statistics(text: str) -> list[float]:
    """Counts and shares of one whole text; every one of them is 0 for an empty text."""
    data = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    n = int(data.sum())
    if not n:
        return [0.0] * len(STATISTICS)
    words = text.split()
    m = max(1, len(words))
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = [x for x in text.split("\n") if x.strip()] or [""]
    share = data[data > 0] / n
    lengths = list(map(len, words)) or [0]
    return [
        float(np.log1p(n)), float(np.log1p(len(words))), sum(lengths) / m, float(np.log1p(max(lengths))),
        data[_UPPER].sum() / max(1, data[_UPPER].sum() + data[_LOWER].sum()), data[48:58].sum() / n,
        data[_PUNCTUATION].sum() / n, data[_SYMBOLS].sum() / n, (data[32] + data[9] + data[10]) / n,
        data[128:].sum() / n, float(-(share * np.log2(share)).sum()),
        len(seen) / m, max(seen.values(), default=0) / m,
        sum(c for w, c in seen.items() if len(w) > 1 and w.isupper()) / m,
        sum(c for w, c in seen.items() if not w[-1].isalnum() and w[-1] not in ".,;:") / m,
        sum(c for w, c in seen.items() if not any(map(str.isalnum, w))) / m,
        float(np.log1p(len(lines))), float(np.log1p(sum(map(len, lines)) / len(lines))),
        1 - len(set(lines)) / len(lines), sum(len(x.split()) >= 5 for x in lines) / len(lines),
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics, an array of doubles, of every row; a null text counts as empty."""

    def run(rows):
        for batch in batches(rows):
            stats = [text_statistics(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].cast(pa.int64()), pa.array(stats, pa.list_(pa.float64()))], ["doc_id", "stats"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(
        giving_back(run), "doc_id long, stats array<double>"
    )


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    levels: np.ndarray
    width: float
    features: int

    def score(self, stats: np.ndarray) -> np.ndarray:
        raw = fourier(stats, self.mean, self.scale, self.features, self.width) @ self.weights
        return self.levels[bins(raw)]


def bins(raw: np.ndarray) -> np.ndarray:
    """The bin of a ridge score; scores are around 0 and 1."""
    return np.clip(((raw + 0.5) * (BINS / 2)).astype(np.int64), 0, BINS - 1)


def fourier(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray, features: int, width: float, seed: int = 7) -> np.ndarray:
    """Cosines of random projections, whose products approximate a Gaussian kernel; and a constant."""
    draw = np.random.default_rng(seed)
    turn = draw.normal(size=(stats.shape[1], features)) / (width * np.sqrt(stats.shape[1]))
    phase = draw.uniform(0, 2 * np.pi, features)
    x = np.clip((stats - mean) / scale, -6, 6)
    return np.hstack([np.sqrt(2 / features) * np.cos(x @ turn + phase), np.ones((len(x), 1))])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch["stats"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(STATISTICS))


def fit(
    stats: DataFrame, labels: DataFrame, features: int = 256, width: float = 1.0, ridge: float = 1e-3
) -> QualityModel:
    """Fit on all labelled rows of `stats`; `labels` has doc_id and label, one row for each document.

    Normal equations are sums over rows, added up by partition, for two halves of the labelled rows. The model
    of either half scores the other half, and these scores, counted by bin, are calibrated; the weights are
    those of both halves together. Without labels every score is 0.5.
    """
    labelled = cut_lineage(
        stats.join(labels, "doc_id").select(F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("half"), "label", "stats")
    )
    k, d = len(STATISTICS), features + 1

    def moments(batch):
        x = _matrix(batch)
        return np.r_[len(x), x.sum(0), (x * x).sum(0)]

    sums = partition_sums(labelled, 1 + 2 * k, moments)
    n = max(sums[0], 1)
    mean = sums[1:k + 1] / n
    scale = np.sqrt(np.maximum(sums[k + 1:] / n - mean**2, 1e-12)) + 1e-3

    def equations(batch):
        z, y = fourier(_matrix(batch), mean, scale, features, width), batch["label"].to_numpy(zero_copy_only=False)
        half = batch["half"].to_numpy(zero_copy_only=False)
        return np.concatenate([np.r_[(z[half == h].T @ z[half == h]).ravel(), z[half == h].T @ y[half == h]] for h in (0, 1)])

    both = partition_sums(labelled, 2 * (d * d + d), equations).reshape(2, d * d + d)

    def solve(total):
        gram = total[:d * d].reshape(d, d)
        return np.linalg.solve(gram + ridge * max(gram[-1, -1], 1) * np.eye(d), total[d * d:])

    # The model of a half scores the other one.
    other = [solve(both[1]), solve(both[0])]

    def counted(batch):
        z, y = fourier(_matrix(batch), mean, scale, features, width), batch["label"].to_numpy(zero_copy_only=False)
        half = batch["half"].to_numpy(zero_copy_only=False)
        at = bins(np.where(half == 0, z @ other[0], z @ other[1]))
        return np.r_[np.bincount(at, y, BINS), np.bincount(at, minlength=BINS)]

    table = partition_sums(labelled, 2 * BINS, counted)
    return QualityModel(mean, scale, solve(both.sum(0)), isotonic(table[:BINS], table[BINS:]), width, features)


def score(stats: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id and score, 0 to 1, of every row."""

    def run(rows):
        for batch in rows:
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(model.score(_matrix(batch)))], ["doc_id", "score"]
            )

    return stats.mapInArrow(run, "doc_id long, score double")


def score_quality(
    docs: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2, threshold: float = 0.7
) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of `docs`, learnt from labelled rows that aren't held out.

    Rows with a null or empty text are scored like any other; repeated rows are scored each. Rows without an id
    are scored and never learnt from. A document's repeated labels count once, null labels not at all. Only the
    text enters a score; other columns of `docs` are not read. An empty table gives an empty result.
    """
    known = one_label(labels, "quality").where(~split_by_crc(modulus, held))
    stats = cut_lineage(document_statistics(docs))
    found = score(stats, fit(stats, known))
    return found.select(
        "doc_id", split_by_crc(modulus, held).alias("held_out"), "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of `docs` that are scored at or above the threshold, with all their columns.

    The score is computed from the row's text in the same pass that keeps or drops it, so no text is shuffled;
    the model is learnt as in `score_quality`.
    """
    known = one_label(labels, "quality").where(~split_by_crc(4, 2))
    model = fit(cut_lineage(document_statistics(docs.join(F.broadcast(known), "doc_id", "left_semi")
                                                if _few(known) else docs)), known)

    def run(rows):
        for batch in batches(rows):
            stats = np.array([text_statistics(t or "") for t in batch["text"].to_pylist()]).reshape(-1, len(STATISTICS))
            yield batch.filter(pa.array(model.score(stats) >= threshold))

    return docs.mapInArrow(giving_back(run), docs.schema)


def _few(known: DataFrame, limit: int = 1_000_000) -> bool:
    """Whether the labelled ids, 8 bytes each, are few enough to be broadcast."""
    return known.count() <= limit
