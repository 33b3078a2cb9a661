"""Personal data by weak supervision: labelers vote, expectation-maximisation weighs them, a classifier decides."""

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodspark.llm.common import batches, whole_text
from moodspark.plans.session import cut_lineage

# Kinds in the order in which spans of one start are listed.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "account", "name")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits is tried at its start only: what follows the run decides, so its later digits can't do better.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def emails(text: str) -> Iterator[Span]:
    """From each @ to both sides, in time that grows with the text alone."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        # Where this @ fails nothing that begins before it can match, and the local part holds no @.
        free = domain.end() if domain else at + 1
        if domain:
            yield "email", start, free
        at = text.find("@", free)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The four base kinds, leftmost and non-overlapping for each kind; matches that fail their test are dropped."""
    found = list(emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
                found.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                    found.append(("phone", m.start(), m.end()))
    return sorted(found, key=_place)


def _place(span: Span) -> tuple[int, int, int]:
    return span[1], KINDS.index(span[0]), span[2]


# A word with a capital, in the letters of western European languages.
_CAPITAL = "[A-ZÀ-ÖØ-ÞŒŸ][a-zß-öø-ÿœ]+"
# Candidates beyond the base kinds, loosely matched; the labelers tell which are personal data.
_LOOSE = [
    ("email", re.compile(r"\b[A-Za-z0-9][A-Za-z0-9._-]{0,63} ?[\[(](?:at|AT|@)[\])] ?[A-Za-z0-9-]{1,63}(?: ?[\[(](?:dot|DOT)[\])] ?|\.)[A-Za-z]{2,24}\b")),
    ("phone", re.compile(r"(?<![\w+.-])(?:00[1-9][0-9 ().-]{7,18}[0-9]|\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4})(?![\w-])")),
    ("card", re.compile(r"(?<![\w.-])[0-9]{4}(?:[ -]?[0-9]{4}){3}(?![\w-])")),
    ("account", re.compile(r"\b(?:[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?|[0-9]{3}-[0-9]{2}-[0-9]{4})\b")),
    ("secret", re.compile(r"\b(?:AKIA[0-9A-Z]{16}|[0-9a-f]{16,}|[A-Za-z0-9+/_-]{32,})\b")),
    ("name", re.compile(rf"\b{_CAPITAL} {_CAPITAL}\b")),
]
_LOOSE_HINT = re.compile(rf"[\[(](?:at|AT|@)[\])]|[0-9]|{_CAPITAL} {_CAPITAL}|[A-Za-z0-9+/_-]{{32}}")

# Fixed values of the gazetteer and context labelers: endings and prefixes of the kind, words that stand before it.
_ENDINGS = frozenset("com org net edu gov info io de fr es uk eu at ch".split())
_CARD_STARTS = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "65")
_COUNTRIES = frozenset("AT BE CH DE DK ES FI FR GB IE IT LU NL NO PL PT SE".split())
_FIRST_NAMES = frozenset("""Anna Anne Carlos Charles Claire David Elena Emma Hans Jack James Jane Jean John Jose Juan
    Julia Karl Klaus Laura Louis Lucas Lucia Maria Marie Mark Martin Mary Michael Paul Peter Pierre Sarah Sofia
    Stefan Susan Thomas William""".split())
_CUES = {
    "email": ("mail", "contact", "write", "correo", "courriel"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "fono"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta"),
    "account": ("iban", "account", "ssn", "konto", "compte", "cuenta", "social"),
    "secret": ("token", "password", "secret", "key", "passwort", "clave", "akia"),
    "name": ("name", "mr", "mrs", "ms", "dr", "herr", "frau", "madame", "monsieur", "dear", "by"),
}
CONTEXT = 24
LABELERS = ("pattern", "gazetteer", "context", "shape")


def _entropy(value: str) -> float:
    _, n = np.unique(list(value), return_counts=True)
    p = n / n.sum()
    return float(-(p * np.log2(p)).sum())


def votes(kind: str, value: str, before: str) -> tuple[int, int, int, int]:
    """1 for, 0 against, -1 silent, of the four labelers."""
    digits = "".join(filter(str.isdigit, value))
    pattern = {
        "email": lambda: 1, "phone": lambda: int(9 <= len(digits) <= 15), "card": lambda: int(luhn(digits)),
        "account": lambda: int(_account(value)), "secret": lambda: int(value.startswith("AKIA") or -1),
        "name": lambda: -1,
    }[kind]()
    gazetteer = {
        "email": lambda: int(value.rpartition(".")[2].lower() in _ENDINGS),
        "phone": lambda: 1 if value.startswith("00") or digits[:1] not in "01" else 0,
        "card": lambda: int(digits.startswith(_CARD_STARTS)),
        "account": lambda: int(value[:2] in _COUNTRIES) if value[:2].isalpha() else -1,
        "secret": lambda: -1,
        "name": lambda: int(value.split()[0] in _FIRST_NAMES),
    }[kind]()
    words = re.split(r"[^a-z]+", before.lower())
    context = 1 if any(w.endswith(cue) if len(cue) > 3 else w == cue for w in words for cue in _CUES[kind]) else 0
    shape = {
        "secret": lambda: int(_entropy(value) > 2.8 and any(map(str.isdigit, value)) and any(map(str.isalpha, value))),
        "card": lambda: int(len(set(digits)) > 3), "phone": lambda: int(len(set(digits)) > 2),
        "email": lambda: 1, "account": lambda: -1, "name": lambda: -1,
    }[kind]()
    return pattern, gazetteer, context, shape


def _account(value: str) -> bool:
    """Check digits of an IBAN, or the ranges of a social security number."""
    if value[:2].isalpha():
        flat = value.replace(" ", "")
        return int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1
    return value[:3] not in ("000", "666") and value[0] != "9" and value[4:6] != "00" and value[7:] != "0000"


def candidates(text: str, base: list[Span]) -> list[tuple[Span, tuple[int, int, int, int]]]:
    """Loose candidates outside all base spans, the first of overlapping ones, with their votes."""
    if not _LOOSE_HINT.search(text):
        return []
    taken = sorted((a, b) for _, a, b in base)
    found: list[tuple[Span, tuple[int, int, int, int]]] = []
    starts, ends = [a for a, _ in taken], [b for _, b in taken]
    used = np.zeros(0, np.int64)
    for kind, pattern in _LOOSE:
        spans = [(m.start(), m.end(), m.group()) for m in pattern.finditer(text)]
        if not spans:
            continue
        at = np.array([s[:2] for s in spans])
        # Overlap: some taken span begins before this one ends and ends after it begins.
        lows, highs = np.sort(np.r_[starts, used[0::2]]), np.sort(np.r_[ends, used[1::2]])
        free = np.searchsorted(lows, at[:, 1], "left") == np.searchsorted(highs, at[:, 0], "right")
        for (a, b, value), ok in zip(spans, free):
            if ok:
                found.append(((kind, a, b), votes(kind, value, text[max(0, a - CONTEXT):a])))
        used = np.r_[used, at[free].ravel()]
    return found


def _key(kind: str, vote: tuple[int, ...]) -> int:
    """A number for a kind and its votes."""
    code = KINDS.index(kind)
    for v in vote:
        code = code * 3 + v + 1
    return code


KEYS = len(KINDS) * 3 ** len(LABELERS)


def _features(key: int) -> tuple[int, np.ndarray]:
    """The kind and the votes behind a number."""
    vote = []
    for _ in LABELERS:
        vote.append(key % 3 - 1)
        key //= 3
    return key, np.array(vote[::-1])


@dataclass(frozen=True)
class SpanModel:
    """The probability that a candidate is personal data, by kind and votes."""

    probability: np.ndarray
    reliability: dict[str, tuple[float, float]]


def fit(counts: np.ndarray, rounds: int = 60) -> SpanModel:
    """Reliabilities by expectation-maximisation over the counts of votes, then the final span classifier.

    Counts are all the votes of the corpus, whatever its size, in one table of fixed size. Labelers are taken to be
    independent given the truth, with a rate of right votes on personal data and another on anything else, shared by
    all kinds; each kind has its own share of personal data. The classifier is a logistic regression on kind, votes
    and silence, trained on the posteriors.
    """
    keys = np.arange(len(counts))
    kinds, vote = zip(*(_features(k) for k in keys))
    kinds, vote = np.array(kinds), np.array(vote)
    spoke = vote >= 0
    share = np.full(len(KINDS), 0.3)
    yes = np.full(len(LABELERS), 0.8)
    no = np.full(len(LABELERS), 0.2)

    def posterior():
        good = np.where(spoke, np.where(vote == 1, np.log(yes), np.log1p(-yes)), 0).sum(1) + np.log(share[kinds])
        bad = np.where(spoke, np.where(vote == 1, np.log(no), np.log1p(-no)), 0).sum(1) + np.log1p(-share[kinds])
        return 1 / (1 + np.exp(np.clip(bad - good, -50, 50)))

    for _ in range(rounds):
        p = posterior()
        # Two cases of belief beforehand keep the rates off 0 and 1 and the labelers better than chance.
        for j in range(len(LABELERS)):
            on = spoke[:, j] * counts
            yes[j] = ((on * p * (vote[:, j] == 1)).sum() + 8) / ((on * p).sum() + 10)
            no[j] = ((on * (1 - p) * (vote[:, j] == 1)).sum() + 2) / ((on * (1 - p)).sum() + 10)
        yes, no = np.clip(yes, 0.5, 0.99), np.clip(no, 0.01, 0.5)
        for k in range(len(KINDS)):
            mine = counts * (kinds == k)
            share[k] = np.clip(((mine * p).sum() + 1) / (mine.sum() + 4), 0.01, 0.95)
    p = posterior()
    x = np.hstack([np.eye(len(KINDS))[kinds], (vote == 1), (vote == 0)]).astype(float)
    weight = counts + 0.01
    w = np.zeros(x.shape[1])
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - q)) - 0.05 * w
        curve = (x * (weight * q * (1 - q))[:, None]).T @ x + 0.05 * np.eye(len(w))
        w += np.linalg.solve(curve, slope)
    final = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return SpanModel(final, {n: (float(a), float(b)) for n, a, b in zip(LABELERS, yes, no)})


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=_place))


def _scan(docs: DataFrame) -> DataFrame:
    """Base spans and candidates of every row."""

    def run(rows):
        for batch in batches(rows):
            out = {n: [] for n in ("counts", "base", "more", "keys")}
            for text in batch["text"].to_pylist():
                base = base_spans(text)
                found = candidates(text, base)
                out["counts"].append([sum(s[0] == k for s in base) for k in BASE_KINDS])
                out["base"].append(_listed(base))
                out["more"].append([f"{k}:{a}:{b}" for (k, a, b), _ in found])
                out["keys"].append([_key(s[0], v) for s, v in found])
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(out["counts"], pa.list_(pa.int64())), pa.array(out["base"], pa.string()),
                 pa.array(out["more"], pa.list_(pa.string())), pa.array(out["keys"], pa.list_(pa.int32()))],
                ["doc_id", "counts", "base", "more", "keys"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(
        run, "doc_id long, counts array<long>, base string, more array<string>, keys array<int>"
    )


def find_personal_data(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans, of every row.

    The base spans always stay; candidates that the classifier puts at or above the threshold are added. A null or
    empty text has no spans: its digest is that of the empty string. Every row gives one row, repeated ones and those
    without an id too; other columns are not read. Very long texts are scanned whole, in time that grows with them.
    """
    scanned = cut_lineage(_scan(docs))
    counts = np.zeros(KEYS)
    for row in scanned.select(F.explode("keys").alias("key")).groupBy("key").count().collect():  # at most KEYS rows
        counts[row["key"]] = row["count"]
    model = fit(counts)
    accepted = model.probability >= threshold

    def run(rows):
        for batch in rows:
            digests, spans = [], []
            for base, more, keys in zip(batch["base"].to_pylist(), batch["more"].to_pylist(), batch["keys"].to_pylist()):
                digests.append(hashlib.sha256(base.encode()).hexdigest())
                every = [s for s in base.split(",") if s] + [s for s, k in zip(more, keys) if accepted[k]]
                spans.append(_listed([(k, int(a), int(b)) for k, a, b in (s.split(":") for s in every)]))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["counts"], pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                ["doc_id", "counts", "base_sha256", "spans"],
            )

    found = scanned.select("doc_id", "counts", "base", "more", "keys").mapInArrow(
        run, "doc_id long, counts array<long>, base_sha256 string, spans string"
    )
    return found.select(
        "doc_id", *[F.col("counts")[k].alias(f"n_{kind}") for k, kind in enumerate(BASE_KINDS)], "base_sha256", "spans"
    )
