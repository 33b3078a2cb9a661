"""Periodic runs of words: recompression gives a run-length grammar, whose LCE queries extend harmonic-grid candidates."""

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodspark.llm.common import batches, mix, whole_text

# A run has at least this many words, and at least two periods.
LEAST_WORDS = 12
# Words whose equality at either side of a grid point makes a candidate. A run reaches, over both sides together, at
# least max(12 - p, p) words beyond a grid point and its copy one period on, so 3 words or more on one side.
PROBE = 3
# Bytes of text that are worked on together, and grid points that are looked at together.
BATCH_BYTES, GRID_POINTS = 3 << 20, 1 << 19


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """A code for every word of the texts, each text's first place, and the words by code.

    Words are runs without ASCII white space, as they stand.
    """
    # Trimmed first, as a blank at either end would leave an empty word.
    split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.fill_null(texts, "")))
    coded = split.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.r_[0, np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))].astype(np.int64)
    empty = pc.equal(coded.dictionary, "").to_numpy(zero_copy_only=False)
    if empty.any():  # the one word of a text without words
        none = empty[codes]
        start = start - np.r_[0, np.cumsum(none)][start]
        codes = codes[~none]
    return codes, start, coded.dictionary


class Grammar:
    """Recompression of a sequence: blocks of one symbol become a symbol, then pairs, in turn, level after level.

    A level has its symbols, the place of each one's parent on the next level, and each parent's first child. A pair is
    made where a symbol of one half of the alphabet is followed by one of the other half, the halves drawn anew on each
    level, so equal stretches are parsed equally but for their ends. The names of blocks and pairs are looked up, not
    hashed: equal symbols stand for equal words.
    """

    def __init__(self, symbols: np.ndarray, enough: int = 8, most: int = 200):
        self.symbols, self.parents, self.firsts, self.blocks = [symbols.astype(np.int64)], [], [], []
        names = int(symbols.max(initial=0)) + 1
        for turn in range(most):
            now = self.symbols[-1]
            if len(now) <= enough:
                break
            if turn % 2 == 0:
                first = np.flatnonzero(np.r_[True, now[1:] != now[:-1]])
                size = np.diff(np.r_[first, len(now)])
                many = size > 1
                keys = now[first[many]] * (int(size.max()) + 1) + size[many]
            else:
                side = (mix(now, turn) & np.uint64(1)).astype(bool)
                rising, falling = ~side[:-1] & side[1:], side[:-1] & ~side[1:]
                opens = np.r_[rising if rising.sum() >= falling.sum() else falling, False]
                inner = np.r_[False, opens[:-1]]
                first = np.flatnonzero(~inner)
                many = opens[first]
                keys = now[first[many]] * names + now[first[many] + 1]
            above = now[first]
            if many.any():
                codes, found = pd.factorize(keys)
                above[many] = names + codes
                names += len(found)
            parent = np.zeros(len(now), np.int32)
            parent[first[1:]] = 1
            self.parents.append(np.cumsum(parent, dtype=np.int32))
            self.firsts.append(np.r_[first, len(now)].astype(np.int32))
            self.blocks.append(turn % 2 == 0)
            self.symbols.append(above)

    def _pass_equal(self, level: int, a: np.ndarray, b: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        """The next places where the symbols of a level differ; within blocks, as far as both blocks reach."""
        symbols, live = self.symbols[level], np.arange(len(a))
        inside = level < len(self.blocks) and self.blocks[level]
        while len(live):
            live = live[symbols[a[live]] == symbols[b[live]]]
            x, y = a[live], b[live]
            far = np.minimum(self._rest(level, x, step), self._rest(level, y, step)) if inside else 1
            a[live], b[live] = x + step * far, y + step * far
        return a, b

    def _rest(self, level: int, at: np.ndarray, step: int) -> np.ndarray:
        """Symbols from here to the end of the parent, this one included."""
        parent, first = self.parents[level][at], self.firsts[level]
        return first[parent + 1] - at if step > 0 else at - first[parent] + 1

    def extension(self, a: np.ndarray, b: np.ndarray, step: int = 1) -> np.ndarray:
        """How many symbols are equal from the places `a` and `b` (a != b) on, onwards or, with step -1, backwards.

        The sequence must begin and end with symbols that it has once. A query climbs while both places are at the
        edge of their parents, passes equal symbols on the way, and from the first difference goes down again to the
        first word that differs.
        """
        stopped: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        who, x, y = np.arange(len(a)), a.astype(np.int64), b.astype(np.int64)
        top = len(self.parents)
        for level in range(top):
            symbols, parents, first = self.symbols[level], self.parents[level], self.firsts[level]
            up, out = [], []
            while len(who):
                same = symbols[x] == symbols[y]
                out.append((who[~same], x[~same], y[~same]))
                who, x, y = who[same], x[same], y[same]
                p, q = parents[x], parents[y]
                edge = (first[p] == x) & (first[q] == y) if step > 0 else (first[p + 1] - 1 == x) & (first[q + 1] - 1 == y)
                up.append((who[edge], p[edge].astype(np.int64), q[edge].astype(np.int64)))
                who, x, y = who[~edge], x[~edge], y[~edge]
                far = np.minimum(self._rest(level, x, step), self._rest(level, y, step)) if self.blocks[level] else 1
                x, y = x + step * far, y + step * far
            stopped.append(_joined(out))
            who, x, y = _joined(up)
        x, y = self._pass_equal(top, x, y, step)
        for level in range(top - 1, -1, -1):
            first = self.firsts[level]
            x, y = (first[x], first[y]) if step > 0 else (first[x + 1] - 1, first[y + 1] - 1)
            x, y = self._pass_equal(level, x.astype(np.int64), y.astype(np.int64), step)
            more = stopped[level]
            who, x, y = np.r_[who, more[0]], np.r_[x, more[1]], np.r_[y, more[2]]
        ends = np.empty(len(a), np.int64)
        ends[who] = x
        return np.abs(ends - a)


def _joined(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    if not parts:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*parts))


def _candidates(marks: np.ndarray, base: np.ndarray, n: np.ndarray):
    """Grid points i, a multiple of p from a text's first word, and periods p whose words near i and i + p agree.

    `marks` names each place's next PROBE words, `base` is where texts begin, `n` their numbers of words.
    """
    half = np.where(n >= LEAST_WORDS, n // 2, 0)
    text = np.repeat(np.arange(len(n)), half)
    period = np.arange(len(text)) - np.repeat(np.cumsum(half) - half, half) + 1
    points = (n[text] - 1) // period
    ends = np.cumsum(points)
    at = 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + GRID_POINTS, "right")))
        p, c = period[at:to].astype(np.int32), points[at:to]
        begin = np.cumsum(c) - c
        p_all = np.repeat(p, c)
        i = np.arange(len(p_all), dtype=np.int32) - np.repeat(begin.astype(np.int32), c)
        i *= p_all
        i += np.repeat(base[text[at:to]].astype(np.int32), c)
        j = i + p_all
        hit = np.flatnonzero((marks[i] == marks[j]) | (marks[i - PROBE] == marks[j - PROBE]))
        if len(hit):
            yield i[hit].astype(np.int64), p_all[hit].astype(np.int64)
        at = to


def word_runs(codes: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """text, start, length, period of all runs of texts given as word codes, ordered by text, start and period.

    A run of period p holds a grid point i, a multiple of p, with i + p; the words from there on and before there are
    equal to those one period on as far as the run goes. The run's smallest period divides all others it is found by.
    """
    n = np.diff(start)
    # A symbol of its own before each text and at the end; places that a look back may reach come first.
    lead = PROBE + 1
    base = start[:-1] + np.arange(1, len(n) + 1) + lead - 1
    line = np.empty(len(codes) + len(n) + lead + PROBE, np.int64)
    mine = np.zeros(len(line), bool)
    mine[np.repeat(base - start[:-1], n) + np.arange(len(codes))] = True
    line[mine] = codes
    line[~mine] = int(codes.max(initial=-1)) + 1 + np.arange(len(line) - len(codes))
    marks = mix(line).astype(np.uint32)
    near = marks[:len(line) - 2] * np.uint32(0x9E3779B1) + marks[1:-1] * np.uint32(0x85EBCA77) + marks[2:] * np.uint32(0xC2B2AE3D)
    near = np.r_[near, marks[-2:]]
    found = list(_candidates(near, base, n))
    none = np.zeros(0, np.int64)
    if not found:
        return none, none, none, none
    i, p = (np.concatenate(c) for c in zip(*found))
    # Only texts with candidates are compressed.
    owner = np.searchsorted(base, i, "right") - 1
    used = np.unique(owner)
    width = n[used] + 1
    offset = np.cumsum(width) - width
    taken = np.repeat(base[used] - 1 - offset, width) + np.arange(int(width.sum()))
    grammar = Grammar(np.r_[line[taken], line[-1]])
    shift = np.zeros(len(n), np.int64)
    shift[used] = offset + 1 - base[used]
    i = i + shift[owner]
    ends, starts = np.empty(len(i), np.int64), np.empty(len(i), np.int64)
    for k in range(0, len(i), GRID_POINTS):
        part = slice(k, k + GRID_POINTS)
        ends[part] = i[part] + p[part] + grammar.extension(i[part], i[part] + p[part])
        starts[part] = i[part] - grammar.extension(i[part] - 1, i[part] + p[part] - 1, -1)
    length = ends - starts
    long = length >= np.maximum(LEAST_WORDS, 2 * p)
    owner, starts, length, p = owner[long], starts[long], length[long], p[long]
    order = np.lexsort((p, length, starts))
    owner, starts, length, p = owner[order], starts[order], length[order], p[order]
    first = np.r_[True, (starts[1:] != starts[:-1]) | (length[1:] != length[:-1])] if len(p) else np.zeros(0, bool)
    owner, starts, length, p = owner[first], starts[first], length[first], p[first]
    starts = starts - shift[owner] - base[owner]
    order = np.lexsort((p, starts, owner))
    return owner[order], starts[order], length[order], p[order]


Edit = Callable[[list, np.ndarray], tuple[np.ndarray, np.ndarray]]


def periodic_runs(docs: DataFrame, edit: Edit | None = None) -> DataFrame:
    """doc_id, n_words, runs, collapsed: the runs of each row's words, and the words left when each run keeps one period.

    A run is a stretch of at least 12 words and two periods whose words are equal to those one smallest period on, and
    that no word beside it extends. `runs` has start (from 0), length and period, ordered by start and period;
    `collapsed` are the words that no run holds after its first period, joined by one blank. Words are runs without
    ASCII white space, compared as they stand.

    `edit`, if given, gets the ids and word counts of rows and returns from where on and with what period each row's
    words are to repeat (a period of 0: not at all). Null and empty texts have no words; repeated rows are read each,
    a null id stays null, other columns are not read, and an empty table gives an empty result. Each row is worked on
    by itself, so no row is shuffled.
    """
    runs_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(rows):
        for batch in batches(rows, BATCH_BYTES):
            codes, start, known = words_of(batch["text"])
            n = np.diff(start)
            if edit:
                since, period = edit(batch["doc_id"].to_pylist(), n)
                place = np.arange(len(codes)) - np.repeat(start[:-1], n)
                a, p = np.repeat(since, n), np.repeat(period, n)
                moved = np.where((p > 0) & (place >= a), a + (place - a) % np.maximum(p, 1), place)
                codes = codes[moved + np.repeat(start[:-1], n)]
            text, begin, length, period = word_runs(codes, start)
            gone = np.zeros(len(codes) + 1, np.int32)
            np.add.at(gone, start[text] + begin + period, 1)
            np.add.at(gone, start[text] + begin + length, -1)
            keep = np.cumsum(gone[:-1]) == 0
            left = np.r_[0, np.cumsum(keep)][start]
            kept = pa.ListArray.from_arrays(pa.array(left, pa.int32()), known.take(pa.array(codes[keep])))
            found = pa.StructArray.from_arrays([pa.array(begin), pa.array(length), pa.array(period)], ["start", "length", "period"])
            listed = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(n) + 1)), pa.int32()), found)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(n), listed.cast(runs_type), pc.binary_join(kept, " ")], ["doc_id", "n_words", "runs", "collapsed"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(
        run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    )


def planted_tails(ids: list, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From where on and with what period the words of some rows repeat, by the checksum of their ids; none without id."""
    h = np.array([1 if k is None else zlib.crc32(str(k).encode()) for k in ids], np.int64).reshape(-1)
    g, some = h // 10, (h % 10 == 0) & (n > 0)
    since = np.where(some, g % np.maximum(n, 1), 0)
    return since, np.where(some, 1 + (n - since) // (3 + g % 8), 0)


def describe_runs(found: DataFrame) -> DataFrame:
    """The longest run (ties: the first, then the shortest period), and digests of all runs and of the words left."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    return found.withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_best.col2")).alias("start"), F.col("_best.length").alias("length"),
        (-F.col("_best.col3")).alias("period"),
        F.expr("_best.length * 1000 div -_best.col3").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
