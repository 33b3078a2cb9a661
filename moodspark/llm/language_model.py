"""LM scoring: a log-frequency Bloom filter of quantised n-gram counts, probed for smoothed probabilities."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodspark.llm.common import batches, giving_back, mix, split_by_crc, string_hashes, whole_text
from moodspark.plans.session import cut_lineage

# Counts c are held as levels 1 + floor(log_BASE c): a level is read by probing 1, 2, ... until one is missing.
BASE = 1.5
# Bits set for an n-gram's first level, which says that it was seen at all, and for each further level.
FIRST_PROBES, MORE_PROBES = 8, 4
# A filter of up to this many bytes is broadcast; a larger one in as many parts, one after the other. Of more text than
# this no filter is sent: n-grams go to the segments and levels come back.
FILTER_BYTES = 128 << 20
# Text that one segment of the n-grams stands for; an n-gram's hash says its segment.
SEGMENT_BYTES = 16 << 20
# At most this many words are more frequent than one in so many; their exact counts are broadcast, 16 bytes each.
HEAVY_WORDS = 1 << 18
# Weight of what the shorter history says, in counts.
PRIOR = 300.0
# What each count is raised by in unigram probabilities.
RAISED = 0.1
BATCH_BYTES = 2 << 20
BLOB_BYTES = 16 << 20
# Text whose n-grams are sent to the segments together, each different one once.
PARCEL_BYTES = 4 << 20

_END = np.uint64(0x9E3779B97F4A7C15)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the tokens of the texts, one after the other, and each text's first place.

    Tokens are the words (runs without ASCII white space, A to Z in lower case), then one end.
    """
    # Trimmed first, as a blank at either end would leave an empty word.
    split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.fill_null(texts, "")))
    coded = split.flatten().dictionary_encode()
    known = string_hashes(pc.ascii_lower(coded.dictionary))
    words = known[coded.indices.to_numpy(zero_copy_only=False)]
    n = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(n)
    if (known == 0).any():  # the one word of a text without words
        ends = ends - np.r_[0, np.cumsum(words == 0)][ends]
        words = words[words != 0]
    return np.insert(words, ends, _END), np.r_[0, ends + np.arange(1, len(ends) + 1)]


def grams(line: np.ndarray, start: np.ndarray, order: int) -> list[np.ndarray]:
    """For each length 1 to `order`, the hash of the n-gram that ends at each token; 0 where the text is too short.

    A text's first token follows an end, so that there are bigrams of beginnings.
    """
    place = np.arange(len(line)) - np.repeat(start[:-1], np.diff(start))
    found = [line]
    for k in range(1, order):
        before = np.r_[np.full(k, _END), line[:-k]][:len(line)]
        before = np.where(place == k - 1, _END, before)
        with np.errstate(over="ignore"):
            longer = mix(found[-1] * np.uint64(0x100000001B3) + before, 30 + k) | np.uint64(1)
        found.append(np.where(place >= k - 1, longer, np.uint64(0)))
    return found


def level_of(counts: np.ndarray) -> np.ndarray:
    return (1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(BASE) + 1e-9)).astype(np.int64)


def count_of(levels: np.ndarray) -> np.ndarray:
    """The middle of the counts that a level stands for; 0 of level 0."""
    top = np.arange(int(levels.max(initial=0)) + 1.0)
    low, high = np.ceil(BASE ** (top - 1) - 1e-9), np.ceil(BASE**top - 1e-9) - 1
    return np.where(top > 0, (low + high) / 2, 0.0)[levels]


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    return (mix(keys, 41) % np.uint64(segments)).astype(np.int64)


def _walks(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """The first number and the step of each key at a level: its k-th bit is at the first number and k steps, modulo
    the segment's size."""
    with np.errstate(over="ignore"):
        a = mix(keys + np.uint64(level * 0xC2B2AE3D27D4EB4F % 2**64), 42)
    return a, mix(a, 43) | np.uint64(1)


def _places(walk: np.ndarray, size: int) -> np.ndarray:
    """The remainders; division by one number and multiplication are several times as fast as taking them."""
    return (walk - walk // np.uint64(size) * np.uint64(size)).view(np.int64)


def _probes(level: int) -> range:
    return range(FIRST_PROBES if level == 1 else MORE_PROBES)


def fill_segment(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The bits, as bytes, of a segment's n-grams: of each its levels up to that of its count; half of the bits are set."""
    levels = level_of(counts)
    size = max(64, int(np.ceil((len(keys) * (FIRST_PROBES - MORE_PROBES) + levels.sum() * MORE_PROBES) / np.log(2) / 8)) * 8)
    bits = np.zeros(size, bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        at, step = _walks(keys[levels >= level], level)
        for _ in _probes(level):
            bits[_places(at, size)] = True
            at += step
    return np.packbits(bits, bitorder="little")


def read_segment(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The level of each key's count in the segment that it belongs to."""
    found = np.zeros(len(keys), np.int64)
    live, level = np.arange(len(keys)), 0
    while len(live):
        level += 1
        walk, step = _walks(keys[live], level)
        for _ in _probes(level):
            at = _places(walk, len(bits) * 8)
            held = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 != 0
            if not held.all():
                live, walk, step = live[held], walk[held], step[held]
            walk += step
        found[live] = level
    return found


@dataclass(frozen=True)
class CountFilter:
    """The segments from `first` on of a log-frequency Bloom filter; `edges` says where each begins in `data`."""

    data: np.ndarray
    edges: np.ndarray
    first: int
    segments: int

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key's count: never too low, too high for few. 0 for keys of segments that are not here."""
        segment = segment_of(keys, self.segments) - self.first
        live = np.flatnonzero((segment >= 0) & (segment < len(self.edges) - 1) & (keys != 0))
        # Segment after segment, so that probes near in time are near in memory.
        live = live[np.argsort(segment[live].astype(np.min_scalar_type(len(self.edges))), kind="stable")]
        ends = np.searchsorted(segment[live], np.arange(len(self.edges)))
        found = np.zeros(len(keys), np.int64)
        for s in np.flatnonzero(np.diff(ends)).tolist():
            here = live[ends[s]:ends[s + 1]]
            found[here] = read_segment(self.data[self.edges[s]:self.edges[s + 1]], keys[here])
        return found


@dataclass(frozen=True)
class CountTable:
    """What was counted: `rows` (segment, bits, keys, counts) holds for each segment its part of the filter, and the
    exact counts of single tokens. `bounds` are the segments at which parts of the filter begin and end."""

    rows: DataFrame
    segments: int
    tokens: int
    distinct: int
    bounds: list[int]
    order: int

    def part(self, k: int) -> CountFilter:
        """Part k of the filter, at most FILTER_BYTES unless one segment alone is larger."""
        first, last = self.bounds[k], self.bounds[k + 1]
        held = {r["segment"]: r["bits"] for r in self.rows.where(F.col("segment").between(first, last - 1)).select("segment", "bits").collect()}
        blobs = [held.get(s, bytes(8)) for s in range(first, last)]
        return CountFilter(np.frombuffer(b"".join(blobs), np.uint8), np.r_[0, np.cumsum([len(b) for b in blobs])], first, self.segments)

    def heavy(self) -> tuple[np.ndarray, np.ndarray]:
        """The tokens, sorted, and the counts of those above one in HEAVY_WORDS, of which there are HEAVY_WORDS at most."""
        floor = self.tokens / HEAVY_WORDS

        def run(rows):
            for batch in rows:
                keys, counts = _numbers(batch["keys"], np.uint64), _numbers(batch["counts"], np.int64)
                often = counts > floor
                yield pa.RecordBatch.from_arrays([pa.array(keys[often].view(np.int64)), pa.array(counts[often])], ["key", "n"])

        found = self.rows.select("keys", "counts").mapInArrow(run, "key long, n long").toArrow()
        keys, counts = found["key"].to_numpy().astype(np.int64).view(np.uint64), found["n"].to_numpy()
        order = np.argsort(keys)
        return keys[order], counts[order]


def _numbers(blobs: pa.Array, kind: type) -> np.ndarray:
    """All numbers of binary values, one after the other."""
    return np.frombuffer(b"".join(blobs.to_pylist()), kind)


def _summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, sorted, with the sum of its counts."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    sums = np.diff(np.r_[first, len(keys)]) if counts is None else np.add.reduceat(counts, first) if len(keys) else counts
    return keys[first], sums


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, sorted, and for each of those given its number among them."""
    order = np.argsort(keys)
    ordered = keys[order]
    first = np.r_[True, ordered[1:] != ordered[:-1]][:len(keys)]
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(first) - 1
    return ordered[first], number


def _blobs(segment: np.ndarray, segments: int, **columns: np.ndarray) -> Iterator[dict]:
    """One row for each segment that occurs, with the columns' numbers of that segment as bytes."""
    order = np.argsort(segment, kind="stable")
    edges = np.searchsorted(segment[order], np.arange(segments + 1)) if segments <= len(order) else None
    held = np.unique(segment) if edges is None else np.flatnonzero(np.diff(edges))
    ordered = {name: values[order] for name, values in columns.items()}
    sorted_segments = segment[order]
    for s in held.tolist():
        a, b = (edges[s], edges[s + 1]) if edges is not None else np.searchsorted(sorted_segments, [s, s + 1])
        yield {"segment": s, **{name: values[a:b].tobytes() for name, values in ordered.items()}}


def _text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0


def _segments(size: int, segment_bytes: int) -> int:
    return max(1, -(-size // segment_bytes))


_COUNTED = pa.schema([("segment", pa.int64()), ("single", pa.bool_()), ("keys", pa.binary()), ("counts", pa.binary())])


def count_grams(docs: DataFrame, order: int = 2, filter_bytes: int = FILTER_BYTES, segment_bytes: int = SEGMENT_BYTES) -> CountTable:
    """Count the n-grams of 1 to `order` tokens of all texts, and hold their quantised counts in filter segments.

    Each task adds up the n-grams of a batch before they are dealt by the segment of their hash. The number of
    segments follows the bytes of text, so a segment is of one size however large the corpus; a frequent n-gram is one
    row for each batch at most. Tokens are told apart by 64-bit hashes.
    """
    segments = _segments(_text_bytes(docs), segment_bytes)

    def count(rows):
        for batch in batches(rows, BATCH_BYTES):
            line, start = tokens(batch["text"])
            for n, keys in enumerate(grams(line, start, order), 1):
                keys, counts = _summed(keys[keys != 0])
                made = list(_blobs(segment_of(keys, segments), segments, keys=keys, counts=counts.astype(np.int32)))
                yield pa.RecordBatch.from_pylist([x | {"single": n == 1} for x in made], _COUNTED)

    def merge(rows):
        held: dict = {"segment": None}

        def all_of(kind):
            return _summed(*map(np.concatenate, zip(*held[kind]))) if held[kind] else (np.zeros(0, np.uint64), np.zeros(0, np.int64))

        def close():
            single, longer = all_of(True), all_of(False)
            bits = fill_segment(np.r_[single[0], longer[0]], np.r_[single[1], longer[1]])
            return pa.RecordBatch.from_pydict({
                "segment": [held["segment"]], "bits": [bits.tobytes()], "n_bits": [len(bits)], "keys": [single[0].tobytes()],
                "counts": [single[1].astype(np.int64).tobytes()], "distinct": [len(single[0])], "tokens": [int(single[1].sum())],
            })

        def add(kind, keys, counts):
            held[kind].append((keys, counts))
            # Equal keys are added up as soon as there are twice as many as after the last time.
            if sum(len(k) for k, _ in held[kind]) > max(1 << 20, 2 * held["size", kind]):
                held[kind] = [all_of(kind)]
                held["size", kind] = len(held[kind][0][0])

        for batch in batches(rows, BLOB_BYTES):
            for segment, single, keys, counts in zip(*(batch[c].to_pylist() for c in ("segment", "single", "keys", "counts"))):
                if held["segment"] != segment:
                    if held["segment"] is not None:
                        yield close()
                    held = {"segment": segment, True: [], False: [], ("size", True): 0, ("size", False): 0}
                add(single, np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.int32).astype(np.int64))
        if held["segment"] is not None:
            yield close()

    counted = docs.select(whole_text().alias("text")).mapInArrow(count, "segment long, single boolean, keys binary, counts binary")
    rows = cut_lineage(counted.repartition(segments, "segment").sortWithinPartitions("segment").mapInArrow(
        merge, "segment long, bits binary, n_bits long, keys binary, counts binary, distinct long, tokens long"
    ))
    sizes = {r["segment"]: r for r in rows.select("segment", "n_bits", "distinct", "tokens").collect()}
    bounds, total = [0], 0
    for s in range(segments):
        wide = sizes[s]["n_bits"] if s in sizes else 8
        if total and total + wide > filter_bytes:
            bounds.append(s)
            total = 0
        total += wide
    found = sizes.values()
    return CountTable(rows, segments, sum(r["tokens"] for r in found), sum(r["distinct"] for r in found), [*bounds, segments], order)


@dataclass(frozen=True)
class Smoothed:
    """Smoothed probabilities from the levels of n-grams: each order's counts are joined with those of the next lower
    one, as a prior of so many counts."""

    tokens: int
    distinct: int
    end_level: int
    prior: float = PRIOR

    def log10(self, levels: list[np.ndarray], start: np.ndarray) -> np.ndarray:
        """log10 of the probability of each token; `levels` are those of the n-grams that end there, by order."""
        chance = (count_of(levels[0]) + RAISED) / (self.tokens + RAISED * (self.distinct + 1))
        seen = levels[0]
        first = start[:-1]
        for k in range(1, len(levels)):
            history = np.r_[0, levels[k - 1][:-1]][:len(levels[0])] if len(levels[0]) else levels[0]
            # The history of a text's first token is an end, of which longer n-grams than bigrams know nothing.
            history[first] = self.end_level if k == 1 else 0
            # An n-gram is not more frequent than what it is made of: that holds most false hits off.
            seen = np.minimum(np.minimum(levels[k], seen), history)
            chance = (count_of(seen) + self.prior * chance) / (count_of(history) + self.prior)
        return np.log10(chance)


def _sums(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, start[:-1]) if len(start) > 1 else np.zeros(0)


# A row of `docs`; or, with a segment, the tokens whose counts a batch asks for, `rows` on from number `row`.
_SCORED = "row long, doc_id long, n_tokens long, known long, base double, score double, segment long, rows binary, keys binary"


def score_texts(docs: DataFrame, table: CountTable, prior: float = PRIOR) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every row of `docs`.

    `score` is the sum of log10 probabilities of a row's tokens, from the levels that the broadcast filter gives. If
    the filter comes in parts, each part adds its levels in a pass of its own, and the last pass scores.

    `base_score` takes exact counts of single tokens: those of frequent ones are broadcast, those of the others are
    looked up where their segment is, to which each batch sends its different tokens.
    """
    spark = docs.sparkSession
    context = spark.sparkContext
    order, passes, segments = table.order, len(table.bounds) - 1, table.segments
    heavy = context.broadcast(table.heavy())
    scale = np.log10(table.tokens + RAISED * (table.distinct + 1))
    now = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"), F.lit(None).cast("binary").alias("levels"))

    def levels_of(batch, part):
        line, start = tokens(batch["text"])
        keys = grams(line, start, order)
        # Each different n-gram is probed once.
        different, back = np.unique(np.concatenate(keys), return_inverse=True)
        found = part.levels(different)[back].astype(np.uint8).reshape(order, len(line))
        if batch["levels"].null_count < len(batch):
            before = [np.frombuffer(x, np.uint8).reshape(order, -1) for x in batch["levels"].to_pylist()]
            found = np.maximum(found, np.concatenate(before, axis=1))
        return line, start, found

    def adding(held):
        def run(rows):
            for batch in batches(rows, BATCH_BYTES):
                _, start, found = levels_of(batch, held.value)
                blobs = [found[:, a:b].tobytes() for a, b in zip(start[:-1], start[1:])]
                yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text"], pa.array(blobs, pa.binary())], ["doc_id", "text", "levels"])

        return run

    end_level = 0
    for k in range(passes):
        part = table.part(k)
        end_level = max(end_level, int(part.levels(np.array([_END]))[0]))
        held = context.broadcast(part)
        if k < passes - 1:
            now = cut_lineage(now.mapInArrow(adding(held), now.schema))
            held.destroy()
    model = Smoothed(table.tokens, table.distinct, end_level, prior)

    def scoring(rows):
        row = TaskContext.get().partitionId() << 40  # numbers of rows, used with the rows that are written here
        names, counts = heavy.value
        shape = pa.schema([
            *[(c, pa.int64()) for c in ("row", "doc_id", "n_tokens", "known")], ("base", pa.float64()), ("score", pa.float64()),
            ("segment", pa.int64()), ("rows", pa.binary()), ("keys", pa.binary()),
        ])
        for batch in batches(rows, BATCH_BYTES):
            line, start, found = levels_of(batch, held.value)
            n = np.diff(start)
            at = np.searchsorted(names, line)
            often = names[np.minimum(at, len(names) - 1)] == line if len(names) else np.zeros(len(line), bool)
            base = np.zeros(len(line))
            base[often] = np.log10(counts[at[often]] + RAISED)
            scores = model.log10([x.astype(np.int64) for x in found], start)
            nothing = pa.nulls(len(n), pa.binary())
            yield pa.RecordBatch.from_arrays([
                pa.array(row + np.arange(len(n))), batch["doc_id"], pa.array(n), pa.array(_sums(often.astype(np.int64), start)),
                pa.array(_sums(base, start) - n * scale), pa.array(_sums(scores, start)), pa.nulls(len(n), pa.int64()), nothing, nothing,
            ], schema=shape)
            # The other tokens ask for their counts.
            rare = ~often
            asked = _blobs(segment_of(line[rare], segments), segments, rows=np.repeat(np.arange(len(n), dtype=np.int32), n)[rare], keys=line[rare])
            yield pa.RecordBatch.from_pylist([{"row": row, **blob} for blob in asked], shape)
            row += len(n)

    scored = cut_lineage(now.mapInArrow(scoring, _SCORED))
    # The scores are written: no task needs the filter any more.
    held.destroy()
    heavy.destroy()
    asked = scored.where("segment IS NOT NULL").select("segment", "row", "rows", "keys", F.lit(None).cast("binary").alias("counts"))
    given = table.rows.select("segment", F.lit(None).cast("long").alias("row"), F.lit(None).cast("binary").alias("rows"), "keys", "counts")

    def look_up(rows):
        of, names, counts = None, None, None
        for batch in batches(rows, BLOB_BYTES):
            for segment, row, numbers, keys, given_counts in zip(*(batch[c].to_pylist() for c in ("segment", "row", "rows", "keys", "counts"))):
                keys = np.frombuffer(keys, np.uint64)
                if row is None:
                    of, names, counts = segment, keys, np.frombuffer(given_counts, np.int64)
                    continue
                if of != segment:  # a segment that nothing was counted in
                    of, names, counts = segment, np.zeros(0, np.uint64), np.zeros(0, np.int64)
                at = np.searchsorted(names, keys)
                n = np.zeros(len(keys), np.int64)
                near = np.minimum(at, max(len(names) - 1, 0))
                if len(names):
                    n = np.where(names[near] == keys, counts[near], 0)
                # Within a blob rows come in order.
                numbers = np.frombuffer(numbers, np.int32)
                first = np.flatnonzero(np.r_[True, numbers[1:] != numbers[:-1]])
                known = np.add.reduceat((n > 0).astype(np.int32), first).astype(np.int32)
                base = np.add.reduceat(np.log10(n + RAISED), first)
                yield pa.RecordBatch.from_pylist([{
                    "row": row, "segment": segment, "rows": numbers[first].tobytes(), "known": known.tobytes(), "base": base.tobytes()
                }], pa.schema([("row", pa.int64()), ("segment", pa.int64()), ("rows", pa.binary()), ("known", pa.binary()), ("base", pa.binary())]))

    def add_up(rows):
        """The answers to a batch's questions, one for each segment, added up by row."""
        of, parts = None, []

        def close():
            number, known, base = (np.concatenate(x) for x in zip(*parts))
            some = np.unique(number)
            return pa.RecordBatch.from_arrays([
                pa.array(of + some.astype(np.int64)), pa.array(np.bincount(number, known)[some].astype(np.int64)), pa.array(np.bincount(number, base)[some])
            ], ["row", "more_known", "more_base"])

        for batch in rows:
            for row, number, known, base in zip(*(batch[c].to_pylist() for c in ("row", "rows", "known", "base"))):
                if row != of and parts:
                    yield close()
                    parts.clear()
                of = row
                parts.append((np.frombuffer(number, np.int32), np.frombuffer(known, np.int32), np.frombuffer(base, np.float64)))
        if parts:
            yield close()

    answers = given.unionByName(asked).repartition(segments, "segment").sortWithinPartitions("segment", F.asc_nulls_first("row")).mapInArrow(
        look_up, "row long, segment long, rows binary, known binary, base binary"
    )
    more = answers.repartition("row").sortWithinPartitions("row", "segment").mapInArrow(add_up, "row long, more_known long, more_base double")
    return scored.where("segment IS NULL").select("row", "doc_id", "n_tokens", "known", "base", "score").join(more, "row", "left").select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), "score",
    )


def _parcels(docs: DataFrame, parcel_bytes: int) -> DataFrame:
    """parcel, texts: the rows in parcels of some `parcel_bytes` of text, each a compressed Arrow stream of batches."""

    def run(rows):
        number, held = TaskContext.get().partitionId() << 32, []  # numbers of parcels, used with the parcels that are written

        def close():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as stream:
                for batch in held:
                    stream.write_batch(batch)
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["parcel", "texts"])

        for batch in batches(rows, min(parcel_bytes, BATCH_BYTES)):
            held.append(batch)
            if sum(b.nbytes for b in held) >= parcel_bytes:
                yield close()
                number, held = number + 1, []
        if held:
            yield close()

    return docs.mapInArrow(giving_back(run), "parcel long, texts binary")


def _opened(texts: pa.Buffer | bytes, order: int) -> tuple[pa.Table, np.ndarray, dict[bool, np.ndarray]]:
    """A parcel's rows, the first place of each text, and its single tokens and longer n-grams, one length after the other."""
    rows = pa.ipc.open_stream(texts).read_all()
    found = [tokens(batch["text"]) for batch in rows.to_batches()]
    line = np.concatenate([x for x, _ in found])
    start = np.r_[0, np.cumsum(np.concatenate([np.diff(x) for _, x in found]))]
    single, *longer = grams(line, start, order)
    return rows, start, {True: single, False: np.concatenate([line[:0], *longer])}


def _asked(keys: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The segments of the different keys, in order; the keys' ranks, rising in each segment; each given key's place there.

    What `segment_of` takes the remainder of is the segment and, as the quotient, the rank, so both name the key.
    """
    mixed, number = _numbered(mix(keys, 41))
    rank, segment = np.divmod(mixed, np.uint64(segments))
    order = np.argsort(segment.astype(np.min_scalar_type(segments)), kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return segment[order].astype(np.int64), rank[order], place[number]


def _key_of(segment: int, rank: np.ndarray, segments: int) -> np.ndarray:
    """The keys of a segment with these ranks: `mix` taken back."""
    with np.errstate(over="ignore"):
        x = rank * np.uint64(segments) + np.uint64(segment)
        for shift, factor in ((31, 0x94D049BB133111EB), (27, 0xBF58476D1CE4E5B9), (30, 1)):
            x = (x ^ (x >> np.uint64(shift)) ^ (x >> np.uint64(2 * shift))) * np.uint64(pow(factor, -1, 2**64))
        return x - np.uint64(0x9E3779B97F4A7C15 * (2 * 41 + 1) % 2**64)


def _steps(rank: np.ndarray) -> bytes:
    """Rising numbers as the steps between them, first bytes together, so that the empty ones take no room in a shuffle."""
    return np.diff(rank, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _of_steps(blob: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()
    return np.cumsum(steps, dtype=np.uint64)


def _short(counts: np.ndarray) -> bytes:
    """A byte for each count, behind them those of 255 and more as numbers."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype(np.int64).tobytes()


def _of_short(blob: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(blob[:n], np.uint8).astype(np.int64)
    counts[counts == 255] = np.frombuffer(blob[n:], np.int64)
    return counts


# What a parcel asks a segment: the ranks of its n-grams, and how often they are learnt.
_ASKED = pa.schema([("parcel", pa.int64()), ("segment", pa.int64()), ("single", pa.bool_()), ("ranks", pa.binary()), ("counts", pa.binary())])
# What a segment says to a parcel; or, without a parcel, its part in the totals.
_TOLD = pa.schema([
    ("parcel", pa.int64()), ("segment", pa.int64()), ("single", pa.bool_()), ("levels", pa.binary()), ("counts", pa.binary()),
    ("distinct", pa.int64()), ("tokens", pa.int64()), ("end_level", pa.int64()),
])


def _answers(parcels: DataFrame, order: int, segments: int) -> DataFrame:
    """The rows of _TOLD: each parcel's different n-grams are counted, and looked up in the filter, where their segment is.

    A segment answers with the levels of a parcel's n-grams in the order in which they were asked for, and with the
    exact counts of single tokens. It holds the n-grams that it is asked for, which are as many however large the corpus.
    """

    def ask(rows):
        for batch in rows:
            for parcel, texts in zip(batch["parcel"].to_pylist(), batch["texts"]):
                held, start, found = _opened(texts.as_buffer(), order)
                learnt = np.repeat(held["learnt"].to_numpy(), np.diff(start))
                for single in (True, False):
                    keys = found.pop(single)
                    there = np.flatnonzero(keys)
                    segment, rank, place = _asked(keys[there], segments)
                    counts = np.bincount(place, learnt[there % len(learnt)], len(rank)).astype(np.int64)
                    edges = np.searchsorted(segment, np.arange(segments + 1)).tolist()
                    yield pa.RecordBatch.from_pylist([
                        {"parcel": parcel, "segment": k, "single": single, "ranks": _steps(rank[a:b]), "counts": _short(counts[a:b])}
                        for k, (a, b) in enumerate(zip(edges, edges[1:])) if a < b
                    ], _ASKED)

    def answer(rows):
        of, held = None, {True: [], False: []}

        def close():
            kinds, told = {}, []
            for single, asked in held.items():
                ranks, number = _numbered(np.concatenate([np.zeros(0, np.uint64), *[_of_steps(x) for _, x, _ in asked]]))
                counts = np.concatenate([np.zeros(0, np.int64), *[_of_short(x, len(y) // 8) for _, y, x in asked]])
                kinds[single] = _key_of(of, ranks, segments), np.bincount(number, counts, len(ranks)).astype(np.int64), number
            bits = fill_segment(*(np.concatenate([kind[x][kind[1] > 0] for kind in kinds.values()]) for x in (0, 1)))
            for single, (keys, counts, number) in kinds.items():
                levels, at = read_segment(bits, keys).astype(np.uint8), 0
                for parcel, ranks, _ in held[single]:
                    here = number[at:at + len(ranks) // 8]
                    at += len(here)
                    told.append({"parcel": parcel, "segment": of, "single": single, "levels": levels[here].tobytes(), "counts": _short(counts[here]) if single else None})
            end = np.array([_END])
            told.append({
                "segment": of, "distinct": int((kinds[True][1] > 0).sum()), "tokens": int(kinds[True][1].sum()),
                "end_level": int(read_segment(bits, end)[0]) if segment_of(end, segments)[0] == of else 0,
            })
            return pa.RecordBatch.from_pylist(told, _TOLD)

        for batch in batches(rows, BLOB_BYTES):
            for segment, parcel, single, ranks, counts in zip(*(batch[c].to_pylist() for c in ("segment", "parcel", "single", "ranks", "counts"))):
                if of != segment:
                    if of is not None:
                        yield close()
                    of, held = segment, {True: [], False: []}
                held[single].append((parcel, ranks, counts))
        if of is not None:
            yield close()

    asked = parcels.mapInArrow(giving_back(ask), "parcel long, segment long, single boolean, ranks binary, counts binary")
    return asked.repartition(segments, "segment").sortWithinPartitions("segment").mapInArrow(
        giving_back(answer), "parcel long, segment long, single boolean, levels binary, counts binary, distinct long, tokens long, end_level long"
    )


def score_by_segment(
    docs: DataFrame, learnt: Column, size: int, order: int = 2, segment_bytes: int = SEGMENT_BYTES, parcel_bytes: int = PARCEL_BYTES,
    prior: float = PRIOR,
) -> tuple[DataFrame, int]:
    """What `score_texts` gives with the counts of the rows that are `learnt`, and the number of tokens counted.

    For any amount of text: nothing is broadcast, and texts are read as often however large the filter. `size` is the
    bytes of text to be learnt from. Texts are written once, in parcels; a parcel's n-grams go to their segments, which
    hold the same bits as those of `count_grams`, and the levels and counts found there go to the parcel.
    """
    segments = _segments(size, segment_bytes)
    parcels = cut_lineage(_parcels(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"), learnt.alias("learnt")), parcel_bytes
    ))
    answers = cut_lineage(_answers(parcels, order, segments))
    total = answers.where("parcel IS NULL").agg(*[f(c).alias(c) for f, c in ((F.sum, "tokens"), (F.sum, "distinct"), (F.max, "end_level"))]).first()
    model = Smoothed(total["tokens"], total["distinct"], total["end_level"], prior)
    scale = np.log10(model.tokens + RAISED * (model.distinct + 1))

    def score(rows):
        def close(texts, told):
            held, start, found = _opened(texts, order)
            levels = {}
            for single in (True, False):
                keys = found.pop(single)
                there = np.flatnonzero(keys)
                _, rank, place = _asked(keys[there], segments)
                got = np.frombuffer(b"".join(x for kind, x, _ in told if kind == single), np.uint8)
                if len(got) != len(rank):
                    raise ValueError("the answers are not those to the parcel's questions")
                levels[single] = np.zeros(len(keys), np.uint8)
                levels[single][there] = got[place]
                if single:
                    counts = np.concatenate([_of_short(x, len(y)) for kind, y, x in told if kind])[place]
            levels = np.concatenate([levels[True], levels[False]]).reshape(order, -1)
            row = 0
            for batch in held.to_batches():
                here = start[row:row + len(batch) + 1]
                row += len(batch)
                a, b = here[0], here[-1]
                here = here - a
                yield pa.RecordBatch.from_arrays([
                    batch["doc_id"], pa.array(np.diff(here)), pa.array(_sums((counts[a:b] > 0).astype(np.int64), here)),
                    pa.array(_sums(np.log10(counts[a:b] + RAISED), here) - np.diff(here) * scale),
                    pa.array(_sums(model.log10([x[a:b].astype(np.int64) for x in levels], here), here)),
                ], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

        texts, told = None, []
        for batch in batches(rows, BLOB_BYTES):
            for given, *answer in zip(*(batch[c].to_pylist() for c in ("texts", "single", "levels", "counts"))):
                if given is None:
                    told.append(answer)
                    continue
                if texts is not None:
                    yield from close(texts, told)
                texts, told = given, []
        if texts is not None:
            yield from close(texts, told)

    told = answers.where("parcel IS NOT NULL").select("parcel", "segment", F.lit(None).cast("binary").alias("texts"), "single", "levels", "counts")
    both = parcels.withColumn("segment", F.lit(None).cast("long")).unionByName(told, allowMissingColumns=True)
    # Twice as many tasks as parcels, so that few get more than two.
    scored = both.repartition(2 * parcels.count(), "parcel").sortWithinPartitions("parcel", F.asc_nulls_first("segment"))
    return scored.mapInArrow(giving_back(score), "doc_id long, n_tokens long, n_known long, base_score double, score double"), model.tokens


def score_language(
    docs: DataFrame, order: int = 2, modulus: int = 10, held: int = 0, filter_bytes: int = FILTER_BYTES,
    segment_bytes: int = SEGMENT_BYTES,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of `docs`.

    Counts are those of all rows whose crc32 of doc_id as text does not leave the held-out remainder. A null or empty
    text has one token, its end. Rows without an id are learnt from, never held out; repeated rows are counted and
    scored each. Other columns are not read. If there is nothing to learn from, every token has the probability 1; an
    empty table gives an empty result.

    The filter of a small corpus is broadcast; of more than `filter_bytes` of text, n-grams are looked up where they were
    counted (`score_by_segment`), with the same levels.
    """
    held_out = split_by_crc(modulus, held)
    train = docs.where(~held_out).select("text")
    size = _text_bytes(train)
    if size > filter_bytes:
        scored, n = score_by_segment(docs, ~held_out, size, order, segment_bytes)
    else:
        table = count_grams(train, order, filter_bytes, segment_bytes)
        scored, n = score_texts(docs, table), table.tokens
    return scored.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score"
    )
