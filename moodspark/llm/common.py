"""What the corpus operators share: reading, measured broadcasts, partition sums, calibration, word columns."""

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A table of up to this many bytes, as measured, is broadcast; a larger one is shuffled.
BROADCAST_BYTES = 64 * 1024 * 1024
# What a row costs in a broadcast table besides its values.
ROW_BYTES = 64
# A key with more rows than this is split into parts of this size.
HOT_ROWS = 200_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """The text as it stands, a null one as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """The names, led by as many underscores as it takes for none to be a column of the table."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def measured(df: DataFrame, row_bytes: Column | int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The table with a broadcast hint if its measured size allows that, else as it is."""
    values = F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes
    size = df.agg(F.sum(values + F.lit(ROW_BYTES)).alias("bytes")).first()["bytes"]
    return F.broadcast(df) if (size or 0) <= limit else df


def join_unique(
    rows: DataFrame, unique: DataFrame, key: str, count: str, spread: str, how: str = "left", floor: int = HOT_ROWS
) -> DataFrame:
    """Join with a table of one row per key that says in `count` how many rows each key has on the left.

    Keys with more than `floor` rows are dealt to several parts by a hash of `spread`. There are at most
    rows / floor such keys, so their list, two numbers each, is small enough to be measured and broadcast.
    """
    parts = F.ceil(F.col(count) / F.lit(floor)).cast("int")
    hot = unique.where(F.col(count) > floor).select(key, parts.alias("_parts"))
    if hot.isEmpty():
        return rows.join(unique.drop(count), key, how)
    marks = measured(hot, F.octet_length(F.col(key).cast("string")) + 16)
    part = F.coalesce(F.pmod(F.xxhash64(spread), F.col("_parts")), F.lit(0)).cast("int")
    left = rows.join(marks, key, "left").withColumn("_part", part).drop("_parts")
    right = unique.withColumn("_part", F.explode(F.sequence(F.lit(0), F.greatest(parts - 1, F.lit(0))))).drop(count)
    return left.join(right, [key, "_part"], how).drop("_part")


def _give_back() -> None:
    """Return free memory to the machine: Python workers live on for other tasks, beside a JVM that needs it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only the GNU library has it
    if trim:
        trim(0)


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A task's function that, when it has ended and let go of what it held, gives back free memory."""

    def whole(rows):
        yield from run(rows)
        _give_back()

    return whole


def batches(rows: Iterator[pa.RecordBatch], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that none holds much more than `most` bytes unless a single row does."""
    for batch in rows:
        step = max(1, int(batch.num_rows * most / max(batch.nbytes, 1)))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)
    _give_back()


def partition_sums(
    df: DataFrame, width: int, add: Callable[[pa.RecordBatch], np.ndarray], kind: type = np.float64, fan: int = 64
) -> np.ndarray:
    """Sum over all rows of a vector of fixed width: in every task, then in ever fewer tasks, then here.

    `kind` is the type in which sums travel; they are added up as 64-bit numbers.
    """
    schema = pa.schema([("slot", pa.int32()), ("sums", pa.binary())])

    def add_up(tasks, blobs):
        def run(rows):
            total, seen = np.zeros(width), False
            for batch in rows:
                if blobs:
                    for blob in batch["sums"]:
                        total += np.frombuffer(blob.as_py(), kind)
                        seen = True
                elif batch.num_rows:
                    total += add(batch)
                    seen = True
            if seen:
                slot = TaskContext.get().partitionId() % tasks
                yield pa.RecordBatch.from_pydict({"slot": [slot], "sums": [total.astype(kind).tobytes()]}, schema)

        return run

    shape = "slot int, sums binary"
    tasks = df.rdd.getNumPartitions()
    into = max(4, -(-tasks // fan))
    sums = df.mapInArrow(giving_back(add_up(into, False)), shape)
    while tasks > 4:
        tasks, into = into, max(4, -(-into // fan))
        sums = sums.repartition(tasks, "slot").mapInArrow(giving_back(add_up(into, True)), shape)
    total = np.zeros(width)
    for found in sums.collect():
        total += np.frombuffer(found["sums"], kind)
    return total


# Scores are counted in this many steps before they are calibrated.
BINS = 2048


def isotonic(hits: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Rising probabilities for bins of rising score: pools neighbours that fall (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for k in range(len(counts)):
        if not counts[k]:
            continue
        blocks.append([hits[k], counts[k], k])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            h, n, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + h, blocks[-1][1] + n, last]
    if not blocks:
        return np.full(len(counts), 0.5)
    # Half a case of either kind keeps the ends off 0 and 1; between the blocks' middles it is interpolated.
    starts = np.r_[0, [b[2] + 1 for b in blocks[:-1]]]
    middle = np.array([(a + b[2]) / 2 for a, b in zip(starts, blocks)])
    level = np.array([(b[0] + 0.5) / (b[1] + 1) for b in blocks])
    return np.interp(np.arange(len(counts)), middle, np.maximum.accumulate(level))


def split_by_crc(modulus: int, held: int) -> Column:
    """Whether crc32 of doc_id as text leaves the held-out remainder; a row without an id never does."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == held, F.lit(False))


def one_label(labels: DataFrame, name: str) -> DataFrame:
    """One label for each document: that of most of its label rows, the lower one if even; nulls don't count."""
    return labels.where(F.col(name).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.when(F.avg(F.col(name).cast("double")) > 0.5, 1).otherwise(0).alias("label")
    )


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A well mixed 64-bit hash of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def letter_words(texts: pa.Array) -> pa.Array:
    """The texts with blanks for everything that isn't a letter, a mark or a digit."""
    return pc.replace_substring_regex(pc.fill_null(texts, ""), r"[^\pL\pM\pN]+", " ")


# Words of more bytes are hashed one by one.
LONG_WORD = 256
_BYTES = mix(np.arange(256), 21)
_PLACES = mix(np.arange(LONG_WORD), 22) | np.uint64(1)


def string_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of strings without nulls; 0 for the empty string alone.

    Each byte's number is multiplied by an odd one for its place, and these are added up for all strings at once.
    """
    import xxhash

    words = words.cast(pa.large_string())
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1] if len(words) else np.zeros(1, int)
    lengths = np.diff(ends)
    long = lengths > LONG_WORD
    if long.any():
        hashes = np.empty(len(words), np.uint64)
        hashes[~long] = string_hashes(words.filter(pa.array(~long)))
        hashes[long] = [xxhash.xxh64_intdigest(w.as_buffer()) or 1 for w in words.filter(pa.array(long))]
        return hashes
    if not lengths.any():
        return np.zeros(len(words), np.uint64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[ends[0]:ends[-1]]
    ends = ends - ends[0]
    values = _BYTES[data] * _PLACES[np.arange(len(data)) - np.repeat(ends[:-1], lengths)]
    total = np.r_[np.uint64(0), np.cumsum(values, dtype=np.uint64)]
    hashes = mix((total[ends[1:]] - total[ends[:-1]]) + lengths.astype(np.uint64), 23)
    return np.where(lengths > 0, np.maximum(hashes, np.uint64(1)), np.uint64(0))


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A code for every lower-case word of the texts, one after the other, each text's first place, and 64-bit
    hashes by code.

    Words are runs without white space. The strings are split and told apart by Arrow, and each different word of
    the batch is hashed once.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    # Trimmed first, as Arrow's split sometimes keeps a blank at the very end in the last word.
    words = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.utf8_lower(texts)))
    coded = pc.dictionary_encode(words.flatten())
    lengths = pc.list_value_length(words).to_numpy(zero_copy_only=False)
    known = string_hashes(coded.dictionary)
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.r_[0, np.cumsum(lengths)].astype(np.int64)
    # An empty text has one empty word, which is dropped.
    if (known == 0).any():
        empty = known[codes] == 0
        start = start - np.r_[0, np.cumsum(empty)][start]
        codes = codes[~empty]
    return codes, start, known


# White space of several bytes, as Arrow and Python have it: the first and last character of each stretch.
WIDE_BLANKS = [(0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F),
               (0x3000, 0x3000)]
_FIRST_BYTES = sorted({chr(c).encode()[0] for c, _ in WIDE_BLANKS})
# By length, the bits of eight bytes that a string of so many bytes has.
_HELD = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _blanks(data: np.ndarray) -> np.ndarray:
    """Which of the UTF-8 bytes belong to white space; at least two more bytes than the text has are expected."""
    # Smaller numbers wrap around: 9 to 13 and 28 to 32.
    blank = (data - np.uint8(9) < 5) | (data - np.uint8(28) < 5)
    wide = np.zeros(len(data) - 2, bool)
    for byte in _FIRST_BYTES:
        wide |= data[:-2] == byte
    wide = np.flatnonzero(wide)
    if len(wide):
        a, b, c = (data[wide + k].astype(np.int32) for k in range(3))
        two = a < 0xE0
        point = np.where(two, (a & 31) << 6 | b & 63, (a & 15) << 12 | (b & 63) << 6 | c & 63)
        found = np.zeros(len(wide), bool)
        for low, high in WIDE_BLANKS:
            found |= (point >= low) & (point <= high)
        for at in (wide[found], wide[found] + 1, wide[found & ~two] + 2):
            blank[at] = True
    return blank


def word_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all lower-case words of the texts, one after the other, and each text's first place.

    The words are those of `word_codes`, the hashes others: eight bytes of all words at a time are read as one number.
    """
    import xxhash

    texts = pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string()))
    if not len(texts):
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    size = int(ends[-1] - ends[0])
    data = np.zeros(size + 8, np.uint8)
    if size:
        data[:size] = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0]:ends[-1]]
    ends = ends - ends[0]
    inside = ~_blanks(data)
    inside[size:] = False
    # A word begins after white space and where a text begins, and ends before the next of either.
    edge = np.zeros(size + 1, bool)
    edge[ends] = True
    edge = edge[:size]
    first = inside[:size].copy()
    first[1:] &= edge[1:] | ~inside[:size - 1] if size else False
    last = inside[:size].copy()
    last[:-1] &= edge[1:] | ~inside[1:size] if size else False
    first = np.flatnonzero(first)
    lengths = np.flatnonzero(last) + 1 - first
    start = np.searchsorted(first, ends)
    # The eight bytes from each byte on, as a number.
    eights = np.ndarray(size + 1, "<u8", data.data, strides=(1,))
    with np.errstate(over="ignore"):
        hashes = (eights[first] & _HELD[np.minimum(lengths, 8)]) + lengths.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
        hashes = mix(hashes, 31)
        more = np.flatnonzero((lengths > 8) & (lengths <= LONG_WORD))
        k = 8
        while len(more):
            part = eights[first[more] + k] & _HELD[np.minimum(lengths[more] - k, 8)]
            hashes[more] = mix(hashes[more] * np.uint64(0x100000001B3) + part, 32)
            k += 8
            more = more[lengths[more] > k]
    for w in np.flatnonzero(lengths > LONG_WORD):
        hashes[w] = xxhash.xxh64_intdigest(data[first[w]:first[w] + lengths[w]])
    return hashes, start


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all lower-case words of the texts, one after the other, and each text's first place."""
    codes, start, known = word_codes(texts)
    return known[codes], start


def shingle_hashes(texts: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of each text, as they follow each other, and each text's first place.

    A text of fewer words than the width has one shingle, of all its words; a text without words none.
    """
    values, start = word_hashes(texts)
    n = np.diff(start)
    size = np.repeat(n, n)
    place = np.arange(len(values)) - np.repeat(start[:-1], n)
    full = np.zeros(len(values), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            part = np.zeros(len(values), np.uint64)
            part[:max(len(values) - k, 0)] = values[k:]
            part[place + k >= size] = 0  # beyond the end of a short text
            full = mix(full * np.uint64(0x100000001B3) + part, k)
    keep = (place == 0) | (place + width <= size)
    return full[keep], np.r_[0, np.cumsum(np.where(n > 0, np.maximum(n - width + 1, 1), 0))].astype(np.int64)


def shingle_sets(texts: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and each text's first place."""
    full, start = shingle_hashes(texts, width)
    owner = np.repeat(np.arange(len(start) - 1), np.diff(start))
    order = np.lexsort((full, owner))
    owner, full = owner[order], full[order]
    first = np.r_[True, (owner[1:] != owner[:-1]) | (full[1:] != full[:-1])] if len(full) else np.zeros(0, bool)
    owner, full = owner[first], full[first]
    return full, np.searchsorted(owner, np.arange(len(start)))


def sorted_groups(rows: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The groups of rows of one key, from batches that are sorted by it; one group is held at a time."""
    held: list[pa.RecordBatch] = []
    for batch in rows:
        if not batch.num_rows:
            continue
        values = batch[key].to_numpy(zero_copy_only=False)
        if held and held[0][key][0].as_py() != values[0]:
            yield pa.Table.from_batches(held)
            held = []
        edges = np.r_[0, np.flatnonzero(values[1:] != values[:-1]) + 1, len(values)]
        for a, b in zip(edges[:-1], edges[1:]):
            held.append(batch.slice(a, b - a))
            if b < len(values):
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)
