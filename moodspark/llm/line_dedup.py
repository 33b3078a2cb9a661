"""Line dedup: an exact set-similarity join of lines by prefix, position and length, which removes later matches."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodspark.functions.text import let
from moodspark.llm.common import batches, fresh_names, giving_back, measured, mix, partition_sums, whole_text, word_keys
from moodspark.plans.session import cut_lineage

THRESHOLD = 0.8
# Lines of fewer different words are left alone; as it stands, none that has words.
EVERY_LINE = 1
# Words are counted in so many counters; words that share one only seem less rare than they are.
COUNTERS = 1 << 20
# Lines that share a word of their prefixes are compared in one task up to this number.
CELL_LINES = 65_536
# Up to this many lines of a word all pairs are tested at once.
SMALL = 48
HEADS = 8
# Of more possible matches than this, for each word of its prefix, a line reports the likeliest alone at first.
REPORTS = 6
# Lines of more words have parities of 128 classes of words instead of 64.
LONG = 64
# Lines' words that one task puts in order.
TASK_WORDS = 300_000
# Bytes of text that a task looks at together: as much as stays in the processor's cache with all that is made of it.
BATCH_BYTES = 1 << 20
# Words whose list is sent to all tasks.
MOST_WORDS = 500_000


def _lines(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All lines of the texts, the text that each is from, and its number there."""
    parts = pc.split_pattern(pc.fill_null(texts, "").cast(pa.large_string()), "\n")
    n = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(n)), n)
    return parts.flatten(), owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).where("doc_id IS NOT NULL")


def word_counts(docs: DataFrame, counters: int = COUNTERS) -> np.ndarray:
    """How often the words of each counter occur in all lines; the table's size does not depend on the corpus."""

    def count(batch):
        total = np.zeros(counters)
        for part in batches([batch], BATCH_BYTES):
            keys, _ = word_keys(part["text"])
            total += np.bincount((keys % np.uint64(counters)).astype(np.int64), minlength=counters)
        return total

    return partition_sums(_texts(docs).select("text"), counters, count, np.float32).astype(np.float32)


def prefix_length(n: np.ndarray, threshold: float) -> np.ndarray:
    """Of two sets that reach the threshold, so many of the rarest words of either have one in common."""
    return n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1


def _rarest_first(known: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The order by count, then by hash: one sort of numbers made of both, unless words share such a number."""
    keys = often.view(np.uint32).astype(np.uint64) << np.uint64(32) | known >> np.uint64(32)
    order = np.argsort(keys)
    keys = keys[order]
    return np.lexsort((known, often)) if (keys[1:] == keys[:-1]).any() else order


def _sets(lines: pa.Array, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the different words of each line, rarest first, and each line's first place.

    Counts that differ by less than a percent may pass for equal; such words go by their hash, in all lines alike.
    """
    keys, start = word_keys(lines)
    n = len(start) - 1
    rare = counts[(keys % np.uint64(len(counts))).astype(np.int64)].view(np.uint32) >> np.uint32(15)
    line = np.repeat(np.arange(n, dtype=np.uint64), np.diff(start))
    # Numbers of the line, 16 bits of the word's count and as many bits of its hash as there is room for.
    room = np.uint64(48 - n.bit_length())
    above = room + np.uint64(16)
    mixed = line << above | rare.astype(np.uint64) << room | keys >> (np.uint64(64) - room)
    order = np.argsort(mixed)
    mixed, words = mixed.take(order), keys.take(order)
    repeated = words[1:] == words[:-1]
    if ((mixed[1:] == mixed[:-1]) & ~repeated).any():
        # Different words with one number: put in order by the whole hash.
        order = _rarest_first(keys, (rare << np.uint32(15)).view(np.float32))
        order = order[np.argsort(line[order], kind="stable")]
        mixed, words = line[order] << above, keys[order]
        repeated = words[1:] == words[:-1]
    keep = np.ones(len(words), bool)
    keep[1:] = ~repeated | (mixed[1:] >> above != mixed[:-1] >> above)
    keep = np.flatnonzero(keep)
    return words.take(keep), np.searchsorted(mixed.take(keep), np.arange(n + 1, dtype=np.uint64) << above)


def line_sets(docs: DataFrame, counts: np.ndarray, threshold: float, least: int, cell_lines: int = CELL_LINES) -> DataFrame:
    """doc_id, line, k1, k2, held of every line with enough different words.

    k1 and k2 are a hash of the set. `held` has n, bits, bits2 and the prefix, eight bytes for each number. `bits`, and
    `bits2` for long lines, have the parity of the number of words for each class of words, so they differ in no more
    bits than two sets differ in words. The prefix has a hash for each of its words, or several for one that very many
    lines have: a cell for each pair of parts that the line's part is in.
    """
    table = docs.sparkSession.sparkContext.broadcast(counts)
    kind = pa.schema([("doc_id", pa.int64()), ("line", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("held", pa.binary())])

    def sets_of(batch):
        lines, owner, number = _lines(batch["text"])
        words, start = _sets(lines, table.value)
        n = np.diff(start)
        keep = np.flatnonzero(n >= least)
        if not len(keep):
            return None
        sums = [np.r_[np.uint64(0), np.cumsum(values, dtype=np.uint64)] for values in (words, mix(words, 5))]
        with np.errstate(over="ignore"):
            k1, k2 = ((s[start[1:]] - s[start[:-1]])[keep] for s in sums)
        # The words' classes are bits of their hashes.
        flags = np.uint64(1) << (words >> np.uint64(58))
        bits, bits2 = _parity(flags, start)[keep], np.zeros(len(keep), np.uint64)
        long = n[keep] > LONG
        if long.any():
            top = _parity(np.where(words & np.uint64(1 << 57), flags, np.uint64(0)), start)[keep]
            bits, bits2 = np.where(long, bits ^ top, bits), np.where(long, top, np.uint64(0))
        # A line so short that one word more is too much matches equal sets only, which need no prefix.
        p = np.where(n[keep] >= threshold * (n[keep] + 1) - 1e-9, prefix_length(n[keep], threshold), 0)
        first = np.r_[0, np.cumsum(p)]
        at = np.arange(first[-1]) - np.repeat(first[:-1], p) + np.repeat(start[:-1][keep], p)
        prefix, lengths = words[at], p
        often = table.value[(prefix % np.uint64(len(table.value))).astype(np.int64)]
        if (often > cell_lines).any():
            prefix, lengths = _cells(prefix, np.ceil(often / cell_lines).astype(np.int64), np.repeat(k1, p), p)
        held, begin = np.empty(len(prefix) + 3 * len(keep), np.uint64), np.cumsum(lengths + 3) - lengths - 3
        plain = np.ones(len(held), bool)
        for k, values in enumerate((n[keep], bits, bits2)):
            held[begin + k], plain[begin + k] = values, False
        held[plain] = prefix
        return pa.RecordBatch.from_arrays(
            [batch["doc_id"].take(pa.array(owner[keep])), pa.array(number[keep].astype(np.int32)), pa.array(k1.view(np.int64)),
             pa.array(k2.view(np.int64)), _packed(held, lengths + 3)], schema=kind,
        )

    def run(rows):
        # What a batch needs is let go of before the next one is looked at.
        for batch in batches(rows, BATCH_BYTES):
            if (made := sets_of(batch)) is not None:
                yield made

    return _texts(docs).mapInArrow(giving_back(run), "doc_id long, line int, k1 long, k2 long, held binary")


def _packed(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Numbers of one type as strings of bytes, so many in each."""
    ends = np.r_[0, np.cumsum(lengths)] * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _unpacked(blobs: pa.Array, kind: np.dtype | type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all strings of bytes, one after the other, and how many each has."""
    blobs = blobs.cast(pa.large_binary())
    ends = np.frombuffer(blobs.buffers()[1], np.int64)[blobs.offset:blobs.offset + len(blobs) + 1] if len(blobs) else np.zeros(1, int)
    held = blobs.buffers()[2]
    values = np.frombuffer(held[int(ends[0]):int(ends[-1])], kind) if held is not None else np.zeros(0, kind)
    return values, np.diff(ends) // values.itemsize


def _lines_held(blobs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n, bits and bits2 of each line, all prefixes one after the other, and how many words each has."""
    held, lengths = _unpacked(blobs, np.uint64)
    begin = np.cumsum(lengths) - lengths
    plain = np.ones(len(held), bool)
    for k in range(3):
        plain[begin + k] = False
    return np.stack([held[begin + k] for k in range(3)]), held[plain], lengths - 3


def _parity(flags: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The exclusive or of each line's flags."""
    rolled = np.r_[np.uint64(0), np.bitwise_xor.accumulate(flags)]
    return rolled[start[1:]] ^ rolled[start[:-1]]


def _cells(prefix: np.ndarray, parts: np.ndarray, key: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The prefix with a word in several parts replaced by its cells, and the new lengths."""
    own = (mix(key, 8) % parts.astype(np.uint64)).astype(np.int64)
    word = np.repeat(np.arange(len(prefix)), parts)
    other = np.arange(len(word)) - np.repeat(np.cumsum(parts) - parts, parts)
    low, high = np.minimum(own[word], other), np.maximum(own[word], other)
    cells = np.where(parts[word] > 1, mix(prefix[word] ^ mix(low * 1_000_003 + high, 9), 10), prefix[word])
    ends = np.cumsum(p)
    totals = np.r_[0, np.cumsum(parts)]
    return cells, totals[ends] - totals[ends - p]


def _apart(cols: dict[str, np.ndarray], late: np.ndarray, early: np.ndarray) -> np.ndarray:
    """In how many bits parities differ; two sets differ in at least as many words."""
    low = cols["bits"][late] ^ cols["bits"][early]
    top = cols["bits2"][late] ^ cols["bits2"][early]
    # A long line's parities fold into those that a short one has.
    same = (cols["n"][late] > LONG) == (cols["n"][early] > LONG)
    return np.where(same, np.bitwise_count(low).astype(np.int32) + np.bitwise_count(top), np.bitwise_count(low ^ top))


def _alike_enough(cols: dict[str, np.ndarray], late: np.ndarray, early: np.ndarray, threshold: float) -> np.ndarray:
    """Parity filter."""
    return (1 + threshold) * _apart(cols, late, early) <= (1 - threshold) * (cols["n"][late] + cols["n"][early]) + 1e-9


def _reach(cols: dict[str, np.ndarray], threshold: float) -> np.ndarray:
    """Filter by length and position: the most words that a line may have to match each line by its word, over all the
    words that their prefixes share. It holds both ways, so the longer line of a pair has at least the word's length."""
    return np.floor((1 + threshold) / threshold * (cols["n"] - cols["pos"]) + 1e-6).astype(np.int64) - cols["n"]


def _key(word: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A number that sorts by word, then by length; words that are one in these bits are one group, which loses nothing."""
    return word & ~_LENGTHS | np.clip(n, 0, int(_LENGTHS)).astype(np.uint64)


def _heads(key: np.ndarray) -> np.ndarray:
    """Where each word begins."""
    word = key & ~_LENGTHS
    return np.flatnonzero(np.r_[True, word[1:] != word[:-1]])


def _pairs_within(cols, who: np.ndarray, low: np.ndarray, high: np.ndarray, threshold: float):
    """Pairs of each line of `who` with those from `low` up to `high`, that pass all filters."""
    many = np.maximum(high - low, 0)
    total = np.r_[0, np.cumsum(many)]
    reach, n, at = cols["reach"], cols["n"], 0
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while at < len(who):
        to = max(at + 1, int(np.searchsorted(total, total[at] + 400_000, "right")) - 1)
        i = np.repeat(who[at:to], many[at:to])
        j = np.arange(len(i)) + np.repeat(low[at:to] - total[at:to] + total[at], many[at:to])
        for test in (lambda i, j: (n[j] <= reach[i]) & (n[i] <= reach[j]), lambda i, j: _alike_enough(cols, i, j, threshold)):
            ok = test(i, j)
            i, j = i[ok], j[ok]
        left.append(i)
        right.append(j)
        at = to
    return np.concatenate(left), np.concatenate(right)


def _small_groups(cols, who: np.ndarray, high: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a line and an earlier one; lines are in order of word and length, and each is tried with the next ones."""
    i, j = _pairs_within(cols, who, who + 1, high, threshold)
    doc, line = cols["doc_id"], cols["line"]
    swap = (doc[i] < doc[j]) | (doc[i] == doc[j]) & (line[i] < line[j])
    return np.where(swap, j, i), np.where(swap, i, j)


def _large_groups(cols, first: np.ndarray, high: np.ndarray, threshold: float, every: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for words of which lines have many others of a like length; `first` is where each line's word begins.

    Each line is tried with the first ones of its word, and only if these fail with all earlier ones. Also says for
    each line whether earlier ones were left untried; with `every` all are tried.
    """
    by_place = np.lexsort((cols["line"], cols["doc_id"], first))
    place = np.empty(len(first), np.int64)
    place[by_place] = np.arange(len(first))
    late, early = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    untried = np.zeros(len(first), bool)
    n, reach = cols["n"], cols["reach"]
    for h in range(0 if every else HEADS):
        i = np.flatnonzero(cols["probe"] & (place - first > h))
        j = by_place[first[i] + h]
        ok = (n[j] <= reach[i]) & (n[i] <= reach[j])
        i, j = i[ok], j[ok]
        ok = _alike_enough(cols, i, j, threshold)
        late.append(i[ok])
        early.append(j[ok])
        untried[i[ok]] = True
    rest = np.flatnonzero(cols["probe"] & ~untried)
    low = np.searchsorted(cols["key"], _key(cols["key"][rest], np.ceil(threshold * n[rest] - 1e-6)))
    i, j = _pairs_within(cols, rest, low, high[rest], threshold)
    ok = place[j] < place[i]
    late, early = np.concatenate([*late, i[ok]]), np.concatenate([*early, j[ok]])
    order = np.argsort(late, kind="stable")
    return late[order], early[order], untried


def _candidates(threshold: float, reports: int | None):
    """A pass over all lines of some words: each line with earlier ones that it may match.

    A task holds its rows, whose number is set by `_pairs`; the lines of a very common word are in cells.
    """
    kind = pa.schema([("doc_id", pa.int64()), ("line", pa.int32()), ("doc_id2", pa.int64()), ("line2", pa.int32()), ("apart", pa.int32()),
                      ("more", pa.bool_())])

    def found(cols, late, early, untried=None):
        own = cols["probe"][late]
        late, early = late[own], early[own]
        if not len(late):
            return
        apart = _apart(cols, late, early).astype(np.int32)
        order = np.lexsort((early, apart, late))
        late, early, apart = late[order], early[order], apart[order]
        more = np.zeros(len(late), bool)
        if reports is not None:
            heads = np.flatnonzero(np.r_[True, late[1:] != late[:-1]])
            sizes = np.diff(np.r_[heads, len(late)])
            more = np.repeat(sizes > reports, sizes)
            keep = ~more
            keep[heads] = True
            if untried is not None:
                more |= untried[late]
            late, early, apart, more = late[keep], early[keep], apart[keep], more[keep]
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[c][k]) for k in (late, early) for c in ("doc_id", "line")] + [pa.array(apart), pa.array(more)], schema=kind
        )

    def groups(cols):
        key = cols["key"]
        heads = _heads(key)
        sizes = np.diff(np.r_[heads, len(key)])
        cols["reach"] = _reach(cols, threshold)
        here = np.arange(len(key))
        high = np.maximum(np.searchsorted(key, _key(key, cols["reach"]), "right"), here + 1)
        # Pairs of a line and the next ones that it may match, for each word.
        many = np.add.reduceat(high - here - 1, heads)
        large = np.repeat(2 * many > SMALL * sizes, sizes)
        small = np.flatnonzero(~large)
        if len(small):
            yield from found(cols, *_small_groups(cols, small, high[small], threshold))
        if large.any():
            order = np.flatnonzero(large)
            moved = np.cumsum(large) - 1
            part = {c: v[order] for c, v in cols.items()}
            yield from found(part, *_large_groups(part, moved[np.repeat(heads, sizes)[order]], moved[high[order] - 1] + 1, threshold, reports is None))

    def run(rows):
        every = np.frombuffer(b"".join(_unpacked(batch["entries"], np.uint8)[0] for batch in rows), _ENTRY)
        if len(every):
            key = np.ascontiguousarray(every["key"])
            order = np.argsort(key)
            key = key[order]
            # Most words are those of one line; the rest of such an entry is not looked at.
            alone = np.r_[_heads(key), len(key)]
            alone = alone[:-1][np.diff(alone) == 1]
            every = every.take(np.delete(order, alone))
            del key, order, alone
            if len(every):
                yield from groups({c: np.ascontiguousarray(every[c]) for c in _ENTRY.names})

    return run


_PAIR = "doc_id long, line int, doc_id2 long, line2 int, apart int, more boolean"
# A line's set, and whether it is a copy for sure.
_SET = np.dtype([("k1", "i8"), ("k2", "i8"), ("doc_id", "i8"), ("line", "i4"), ("copy", "?")])
# Bits of a word's key that give way to the line's number of words, or the most that they hold.
_LENGTHS = np.uint64((1 << 12) - 1)
# A word of a line's prefix: the line, its number of words, the word's place among them, parities, whether it is asked for.
_ENTRY = np.dtype([("key", "u8"), ("doc_id", "i8"), ("bits", "u8"), ("bits2", "u8"), ("line", "i4"), ("n", "i4"), ("pos", "i4"), ("probe", "?")])


def _dealt(entries: np.ndarray, drawn: np.ndarray, blocks: int) -> pa.RecordBatch:
    """The entries, packed by the block that the numbers drawn for them deal them to."""
    block = (drawn % np.uint64(blocks)).astype(np.uint32)
    order = np.argsort(block, kind="stable")
    block = block[order]
    edges = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True]) if len(block) else np.zeros(1, int)
    return pa.RecordBatch.from_arrays([pa.array(block[edges[:-1]].astype(np.int32)), _packed(entries.take(order), np.diff(edges))], ["block", "entries"])


def _later(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The entries by set, document and line, where each set begins, and which are not at the set's first place."""
    entries = entries.take(np.lexsort([entries[c] for c in ("line", "doc_id", "k2", "k1")]))
    k1, k2, doc, line = (np.ascontiguousarray(entries[c]) for c in ("k1", "k2", "doc_id", "line"))
    heads = np.ones(len(entries), bool)
    heads[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
    first = np.flatnonzero(heads)
    first = np.repeat(first, np.diff(np.r_[first, len(entries)]))
    return entries, heads, (doc != doc[first]) | (line != line[first])


def _copies(lines: DataFrame, rows: int) -> DataFrame:
    """doc_id, line of every line whose set an earlier line has; some come twice.

    Sets are dealt to tasks by hash. Of a set only the first line of each batch needs to go there, as the others are
    later than that one; so one that very many lines have fills no task.
    """
    parts = max(1, -(-rows // TASK_WORDS))
    blocks = 4 * parts

    def spread(rows):
        for batch in rows:
            out = np.zeros(batch.num_rows, _SET)
            for c in ("k1", "k2", "doc_id", "line"):
                out[c] = batch[c].to_numpy(zero_copy_only=False)
            out, heads, out["copy"] = _later(out)
            out = out.take(np.flatnonzero(heads | out["copy"]))
            # What is a copy for sure may go anywhere.
            drawn = np.where(out["copy"], mix(out["doc_id"]) + out["line"].astype(np.uint64), out["k1"].view(np.uint64))
            yield _dealt(out, mix(drawn, 12), blocks)

    def found(rows):
        every = np.frombuffer(b"".join(_unpacked(batch["entries"], np.uint8)[0] for batch in rows), _SET)
        sure = np.flatnonzero(every["copy"])
        order = np.flatnonzero(~every["copy"])
        order = order[np.argsort(every["k1"][order])]
        k1 = every["k1"][order]
        # Most sets are those of one line.
        same = np.r_[False, k1[1:] == k1[:-1], False][:len(k1) + 1]
        some, _, later = _later(every.take(order[same[1:] | same[:-1]]))
        for copies in (every.take(sure), some.take(np.flatnonzero(later))):
            if len(copies):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(copies[c])) for c in ("doc_id", "line")], ["doc_id", "line"])

    packed = lines.select("k1", "k2", "doc_id", "line").mapInArrow(giving_back(spread), "block int, entries binary")
    return packed.repartition(parts, "block").mapInArrow(giving_back(found), "doc_id long, line int")


def _pairs(lines: DataFrame, rows: int, threshold: float, reports: int | None, words: np.ndarray | None = None) -> DataFrame:
    """Lines with earlier ones that they may match, from lines with `probe`; only by the given words, if there are any.

    The words of all prefixes are dealt to tasks by hash, packed by the task that they go to.
    """
    parts = max(1, -(-rows // TASK_WORDS))
    blocks = 4 * parts

    def spread(rows):
        for batch in rows:
            numbers, prefix, n = _lines_held(batch["held"])
            size = numbers[0].astype(np.int64)
            owner = np.repeat(np.arange(len(n)), n)
            out = np.empty(len(owner), _ENTRY)
            # With cells in a prefix its places are unknown, and 0 keeps the filter by position from dropping anything.
            plain = n == prefix_length(size, threshold)
            out["pos"] = np.where(plain[owner], np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n), 0)
            for c, values in zip(("n", "bits", "bits2"), (size, *numbers[1:])):
                out[c] = values.take(owner)
            for c in ("doc_id", "line", "probe"):
                out[c] = batch[c].to_numpy(zero_copy_only=False).take(owner)
            out["key"] = _key(prefix, size.take(owner))
            if words is not None:
                out = out.take(np.flatnonzero(np.isin(prefix, words)))
            yield _dealt(out, mix(out["key"] & ~_LENGTHS, 11), blocks)

    packed = lines.select("doc_id", "line", "held", "probe").mapInArrow(giving_back(spread), "block int, entries binary")
    found = packed.repartition(parts, "block").mapInArrow(giving_back(_candidates(threshold, reports)), _PAIR)
    return cut_lineage(found.groupBy("doc_id", "line", "doc_id2", "line2").agg(F.min("apart").alias("apart"), F.max("more").alias("more")))


def _verified(docs: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """doc_id, line of the pairs whose Jaccard similarity, over all words of both lines, reaches the threshold.

    Of each line the likeliest pair is tried first, the others only if it fails.
    """
    ends = pairs.select("doc_id", "line").unionByName(pairs.select(F.col("doc_id2").alias("doc_id"), F.col("line2").alias("line")))
    wanted = cut_lineage(ends.groupBy("doc_id").agg(F.collect_set("line").alias("lines")))
    one = np.ones(1, np.float32)  # the order of words does not matter here

    def run(rows):
        for batch in batches(rows, BATCH_BYTES):
            lines, owner, number = _lines(batch["text"])
            asked = batch["lines"].combine_chunks() if isinstance(batch["lines"], pa.ChunkedArray) else batch["lines"]
            base = int(number.max(initial=0)) + 1
            sought = np.repeat(np.arange(len(asked)), pc.list_value_length(asked).to_numpy(zero_copy_only=False)) * base
            sought = sought + np.minimum(asked.flatten().to_numpy(zero_copy_only=False), base - 1)
            keep = np.flatnonzero(np.isin(owner * base + number, sought))
            words, first = _sets(lines.take(pa.array(keep)), one)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].take(pa.array(owner[keep])), pa.array(number[keep].astype(np.int32)),
                 pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(words.view(np.int64)))], ["doc_id", "line", "words"],
            )

    texts = _texts(docs).join(measured(wanted, F.size("lines") * 4 + 24), "doc_id")
    # Rows that share an id may give a line twice; then either may match.
    words = cut_lineage(texts.mapInArrow(giving_back(run), "doc_id long, line int, words array<long>"))
    best = pairs.groupBy("doc_id", "line").agg(F.min(F.struct("apart", "doc_id2", "line2")).alias("best"))
    matched = cut_lineage(_similar(best.select("doc_id", "line", "best.doc_id2", "best.line2"), words, threshold))
    rest = pairs.select("doc_id", "line", "doc_id2", "line2").join(measured(matched, 16), ["doc_id", "line"], "left_anti")
    return matched.unionByName(_similar(rest, words, threshold))


def _words(rows):
    """The different words of each batch's prefixes."""
    for batch in rows:
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(_lines_held(batch["held"])[1]).view(np.int64))], ["word"])


def _similar(pairs: DataFrame, words: DataFrame, threshold: float) -> DataFrame:
    other = words.select(F.col("doc_id").alias("doc_id2"), F.col("line").alias("line2"), F.col("words").alias("words2"))
    both = pairs.join(words, ["doc_id", "line"]).join(other, ["doc_id2", "line2"])
    common = F.size(F.array_intersect("words", "words2"))
    return both.where(common * (1 + threshold) >= threshold * (F.size("words") + F.size("words2")) - 1e-9).select("doc_id", "line").distinct()


def repeated_lines(docs: DataFrame, threshold: float = THRESHOLD, least: int = EVERY_LINE, cell_lines: int = CELL_LINES) -> DataFrame:
    """doc_id, line of every line that an earlier one matches; earlier by doc_id, then by number of the line.

    Lines of equal sets are brought together before anything is joined. Of the others each first reports some earlier
    lines that pass all filters; these are verified word by word. Lines whose reports fail, if they had more, report
    all of them in a second pass, so that no match is lost.
    """
    counts = word_counts(docs)
    lines = cut_lineage(line_sets(docs, counts, threshold, least, cell_lines))
    total = lines.agg(F.count("*").alias("lines"), F.sum(F.octet_length("held")).alias("bytes")).first()
    copies = cut_lineage(_copies(lines, total["lines"]))

    # One line for each set goes on.
    reps = lines.join(measured(copies, 16), ["doc_id", "line"], "left_anti")
    rows = (total["bytes"] or 0) // 8 - 3 * total["lines"]
    pairs = _pairs(reps.withColumn("probe", F.lit(True)), rows, threshold, REPORTS)
    matched = cut_lineage(_verified(docs, pairs, threshold))
    open_ = cut_lineage(pairs.where("more").select("doc_id", "line").distinct().join(matched, ["doc_id", "line"], "left_anti"))
    if not open_.isEmpty():
        asked = measured(open_.withColumn("probe", F.lit(True)), 16)
        marked = reps.join(asked, ["doc_id", "line"], "left").withColumn("probe", F.coalesce("probe", F.lit(False)))
        sought = reps.join(asked, ["doc_id", "line"]).select("held").mapInArrow(_words, "word long").distinct()
        # Other words' lines are left out, if a list of the words is small enough to go to all tasks.
        words = [r["word"] for r in sought.limit(MOST_WORDS + 1).collect()]
        few = np.array(words, np.int64).view(np.uint64) if len(words) <= MOST_WORDS else None
        again = _pairs(marked, rows, threshold, None, few)
        matched = matched.unionByName(_verified(docs, again, threshold))
    return copies.unionByName(matched).distinct()


def without_lines(docs: DataFrame, repeated: DataFrame) -> tuple[DataFrame, str, str]:
    """The rows of `docs` with the repeated lines taken out of the text, and the names of two more columns, which no
    other has: the numbers of lines and of lines taken."""
    doc, gone, n_lines, n_taken = fresh_names(docs, "_doc", "_lines", "_n_lines", "_n_taken")
    taken = cut_lineage(repeated.groupBy(F.col("doc_id").alias(doc)).agg(F.collect_set("line").alias(gone)))
    lines = F.split(whole_text(), "\n")
    joined = docs.join(measured(taken, F.size(gone) * 4 + 24), docs["doc_id"].cast("long") == F.col(doc), "left")
    # Numbers beyond the text's lines can only come from another row of the same id.
    left = let(lines, lambda held: F.array_join(
        F.transform(F.array_except(F.sequence(F.lit(0), F.size(held) - 1), F.col(gone)), lambda k: held[k]), "\n"
    ))
    return joined.select(
        *[F.col(f"`{c}`") for c in docs.columns if c != "text"],
        F.when(F.col(gone).isNull(), whole_text()).otherwise(left).alias("text"),
        # Counted without splitting, which only texts that lose lines need.
        (F.octet_length(whole_text()) - F.octet_length(F.replace(whole_text(), F.lit("\n"), F.lit(""))) + 1).alias(n_lines),
        F.coalesce(F.size(gone), F.lit(0)).alias(n_taken),
    ), n_lines, n_taken


def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD, least: int = EVERY_LINE, cell_lines: int = CELL_LINES) -> DataFrame:
    """doc_id, text, n_lines, n_removed of every row: the text without the lines that an earlier line matches.

    Two lines match if the Jaccard similarity of their sets of lower-case words is at least the threshold; lines with
    fewer than `least` different words are left alone. A line goes if any earlier line of the corpus matches it,
    whether that one stays or not. A null text counts as empty. Rows without an id keep all their lines and count as
    earlier than none; rows that share an id are one document, whose lines go by their number. Other columns are not
    read; an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    left, n_lines, n_taken = without_lines(docs, repeated_lines(docs, threshold, least, cell_lines))
    return left.select("doc_id", "text", F.col(n_lines).alias("n_lines"), F.col(n_taken).alias("n_removed"))


def drop_repeated_lines(docs: DataFrame, threshold: float = THRESHOLD, least: int = EVERY_LINE) -> DataFrame:
    """The rows of `docs` without repeated lines, in the same columns, n_chars put right; a text of which nothing but
    white space is left because of that goes altogether."""
    left, _, n_taken = without_lines(docs, repeated_lines(docs, threshold, least))
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        left = left.withColumn("n_chars", F.when(F.col(n_taken) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return left.where((F.col(n_taken) == 0) | F.col("text").rlike(r"\S")).select(docs.columns)
