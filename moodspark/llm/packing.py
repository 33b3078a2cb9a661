"""Best-fit packing: pieces that fill a sequence exactly are combined by hashing sums, the rest by best fit."""

import re
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from moodspark.llm.common import batches, giving_back, whole_text
from moodspark.plans.session import cut_lineage

LIMIT = 1024
END = 2
# Pieces of one length are numbered in so many groups, each by itself.
GROUPS = 1024

# Characters about which all word-splitting engines agree; other texts take the slower way.
_COMMON = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-ɏ]*")


def tokenizer(json_path: str, ranks_path: str | None = None):
    """A function from a list of texts to arrays of ids, those of the tokenizer in `json_path`.

    With `ranks_path`, the same vocabulary as ranks, texts in common characters are encoded from it, which is
    several times as fast. The name of a special token, such as an end of text that was scraped along, gives that
    token's id, as the tokenizer has it.
    """
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(json_path)
    added = [token.content for token in whole.get_added_tokens_decoder().values()]
    special = re.compile("|".join(map(re.escape, added)) or r"(?!)")
    fast = None
    if ranks_path:
        import base64

        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(texts):
        for text in texts:
            # A very long run without a blank takes the ranks' encoder too long.
            if fast and _COMMON.fullmatch(text) and not special.search(text) and not re.search(r"\S{2000}|\s{2000}", text):
                yield np.array(fast.encode_ordinary(text), np.uint32)
            else:
                yield np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def cut(ids: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Start and length of a document's pieces; if it must be cut, what is over goes first, as the shorter one."""
    n = len(ids)
    if n <= limit:
        return [(0, n)]
    first = n % limit
    starts = ([0] if first else []) + list(range(first, n, limit))
    return [(a, min(b, n) - a) for a, b in zip(starts, [*starts[1:], n])]


def pieces(docs: DataFrame, json_path: str, ranks_path: str | None, limit: int = LIMIT) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and a number for the row within its task's input, for every piece."""
    kind = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(rows):
        encode = tokenizer(json_path, ranks_path)
        for batch in batches(rows, 2 << 20):
            out = []
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), encode(batch["text"].to_pylist())):
                ids = np.r_[ids, np.uint32(END)].astype("<u4")
                for k, (a, n) in enumerate(cut(ids, limit)):
                    out.append((doc_id, k, a, n, zlib.crc32(ids[a:a + n].tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kind)], schema=kind)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(
        giving_back(run), "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


Plan = list[tuple[tuple[int, ...], int]]


def plan_packing(counts: dict[int, int], limit: int) -> Plan:
    """Combinations of lengths and how often each is used, from how many pieces there are of every length.

    Only counts of at most `limit` lengths are looked at, so the work does not grow with the corpus. Longest first,
    a length takes a single, pair or triple of others whose sum, looked up by hash, is exactly its gap, as often as
    there are pieces of all of them. What remains is placed by best fit, again many equal pieces at a time.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    plan: Plan = []

    def use(lengths, times):
        plan.append((tuple(lengths), times))
        for n in lengths:
            left[n] -= times
            if not left[n]:
                del left[n]

    if left.get(limit):
        use((limit,), left[limit])

    def times(lengths):
        return min(left.get(n, 0) // lengths.count(n) for n in set(lengths))

    def filling(first):
        """Singles, pairs, triples that fill the gap beside `first` exactly, larger pieces first."""
        gap = limit - first
        if gap in left:
            yield (gap,)
        have = sorted((n for n in left if n < gap), reverse=True)
        for a in have:
            if 2 * a < gap:
                break
            if gap - a in left:
                yield (a, gap - a)
        for a in have:
            if 3 * a < gap:
                break
            rest = gap - a
            for b in have[bisect_left(have, -min(a, rest - 1), key=lambda n: -n):]:
                if 2 * b < rest:
                    break
                if rest - b in left:
                    yield (a, b, rest - b)

    for first in sorted(left, reverse=True):
        # Half of the limit and less, only what larger pieces have left remains; it fills up among itself.
        for others in filling(first) if first in left else ():
            combination = (first, *others)
            n = times(combination)
            if n:
                use(combination, n)
            if first not in left:
                break

    # Best fit, longest first: open sequences are kept by the room they have, as a pattern and a number of them.
    rooms: list[int] = []
    opened: dict[int, list[list]] = {}

    def put(room, pattern, number):
        if room not in opened:
            insort(rooms, room)
            opened[room] = []
        opened[room].append([pattern, number])

    for n in sorted(left, reverse=True):
        many = left[n]
        while many:
            k = bisect_left(rooms, n)
            if k < len(rooms):
                room = rooms[k]
                pattern, number = opened[room].pop()
                if not opened[room]:
                    del opened[room]
                    rooms.pop(k)
                took = min(number, many)
                if number > took:
                    put(room, pattern, number - took)
                put(room - n, (*pattern, n), took)
            else:
                # As many new ones as all pieces of this length fill by themselves.
                each = min(limit // n, many)
                took = many // each
                put(limit - n * each, (n,) * each, took)
                took *= each
            many -= took
    return plan + [(tuple(p), c) for found in opened.values() for p, c in found]


def _slots(spark: SparkSession, plan: Plan) -> DataFrame:
    """For each length, ranges of its pieces' numbers with the sequences and the offset that they go to.

    A row says that pieces `low` to `high` - 1 of a length are the `nth` of `width` equal ones at `offset` onwards
    in the sequences from `sequence` on.
    """
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, number in plan:
        offset = 0
        for n in sorted(set(pattern), reverse=True):
            width = pattern.count(n)
            low = used.get(n, 0)
            rows.append((n, low, low + width * number, width, sequence, offset))
            used[n] = low + width * number
            offset += n * width
        sequence += number
    return spark.createDataFrame(rows, "length long, low long, high long, width long, sequence long, at long")


def pack_documents(
    docs: DataFrame, json_path: str, ranks_path: str | None = None, limit: int = LIMIT, groups: int = GROUPS
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row.

    A null or empty text is the end token alone. Repeated rows, and rows without an id, are packed each. Pieces of
    one length are numbered within groups by hash, after the groups before, so no length is in one task; the plan of
    lengths and ranges of numbers is of bounded size and meets them in a join. Other columns are not read; an empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    cutting = cut_lineage(pieces(docs, json_path, ranks_path, limit))
    cutting = cutting.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    sizes = cutting.groupBy("length", "group").agg(F.count("*").alias("n"))
    # At most limit rows.
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = _slots(spark, plan_packing(counts, limit))
    before = W.partitionBy("length").orderBy("group").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = W.partitionBy("length", "group").orderBy("doc_id", "piece", "start", "ids_crc32")
    numbered = cutting.withColumn("rank", F.row_number().over(inside) - 1).join(offsets, ["length", "group"])
    numbered = numbered.withColumn("number", F.col("rank") + F.col("base")).drop("rank", "base", "group")
    # A length's ranges are kept as one array, so that a piece finds its own without meeting the others as rows.
    by_length = slots.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("low", "high", "width", "sequence", "at"))).alias("ranges"))
    found = numbered.join(F.broadcast(by_length), "length")
    slot = F.filter("ranges", lambda r: (r["low"] <= F.col("number")) & (F.col("number") < r["high"]))[0]
    placed = found.withColumn("slot", F.explode(F.array(slot)))
    rank = F.col("number") - F.col("slot.low")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("slot.sequence") + F.floor(rank / F.col("slot.width"))).cast("long").alias("sequence_id"),
        (F.col("slot.at") + F.pmod(rank, F.col("slot.width")) * F.col("length")).cast("long").alias("offset"),
    )
