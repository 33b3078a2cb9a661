"""N-gram Jaccard join by chosen paths: sets are split again and again on sampled tokens that they share."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodspark.llm.common import batches, fresh_names, giving_back, join_unique, measured, mix, shingle_sets, sorted_groups, whole_text
from moodspark.llm.components import components
from moodspark.plans.session import cut_lineage

THRESHOLD = 0.8
WIDTH = 5
# Share of the links at the threshold that the runs must find, and so their number.
RECALL = 0.9999
# A bucket of more sets is split further, this many times at most; what is still larger holds sets much alike.
LEAF = 32
LEVELS = 4
# Bits of a sketch are 16 for each of so many ranges of hashes.
RANGES = 128
# A larger bucket, or class, is dealt to several tasks.
BUCKET_ROWS = 50_000
CELL_ROWS = 1_024
# Hashes of all sets in a part of a class.
CELL_HASHES = 500_000


def runs(recall: float, levels: int) -> int:
    """Runs for the target recall, if a pair at the threshold meets in large buckets only.

    It then needs a path that both sets share through all levels. Of a shared path it shares at least one more path on
    average, and no more where one set contains the other; the chance that none gets through a level follows from the
    chance for the levels below. Sets that share such a path share it in one bucket, however many they are.
    """
    missed = 0.0
    for _ in range(levels):
        missed = math.exp(missed - 1)
    return math.ceil(math.log(1 - recall) / math.log(missed))


def _choose(values: np.ndarray, start: np.ndarray, parent: np.ndarray, level: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Owners and new paths: every set takes each of its tokens with chance 1 / (threshold x size), by a hash.

    `parent` is the path so far, one for each set. Sets that share a token and a path make the same choice of it,
    but for their sizes.
    """
    n = np.diff(start)
    owner = np.repeat(np.arange(len(n)), n)
    bound = np.minimum(1.0, 1 / (threshold * np.maximum(n, 1)))
    drawn = mix(values ^ parent[owner], 2 * level + 1)
    taken = (drawn >> np.uint64(11)).astype(np.float64) * 2.0**-53 < bound[owner]
    return owner[taken], mix(drawn[taken] + parent[owner[taken]], 2 * level + 2)


def _sketches(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each set 16 bits of the smallest hash in each range of hashes, 0 where there is none."""
    n = len(start) - 1
    owner = np.repeat(np.arange(n), np.diff(start))
    spread = mix(values, 99)
    at = owner * RANGES + (spread % np.uint64(RANGES)).astype(np.int64)
    low = np.full(n * RANGES, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(low, at, spread // np.uint64(RANGES))
    bits = (low % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
    bits[low == np.iinfo(np.uint64).max] = 0
    return bits.reshape(n, RANGES)


def _alike(a: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of one sketch to each of many."""
    filled = (many != 0) | (a != 0)
    return ((many == a) & filled).sum(1) / np.maximum(filled.sum(1), 1)


def _keys(values: np.ndarray, start: np.ndarray) -> list[bytes]:
    """128 bits for each set, the same for equal sets only."""
    out = []
    with np.errstate(over="ignore"):
        sums = [np.r_[np.uint64(0), np.cumsum(mix(values, s), dtype=np.uint64)] for s in (5, 6)]
        for k in range(len(start) - 1):
            out.append(b"".join(int(s[start[k + 1]] - s[start[k]]).to_bytes(8, "big") for s in sums))
    return out


def document_sets(docs: DataFrame, threshold: float, repeats: int, width: int = WIDTH) -> DataFrame:
    """doc_id, key, n, sketch, paths of every row with an id: its set of shingles and the first paths of all runs."""
    kind = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("n", pa.int32()), ("sketch", pa.binary()), ("paths", pa.list_(pa.int64()))])

    def run(rows):
        for batch in batches(rows, 2 << 20):
            values, start = shingle_sets(batch["text"], width)
            rows_here = batch.num_rows
            owners, paths = [], []
            for r in range(repeats):
                o, p = _choose(values, start, np.full(rows_here, mix(np.array([r]), 77)[0]), 0, threshold)
                owners.append(o)
                paths.append(p)
            owner, path = np.concatenate(owners), np.concatenate(paths)
            order = np.argsort(owner, kind="stable")
            offsets = np.searchsorted(owner[order], np.arange(rows_here + 1)).astype(np.int32)
            sketch = _sketches(values, start)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(_keys(values, start), pa.binary()), pa.array(np.diff(start).astype(np.int32)),
                 pa.array([s.tobytes() for s in sketch], pa.binary()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(path[order].view(np.int64)))], schema=kind,
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).where("doc_id IS NOT NULL")
    return texts.mapInArrow(giving_back(run), "doc_id long, key binary, n int, sketch binary, paths array<long>")


def _deeper(docs: DataFrame, frontier: DataFrame, level: int, threshold: float, width: int) -> DataFrame:
    """key, path of the next level for the sets of `frontier`, which has doc_id, key, path."""
    wanted = frontier.groupBy("doc_id").agg(F.first("key").alias("key"), F.collect_list("path").alias("paths"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    wanted = cut_lineage(wanted)

    def run(rows):
        for batch in batches(rows, 2 << 20):
            values, start = shingle_sets(batch["text"], width)
            keys = batch["key"].to_pylist()
            right = [a == b for a, b in zip(_keys(values, start), keys)]
            paths = batch["paths"].to_pylist()
            # A set for each of its paths, one after the other.
            which = np.repeat(np.arange(len(keys)), [len(p) if ok else 0 for p, ok in zip(paths, right)])
            parent = np.array([p for ps, ok in zip(paths, right) if ok for p in ps], np.int64).view(np.uint64)
            step = max(1, 500_000 // max(1, int(np.diff(start).max(initial=1))))
            for a in range(0, len(which), step):
                w = which[a:a + step]
                n = np.diff(start)[w]
                first = np.r_[0, np.cumsum(n)]
                index = np.arange(first[-1]) - np.repeat(first[:-1], n) + np.repeat(start[w], n)
                owner, path = _choose(values[index], first, parent[a:a + step], level, threshold)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([keys[k] for k in w[owner]], pa.binary()), pa.array(path.view(np.int64))], ["key", "path"]
                )

    joined = texts.join(measured(wanted, F.size("paths") * 8 + 40), "doc_id")
    return joined.mapInArrow(giving_back(run), "key binary, path long")


def buckets(docs: DataFrame, reps: DataFrame, threshold: float, width: int, leaf: int = LEAF, levels: int = LEVELS) -> DataFrame:
    """path, key, size of all buckets of two sets and more, once they are small or as deep as they go.

    Buckets are counted before anything is joined to them. Only the sets of large ones go on to the next level.
    """
    names = reps.select("key", "doc_id")
    rows = reps.select("key", F.explode("paths").alias("path")).distinct()
    done = []
    for level in range(1, levels + 1):
        rows = cut_lineage(rows)
        sizes = rows.groupBy("path").agg(F.count("*").alias("size")).where("size > 1")
        last = level == levels
        sized = cut_lineage(rows.join(sizes, "path"))
        done.append(sized if last else sized.where(F.col("size") <= leaf))
        frontier = sized.where(F.col("size") > leaf)
        if last or frontier.isEmpty():
            break
        rows = _deeper(docs, frontier.join(names, "key").select("doc_id", "key", "path"), level, threshold, width).distinct()
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _linked(rows, join_at: float, connect_at: float, leaders_too: bool):
    """Edges that connect each set of a bucket with the leaders that it may be in one class with, one or two a set.

    A set without a leader as alike as `join_at` becomes one. By the triangle inequality of the Jaccard distance, two
    sets at the threshold have leaders in common, or connected, at `connect_at`.
    """
    kind = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("path", pa.int64()), ("leader", pa.binary()), ("sketch", pa.binary())])
    for group in sorted_groups(rows, "bucket"):
        keys, sketches = group["key"].to_pylist(), group["sketch"].to_pylist()
        path = group["path"][0].as_py()
        leaders, matrix, above = [], np.zeros((0, RANGES), np.uint16), []
        out = []

        def top(k):
            while above[k] != k:
                above[k] = above[above[k]]
                k = above[k]
            return k

        for key, sketch in zip(keys, sketches):
            own = np.frombuffer(sketch, np.uint16)
            likeness = _alike(own, matrix) if leaders else np.zeros(0)
            near = np.flatnonzero(likeness >= connect_at).tolist()
            if not (likeness >= join_at).any():
                near.append(len(leaders))
                above.append(len(leaders))
                leaders.append(key)
                matrix = np.vstack([matrix, own])
                if leaders_too:
                    out.append((None, None, path, key, sketch))
            # The leaders that a set is near to come together; the set itself needs one edge.
            for k in near[1:]:
                above[top(k)] = top(near[0])
            if key != leaders[near[0]]:
                out.append((key, leaders[near[0]], path, None, None))
        out += [(key, leaders[top(k)], path, None, None) for k, key in enumerate(leaders) if top(k) != k]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kind)], schema=kind)


def candidate_classes(reps: DataFrame, paths: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """key, root: sets that may be linked, directly or through others, as their sketches say."""
    shape = "a binary, b binary, path long, leader binary, sketch binary"
    rows = paths.join(reps.select("key", "sketch"), "key").withColumn(
        "bucket", F.xxhash64("path", F.pmod(F.xxhash64("key"), F.ceil(F.col("size") / bucket_rows)))
    )

    def within(rows):
        yield from _linked(rows, 0.7, 0.4, True)

    def between(rows):
        yield from _linked(rows, 1.1, 0.15, False)

    found = cut_lineage(rows.select("bucket", "path", "key", "sketch").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(giving_back(within), shape))
    edges = found.where("a IS NOT NULL").select("a", "b")
    large = paths.where(F.col("size") > bucket_rows).select("path").distinct()
    if not large.isEmpty():
        # A bucket that was dealt to several tasks: their leaders meet.
        leaders = found.where("leader IS NOT NULL").join(large, "path", "left_semi").select(
            F.col("path").alias("bucket"), "path", F.col("leader").alias("key"), "sketch"
        )
        more = leaders.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(giving_back(between), shape)
        edges = edges.unionByName(more.select("a", "b"))
    return components(edges)


def _pairs(sets: list[np.ndarray], sizes: np.ndarray, rows: slice, threshold: float) -> np.ndarray:
    """Which of all sets are linked to those in `rows`; tokens that are in one set only don't matter."""
    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    _, code, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = count[code] > 1
    _, code = np.unique(code[shared], return_inverse=True)
    owner = owner[shared]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    common = np.zeros((rows.stop - rows.start, len(sets)), np.float32)
    width = 8192
    for low in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        a, b = np.searchsorted(code, [low, low + width])
        block = np.zeros((len(sets), width), np.float32)
        block[owner[a:b], code[a:b] - low] = 1
        common += block[rows] @ block.T
    total = sizes[rows, None] + sizes[None, :] - common
    return common >= threshold * total - 1e-6


def links(docs: DataFrame, members: DataFrame, threshold: float, width: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    """key, n_links, linked: how many sets of its candidate class each is linked to, and some that connect them.

    Every set of a class meets every other one, exactly; `members` has doc_id, key, n, root. A class of more than
    `cell_rows` sets, or CELL_HASHES hashes, is cut into parts, each pair of which is a cell of its own; pairs are
    counted, not listed.
    """
    parts = F.greatest(F.ceil(F.count("*") / F.lit(cell_rows)), F.ceil(F.sum("n") / F.lit(CELL_HASHES)))
    sized = members.drop("n").join(members.groupBy("root").agg(parts.alias("parts")), "root")
    wanted = cut_lineage(sized)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))

    def sets(rows):
        for batch in batches(rows, 2 << 20):
            values, start = shingle_sets(batch["text"], width)
            keys = _keys(values, start)
            right = np.array([a == b for a, b in zip(keys, batch["key"].to_pylist())], bool)
            blobs = pa.array([values[start[k]:start[k + 1]].tobytes() if right[k] else b"" for k in range(len(keys))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["key"], batch["root"], batch["parts"], blobs], ["key", "root", "parts", "hashes"]).filter(pa.array(right))

    found = texts.join(measured(wanted, 80), "doc_id").mapInArrow(giving_back(sets), "key binary, root binary, parts long, hashes binary")
    # A document whose id is repeated may give a set twice, which a cell brings together.
    own = F.pmod(F.xxhash64("key"), F.col("parts"))
    dealt = found.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    cells = dealt.select(
        F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "root", "key", "own",
        F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "hashes",
    )
    kind = pa.schema([("key", pa.binary()), ("n_links", pa.int64()), ("linked", pa.binary())])

    def count(rows):
        for group in sorted_groups(rows, "cell"):
            seen: dict[bytes, int] = {}
            for k, key in enumerate(group["key"].to_pylist()):
                seen.setdefault(key, k)
            take = sorted(seen.values())
            group = group.take(pa.array(take))
            keys, own = group["key"].to_pylist(), group["own"].to_numpy()
            low, high = group["low"][0].as_py(), group["high"][0].as_py()
            hashes = [np.frombuffer(h.as_py(), np.uint64) for h in group["hashes"]]
            sizes = np.array([len(h) for h in hashes])
            linked = np.zeros((len(keys), len(keys)), bool)
            for a in range(0, len(keys), 512):
                rows_here = slice(a, min(a + 512, len(keys)))
                linked[rows_here] = _pairs(hashes, sizes, rows_here, threshold)
            np.fill_diagonal(linked, False)
            if low != high:  # pairs within a part are counted in the part's own cell
                linked &= own[:, None] != own[None, :]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array(linked.sum(1).astype(np.int64)), pa.array(_spanning(linked, keys), pa.binary())], schema=kind
            )

    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(giving_back(count), "key binary, n_links long, linked binary")


def _spanning(linked: np.ndarray, keys: list[bytes]) -> list[bytes]:
    """For each set the smallest key that its links lead to within the cell."""
    root = np.full(len(keys), -1)
    for first in sorted(range(len(keys)), key=keys.__getitem__):
        if root[first] >= 0:
            continue
        front = np.zeros(len(keys), bool)
        front[first] = True
        root[first] = first
        while front.any():
            front = linked[front].any(0) & (root < 0)
            root[front] = first
    return [keys[r] for r in root]


def near_duplicates(
    docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, width: int = WIDTH, leaf: int = LEAF,
    levels: int = LEVELS, bucket_rows: int = BUCKET_ROWS, cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """doc_id, class_id, copies, n_links of every row with an id.

    Two texts are linked if the Jaccard similarity of their sets of `width`-word shingles, in lower case, is at least
    the threshold; a text of fewer words has one shingle of them all. `copies` counts the rows of a text's set,
    itself included; `n_links` the other sets that it is linked to; `class_id` is the smallest doc_id that links
    lead to. Chosen paths find the candidates, with the stated recall for a pair at the threshold in each class of its
    own and more for pairs with common neighbours; all pairs of a candidate class are then compared exactly.

    Texts without words are linked to nothing and are each a class of their own. Rows without an id can't be named
    and are left out. Repeated rows give a row each. Other columns are not read; an empty table gives an empty result.
    """
    every = cut_lineage(document_sets(docs, threshold, runs(recall, levels), width))
    rows = every.where("n > 0")
    first = rows.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    reps = cut_lineage(rows.join(first, ["key", "doc_id"]).dropDuplicates(["key"]))
    paths = cut_lineage(buckets(docs, reps, threshold, width, leaf, levels))
    members = cut_lineage(candidate_classes(reps, paths, bucket_rows).join(reps.select("key", "doc_id", "n"), "key"))
    found = cut_lineage(links(docs, members, threshold, width, cell_rows))
    roots = components(found.select(F.col("key").alias("a"), F.col("linked").alias("b")))
    counts = found.groupBy("key").agg(F.sum("n_links").alias("n_links"))
    named = roots.join(first.select("key", "doc_id"), "key")
    classes = named.join(named.groupBy("root").agg(F.min("doc_id").alias("class_id")), "root").join(counts, "key").select("key", "class_id", "n_links")
    by_key = first.join(classes, "key", "left").select(
        "key", F.coalesce("class_id", "doc_id").alias("class_id"), "copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.col("copies").alias("_rows"),
    )
    worded = join_unique(rows.select("doc_id", "key"), by_key, "key", "_rows", "doc_id").drop("key")
    bare = every.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("copies"), F.lit(0).cast("long").alias("n_links"))
    return worded.select(bare.columns).unionByName(bare)


def keep_one_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class of `docs`, with all its columns: the one of the smallest id.

    A row is told by its id and its text, so of two texts under one id each is judged by itself, and of rows that
    share both one stays (the least by its other columns). Texts without words are a class of their own each. Rows
    without an id stay. Null texts count as empty; an empty table gives an empty result.
    """
    own, best = fresh_names(docs, "own", "best")
    hashed = F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.col("doc_id").cast("long"), whole_text()))
    ids = cut_lineage(docs.select(hashed.alias("own"), F.col("doc_id").cast("long").alias("id")).where("own IS NOT NULL").groupBy("own").agg(
        F.min("id").alias("id"), F.count("*").alias("rows")
    ))
    found = near_duplicates(docs.select(hashed.alias("doc_id"), whole_text().alias("text")), threshold)
    classes = cut_lineage(found.select(F.col("doc_id").alias("own"), "class_id").distinct().join(ids, "own"))
    first = classes.groupBy("class_id").agg(F.min(F.struct("id", "own")).alias("first"), F.count("*").alias("members"))
    extra = cut_lineage(
        classes.join(measured(first.where("members > 1"), 32), "class_id").where("own <> first.own").select(F.col("own").alias(own))
    )
    kept = docs.withColumn(own, hashed).join(measured(extra, 16), own, "left_anti")
    repeated = cut_lineage(ids.where("rows > 1").select(F.col("own").alias(own)))
    if repeated.isEmpty():
        return kept.select(docs.columns)
    repeated = measured(repeated, 16)
    single = kept.join(repeated, own, "left_semi").groupBy(own).agg(F.min(F.struct(*docs.columns)).alias(best)).select(f"{best}.*")
    return kept.join(repeated, own, "left_anti").select(docs.columns).unionByName(single.select(docs.columns))
