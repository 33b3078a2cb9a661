"""Which candidates are new: first by address, and for activities by title too."""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from moodspark import vocab
from moodspark.functions.text import title_key
from moodspark.plans.session import cut_lineage
from moodspark.plans.skew import BROADCAST_BYTES, HOT_FLOOR, hot_keys, keep_first, only_wanted, salted_join

# Sources whose titles are compared as well.
TITLE_CHECKED = {"ACTIVITY"}

_NARROW = ["ord", "emotion", "content_url", "stored_key", "probe_key"]
_SAVED = ["ord", "emotion", "content_url", "stored_key"]
_URL, _TITLE = ("content_url",), ("emotion", "probe_key")

# Joins rows with a table of one row per key, whatever share of the rows one key has.
Join = Callable[[DataFrame, DataFrame, tuple[str, ...], str], DataFrame]


def new_by_url(candidates: DataFrame, catalogue: DataFrame) -> DataFrame:
    """First candidate of every address that the catalogue does not have, over all moods and categories."""
    first = keep_first(candidates, ["content_url"], [F.col("ord")])
    known = catalogue.select("content_url").where(F.col("content_url").isNotNull()).distinct()
    return first.join(known, "content_url", "left_anti")


def _joiner(rows: DataFrame, size: int, floor: int) -> Join:
    """A join for these rows and what remains of them later: their hot keys are looked up once."""
    hot = {} if size <= floor else {k: hot_keys(rows, list(k), floor) for k in (_URL, _TITLE)}

    def join(left: DataFrame, table: DataFrame, keys: tuple[str, ...], how: str) -> DataFrame:
        return salted_join(left, table, list(keys), how, ["ord"], hot.get(keys))

    return join


def _without_known(rows: DataFrame, catalogue: DataFrame, join: Join) -> DataFrame:
    urls = catalogue.select("content_url").where(F.col("content_url").isNotNull()).distinct()
    titles = catalogue.select("emotion", title_key("title").alias("probe_key")).distinct()
    return join(join(rows, urls, _URL, "left_anti"), titles, _TITLE, "left_anti")


def _first_two(rows: DataFrame, keys: list[str], place: str, first: str) -> DataFrame:
    """The first two undecided rows of each key, with their place and the first one's order.

    Every task keeps two rows per key before the shuffle.
    """
    by_key = W.partitionBy(*keys).orderBy("ord")
    so_far = by_key.rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = rows.withColumn(place, F.row_number().over(by_key)).withColumn(first, F.first("ord").over(so_far))
    return ranked.where(F.col(place) <= 2)


def _leading(rows: DataFrame, long_titles: int, join: Join) -> DataFrame:
    """Undecided rows that at most one undecided row before them can exclude, with that row as `blocker`.

    Such a row is first or second of its address and of the rows that store the title it looks for. A title
    within the limit is looked for as it is stored, so there the places in the two lists are enough, and the
    lists meet on the order alone. A longer title never finds its own stored form; such rows are taken only where
    nothing can exclude them.
    """
    urls = _first_two(rows, ["content_url"], "_u", "_url_first")
    titles = _first_two(rows.select("ord", "emotion", "stored_key"), ["emotion", "stored_key"], "_t", "_title_first")
    both = urls.where("stored_key = probe_key").join(titles.select("ord", "_t", "_title_first"), "ord")
    blocker = (
        F.when(F.col("_u") == 1, F.when(F.col("_t") == 2, F.col("_title_first")))
        .when((F.col("_t") == 1) | (F.col("_url_first") == F.col("_title_first")), F.col("_url_first"))
    )
    one = (F.col("_u") == 1) | (F.col("_t") == 1) | (F.col("_url_first") == F.col("_title_first"))
    usual = both.where(one).select(*_SAVED, blocker.alias("blocker"))
    if not long_titles:
        return usual
    earlier = titles.where("_t = 1").select("emotion", F.col("stored_key").alias("probe_key"), F.col("ord").alias("_before"))
    long = join(urls.where("_u = 1 AND stored_key <> probe_key"), earlier, _TITLE, "left")
    free = long.where("_before IS NULL OR _before >= ord")
    return usual.unionByName(free.select(*_SAVED, F.lit(None).cast(rows.schema["ord"].dataType).alias("blocker")))


def _follow(rows: DataFrame) -> DataFrame:
    """One doubling: each row that still points at a blocker takes over what its blocker knows.

    `saved` is the decision of a row without a blocker, and of the others says whether they go the way of their
    blocker or the other way. A row whose blocker is not among the rows has to wait, and goes.
    """
    settled, open_ = rows.where("blocker IS NULL"), rows.where("blocker IS NOT NULL")
    known = rows.select(F.col("ord").alias("blocker"), F.col("blocker").alias("_next"), F.col("saved").alias("_saved"))
    moved = open_.join(known, "blocker").select(
        *_SAVED, F.col("_next").alias("blocker"), (F.col("saved") == F.col("_saved")).alias("saved")
    )
    return settled.unionByName(moved)


def _savable(rows: DataFrame, long_titles: int, join: Join) -> DataFrame:
    """Undecided rows that are saved whatever becomes of the rows that stay undecided.

    A row that nothing can exclude is saved. One that a single row can exclude is saved if that one is not,
    so along a chain of such rows the decisions alternate; pointers are doubled until each reaches the end of its
    chain, which takes as many steps as the logarithm of the longest.
    """
    chains = cut_lineage(_leading(rows, long_titles, join).withColumn("saved", F.col("blocker").isNull()))
    pointing = chains.where("blocker IS NOT NULL")
    # Without a pointer at a pointer only rows of their own are saved, and they exclude the rest.
    if not pointing.join(pointing.select(F.col("ord").alias("blocker")), "blocker", "left_semi").isEmpty():
        while not chains.where("blocker IS NOT NULL").isEmpty():
            chains = cut_lineage(_follow(chains))
    return chains.where("blocker IS NULL AND saved").drop("blocker", "saved")


def _not_excluded(rows: DataFrame, saved: DataFrame, join: Join) -> DataFrame:
    """Undecided rows that no saved row excludes by its address, which drops the saved too, or by an earlier title."""
    rest = join(rows, saved.select("content_url"), _URL, "left_anti")
    first = keep_first(saved.select("emotion", "stored_key", "ord"), ["emotion", "stored_key"], [F.col("ord")])
    titles = first.select("emotion", F.col("stored_key").alias("probe_key"), F.col("ord").alias("_before"))
    return join(rest, titles, _TITLE, "left").where("_before IS NULL OR _before > ord").drop("_before")


def new_by_url_and_title(candidates: DataFrame, catalogue: DataFrame, floor: int = HOT_FLOOR) -> DataFrame:
    """What saving the candidates one by one would keep, testing address and title against saved rows.

    Each round saves every undecided candidate that nothing undecided can exclude, decides the chains of those
    that hang on a single other one, and drops what the saved ones exclude, until all are decided. A chain costs the
    logarithm of its length; only candidates with two or more undecided ones before them wait for a further round.
    Rounds work on the few columns that decide and write their result to the shared folder. A
    repeat of mood, address and title never matters and goes first. The candidates are read more than once, so
    cut their lineage before if they are costly.
    """
    join = _joiner(candidates, candidates.count(), floor)
    single = keep_first(candidates.select(*_NARROW), ["emotion", "content_url", "probe_key"], [F.col("ord")])
    fresh = _without_known(single, catalogue, join)
    undecided = cut_lineage(fresh)
    left = F.count("*").alias("rows"), F.count_if(F.col("stored_key") != F.col("probe_key")).alias("long")
    saved = []
    while (todo := undecided.agg(*left).first())["rows"]:
        savable = _savable(undecided, todo["long"], join)
        saved.append(savable.select("ord"))
        undecided = cut_lineage(_not_excluded(undecided, savable, join))
    if not saved:
        return candidates.limit(0)
    return candidates.join(reduce(DataFrame.unionByName, saved), "ord", "left_semi")


def _near(catalogue: DataFrame, candidates: DataFrame, limit: int) -> DataFrame:
    """Catalogue rows that share an address or a title with the candidates; all if these are many."""
    keyed = catalogue.withColumn("probe_key", title_key("title"))
    by_url = only_wanted(keyed, candidates, ["content_url"], limit)
    by_title = only_wanted(keyed, candidates, ["emotion", "probe_key"], limit)
    if by_url is keyed or by_title is keyed:
        return catalogue
    return by_url.unionByName(by_title).drop("probe_key")


def harvest(
    candidates: DataFrame,
    catalogue: DataFrame,
    source_order: list[str] = vocab.FULL_RUN,
    floor: int = HOT_FLOOR,
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """New catalogue rows from the candidates of all sources, saved source after source.

    Sources that the order does not name come last, as one step that compares addresses only.
    The candidates are read several times, so cut their lineage first, as reading pages is costly. Of the
    catalogue a small harvest needs only the rows it can meet. Neighbouring sources that compare addresses
    only are one step, as their order is part of `ord`.
    """
    steps: list[list[str]] = []
    for source in source_order:
        if steps and source not in TITLE_CHECKED and steps[-1][-1] not in TITLE_CHECKED:
            steps[-1].append(source)
        else:
            steps.append([source])
    unnamed = F.col("source").isNull() | ~F.col("source").isin(source_order)
    parts = [(F.col("source").isin(sources), sources[0] in TITLE_CHECKED) for sources in steps]
    if not candidates.where(unnamed).isEmpty():
        parts.append((unnamed, False))
    existing = _near(catalogue.select("emotion", "title", "content_url"), candidates, limit)
    saved = []
    for chosen, titles in parts:
        part = candidates.where(chosen)
        if titles:
            found = new_by_url_and_title(part, existing, floor)
        else:
            found = new_by_url(part, existing)
        if len(saved) < len(parts) - 1:
            found = cut_lineage(found)
        saved.append(found)
        existing = existing.unionByName(found.select("emotion", "title", "content_url"))
    return reduce(DataFrame.unionByName, saved)


def harvest_report(candidates: DataFrame, saved: DataFrame, by: list[str] = ["category", "emotion"]) -> DataFrame:
    """Found, saved and skipped candidates; skipped are those found and not saved."""
    one, none = F.lit(1), F.lit(0)
    rows = candidates.select(*by, one.alias("found"), none.alias("saved")).unionByName(
        saved.select(*by, none.alias("found"), one.alias("saved"))
    )
    return rows.groupBy(*by).agg(F.sum("found").alias("found"), F.sum("saved").alias("saved")).withColumn(
        "skipped", F.col("found") - F.col("saved")
    )
