"""Current diaries from a log of creations, edits and deletions, in one go or part after part."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodspark import vocab
from moodspark.functions import dates
from moodspark.functions.text import is_blank
from moodspark.plans.skew import HOT_FLOOR, hot_keys, salted_join

# Reasons for a rejected event.
BLANK, NO_DATE, NOT_FOUND, REPEATED = "BLANK CONTENT", "NO DATE", "NOT FOUND", "REPEATED CREATE"


def _openings(log: DataFrame, respect_given_date: bool) -> DataFrame:
    """First valid creation per diary. It fixes owner, mood, score and comment."""
    today = dates.kst_today("ts")
    creations = log.where((F.col("op") == "CREATE") & ~is_blank("content"))
    first = F.min_by(
        F.struct(
            F.col("seq").alias("create_seq"),
            F.col("member_id").alias("owner"),
            F.col("ts").alias("create_ts"),
            "content", "emoji",
            (F.coalesce("date", today) if respect_given_date else today).alias("date"),
            "emotion", "sentiment_score", "ai_comment",
        ),
        "seq",
    )
    return creations.groupBy("id").agg(first.alias("first")).select("id", "first.*")


def judge_changes(log: DataFrame, floor: int = HOT_FLOOR) -> DataFrame:
    """Every event with the reason it is rejected for, NULL if accepted.

    Creations are found first, then the first deletion by the owner, then each event is judged against
    the two. None of the steps needs a diary's events in one task: the picks are aggregations and the
    joins spread the events of a hot diary.
    """
    hot = hot_keys(log, ["id"], floor)
    created = log.where((F.col("op") == "CREATE") & ~is_blank("content")).groupBy("id").agg(
        F.min("seq").alias("create_seq"), F.min_by("member_id", "seq").alias("owner")
    )
    deletions = log.where(F.col("op") == "DELETE").select("id", "seq", "member_id")
    ended = (
        salted_join(deletions, created, ["id"], "inner", ["seq"], hot)
        .where((F.col("member_id") == F.col("owner")) & (F.col("seq") > F.col("create_seq")))
        .groupBy("id").agg(F.min("seq").alias("delete_seq"))
    )
    life = created.join(ended, "id", "left")
    events = log.select(
        "id", "seq", "member_id", "op", "ts",
        is_blank("content").alias("_blank"), F.col("date").isNull().alias("_no_date"),
    )
    found = (
        F.col("create_seq").isNotNull()
        & (F.col("member_id") == F.col("owner"))
        & (F.col("seq") > F.col("create_seq"))
        & (F.col("delete_seq").isNull() | (F.col("seq") <= F.col("delete_seq")))
    )
    edit, delete = F.col("op") == "UPDATE", F.col("op") == "DELETE"
    reason = (
        F.when((edit | (F.col("op") == "CREATE")) & F.col("_blank"), BLANK)
        .when((F.col("op") == "CREATE") & (F.col("seq") != F.col("create_seq")), REPEATED)
        .when((edit | delete) & ~found, NOT_FOUND)
        .when(edit & F.col("_no_date"), NO_DATE)
    )
    return salted_join(events, life, ["id"], "left", ["seq"], hot).select(
        "id", "seq", "member_id", "op", "ts", reason.alias("reason")
    )


def apply_changes(
    log: DataFrame, respect_given_date: bool = False, floor: int = HOT_FLOOR
) -> tuple[DataFrame, DataFrame]:
    """Current state of every diary and the rejected events.

    An edit replaces content, emoji and date, with nothing where it sends nothing, and leaves the
    sentiment alone. A deleted diary stays with its last content and the status DELETED.
    """
    judged = judge_changes(log, floor)
    accepted = judged.where(F.col("reason").isNull())
    latest = accepted.groupBy("id").agg(
        F.max(F.when(F.col("op") == "UPDATE", F.col("seq"))).alias("edit_seq"),
        F.max_by("ts", "seq").alias("last_ts"),
        F.bool_or(F.col("op") == "DELETE").alias("deleted"),
    )
    texts = log.where(F.col("op") == "UPDATE").select(
        "id", F.col("seq").alias("edit_seq"),
        F.col("content").alias("_content"), F.col("emoji").alias("_emoji"), F.col("date").alias("_date"),
    )
    edited = F.col("edit_seq").isNotNull()
    # The edit is looked up by diary and event: diaries without an edit spread by their id.
    state = (
        _openings(log, respect_given_date).join(latest, "id").join(texts, ["id", "edit_seq"], "left")
    )
    current = state.select(
        "id",
        F.col("owner").alias("member_id"),
        F.when(edited, F.col("_content")).otherwise(F.col("content")).alias("content"),
        F.when(edited, F.col("_emoji")).otherwise(F.col("emoji")).alias("emoji"),
        "emotion", "sentiment_score", "ai_comment",
        F.when(edited, F.col("_date")).otherwise(F.col("date")).alias("date"),
        F.when(F.col("deleted"), vocab.DELETED).otherwise(vocab.ACTIVE).alias("status"),
        dates.kst_now("create_ts").alias("created_at"),
        dates.kst_now("last_ts").alias("updated_at"),
    )
    rejects = judged.where(F.col("reason").isNotNull()).select("seq", "id", "member_id", "op", "reason")
    return current, rejects


def decisive(log: DataFrame, complete: bool = False, floor: int = HOT_FLOOR) -> DataFrame:
    """The events of a part of the log that can still count, whatever parts come before and after it.

    Parts follow one another by `seq`. What decides on a diary is its first creation, the owner's first deletion after it
    and the owner's last edit between the two. Within a part that is: the first creation, and for each member the first
    deletion and the last edit before it, once over the whole part, in case an earlier part has the creation, and once from the
    part's own creation on. So a diary keeps at most four events a member and one more, however long its log is, and
    `decisive(a + b)` decides as `decisive(decisive(a) + decisive(b))` does. A part that nothing precedes
    (`complete`) needs only what follows its own creation, at most three events a diary.
    """
    edit, delete = F.col("op") == "UPDATE", F.col("op") == "DELETE"
    created = log.where((F.col("op") == "CREATE") & ~is_blank("content")).groupBy("id").agg(
        F.min("seq").alias("create_seq"), F.min_by("member_id", "seq").alias("owner")
    )
    later = log.where(delete | (edit & ~is_blank("content") & F.col("date").isNotNull())).select("id", "seq", "member_id", "op")
    placed = salted_join(later, created, ["id"], "inner" if complete else "left", ["seq"], hot_keys(log, ["id"], floor)).select(
        "id", "seq", "member_id", "op",
        F.when((F.col("member_id") == F.col("owner")) & (F.col("seq") > F.col("create_seq")), F.col("create_seq")).alias("_own"),
    )
    if complete:
        placed = placed.where("_own IS NOT NULL")
    ends = placed.groupBy("id", "member_id").agg(
        F.min(F.when(delete, F.col("seq"))).alias("_any_end"),
        F.min(F.when(delete & F.col("_own").isNotNull(), F.col("seq"))).alias("_own_end"),
    )
    edits = salted_join(
        placed.where(edit), ends, ["id", "member_id"], "inner", ["seq"], hot_keys(placed, ["id", "member_id"], floor)
    )
    before = lambda end: F.col(end).isNull() | (F.col("seq") < F.col(end))
    last = edits.groupBy("id", "member_id").agg(
        F.max(F.when(before("_any_end"), F.col("seq"))).alias("_any_edit"),
        F.max(F.when(F.col("_own").isNotNull() & before("_own_end"), F.col("seq"))).alias("_own_edit"),
    )
    kept = created.select("id", F.col("create_seq").alias("seq"))
    for rows, columns in ((ends, ("_any_end", "_own_end")), (last, ("_any_edit", "_own_edit"))):
        kept = kept.unionByName(rows.select("id", F.explode(F.array(*columns)).alias("seq")).where("seq IS NOT NULL"))
    return log.join(kept.distinct(), ["id", "seq"], "left_semi")


def advance(state: DataFrame, part: DataFrame, floor: int = HOT_FLOOR) -> tuple[DataFrame, DataFrame]:
    """The state after a new part of the log, and the part's rejected events; the log before is not read.

    A state is itself a log, of at most three events a diary: what `decisive` leaves of all parts so far. It starts as a
    table without rows. `apply_changes` of a state gives the current diaries. Only the diaries that the part names are
    judged again. Both inputs are read several times, so they should be stored tables.
    """
    named = part.select("id").distinct().withColumn("_named", F.lit(True))
    marked = state.join(named, "id", "left")
    log = marked.where("_named").drop("_named").unionByName(part)
    rejects = judge_changes(log, floor).where(F.col("reason").isNotNull()).select("seq", "id", "member_id", "op", "reason")
    untouched = marked.where("_named IS NULL").drop("_named")
    return untouched.unionByName(decisive(log, True, floor)), rejects
