"""Chat formatting: logged snapshots of a conversation collapse into the longest one, which is rendered."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from moodspark.llm.common import HOT_ROWS, join_unique

# Turn numbers that are put in order and rendered together: a part of a conversation.
PART_TURNS = 512


def _turns(conversations: DataFrame, part_turns: int) -> DataFrame:
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return conversations.where(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", F.floor(F.coalesce("turn", F.lit(0)) / part_turns).cast("long").alias("part"),
        role.alias("role"), text.alias("text"),
        F.xxhash64(F.lit(1), role, text).alias("h1"), F.xxhash64(F.lit(2), role, text).alias("h2"),
    )


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, n, pos, p1, p2: the hashes of the first `pos` of a conversation's `n` turns.

    A prefix's hash is the exclusive or of hashes that each hold a turn and its place, 128 bits in two columns. So
    it rolls on from turn to turn, and from part to part of a very long conversation, which need not be in one task.
    """
    small = turns.groupBy("conv_id", "part", "turn", "role", "h1", "h2").agg(F.lit(1).alias("one"))
    order = [F.asc_nulls_first("turn"), "role", "h1", "h2"]
    inside = W.partitionBy("conv_id", "part").orderBy(*order)
    before = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("conv_id")
    sizes = small.groupBy("conv_id", "part").agg(F.count("*").alias("size")).select(
        "conv_id", "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"), F.sum("size").over(whole).alias("n")
    )
    placed = small.withColumn("rank", F.row_number().over(inside)).join(sizes, ["conv_id", "part"])
    pos = F.col("offset") + F.col("rank")
    marked = placed.select(
        "conv_id", "part", "n", pos.alias("pos"), F.xxhash64(F.lit(1), pos, "h1").alias("g1"), F.xxhash64(F.lit(2), pos, "h2").alias("g2")
    )
    carried = marked.groupBy("conv_id", "part").agg(F.bit_xor("g1").alias("x1"), F.bit_xor("g2").alias("x2")).select(
        "conv_id", "part", *[F.coalesce(F.bit_xor(x).over(before), F.lit(0)).alias(x) for x in ("x1", "x2")]
    )
    rolling = W.partitionBy("conv_id", "part").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    return marked.join(carried, ["conv_id", "part"]).select(
        "conv_id", "n", "pos", F.bit_xor("g1").over(rolling).bitwiseXOR(F.col("x1")).alias("p1"),
        F.bit_xor("g2").over(rolling).bitwiseXOR(F.col("x2")).alias("p2"),
    )


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, n, copies of the conversations that are no prefix of a longer one; of equal ones the smallest id.

    Equal conversations and equal prefixes are brought together before the join, so a very common conversation or
    first turn is one row on either side of it.
    """
    prefixes = prefix_hashes(turns)
    ends = prefixes.where("pos = n").groupBy("n", "p1", "p2").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("copies")
    )
    within = prefixes.where("pos < n").groupBy(F.col("pos").alias("n"), "p1", "p2").agg(F.lit(1).alias("one")).drop("one")
    return ends.join(within, ["n", "p1", "p2"], "left_anti").select("conv_id", "n", "copies")


def format_chats(conversations: DataFrame, part_turns: int = PART_TURNS, floor: int = HOT_ROWS) -> DataFrame:
    """conv_id, part, n_turns, copies, text: the maximal conversations, rendered.

    A conversation has one row for each `part_turns` turn numbers, most of them one row in all; its text is the rows
    in order of `part`. Turns are in order of their number, those without one first, then role and text; an exact
    repeat of a turn counts once; a null role or text is empty. Rows without conv_id belong to no conversation and are
    left out. Other columns are not read; an empty table gives an empty result.
    """
    turns = _turns(conversations, part_turns)
    kept = maximal_conversations(turns).withColumnRenamed("n", "n_turns").withColumn("_rows", F.col("n_turns"))
    rows = join_unique(turns, kept, "conv_id", "_rows", "turn", "inner", floor)
    turn = F.struct("turn", "role", "h1", "h2", "text")
    return rows.groupBy("conv_id", "part").agg(
        F.first("n_turns").alias("n_turns"), F.first("copies").alias("copies"), F.sort_array(F.collect_set(turn)).alias("turns")
    ).select(
        "conv_id", "part", "n_turns", "copies",
        F.array_join(F.transform("turns", lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("\n"))), "").alias("text"),
    )


FORMAT_SQL = r"""
WITH t AS (
    SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL
), c AS (
    SELECT conv_id, count(*) AS n, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role, text) AS m
    FROM t GROUP BY conv_id
), u AS (
    SELECT m, min(conv_id) AS conv_id, any_value(n) AS n, count(*) AS copies FROM c GROUP BY m
), p AS (
    SELECT DISTINCT m[1:i] AS m FROM (SELECT m, unnest(range(1, n)) AS i FROM u)
), k AS (
    SELECT u.* FROM u ANTI JOIN p ON u.m = p.m
)
SELECT k.conv_id, CAST(floor(coalesce(turn, 0) / 512) AS BIGINT) AS part, CAST(any_value(n) AS BIGINT) AS n_turns,
       CAST(any_value(copies) AS BIGINT) AS copies,
       string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS text
FROM k JOIN t ON t.conv_id = k.conv_id GROUP BY k.conv_id, part
"""
