"""Conversation structure repair: generalised LR parsing of roles with weighted delete, rerole and insert actions."""

import hashlib
import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moodspark.llm.common import HOT_ROWS, join_unique

# What a conversation's roles must look like: nothing, or an optional system turn and pairs of user and assistant.
ROLE_GRAMMAR = (
    ("Chat", ()), ("Chat", ("Turns",)), ("Chat", ("s", "Turns")),
    ("Turns", ("Pair",)), ("Turns", ("Turns", "Pair")), ("Pair", ("u", "a")),
)
# Roles that an edit may give a turn, by their initial.
MADE_ROLES = {"u": "user", "a": "assistant"}
# First letters of roles that a turn may keep.
LEGAL_INITIALS = frozenset(symbol for _, body in ROLE_GRAMMAR for symbol in body if symbol.islower())
LEGAL_PAIRS = frozenset({"su", "ua", "au"})
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
# Whatever turns may follow one stack of the role grammar, they can follow any other after one insertion and with one
# turn deleted, or after two insertions. So a stack that costs this much more than another is in no cheapest repair.
SLACK = max(INSERT + DELETE, 2 * INSERT)
_END = "$"
FAULTS = ("blank", "duplicate", "truncated")
# A part of the audit that all live stacks share is put aside every so many turns.
_SETTLE = 512


class RoleParser:
    """An LR automaton of a grammar and the stacks that it has met.

    All actions of a state are followed: shifts, and reductions whose head the next terminal may follow. A stack is
    a node, a state on top of another node; nodes are made once, so equal stacks are one node and share what is
    below them. Where a node leads under a terminal is worked out once.
    """

    def __init__(self, grammar=ROLE_GRAMMAR):
        self.rules = [("", (grammar[0][0],)), *grammar]
        self.heads = {head for head, _ in self.rules}
        self.follow = self._follow()
        self.states = [self._closure({(0, 0)})]
        self.moves: list[dict[str, int]] = []
        for state in self.states:
            move = {}
            for symbol in sorted({s for s in map(self._next, state) if s}):
                items = self._closure({(r, dot + 1) for r, dot in state if self._next((r, dot)) == symbol})
                if items not in self.states:
                    self.states.append(items)
                move[symbol] = self.states.index(items)
            self.moves.append(move)
        self.nodes: list[tuple[int, int]] = [(0, -1)]
        self.known = {self.nodes[0]: 0}
        self.paths: dict[tuple[int, str], tuple[int, ...]] = {}
        self.ends: dict[int, bool] = {}

    def _next(self, item):
        r, dot = item
        body = self.rules[r][1]
        return body[dot] if dot < len(body) else None

    def _closure(self, items):
        items, todo = set(items), list(items)
        while todo:
            symbol = self._next(todo.pop())
            new = {(r, 0) for r, (head, _) in enumerate(self.rules) if head == symbol} - items
            items |= new
            todo += new
        return frozenset(items)

    def _follow(self):
        """The terminals that may come after each head."""
        empty, first, follow = set(), {h: set() for h in self.heads}, {h: set() for h in self.heads}
        follow[""].add(_END)
        before = None
        while before != (before := (len(empty), sum(map(len, first.values())), sum(map(len, follow.values())))):
            for head, body in self.rules:
                behind, open_end = set(follow[head]), True
                for symbol in reversed(body):
                    if symbol in self.heads:
                        follow[symbol] |= behind
                        behind = first[symbol] | (behind if symbol in empty else set())
                    else:
                        behind = {symbol}
                for symbol in body:
                    first[head] |= first[symbol] if symbol in self.heads else {symbol}
                    if symbol not in empty:
                        open_end = False
                        break
                if open_end:
                    empty.add(head)
        return follow

    def _push(self, state: int, below: int) -> int:
        node = (state, below)
        if node not in self.known:
            self.known[node] = len(self.nodes)
            self.nodes.append(node)
        return self.known[node]

    def _reduced(self, node: int, terminal: str) -> set[int]:
        """The node and all it can be reduced to before the terminal."""
        found, todo = {node}, [node]
        while todo:
            top = todo.pop()
            for r, dot in self.states[self.nodes[top][0]]:
                head, body = self.rules[r]
                if r and dot == len(body) and terminal in self.follow[head]:
                    below = top
                    for _ in body:
                        below = self.nodes[below][1]
                    new = self._push(self.moves[self.nodes[below][0]][head], below)
                    if new not in found:
                        found.add(new)
                        todo.append(new)
        return found

    def after(self, node: int, terminal: str) -> tuple[int, ...]:
        """The stacks that shifting the terminal gives."""
        if (node, terminal) not in self.paths:
            tops = ((top, self.moves[self.nodes[top][0]].get(terminal)) for top in self._reduced(node, terminal))
            self.paths[node, terminal] = tuple(sorted(self._push(state, top) for top, state in tops if state is not None))
        return self.paths[node, terminal]

    def accepts(self, node: int) -> bool:
        """Whether the conversation may end here."""
        if node not in self.ends:
            self.ends[node] = any((0, 1) in self.states[self.nodes[top][0]] for top in self._reduced(node, _END))
        return self.ends[node]


class Repair:
    """The cheapest edits of one conversation, whose turns come one after the other.

    Live stacks are held with their cost, audit and the digest of the repaired text so far; of equal stacks the one
    of the smallest (cost, audit) stays. No turn is kept, so memory does not grow with the number of turns, but for the
    audit.
    """

    def __init__(self, parser: RoleParser):
        self.parser = parser
        self.audit: list[str] = []  # what all live stacks begin with
        self.turns = 0
        self.live = self._inserted({0: (0, "", None)})

    def _digest(self, before, role: str, text: str):
        digest = before.copy() if before else hashlib.sha256()
        digest.update((("\n" if before else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        return digest

    def _inserted(self, live: dict) -> dict:
        """The stacks and those that inserted turns make of them."""
        todo = list(live)
        while todo:
            node = todo.pop()
            cost, audit, digest = live[node]
            for initial, role in MADE_ROLES.items():
                for new in self.parser.after(node, initial):
                    if new not in live or (cost + INSERT, audit + "I") < live[new][:2]:
                        live[new] = (cost + INSERT, audit + "I", self._digest(digest, role, ""))
                        todo.append(new)
        return live

    def turn(self, role: str, text: str, fault: str) -> None:
        best: dict[int, tuple] = {}  # stack: cost, audit, digest before, role or None

        def offer(node, cost, audit, digest, made):
            if node not in best or (cost, audit) < best[node][:2]:
                best[node] = (cost, audit, digest, made)

        after = self.parser.after
        extra = TRUNCATED if fault == "truncated" else 0
        for node, (cost, audit, digest) in self.live.items():
            offer(node, cost + DELETE, audit + "D", digest, None)
            if fault in ("blank", "duplicate"):
                continue
            for new in after(node, role[:1]) if role[:1] in LEGAL_INITIALS else ():
                offer(new, cost + extra, audit + "K", digest, role)
            for initial, made in MADE_ROLES.items():
                for new in after(node, initial):
                    offer(new, cost + REROLE + extra, audit + "R", digest, made)
        most = min(x[0] for x in best.values()) + SLACK
        self.live = self._inserted({
            node: (cost, audit, digest if made is None else self._digest(digest, made, text))
            for node, (cost, audit, digest, made) in best.items() if cost <= most
        })
        self.turns += 1
        if self.turns % _SETTLE == 0:
            shared = os.path.commonprefix([audit for _, audit, _ in self.live.values()])
            self.audit.append(shared)
            self.live = {n: (cost, audit[len(shared):], digest) for n, (cost, audit, digest) in self.live.items()}

    def result(self) -> tuple[int, str, str]:
        """Cost, audit, and SHA-256 of the repaired conversation."""
        cost, audit, digest = min((x for n, x in self.live.items() if self.parser.accepts(n)), key=lambda x: x[:2])
        return cost, "".join(self.audit) + audit, (digest or hashlib.sha256()).hexdigest()


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies; copies is how often the turn is there, 0 if it only names its conversation."""
    copies = F.col("copies").cast("int") if "copies" in conversations.columns else F.lit(1)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), copies.alias("copies"))


def with_faults(turns: DataFrame, floor: int = HOT_ROWS) -> DataFrame:
    """The turns with `later`: whether an earlier turn number of the conversation has the same role and text; and
    `blank` and `truncated`.

    Repeats are found by counts of each role and text, added up before the shuffle, and only those that occur more
    than once are joined back, dealt to parts where they are very many.
    """
    same = F.md5(F.concat_ws("\x00", F.col("conv_id").cast("string"), F.col("conv_id").isNull().cast("string"),
                             F.octet_length("role").cast("string"), "role", "text"))
    keyed = turns.withColumn("_same", same)
    first = keyed.where("copies > 0").groupBy("_same").agg(
        F.min("turn").alias("_first"), F.count("*").alias("_n"), (F.count("*") > F.count("turn")).alias("_unnumbered")
    ).where("_n > 1")
    joined = join_unique(keyed, first, "_same", "_n", "turn", "left", floor)
    # Turns without a number come before all others.
    later = F.coalesce(F.col("turn").isNotNull() & (F.col("_unnumbered") | (F.col("turn") > F.col("_first"))), F.lit(False))
    last = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    return joined.select(
        "conv_id", "turn", "role", "text", "copies", later.alias("later"), (last == "").alias("blank"),
        (~last.isin(".", "!", "?")).alias("truncated"),
    )


def _sorted_turns(turns: DataFrame) -> DataFrame:
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")


def repair_conversations(conversations: DataFrame, floor: int = HOT_ROWS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: one row per conversation.

    `conversations` has conv_id, turn, role, text, and may have `copies`, how often a turn is there: 0 for one that
    only keeps its conversation in the result. Other columns are not read.

    Turns are in order of turn (nulls first), role and text. The first that holds of a turn is its fault: blank (only
    white space), duplicate (role and text came before), truncated (the text does not end in . ! or ?). Role and text
    count as one blank where null. The audit has a letter for each edit: K keep, R give another role, D delete, I
    insert an empty turn; of all cheapest edits that give the role grammar it is the least in ASCII order, and it
    fixes the repaired turns. Roles count by their first letter; those of other letters cannot be kept. gaps are the
    turn numbers missing between the smallest and the largest. Rows without conv_id are one conversation, repeated
    rows are duplicates, conversations of no turns have zeros, and an empty table gives an empty result.

    A conversation is read turn by turn, sorted, in one task, as its digest can only be taken in order; a task holds
    a batch of turns and a few stacks, however many turns there are.
    """
    shape = T.StructType([
        conversations.schema["conv_id"], *[T.StructField(c, T.LongType()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType()),
    ])

    def run(rows):
        parser, state, done = RoleParser(), None, []

        def close():
            spread = 0 if state["low"] is None else state["high"] - state["low"] + 1 - state["numbers"]
            done.append((state["id"], spread, *(state["faults"][f] for f in FAULTS), state["illegal"], *state["repair"].result()))

        for batch in rows:
            for conv_id, turn, role, text, copies, later, blank, truncated in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or state["id"] != conv_id:
                    if state:
                        close()
                    state = {"id": conv_id, "repair": Repair(parser), "faults": dict.fromkeys(["", *FAULTS], 0), "illegal": 0,
                             "low": None, "high": None, "numbers": 0, "before": None, "initial": None}
                for _ in range(copies):
                    again = state["before"] == (turn, role, text)
                    fault = "blank" if blank else "duplicate" if later or again else "truncated" if truncated else ""
                    state["faults"][fault] += 1
                    state["illegal"] += state["initial"] is not None and state["initial"] + role[:1] not in LEGAL_PAIRS
                    state["before"], state["initial"] = (turn, role, text), role[:1]
                    if turn is not None and turn != state["high"]:
                        state["low"] = turn if state["low"] is None else state["low"]
                        state["high"], state["numbers"] = turn, state["numbers"] + 1
                    state["repair"].turn(role, text, fault)
            if done:
                yield _batch(done, shape, batch.schema)
                done.clear()
        if state:
            close()
            yield _batch(done, shape, batch.schema)

    return _sorted_turns(with_faults(_turns(conversations), floor)).mapInArrow(run, shape)


def _batch(rows: list[tuple], shape: T.StructType, given: pa.Schema) -> pa.RecordBatch:
    """Rows as a batch whose first column is of the type that it has in the batches given."""
    kinds = [given.field(0).type, *(pa.int64() if f.dataType == T.LongType() else pa.string() for f in shape.fields[1:])]
    return pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in zip(zip(*rows), kinds)], shape.names)


def repaired_turns(conversations: DataFrame, repairs: DataFrame) -> DataFrame:
    """conv_id, position, turn, role, text, edit of the repaired conversations: the edits of `repairs` carried out.

    `repairs` is what repair_conversations gives for the same rows. Inserted turns have no turn number and an empty
    text; position counts from 0. A conversation's audit comes before its turns in the sorted rows of a task, so both
    are read once, in order.
    """
    shape = T.StructType([
        conversations.schema["conv_id"], T.StructField("position", T.LongType()), T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("edit", T.StringType()),
    ])
    audits = repairs.select(
        "conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(1).alias("copies")
    )
    turns = _turns(conversations).where("copies > 0").select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", "copies")

    def run(rows):
        made: list[tuple] = []
        conv, audit, at, place, last = None, "", 0, 0, None

        def due():
            return "assistant" if last == "u" else "user"

        def add(turn, role, text, edit):
            nonlocal place, last
            made.append((conv, place, turn, role, text, edit))
            place, last = place + 1, role[:1]

        def insert():
            nonlocal at
            while audit[at:at + 1] == "I":
                add(None, due(), "", "I")
                at += 1

        for batch in rows:
            for conv_id, kind, turn, role, text, copies in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 0:
                    conv, audit, at, place, last = conv_id, text, 0, 0, None
                    insert()
                    continue
                for _ in range(copies):
                    edit = audit[at]
                    at += 1
                    if edit != "D":
                        add(turn, role if edit == "K" else due(), text, edit)
                    insert()
            if made:
                yield _batch(made, shape, batch.schema)
                made.clear()

    both = audits.unionByName(turns)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.asc_nulls_first("turn"), "role", "text").mapInArrow(run, shape)


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults by the checksum of conv_id:turn: dropped (copies 0), emptied, without . ! ?, repeated,
    or said by the user. Nulls are one blank."""
    conv, turn, role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text"))
    kind = F.pmod(F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")), F.lit(20))
    return conversations.select(
        "conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )
