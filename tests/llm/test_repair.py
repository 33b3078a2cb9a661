"""Repair of conversations against a plain search over all edits, and what it does at the edges."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from moodspark.llm import repair
from moodspark.llm.queries import LLM_QUERIES

SHAPE = "conv_id long, turn long, role string, text string"
BLANK = re.compile(r"[^\x20\x09-\x0D]")
# State of the role pattern -> {initial: next state}; written down by hand, not made from the grammar.
NEXT = {"start": {"s": "system", "u": "user"}, "system": {"u": "user"}, "user": {"a": "pair"}, "pair": {"u": "user"}}
ROLES = {"u": "user", "a": "assistant"}


def harmed(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def plain(rows):
    """What is due for one conversation's turns after damage: every state with its least (cost, audit)."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    seen, faults, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
    for _, _, role, text in rows:
        marks = BLANK.findall(text)
        fault = "blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
        counts[fault] += 1

    def insert(best):
        changed = True
        while changed:
            changed = False
            for state, (cost, audit, turns) in list(best.items()):
                for i, to in NEXT[state].items():
                    if i in ROLES and (to not in best or (cost + 2, audit + "I") < best[to][:2]):
                        best[to] = (cost + 2, audit + "I", [*turns, (ROLES[i], "")])
                        changed = True
        return best

    best = insert({"start": (0, "", [])})
    for (_, _, role, text), fault in zip(rows, faults):
        new = {}

        def offer(state, cost, audit, turns):
            if state not in new or (cost, audit) < new[state][:2]:
                new[state] = (cost, audit, turns)

        for state, (cost, audit, turns) in best.items():
            offer(state, cost + 3, audit + "D", turns)
            if fault not in ("blank", "duplicate"):
                late = fault == "truncated"
                for i, to in NEXT[state].items():
                    if role[:1] == i:
                        offer(to, cost + late, audit + "K", [*turns, (role, text)])
                    if i in ROLES:
                        offer(to, cost + 2 + late, audit + "R", [*turns, (ROLES[i], text)])
        best = insert(new)
    cost, audit, turns = min(x for s, x in best.items() if s in ("start", "pair"))
    numbers = [r[1] for r in rows if r[1] is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest), turns


def due(rows):
    after = harmed(rows)
    return {conv: plain([r for r in after if r[0] == conv]) for conv in {r[0] for r in rows}}


def found(df):
    rows = df.select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: tuple(r[1:]) for r in rows}


def test_query_against_plain_search(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(LLM_QUERIES["op11_structure_repair"](spark, small)) == {c: x for c, (x, _) in due(rows).items()}


@pytest.mark.parametrize("seed", range(4))
def test_random_conversations(spark, seed):
    draw = random.Random(seed)
    texts = ["Yes.", "No!", "cut", " ", "", "so \t", "Done. \n", "x?", None]
    rows = []
    for conv in [None, *range(60)]:
        for k in range(draw.randrange(0, 14)):
            turn = None if draw.random() < 0.1 else draw.choice([k, k, k + 3, 2])
            rows.append((conv, turn, draw.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), draw.choice(texts)))
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, SHAPE)
    want = due(rows)
    harm = repair.damaged(df)
    # A floor of one row splits every repeated text's key as if it were hot.
    for floor in (1, 200_000):
        assert found(repair.repair_conversations(harm, floor)) == {c: x for c, (x, _) in want.items()}
    turns = repair.repaired_turns(harm, repair.repair_conversations(harm)).collect()
    by_conv = {}
    for r in sorted(turns, key=lambda r: r["position"]):
        by_conv.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert by_conv == {c: t for c, (_, t) in want.items() if t}


def test_long_conversation_and_long_text(spark):
    rows = [(1, k, "user" if k % 3 else "assistant", f"{k} said." if k % 7 else "x" * 50_000) for k in range(1500)]
    df = spark.createDataFrame(rows, SHAPE)
    want, _ = plain(rows)
    assert found(repair.repair_conversations(df)) == {1: want}
    assert repair.Repair(repair.RoleParser()).result() == (0, "", hashlib.sha256().hexdigest())


def test_stacks_do_not_grow_with_the_turns():
    parser = repair.RoleParser()
    one = repair.Repair(parser)
    for k in range(5000):
        one.turn(["user", "assistant", "system", "tool"][k * k % 4], f"{k}.", "")
    assert len(one.live) < 20 and len(parser.nodes) < 40
    assert max(len(a) for _, a, _ in one.live.values()) < 3 * 512


def test_empty_dropped_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SHAPE)
    assert found(repair.repair_conversations(repair.damaged(empty))) == {}
    gone = spark.createDataFrame([(7, 0, "user", "Hi.", 0), (7, 1, "user", "Hi.", 0), (8, None, None, None, 1)], SHAPE + ", copies int")
    nothing = hashlib.sha256().hexdigest()
    assert found(repair.repair_conversations(gone)) == {7: (0, 0, 0, 0, 0, 0, "", nothing), 8: (0, 1, 0, 0, 0, 3, "D", nothing)}
    rows = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes.")], SHAPE)
    more = rows.select("*", *[F.lit(5).alias(c) for c in ("later", "blank", "_same", "_first", "_n", "kind", "audit", "position", "_part")])
    assert found(repair.repair_conversations(more))[1][5:7] == (0, "KK")


def test_other_grammar():
    parser = repair.RoleParser((("S", ("u", "S", "a")), ("S", ())))
    top = 0
    for symbol in "uuaa":
        (top,) = parser.after(top, symbol)
    assert parser.accepts(top) and not parser.after(top, "a")
