"""Conversation repair against a search over all edit strings, in blocks and batches of any size, and on odd inputs."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from corpuscle.llm import repair

COLUMNS = "conv_id long, turn long, role string, text string"
FOLLOWS = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def after_damage(conv, rows):
    out = []
    for turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        out += [(turn, "user" if draw == 4 else role, text)] * {0: 0, 3: 2}.get(draw, 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def cheapest(rows, faults):
    """(cost, audit, repaired) by a search that goes through audits from the cheapest, ASCII-least first."""
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, i, state, said = heapq.heappop(queue)
        if i == len(rows) and state in ("", "a"):
            return cost, audit, "\n".join(said)
        if (i, state) in done:
            continue
        done.add((i, state))
        needed = "a" if state == "u" else "u"
        name = {"u": "user", "a": "assistant"}[needed]
        heapq.heappush(queue, (cost + 5, audit + "I", i, needed, (*said, f"{name}:")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(queue, (cost + 2, audit + "D", i + 1, state, said))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 * (faults[i] == "truncated")
                heapq.heappush(queue, (cost + 1 + more, audit + "R", i + 1, needed, (*said, f"{name}:{text}")))
                if (state, role[:1]) in FOLLOWS:
                    heapq.heappush(queue, (cost + more, audit + "K", i + 1, FOLLOWS[state, role[:1]], (*said, f"{role}:{text}")))
    raise AssertionError


def plain(conv, given):
    rows, seen, faults = after_damage(conv, given), set(), []
    for _, role, text in rows:
        end = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = {t for t, *_ in rows if t is not None}
    cost, audit, said = cheapest(rows, faults)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(said.encode()).hexdigest())


def drawn(rng, conv):
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "über", "unknown"]
    texts = ["Yes.", "No!", "and then", "", " \n", "Why?", None, "Yes.", "x" * 50, "über…", "fine. \t"]
    n = rng.choice([1, 1, 2, 3, 4, 5, 6, 7, 9])
    return [(rng.choice([i, i, i, i + 3, None, 0]), rng.choice(roles[: rng.choice([2, 3, 10])]), rng.choice(texts)) for i in range(n)]


def as_table(spark, convs):
    df = spark.createDataFrame([(c, *r) for c, rows in convs for r in rows], COLUMNS)
    return df.withColumns({c: F.lit("clash") for c in ("conv", "part", "place", "gone", "again", "path", "edits", "copies", "draw")})


def results(df):
    return {r[0]: tuple(r[1:]) for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


def test_same_as_search_over_edits(spark):
    rng = random.Random(8)
    convs = [(c if c else None, drawn(rng, c)) for c in range(300)]
    got = results(repair.damage_and_repair(as_table(spark, convs).repartition(5)))
    assert got == {c: plain(c, rows) for c, rows in convs}
    assert any(r[-2] == "" for r in got.values()) and {e for r in got.values() for e in r[-2]} == set("KRD")


@pytest.mark.parametrize(("block", "batch"), [(1, 3), (7, 10), (64, 10_000)])
def test_giant_conversation_in_blocks_and_batches(spark, block, batch):
    rng = random.Random(9)
    convs = [(5, [(t, rng.choice(["user", "assistant", "user", "assistant", "system"]), rng.choice(["Yes.", "no", f"{t}.", f"{t}?", f"t{t}!"])) for t in range(700)]), (6, [(0, "user", "Hi.")]), (None, [(t, "user", f"{t}.") for t in range(40)])]
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = results(repair.repair(repair.damaged(as_table(spark, convs), "conv_id", "turn", "role", "text"), block=block))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert got == {c: plain(c, rows) for c, rows in convs}


def test_pointers_held_are_bounded():
    """Spilled parts leave a block of pointers and a few numbers a block behind."""
    c = repair.Conversation(repair.Programme(repair.Costs()), 16)
    parts = 0
    for t in range(5000):
        c.add(t, ["user", "assistant", "user"][t % 3], f"{t}.", False, False, t % 5 == 0)
        parts += len(c.spilled())
        assert len(c.pointers) < 16 and len(c.hashes) <= 4
    assert len(c.maps) == 5000 // 16 and parts <= 4 * len(c.maps) and len(c.programme.steps) < 200


def test_other_costs_take_insertions(spark):
    convs = [(1, [(0, "user", "Hi."), (1, "user", "There."), (2, "assistant", "Yes.")])]
    rows = as_table(spark, convs).select("conv_id", "turn", "role", "text", F.lit(False).alias("gone"))
    got = results(repair.repair(rows, repair.Costs(rerole=9, delete=9, insert=1)))
    assert got[1][5:] == (1, "KIKK", hashlib.sha256(b"user:Hi.\nassistant:\nuser:There.\nassistant:Yes.").hexdigest())


def test_odd_conversations(spark):
    assert repair.damage_and_repair(spark.createDataFrame([], COLUMNS)).count() == 0
    long = "word " * 400_000 + "end."
    edges = [(1, [(-(2**63), "user", long), (2**63 - 1, "assistant", long)]), (2, [(None, None, None)] * 3)]
    got = results(repair.damage_and_repair(as_table(spark, edges)))
    want = {c: plain(c, rows) for c, rows in edges}
    assert got == {c: (min(r[0], 2**63 - 1), *r[1:]) for c, r in want.items()}
