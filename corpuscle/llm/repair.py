"""Conversation structure repair: secondary-sorted streaming with a dynamic programme.

Rows are repartitioned by conversation once. In those partitions a window numbers equal (role, text)
rows by turn, which tells duplicates without a set of texts in memory, and a sort by conversation and
turn follows; both sorts spill. ``mapInPandas`` then reads the rows as a stream: the state of the
programme goes from one Arrow batch to the next, so a conversation may span any number of batches.

The state is the least cost of each role position (start, after a system, user or assistant turn), the
order of the four paths as strings and a sha256 of each path's repaired text. Paths that another one
beats whatever follows are dropped, so costs relative to the least are few, and a step (relative costs,
order, kind of row) is computed once and then looked up; its number is the row's back-pointer. Every
``block`` rows of a conversation the pointers are traced for the up to four ends of the block and spilled
as rows of the output, short strings of edits, so that a giant conversation holds no more than a block of
pointers and a few bytes a block; the chosen strings are joined to it afterwards. The audit itself is one
string by contract.

Edits: Keep costs 0, Rerole (to user or assistant, whichever fits) 1, Delete 2 (the only one for blank
and duplicate rows), Insert (an empty user or assistant turn) 5; a truncated row that stays adds 5. The
role initials left must read ``(s?(ua)+)?``. Of the cheapest audits the ASCII-least is taken.

Defined cases: null roles and texts read as one space, as do null ids and turns in the draw of damage.
Rows of one turn follow each other by role and text. Rows with a null id form one conversation with a
null id. Gaps that pass 64 bits end at 2^63 - 1. A conversation all of whose rows were dropped has zeros,
an empty audit and the hash of the empty string. Repeated rows are duplicates. An empty table gives no
rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.session import stash

BLANKS = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
#: Position after a turn with this initial, by position before it.
FOLLOWS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
NEEDED = {START: "u", SYSTEM: "u", ASSISTANT: "u", USER: "a"}
NAMES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
MOST = (1 << 63) - 1
OUT = "conv_id {kind}, part int, place int, edits string, path string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, repaired_sha256 string"


@dataclass(frozen=True)
class Costs:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


@dataclass(frozen=True)
class Step:
    """What a row of one kind does to the paths: relative costs and order after it, cost added to all, and for each position (position before, edits)."""

    rest: tuple
    added: int
    back: tuple


def inserted(place: int, most: int = 3) -> list[tuple[int, str]]:
    """Positions after 0 to ``most`` insertions, with the initials inserted."""
    out, roles = [(place, "")], ""
    for _ in range(most):
        roles += NEEDED[place]
        place = FOLLOWS[roles[-1]][place]
        out.append((place, roles))
    return out


class Programme:
    """Steps by (state, kind of row). A state is (relative cost, rank) of each position, None where no path ends."""

    def __init__(self, costs: Costs) -> None:
        self.costs, self.known, self.steps = costs, {}, []

    def number(self, rest: tuple, kind: tuple) -> int:
        """Of the step that a row of ``kind`` (initial, must go, truncated) takes from ``rest``."""
        at = self.known.get((rest, kind))
        if at is None:
            at = self.known[rest, kind] = len(self.steps)
            self.steps.append(self.step(rest, *kind))
        return at

    def step(self, rest: tuple, initial: str, must_go: bool, truncated: bool) -> Step:
        c, best = self.costs, {}
        for place, own in enumerate(rest):
            if own is None:
                continue
            for n, (there, roles) in enumerate(inserted(place)):
                moves = [(there, c.delete, "D")]
                if not must_go:
                    stays = c.truncated if truncated else 0
                    if (to := FOLLOWS.get(initial, {}).get(there)) is not None:
                        moves.append((to, stays, "K"))
                    moves.append((FOLLOWS[NEEDED[there]][there], c.rerole + stays, "R"))
                for to, price, edit in moves:
                    way = (own[0] + n * c.insert + price, own[1], "I" * n + edit, place, roles)
                    if to not in best or way < best[to]:
                        best[to] = way
        # Whatever follows a system turn follows an assistant's too, and at the start only a system turn more, which the other path may delete.
        for place, spared in ((SYSTEM, 0), (START, c.delete)):
            if ASSISTANT in best and place in best and best[place][0] > best[ASSISTANT][0] + spared:
                del best[place]
        least = min(way[0] for way in best.values())
        order = sorted(best, key=lambda to: best[to][1:3])
        after = tuple((best[to][0] - least, order.index(to)) if to in best else None for to in range(4))
        return Step(after, least, tuple((best[to][3], best[to][2], best[to][4]) if to in best else None for to in range(4)))


FIRST = ((0, 0), None, None, None)


class Conversation:
    """One conversation while its rows go by."""

    def __init__(self, programme: Programme, block: int) -> None:
        self.programme, self.block = programme, block
        self.rest, self.base, self.rows = FIRST, 0, 0
        self.pointers: list[int] = []
        self.maps: list[tuple] = []
        self.hashes = {START: (hashlib.sha256(), False)}
        self.low = self.high = self.turn = self.initial = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn: int | None, role: str, text: str, blank: bool, again: bool, cut: bool) -> None:
        if turn is not None:
            self.turns += turn != self.turn
            self.low, self.high, self.turn = turn if self.low is None else self.low, turn, turn
        duplicate, truncated = again and not blank, cut and not blank and not again
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + truncated
        initial = role[:1]
        self.illegal += self.initial is not None and self.initial + initial not in LEGAL
        self.initial = initial
        at = self.programme.number(self.rest, (initial if initial in FOLLOWS else "", blank or duplicate, truncated))
        step = self.programme.steps[at]
        self.hashes = {to: self.extended(*back, to, role, text) for to, back in enumerate(step.back) if back}
        self.rest, self.base = step.rest, self.base + step.added
        self.pointers.append(at)

    def extended(self, place: int, edits: str, roles: str, to: int, role: str, text: str) -> tuple:
        """The hash of the repaired text of a path, and whether it has a turn."""
        held, some = self.hashes[place]
        if edits == "D":
            return held, some
        turns = [f"{NAMES[r]}:" for r in roles]
        if edits[-1] != "D":
            name = role if edits[-1] == "K" else NAMES["u" if to == USER else "a"]
            turns.append(f"{name}:{text}")
        held = held.copy()
        held.update(("\n" * some + "\n".join(turns)).encode("utf-8", "surrogatepass"))
        return held, True

    def traced(self, place: int) -> tuple[str, int]:
        """Edits of the rows held that end at ``place``, and the position before them."""
        out = []
        for at in reversed(self.pointers):
            place, edits, _ = self.programme.steps[at].back[place]
            out.append(edits)
        return "".join(reversed(out)), place

    def spilled(self) -> list[tuple[int, int, str]]:
        """(part, position at its end, edits) of a full block, whose pointers are dropped."""
        if len(self.pointers) < self.block:
            return []
        ends = {place: self.traced(place) for place, own in enumerate(self.rest) if own is not None}
        self.maps.append(tuple(ends[p][1] if p in ends else None for p in range(4)))
        self.pointers = []
        return [(len(self.maps) - 1, place, edits) for place, (edits, _) in ends.items()]

    def finished(self) -> tuple:
        """edits of the last rows, path (the position at the end of each spilled part), gaps, counts, cost and hash."""
        ways = []
        for place, own in enumerate(self.rest):
            for n, (there, roles) in enumerate(inserted(place) if own is not None else []):
                if there in (START, ASSISTANT):
                    ways.append((own[0] + n * self.programme.costs.insert, own[1], "I" * n, place, roles))
        cost, _, more, place, roles = min(ways)
        held, some = self.hashes[place]
        if roles:
            held = held.copy()
            held.update(("\n" * some + "\n".join(f"{NAMES[r]}:" for r in roles)).encode())
        edits, place = self.traced(place)
        path = []
        for ends in reversed(self.maps):
            path.append(str(place))
            place = ends[place]
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.turns, MOST)
        return edits + more, "".join(reversed(path)), gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.base + cost, held.hexdigest()


def damaged(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv_id, turn, role, text after damage drawn by crc32 of ``conv:turn``; dropped rows stay with ``gone`` so that their conversation is known."""
    told = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(told(F.col(conv_col)), F.lit(":"), told(F.col(turn_col)))) % 20
    text = told(F.col(text_col))
    out = rows.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.when(draw == 4, "user").otherwise(told(F.col(role_col))).alias("role"),
        F.when(draw == 1, "").when(draw == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (draw == 0).alias("gone"),
        F.when(draw == 3, 2).otherwise(1).alias("copies"),
    )
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return out.select("conv_id", F.when(~F.col("gone"), F.col("turn")).alias("turn"), F.when(~F.col("gone"), F.col("role")).alias("role"), F.when(~F.col("gone"), F.col("text")).alias("text"), "gone")


def repair(rows: DataFrame, costs: Costs | None = None, block: int = 65_536) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation of ``rows`` (conv_id, turn, role, text, gone)."""
    costs, kind = costs or Costs(), rows.schema["conv_id"].dataType.simpleString()
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    same = Window.partitionBy("conv_id", "role", "text").orderBy("turn")
    one = rows.repartition("conv_id").withColumn("again", F.row_number().over(same) > 1)
    one = one.withColumns({"blank": end == "", "cut": ~F.right(end, F.lit(1)).isin(".", "!", "?")})
    one = one.sortWithinPartitions("conv_id", F.desc("gone"), F.asc_nulls_first("turn"), "role", "text")
    columns = ["conv_id", "part", "place", "edits", "path", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "repaired_sha256"]

    def frame(out: list[tuple]) -> pd.DataFrame:
        df = pd.DataFrame(out, columns=columns, dtype=object)
        for c in ("part", "place", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"):
            df[c] = df[c].astype("Int64")
        return df

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        programme, open_, key, out = Programme(costs), None, None, []
        for pdf in batches:
            ids = pdf["conv"].tolist()
            turns, known = pdf["turn"].tolist(), pdf["has_turn"].tolist()
            for i, (conv, gone, role, text, blank, again, cut) in enumerate(zip(ids, pdf["gone"], pdf["role"], pdf["text"], pdf["blank"], pdf["again"], pdf["cut"], strict=True)):
                if open_ is None or conv != key:
                    if open_ is not None:
                        out.append((key, None, None, *open_.finished()))
                    open_, key = Conversation(programme, block), conv
                if not gone:
                    open_.add(turns[i] if known[i] else None, role, text, bool(blank), bool(again), bool(cut))
                    out += [(key, part, place, edits, *[None] * 8) for part, place, edits in open_.spilled()]
            if out:
                yield frame(out)
                out = []
        if open_ is not None:
            yield frame([(key, None, None, *open_.finished())])

    shown = one.select(F.col("conv_id").cast("string").alias("conv"), F.coalesce("turn", F.lit(0)).alias("turn"), F.col("turn").isNotNull().alias("has_turn"), "role", "text", "gone", F.coalesce("blank", F.lit(False)).alias("blank"), "again", F.coalesce("cut", F.lit(False)).alias("cut"))
    found = stash(shown.mapInPandas(run, OUT.format(kind="string")), "repaired")
    whole = found.filter("part is null").drop("part", "place")
    steps = whole.filter("path <> ''").select("conv_id", F.posexplode(F.split("path", "")).alias("part", "place")).filter("place <> ''").withColumn("place", F.col("place").cast("int"))
    spilled = found.filter("part is not null").select(F.col("conv_id").alias("conv"), "part", "place", F.col("edits").alias("piece"))
    named = steps.join(spilled, F.col("conv_id").eqNullSafe(F.col("conv")) & (steps["part"] == spilled["part"]) & (steps["place"] == spilled["place"]))
    heads = named.groupBy(F.col("conv").alias("head_of")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(steps["part"].alias("part"), "piece"))), lambda s: s["piece"]), "").alias("head"))
    both = whole.join(heads, F.col("conv_id").eqNullSafe(F.col("head_of")), "left")
    audit = F.concat(F.coalesce("head", F.lit("")), F.col("edits"))
    return both.select(F.col("conv_id").cast(kind).alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", audit.alias("audit"), "repaired_sha256")


def damage_and_repair(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The repair of a table after damage, one row for each of its conversations."""
    return repair(damaged(conversations, conv_col, turn_col, role_col, text_col)).withColumnRenamed("conv_id", conv_col)
