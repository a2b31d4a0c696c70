"""Rules over a text, written once and turned into Spark columns or SQL.

A rule is built from needles (substrings; A-Z is matched without case unless ``exact``), counts and the
connectives below. No Python runs on the rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(UPPER, LOWER)
#: Characters that prose rarely holds: one test for them spares the search for every needle that has them.
GATES = "(=[<\\@%{;+_&"


@dataclass(frozen=True)
class Rule:
    column: Callable[[dict[str, Column]], Column]
    sql: str

    def __and__(self, other: Rule) -> Rule:
        return Rule(lambda t: self.column(t) & other.column(t), f"({self.sql} AND {other.sql})")

    def __or__(self, other: Rule) -> Rule:
        return Rule(lambda t: self.column(t) | other.column(t), f"({self.sql} OR {other.sql})")

    def __invert__(self) -> Rule:
        return Rule(lambda t: ~self.column(t), f"(NOT {self.sql})")


@dataclass(frozen=True)
class Number:
    column: Callable[[dict[str, Column]], Column]
    sql: str

    def __add__(self, other: Number) -> Number:
        return Number(lambda t: self.column(t) + other.column(t), f"({self.sql} + {other.sql})")

    def __mul__(self, k: float) -> Number:
        return Number(lambda t: self.column(t) * k, f"({self.sql} * {k})")

    def __truediv__(self, other: Number) -> Number:
        return Number(lambda t: self.column(t) / other.column(t), f"(({self.sql}) * 1.0 / ({other.sql}))")

    def at_least(self, k: float) -> Rule:
        return Rule(lambda t: self.column(t) >= k, f"({self.sql} >= {k})")

    def above(self, k: float) -> Rule:
        return Rule(lambda t: self.column(t) > k, f"({self.sql} > {k})")

    def share_at_least(self, whole: Number, percent: int) -> Rule:
        """Whole-number percentage of ``whole``."""
        return Rule(lambda t: self.column(t) * 100 >= whole.column(t) * percent, f"({self.sql} * 100 >= {whole.sql} * {percent})")


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def has(needle: str, exact: bool = False) -> Rule:
    name, text = ("text", needle) if exact else ("low", needle.translate(_FOLD))
    gate = next((g for g in GATES if g in needle), None)

    def column(t: dict[str, Column]) -> Column:
        found = F.contains(t[name], F.lit(text))
        return t[gate] & found if gate and len(needle) > 1 else found

    return Rule(column, f"contains({name}, {quoted(text)})")


def any_of(*needles: str, exact: bool = False) -> Rule:
    out = has(needles[0], exact)
    for n in needles[1:]:
        out = out | has(n, exact)
    return out


def all_of(*needles: str, exact: bool = False) -> Rule:
    out = has(needles[0], exact)
    for n in needles[1:]:
        out = out & has(n, exact)
    return out


def hits(*rules: str | Rule) -> Number:
    """How many of the needles or rules hold."""
    own = [has(r) if isinstance(r, str) else r for r in rules]

    def column(t: dict[str, Column]) -> Column:
        out = F.lit(0)
        for r in own:
            out = out + r.column(t).cast("int")
        return out

    return Number(column, "(" + " + ".join(f"CAST({r.sql} AS INTEGER)" for r in own) + ")")


def count_of(needle: str, exact: bool = True) -> Number:
    """Occurrences that do not overlap, from lengths before and after removal."""
    name, text = ("text", needle) if exact else ("low", needle.translate(_FOLD))
    n = len(needle)
    gate = next((g for g in GATES if g in needle), None)

    def column(t: dict[str, Column]) -> Column:
        found = ((F.length(t[name]) - F.length(F.replace(t[name], F.lit(text), F.lit("")))) / n).cast("int")
        there = F.contains(t[name], F.lit(text))
        return F.when(t[gate] & there if gate else there, found).otherwise(0)

    return Number(column, f"CAST((length({name}) - length(replace({name}, {quoted(text)}, ''))) / {n} AS INTEGER)")


def matches(pattern: str) -> Rule:
    """A regular expression that reads the same in Java and RE2, on the text as it is."""
    return Rule(lambda t: t["text"].rlike(pattern), f"regexp_matches(text, {quoted(pattern)})")


def only_if(gate: Callable[[dict[str, Column]], Column], rule: Rule) -> Rule:
    """The rule behind a cheap condition that it implies; in SQL the rule alone."""
    return Rule(lambda t: gate(t) & rule.column(t), rule.sql)


def left_by(pattern: str, octets: bool = False) -> Number:
    """Characters (or bytes) that remain when the pattern is removed."""
    size, sql = (F.octet_length, "strlen") if octets else (F.length, "length")
    return Number(lambda t: size(F.regexp_replace(t["text"], pattern, "")), f"{sql}(regexp_replace(text, {quoted(pattern)}, '', 'g'))")


def octets() -> Number:
    return Number(lambda t: F.octet_length(t["text"]), "strlen(text)")


def words_where(condition: Callable[[Column], Column], sql: str) -> Number:
    """White-space separated words for which a condition holds (``w`` in SQL)."""
    return Number(lambda t: F.size(F.filter(F.split(t["text"], r"\s+"), condition)), f"len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: {sql}))")


def inputs(text: Column) -> dict[str, Column]:
    """The columns a rule reads, by name; to be computed once ahead of the rules."""
    safe = F.coalesce(text, F.lit(""))
    # lower() is much the faster and differs, as far as ASCII needles can tell, for two letters only
    rare = F.contains(safe, F.lit("\u212a")) | F.contains(safe, F.lit("\u0130"))
    low = F.when(rare, F.translate(safe, UPPER, LOWER)).otherwise(F.lower(safe))
    return {"text": safe, "low": low} | {g: F.contains(safe, F.lit(g)) for g in GATES}
