"""Predicates with two-valued logic: a comparison with a missing value is false, even ``!=``.

Strings compare without regard to ASCII case and only for equality; a number against text is false;
metadata values compare as numbers only where the literal is a number and the value parses as one.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.schemas import two_valued

OPERATORS = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def compare(field: Column, op: str, value: str | float | bool, kind: str = "string") -> Column:
    """``kind`` of the field: string, number, bool or meta (text that may hold a number)."""
    if op not in OPERATORS:
        raise ValueError(f"unknown operator {op}")
    is_number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if kind == "meta" and is_number:
        return two_valued(OPERATORS[op](field.try_cast("double"), F.lit(float(value))))
    if kind == "number":
        return two_valued(OPERATORS[op](field.cast("double"), F.lit(float(value)))) if is_number else F.lit(False)
    if is_number or op not in ("==", "!="):
        return F.lit(False)
    if kind == "bool":
        text = str(value).lower()
        return two_valued(OPERATORS[op](field, F.lit(text == "true"))) if text in ("true", "false") else F.lit(False)
    return two_valued(OPERATORS[op](ascii_lower(field), F.lit(str(value).translate(str.maketrans(UPPER, LOWER)))))


def all_(*conditions: Column) -> Column:
    return reduce(operator.and_, map(two_valued, conditions), F.lit(True))


def any_(*conditions: Column) -> Column:
    return reduce(operator.or_, map(two_valued, conditions), F.lit(False))


def not_(condition: Column) -> Column:
    return ~two_valued(condition)


def finding_fields() -> dict[str, tuple[Column, str]]:
    """Field names of a finding row: column and kind. Other names are metadata keys."""
    meta = lambda *keys: F.coalesce(*[F.col("meta")[k] for k in keys])
    return {
        "id": (F.col("id"), "string"),
        "kind": (F.col("kind"), "string"),
        "subtype": (F.col("kind"), "string"),
        "surface": (F.col("surface"), "string"),
        "severity": (F.col("severity"), "string"),
        "filter": (F.col("severity"), "string"),
        "confidence": (F.col("confidence"), "string"),
        "impact": (F.col("impact"), "string"),
        "action_type": (F.col("action_type"), "string"),
        "action_target": (F.col("action_target"), "string"),
        "length": (F.octet_length("description"), "number"),
        "objects": (F.size("objects"), "number"),
        "evidence": (F.size("evidence"), "number"),
        "name": (meta("filename", "name"), "string"),
        "magic": (meta("magic", "magic_type"), "string"),
        "hash": (meta("hash", "sha256"), "string"),
    }


def field(name: str, op: str, value: str | float | bool) -> Column:
    """Comparison on a named field of a finding, or on a metadata key (keys in lower case)."""
    known = finding_fields()
    if name in known:
        column, kind = known[name]
        return compare(column, op, value, kind)
    return compare(F.transform_keys("meta", lambda k, _: F.lower(k))[name.lower()], op, value, "meta")


def filter_rows(df: DataFrame, condition: Column) -> DataFrame:
    """Rows of findings, events, urls or chains for which a predicate holds."""
    return df.filter(two_valued(condition))


filter_findings = filter_rows
