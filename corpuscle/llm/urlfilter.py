"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a prefix rule (host and path) or a pattern. Each rule names the literal tokens that every
matching URL must contain; it is filed under the one of these that is rarest in the URLs at hand. A
URL's tokens fetch the candidate rules, and only those run their regular expressions.

Defined cases: a null URL or one without ``://`` has empty host and path, matches no prefix rule and
is judged by the patterns alone (a null URL matches none). Rows are neither dropped nor merged, so
repeated rows stay. Of prefix rules of one length that fit, the first counts. Extra columns of the input
are ignored. No rule: everything is allowed.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    """``name`` is reported; ``regex`` is searched in ``host + path`` (prefix) or in the lower-cased URL (pattern)."""

    name: str
    action: str
    regex: str
    tokens: tuple[str, ...]
    prefix: bool = False


def prefix_rule(text: str, action: str) -> Rule:
    """``example.com/en/7``: fits that host and its subdomains where the path starts with ``/en/7``."""
    host, _, path = text.partition("/")
    closed = path[: path.rfind("/") + 1]  # a last segment without slash may go on in the URL
    tokens = (*WORD.findall(host), *WORD.findall(closed.lower()))
    return Rule(text, action, rf"^(?:[^/]*\.)?{re.escape(host)}/{re.escape(path)}", tokens, True)


def pattern_rule(text: str, action: str) -> Rule:
    """Literal text with ``*`` for anything and ``^`` for a non-alphanumeric character or an end."""
    regex = "".join({"*": ".*", "^": r"(?:[^a-z0-9]|^|$)"}.get(c, re.escape(c)) for c in text.lower().strip("*"))
    literal = re.sub(r"(?:^|\*)[a-z0-9]+|[a-z0-9]+(?:\*|$)", "*", text.lower())
    return Rule(text, action, regex, tuple(WORD.findall(literal)))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty for null or where ``://`` is missing."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def token_counts(urls: DataFrame, tokens: Iterable[str]) -> dict[str, int]:
    """URLs that hold each of the rules' tokens: one row a token comes back, so as many as the rules have."""
    wanted = sorted(set(tokens))
    if not wanted:
        return {}
    words = F.split(F.translate("url", UPPER, LOWER), "[^a-z0-9]+")
    held = F.array_intersect(words, F.array(*map(F.lit, wanted))) if len(wanted) <= 200 else F.array_distinct(words)
    seen = urls.select(F.explode(held).alias("token"))
    if len(wanted) > 200:
        seen = seen.join(F.broadcast(urls.sparkSession.createDataFrame(pd.DataFrame({"token": wanted}))), "token")
    return {r["token"]: r["n"] for r in seen.groupBy("token").agg(F.count("*").alias("n")).collect()}


def build_index(rules: list[Rule], counts: dict[str, int]) -> dict[str, list[int]]:
    """Token to rule numbers, each rule under its token that fewest URLs hold (of equal ones, fewest rules); rules without a usable token under the empty one, which always runs."""
    shared = Counter(t for r in rules for t in set(r.tokens))
    index: dict[str, list[int]] = {}
    for i, rule in enumerate(rules):
        key = min(rule.tokens, key=lambda t: (counts.get(t, 0), shared[t], t), default="")
        index.setdefault(key, []).append(i)
    return index


class Judge:
    """Rules and their index in a task; a rule's regular expression is compiled when it is first fetched."""

    def __init__(self, rules: list[tuple[str, str, str, bool]], index: dict[str, list[int]]) -> None:
        self.rules, self.index, self.ready = rules, index, {}

    def expression(self, n: int) -> re.Pattern:
        if n not in self.ready:
            self.ready[n] = re.compile(self.rules[n][2], re.S)
        return self.ready[n]

    def __call__(self, url: str | None, host: str, path: str) -> tuple:
        """(prefix rule or None, verdict, pattern or None). Longest prefix rule wins, of equal ones the first; an allowing pattern beats a blocking one."""
        if url is None:
            return None, "allow", None
        low, place, best, found = url.translate(ASCII_LOWER), host + path, None, {}
        numbers = {n for t in ("", *set(WORD.findall(low))) for n in self.index.get(t, ())}
        for n in sorted(numbers):
            name, action, _, prefix = self.rules[n]
            if prefix:
                if host and self.expression(n).search(place) and (best is None or len(name) > len(best[0])):
                    best = (name, action)
            elif self.expression(n).search(low):
                found.setdefault(action, name)
        pattern = found.get("allow") or found.get("block")
        verdict = best[1] if best else "block" if "block" in found and "allow" not in found else "allow"
        return best and best[0], verdict, pattern


ASCII_LOWER = str.maketrans(UPPER, LOWER)


def filter_urls(urls: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", max_rules: int = 200_000) -> DataFrame:
    """id, host, path, rule, verdict, pattern for each row. The rule list goes to every task, so its length is checked."""
    if len(rules) > max_rules:
        raise ValueError(f"{len(rules)} rules; at most {max_rules} are sent to the tasks")
    rows = urls.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    index = build_index(rules, token_counts(rows, (t for r in rules for t in r.tokens)))
    held = urls.sparkSession.sparkContext.broadcast(([(r.name, r.action, r.regex, r.prefix) for r in rules], index))

    @F.pandas_udf("rule string, verdict string, pattern string")
    def judged(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        judge = Judge(*held.value)
        for part in parts:
            yield pd.DataFrame([judge(*x) for x in zip(*part, strict=True)], columns=["rule", "verdict", "pattern"])

    host, path = host_and_path(F.col("url"))
    out = rows.select("id", "url", host.alias("host"), path.alias("path")).withColumn("j", judged("url", "host", "path"))
    return out.select(F.col("id").alias(id_col), "host", "path", "j.rule", "j.verdict", "j.pattern")
