"""Named rules as columns: the extension point. A rule set becomes one projection; nothing runs row by row."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIERS = {"fast": ("cheap",), "default": ("cheap", "moderate"), "deep": ("cheap", "moderate", "expensive")}


@dataclass(frozen=True)
class NamedRule:
    id: str
    surface: str
    severity: str
    confidence: str
    condition: Column
    cost: str = "cheap"


@dataclass
class RuleSet:
    rules: list[NamedRule] = field(default_factory=list)

    def add(self, id: str, surface: str, severity: str, confidence: str, condition: Column, cost: str = "cheap") -> RuleSet:  # noqa: A002
        self.rules.append(NamedRule(id, surface, severity, confidence, condition, cost))
        return self

    def run(self, df: DataFrame, *keys: str, tier: str = "default") -> DataFrame:
        """keys, rule, surface, severity, confidence for every rule of the tier that holds; the tier is chosen before planning."""
        chosen = [r for r in self.rules if r.cost in TIERS[tier]]
        cells = [F.when(r.condition, F.struct(F.lit(r.id).alias("rule"), F.lit(r.surface).alias("surface"), F.lit(r.severity).alias("severity"), F.lit(r.confidence).alias("confidence"))) for r in chosen]
        return df.select(*keys, F.explode(F.array_compact(F.array(*cells))).alias("r")).select(*keys, "r.*")

    def profile(self, df: DataFrame, tier: str = "default") -> DataFrame:
        """rule, n and share of all hits."""
        counts = self.run(df, tier=tier).groupBy("rule").agg(F.count("*").alias("n"))
        return counts.join(F.broadcast(counts.agg(F.sum("n").alias("t")))).select("rule", "n", F.round(F.col("n") / F.col("t") * 100, 2).alias("percent"))
