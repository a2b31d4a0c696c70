"""Connected components of an undirected link table, as Spark joins.

Labels start as the node itself; each round takes the smallest label among a node and its neighbours
and then the label of that label. Chains shrink by more than half a round, so few rounds are needed.
Labels of labels are looked up with a salt, since all nodes of a large component ask for one. Nothing is
gathered but one count a round. Null ends and self links are ignored; repeated links are fine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.session import Scratch

SALTS = 16


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) for every node of ``links`` (a, b)."""
    both = links.filter("a is not null and b is not null and a <> b")
    both = both.select(F.col("a").alias("node"), F.col("b").alias("other")).union(both.select("b", "a")).distinct()
    kept, last = Scratch(links.sparkSession), Scratch(links.sparkSession)
    both = kept.stash(both, "links")
    labels = last.stash(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("component")), "labels")
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int").alias("salt")
    for _ in range(rounds):
        there = labels.select(F.col("node").alias("other"), F.col("component").alias("far"))
        near = both.join(there, "other").groupBy("node").agg(F.min("far").alias("far"))
        lower = last.stash(labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "far").alias("component")), "lower")
        up = lower.select(F.col("node").alias("component"), F.col("component").alias("above")).filter("above < component")
        up = up.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        jumped = lower.select("*", salt).join(up, ["component", "salt"], "left").select("node", "was", F.least("component", F.coalesce("above", "component")).alias("component"))
        following = Scratch(links.sparkSession)
        jumped = following.stash(jumped, "labels")
        last.clear()
        labels, last = jumped.select("node", "component"), following
        if jumped.filter("was <> component").isEmpty():
            kept.clear()
            return labels
    raise RuntimeError(f"components have not settled after {rounds} rounds")
