"""Content-stream signals aligned with high-risk outcomes of their document: over an event graph, or by shared objects where there is none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.operators.graph import meetings
from corpuscle.session import stash

#: Kinds of signals and of outcomes, stages that make any finding an outcome, and outcome types of high risk.
SIGNALS = ["content_stream_anomaly", "content_stream_gstate_abuse", "content_stream_marked_evasion", "content_stream_resource_name_obfuscation"]
OUTCOMES = ["action_remote_target_suspicious", "launch_embedded_file", "submitform_present", "xfa_submit", "js_suspicious", "js_obfuscated"]
OUTCOME_STAGES = ["execute", "egress"]
HIGH_RISK = ["code_execution", "network_egress", "form_submission", "external_launch"]
UNKNOWN_EVENT, UNKNOWN_OUTCOME = "unknown_event_node", "unknown_outcome_node"


def is_signal() -> Column:
    return F.col("kind").isin(SIGNALS)


def is_outcome() -> Column:
    return F.col("kind").isin(OUTCOMES) | F.coalesce(F.col("meta")["chain.stage"].isin(OUTCOME_STAGES), F.lit(False))


def finding_nodes(nodes: DataFrame, edges: DataFrame, wanted: Column) -> DataFrame:
    """doc, id, node: nodes of the wanted sort at either end of the edges that a finding gave."""
    ends = edges.filter("finding_id is not null").select("doc", F.col("finding_id").alias("id"), F.explode(F.array("src", "dst")).alias("node")).distinct()
    return ends.join(nodes.filter(wanted).select("doc", F.col("node_id").alias("node")).distinct(), ["doc", "node"]).select("doc", "id", "node")


def classes(findings: DataFrame, at: DataFrame, side: str) -> DataFrame:
    """Findings of one kind and one set of nodes count as their first by seq: doc, id, kind, seq and nodes, named after the side."""
    sets = at.groupBy("doc", "id").agg(F.array_sort(F.collect_set("node")).alias("nodes"))
    met = findings.select("doc", "id", "kind", "seq").join(sets, ["doc", "id"])
    grouped = met.groupBy("doc", F.col("kind").alias(f"{side}_kind"), F.col("nodes").alias(f"{side}_nodes"))
    return stash(grouped.agg(F.min_by("id", "seq").alias(f"{side}_id"), F.min("seq").alias(f"{side}_seq")), f"classes_{side}")


def told(pairs: DataFrame) -> DataFrame:
    """One row a pair of nodes and kinds, named by the first findings that give it."""
    keys = ["doc", "event_node", "outcome_node", "signal_kind", "outcome_kind"]
    first = pairs.groupBy(*keys).agg(F.min_by(F.struct("hops", "signal_id", "outcome_id"), F.struct("signal_seq", "outcome_seq")).alias("f"))
    ids = F.array_join(F.array_sort(F.array_distinct(F.array("f.signal_id", "f.outcome_id"))), ",")
    return first.select(*keys, F.col("f.hops").alias("hops"), F.lit("high").alias("severity"), F.lit("strong").alias("confidence"), ids.alias("finding_ids"))


def align_over_graph(findings: DataFrame, nodes: DataFrame, edges: DataFrame, most: int = 3) -> DataFrame:
    """Signals and outcomes whose nodes lie within ``most`` undirected hops; of their node pairs the first by name speaks for them.

    The search runs from both ends, so pairs arise only where the fronts meet; findings alike in kind and nodes go as one.
    """
    ours = classes(findings.filter(is_signal()), finding_nodes(nodes, edges, F.col("event_type") == "content_stream_exec"), "signal")
    theirs = classes(findings.filter(is_outcome()), finding_nodes(nodes, edges, F.col("outcome_type").isin(HIGH_RISK)), "outcome")
    each = lambda df, side, name: df.select("*", F.explode(f"{side}_nodes").alias(name))
    one, two = each(ours, "signal", "a"), each(theirs, "outcome", "b")
    near = meetings(edges, one.select("doc", F.col("a").alias("node")), two.select("doc", F.col("b").alias("node")), most)
    met = one.join(near, ["doc", "a"]).join(two, ["doc", "b"])
    path = met.groupBy("doc", "signal_id", "signal_kind", "signal_seq", "outcome_id", "outcome_kind", "outcome_seq").agg(F.min(F.struct("a", "b", "hops")).alias("p"))
    return told(path.select("*", F.col("p.a").alias("event_node"), F.col("p.b").alias("outcome_node"), F.col("p.hops").cast("int").alias("hops")))


def align_by_object(findings: DataFrame) -> DataFrame:
    """The same without a graph: signals and outcomes on one object, one hop apart, under the nodes that their metadata names."""

    def side(rows: DataFrame, name: str, node: str, unknown: str) -> DataFrame:
        at = rows.select("doc", "id", "kind", "seq", F.coalesce(F.col("meta")["event.node_id"], F.lit(unknown)).alias(node), F.explode(F.array_distinct("objects")).alias("object"))
        return at.groupBy("doc", "object", node, F.col("kind").alias(f"{name}_kind")).agg(F.min_by("id", "seq").alias(f"{name}_id"), F.min("seq").alias(f"{name}_seq"))

    met = side(findings.filter(is_signal()), "signal", "event_node", UNKNOWN_EVENT).join(side(findings.filter(is_outcome()), "outcome", "outcome_node", UNKNOWN_OUTCOME), ["doc", "object"])
    return told(met.withColumn("hops", F.lit(1)))
