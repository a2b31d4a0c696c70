"""Queries of joins between findings, streams and event graphs, and of places in an order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.operators import alignment, intervals
from corpuscle.plans import bindings as b
from corpuscle.plans.queries import found, query
from corpuscle.session import stash

#: One stream a kind of a document: from its first offset, 500 bytes long, but 100,000 for scripts and none for phishing.
STREAMS_SQL = """st AS (SELECT doc, 's' || kind AS stream, min(off) AS start, CASE WHEN starts_with(kind, 'js') THEN 100000 WHEN kind = 'content_phishing' THEN 0 ELSE 500 END AS length,
  max(objects[2]) AS object, min(objects[1]) AS page FROM f GROUP BY doc, kind)"""


def streams(f: DataFrame) -> DataFrame:
    length = F.when(F.startswith("kind", F.lit("js")), 100_000).when(F.col("kind") == "content_phishing", 0).otherwise(500).cast("long")
    per = f.groupBy("doc", "kind").agg(F.min(F.get("evidence", F.lit(0))["offset"]).alias("start"), F.max(F.get("objects", F.lit(1))).alias("object"), F.min(F.get("objects", F.lit(0))).alias("page"))
    return per.select("doc", F.concat(F.lit("s"), "kind").alias("stream"), "start", length.alias("length"), "object", "page")


@found("interval_evidence_match", f", {STREAMS_SQL} SELECT DISTINCT f.doc, s.stream, f.id FROM f JOIN st s ON f.doc = s.doc AND f.off >= s.start AND f.off < s.start + s.length")
def _(f: DataFrame) -> DataFrame:
    return intervals.match_streams(f, streams(f))


@found("content_stream_findings", f""", {STREAMS_SQL} SELECT s.doc, s.stream, f.id, f.kind, f.severity, f.sev AS rank, CASE f.kind WHEN 'content_invisible_text' THEN 'InvisibleRenderingMode' END AS anomaly,
  CASE WHEN f.off >= s.start AND f.off < s.start + s.length THEN f.off END AS decoded_offset
  FROM f JOIN st s ON f.doc = s.doc AND (list_contains(f.objects, s.object) OR list_contains(f.objects, s.page) OR (f.off >= s.start AND f.off < s.start + s.length))""")
def _(f: DataFrame) -> DataFrame:
    return intervals.stream_findings(f, streams(f), "file")


#: Signals and outcomes as the kinds and the stages say; nodes of findings; undirected distances up to three from every signal's node.
ALIGNMENT_SQL = f"""{b.FINDINGS_SQL}, {b.EVENT_GRAPH_SQL},
sg AS (SELECT * FROM f WHERE kind IN ('content_stream_anomaly', 'content_stream_gstate_abuse', 'content_stream_marked_evasion', 'content_stream_resource_name_obfuscation')),
oc AS (SELECT * FROM f WHERE stage IN ('execute', 'egress') OR kind IN ('action_remote_target_suspicious', 'launch_embedded_file', 'submitform_present', 'xfa_submit', 'js_suspicious', 'js_obfuscated'))"""
LAST_SQL = """SELECT doc, event_node, outcome_node, signal_kind, outcome_kind, p.hops AS hops, 'high' AS severity, 'strong' AS confidence, CASE WHEN p.s = p.o THEN p.s ELSE least(p.s, p.o) || ',' || greatest(p.s, p.o) END AS finding_ids
  FROM (SELECT doc, event_node, outcome_node, signal_kind, outcome_kind, arg_min(struct_pack(hops := hops, s := s_id, o := o_id), struct_pack(a := s_seq, b := o_seq)) AS p FROM pairs GROUP BY ALL)"""


@query("exec_outcome_alignment", f"""WITH RECURSIVE {ALIGNMENT_SQL}, u AS (SELECT doc, src a, dst b FROM ee UNION SELECT doc, dst, src FROM ee), ends AS (SELECT doc, finding_id id, src node FROM ee UNION SELECT doc, finding_id, dst FROM ee),
sn AS (SELECT ends.doc, id, node FROM ends JOIN en ON en.doc = ends.doc AND en.node_id = node AND en.event_type = 'content_stream_exec'), onn AS (SELECT ends.doc, id, node FROM ends JOIN en ON en.doc = ends.doc AND en.node_id = node AND en.outcome_type = 'network_egress'),
w(doc, seed, node, h) AS (SELECT DISTINCT sn.doc, node, node, 0 FROM sn JOIN sg ON sg.id = sn.id UNION SELECT w.doc, w.seed, u.b, w.h + 1 FROM w JOIN u ON u.doc = w.doc AND u.a = w.node WHERE w.h < 3),
near AS (SELECT doc, seed, node, min(h) h FROM w GROUP BY ALL),
pairs AS (SELECT doc, s_id, s_seq, signal_kind, o_id, o_seq, outcome_kind, p.a AS event_node, p.b AS outcome_node, p.h AS hops FROM (
  SELECT sg.doc, sg.id s_id, sg.seq s_seq, sg.kind signal_kind, oc.id o_id, oc.seq o_seq, oc.kind outcome_kind, min(struct_pack(a := sn.node, b := onn.node, h := near.h)) p
  FROM sg JOIN sn ON sn.id = sg.id JOIN near ON near.doc = sg.doc AND near.seed = sn.node JOIN onn ON onn.doc = sg.doc AND onn.node = near.node JOIN oc ON oc.id = onn.id GROUP BY ALL)) {LAST_SQL}""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_over_graph(b.findings(spark, sf_dir), *b.event_graph(spark, sf_dir))


@query("exec_outcome_by_object", f"""WITH {ALIGNMENT_SQL}, pairs AS (SELECT DISTINCT sg.doc, 'unknown_event_node' AS event_node, 'unknown_outcome_node' AS outcome_node, sg.kind signal_kind, oc.kind outcome_kind, CAST(1 AS INTEGER) AS hops, sg.id s_id, oc.id o_id, sg.seq s_seq, oc.seq o_seq
  FROM sg JOIN oc ON sg.doc = oc.doc AND list_has_any(sg.objects, oc.objects)) {LAST_SQL}""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_by_object(b.findings(spark, sf_dir))


U_SQL = f"WITH RECURSIVE {b.EDGES_SQL}, u AS (SELECT src a, dst b FROM ed UNION SELECT dst, src FROM ed)"


@query("shortest_hops_within", f"""{U_SQL}, w(nation, node, h) AS (SELECT DISTINCT a, a, 0 FROM u WHERE a LIKE 'n%' UNION SELECT w.nation, u.b, w.h + 1 FROM w JOIN u ON w.node = u.a WHERE w.h < 3)
  SELECT node AS supplier, nation, CAST(min(h) AS INTEGER) AS hops FROM w WHERE node LIKE 's%' GROUP BY node, nation""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and nations at most three undirected hops apart, over edges of every type; the nations are few and go the step more."""
    from corpuscle.operators import graph

    e = stash(b.typed_edges(spark, sf_dir), "edges")
    nodes = e.select("doc", F.col("src").alias("node")).union(e.select("doc", "dst"))
    named = lambda p: nodes.filter(F.startswith("node", F.lit(p)))
    return graph.meetings(e, named("n"), named("s"), 3).select(F.col("b").alias("supplier"), F.col("a").alias("nation"), F.col("hops").cast("int").alias("hops"))
