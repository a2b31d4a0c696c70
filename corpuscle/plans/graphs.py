"""Queries of graph work: numbering, limits, components, cycles and paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.operators import context, cycles, graph
from corpuscle.plans import bindings as b
from corpuscle.plans.queries import query

TN_SQL = f"{b.TRANSITIONS_SQL}, tn AS (SELECT doc, src AS node FROM te UNION SELECT doc, dst FROM te)"


@query("edge_index", f"""WITH {b.EDGES_SQL}, n AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS i FROM (SELECT src AS node FROM ed UNION SELECT dst FROM ed))
  SELECT CAST(a.i AS BIGINT) AS src_i, CAST(c.i AS BIGINT) AS dst_i FROM ed JOIN n a ON ed.src = a.node JOIN n c ON ed.dst = c.node""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = b.typed_edges(spark, sf_dir)
    return graph.edge_index(e.select("doc", F.col("src").alias("node_id")), e).select(F.col("src_i").cast("long").alias("src_i"), F.col("dst_i").cast("long").alias("dst_i"))


@query("edge_index_by_graph", f"""WITH {TN_SQL}, n AS (SELECT doc, node, row_number() OVER (PARTITION BY doc ORDER BY node) - 1 AS i FROM tn)
  SELECT te.doc, CAST(a.i AS BIGINT) AS src_i, CAST(c.i AS BIGINT) AS dst_i, count(*) AS n FROM te JOIN n a ON te.doc = a.doc AND te.src = a.node JOIN n c ON te.doc = c.doc AND te.dst = c.node GROUP BY ALL""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = b.transitions(spark, sf_dir)
    return graph.edge_index(e.select("doc", F.col("src").alias("node_id")), e).groupBy("doc", F.col("src_i").cast("long").alias("src_i"), F.col("dst_i").cast("long").alias("dst_i")).agg(F.count("*").alias("n"))


LIMIT_NODES, LIMIT_EDGES = 30, 25
LIMIT_SQL = f"""WITH {b.EVENT_GRAPH_SQL}, kept AS (SELECT doc, node_id FROM en QUALIFY row_number() OVER (PARTITION BY doc ORDER BY CASE node_kind WHEN 'event' THEN 0 WHEN 'outcome' THEN 1 ELSE 2 END, node_id) <= {LIMIT_NODES}),
inside AS (SELECT ee.* FROM ee JOIN kept a ON a.doc = ee.doc AND a.node_id = src JOIN kept c ON c.doc = ee.doc AND c.node_id = dst), edges AS (SELECT * FROM inside QUALIFY row_number() OVER (PARTITION BY doc ORDER BY src, dst, seq) <= {LIMIT_EDGES})"""


@query("graph_limit_nodes", f"{LIMIT_SQL} SELECT doc, node_id FROM kept")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.limit_graph(*b.event_graph(spark, sf_dir), LIMIT_NODES, LIMIT_EDGES)[0].select("doc", "node_id")


@query("graph_limit_edges", f"{LIMIT_SQL} SELECT doc, src, dst, finding_id FROM edges")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.limit_graph(*b.event_graph(spark, sf_dir), LIMIT_NODES, LIMIT_EDGES)[1].select("doc", "src", "dst", "finding_id")


@query("graph_limit", f"""{LIMIT_SQL}, c AS (SELECT doc, (SELECT count(*) FROM en WHERE en.doc = d.doc) nodes, (SELECT count(*) FROM ee WHERE ee.doc = d.doc) edges, (SELECT count(*) FROM kept WHERE kept.doc = d.doc) kn, (SELECT count(*) FROM edges WHERE edges.doc = d.doc) ke FROM (SELECT DISTINCT doc FROM en) d)
  SELECT doc, nodes, edges, nodes - kn AS dropped_nodes, edges - ke AS dropped_edges, 'Truncated graph (nodes ' || nodes || ', edges ' || edges || ')' AS label FROM c WHERE nodes > kn OR edges > ke""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.limit_graph(*b.event_graph(spark, sf_dir), LIMIT_NODES, LIMIT_EDGES)[2]


@query("find_cycles", f"""WITH RECURSIVE {b.TRANSITIONS_SQL}, s AS (SELECT DISTINCT doc, src, dst FROM te), w(doc, start, node, path) AS (SELECT doc, src, dst, [src, dst] FROM s WHERE dst > src UNION ALL SELECT w.doc, w.start, s.dst, list_append(w.path, s.dst) FROM w JOIN s ON w.doc = s.doc AND w.node = s.src WHERE len(w.path) < 4 AND s.dst > w.start AND NOT list_contains(w.path, s.dst)),
  c AS (SELECT doc, [src] AS p FROM s WHERE src = dst UNION ALL SELECT w.doc, w.path FROM w JOIN s ON w.doc = s.doc AND w.node = s.src AND s.dst = w.start)
  SELECT DISTINCT doc, list_aggregate(least(p, list_concat([p[1]], list_reverse(p[2:]))), 'string_agg', '>') AS cycle, CAST(len(p) AS INTEGER) AS length FROM c""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cycles.find_cycles(b.transitions(spark, sf_dir), 4).select("doc", F.array_join("cycle", ">").alias("cycle"), "length")


@query("classify_cycles", f"""WITH {b.RINGS_SQL}, l AS (SELECT doc, list(node ORDER BY key) AS l, count(*) AS n, count(*) FILTER (type = 'pages') AS pages, count(*) FILTER (type <> 'other') AS paged FROM rg GROUP BY doc),
  c AS (SELECT *, list_position(l, list_min(l)) AS pos FROM l), r AS (SELECT *, list_concat(l[pos:], l[:pos - 1]) AS p FROM c), sorted AS (SELECT *, CASE WHEN n = 1 THEN 'self_reference' WHEN n = 2 AND paged = 2 AND pages > 0 THEN 'page_tree_parent_child'
    WHEN n <= 6 AND paged = n THEN 'page_tree_small_cycle' WHEN n <= 6 THEN 'small_cycle' WHEN n > 100 THEN 'extremely_large_cycle' ELSE 'large_cycle' END AS sort FROM r)
  SELECT doc, list_aggregate(least(p, list_concat([p[1]], list_reverse(p[2:]))), 'string_agg', '>') AS cycle, CAST(n AS INTEGER) AS length, sort,
    CASE sort WHEN 'page_tree_parent_child' THEN 'info' WHEN 'page_tree_small_cycle' THEN 'low' WHEN 'small_cycle' THEN 'medium' WHEN 'extremely_large_cycle' THEN 'critical' ELSE 'high' END AS severity FROM sorted""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, types = b.rings(spark, sf_dir)
    return cycles.classify_cycles(cycles.find_cycles(edges, 6), types).withColumn("cycle", F.array_join("cycle", ">"))


@query("strong_components", f"""WITH RECURSIVE {b.EVENT_GRAPH_SQL}, s AS (SELECT DISTINCT doc, src, dst FROM ee), w(doc, a, b) AS (SELECT doc, src, dst FROM s UNION SELECT w.doc, w.a, s.dst FROM w JOIN s ON w.doc = s.doc AND w.b = s.src),
  c AS (SELECT x.doc, x.a AS node, x.b AS other FROM w x JOIN w y ON x.doc = y.doc AND x.a = y.b AND x.b = y.a) SELECT doc, node, min(other) AS component, count(*) AS size FROM c GROUP BY doc, node""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cycles.strong_components(b.event_graph(spark, sf_dir)[1])


@query("shortest_cycles", f"""WITH RECURSIVE {b.EVENT_GRAPH_SQL}, s AS (SELECT DISTINCT doc, src, dst FROM ee), w(doc, a, b, h) AS (SELECT doc, src, dst, 1 FROM s UNION SELECT w.doc, w.a, s.dst, w.h + 1 FROM w JOIN s ON w.doc = s.doc AND w.b = s.src WHERE w.h < 8 AND w.b <> w.a)
  SELECT doc, a AS node, CAST(min(h) AS INTEGER) AS length FROM w WHERE a = b GROUP BY doc, a""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cycles.shortest_cycles(b.event_graph(spark, sf_dir)[1], 8)


@query("reachable_from", f"""WITH RECURSIVE {b.EDGES_SQL}, w(seed, node, hops) AS (SELECT DISTINCT src, src, 0 FROM ed WHERE edge_type = 'places' AND suspicious UNION SELECT w.seed, ed.dst, w.hops + 1 FROM w JOIN ed ON w.node = ed.src WHERE w.hops < 3)
  SELECT seed, node, CAST(min(hops) AS INTEGER) AS hops FROM w GROUP BY seed, node""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = b.typed_edges(spark, sf_dir)
    seeds = e.filter("edge_type = 'places' and suspicious").select("doc", F.col("src").alias("node"))
    return graph.distances(e, seeds, 3, cut_every=1).select("seed", "node", "hops")


@query("reachable_from_each", f"""WITH RECURSIVE {b.EVENT_GRAPH_SQL}, s AS (SELECT DISTINCT doc, src, dst FROM ee), w(doc, seed, node, hops) AS (SELECT doc, node_id, node_id, 0 FROM en WHERE node_kind = 'event' UNION SELECT w.doc, w.seed, s.dst, w.hops + 1 FROM w JOIN s ON w.doc = s.doc AND w.node = s.src WHERE w.hops < 3)
  SELECT doc, seed, node, CAST(min(hops) AS INTEGER) AS hops FROM w GROUP BY doc, seed, node""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = b.event_graph(spark, sf_dir)
    return graph.distances(edges, nodes.filter("node_kind = 'event'").select("doc", F.col("node_id").alias("node")), 3)


@query("reachable_paths", f"""WITH RECURSIVE {b.EVENT_GRAPH_SQL}, s AS (SELECT DISTINCT doc, src, dst FROM ee), w(doc, seed, node, path) AS (SELECT doc, node_id, node_id, [node_id] FROM en WHERE event_type = 'page_open'
    UNION ALL SELECT w.doc, w.seed, s.dst, list_append(w.path, s.dst) FROM w JOIN s ON w.doc = s.doc AND w.node = s.src WHERE len(w.path) <= 4 AND NOT list_contains(w.path, s.dst))
  SELECT doc, seed, node, array_to_string(arg_min(path, struct_pack(n := len(path), p := path)), '>') AS path FROM w GROUP BY doc, seed, node""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = b.event_graph(spark, sf_dir)
    return graph.reachable_paths(edges, nodes.filter("event_type = 'page_open'").select("doc", F.col("node_id").alias("node")), 4).withColumn("path", F.array_join("path", ">"))


@query("null_chain", f"""WITH RECURSIVE {b.EVENT_GRAPH_SQL}, there AS (SELECT doc, node_id FROM en WHERE outcome_type IS DISTINCT FROM 'parser_failure'), s AS (SELECT DISTINCT ee.doc, src, dst, t.node_id IS NULL AS gone FROM ee LEFT JOIN there t ON t.doc = ee.doc AND t.node_id = dst),
  w(doc, start, node, path, gone) AS (SELECT doc, node_id, node_id, [node_id], false FROM there WHERE (doc, node_id) IN (SELECT (doc, src) FROM s) UNION ALL SELECT w.doc, start, dst, list_append(path, dst), s.gone FROM w JOIN s ON s.doc = w.doc AND s.src = w.node WHERE NOT w.gone AND len(path) <= 6 AND NOT list_contains(path, dst))
  SELECT doc, start, array_to_string(path, '>') AS path, CAST(len(path) - 1 AS INTEGER) AS depth, CASE WHEN len(path) > 5 THEN 'high' ELSE 'medium' END AS severity FROM w WHERE gone AND len(path) > 3 QUALIFY row_number() OVER (PARTITION BY doc, start ORDER BY len(path), path) <= 4""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = b.event_graph(spark, sf_dir)
    there = nodes.filter("outcome_type is distinct from 'parser_failure'")
    return graph.dangling_chains(edges, there, 3, 6).select("doc", "start", F.array_join("path", ">").alias("path"), "depth", "severity")


DEPTH_SQL = f"""WITH RECURSIVE {b.EVENT_GRAPH_SQL}, s AS (SELECT DISTINCT doc, src, dst FROM ee), w(doc, node, d) AS (SELECT doc, node_id, 0 FROM en WHERE event_type = 'page_open' AND node_id < 'signup@3' UNION SELECT w.doc, s.dst, w.d + 1 FROM w JOIN s ON w.doc = s.doc AND w.node = s.src WHERE w.d < 30),
  far AS (SELECT doc, node, min(d) d FROM w GROUP BY doc, node)"""


def _roots(nodes: DataFrame) -> DataFrame:
    return nodes.filter("event_type = 'page_open' and node_id < 'signup@3'").select("doc", F.col("node_id").alias("node"))


@query("depths_from_root", f"{DEPTH_SQL} SELECT doc, CAST(max(d) AS INTEGER) AS max_depth, round(avg(d), 6) AS avg_depth, count(*) AS nodes FROM far GROUP BY doc")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = b.event_graph(spark, sf_dir)
    return graph.depths(edges, _roots(nodes), 30).withColumn("avg_depth", F.round("avg_depth", 6))


#: From the first customer of each nation or region along the ring: depths below, between and above the bounds, and a capped one.
@query("reference_depth", f"""WITH {b.RINGS_SQL}, n AS (SELECT doc, least(count(*) - 1, 64) AS d FROM rg GROUP BY doc)
  SELECT doc, CAST(d AS INTEGER) AS max_depth, d + 1 AS nodes, d >= 64 AS capped, CASE WHEN d > 50 THEN 'high' WHEN d > 20 THEN 'medium' ELSE 'info' END AS severity FROM n""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, types = b.rings(spark, sf_dir)
    first = types.groupBy("doc").agg(F.min("node").alias("node"))
    return graph.reference_depth(edges, first).select("doc", "max_depth", "nodes", "capped", "severity")


@query("induced_subgraph_hops", f"""WITH {b.EDGES_SQL}, u AS (SELECT src a, dst b FROM ed UNION SELECT dst, src FROM ed), seeds AS (SELECT DISTINCT src AS x FROM ed WHERE edge_type = 'in' AND suspicious), one AS (SELECT x FROM seeds UNION SELECT b FROM u WHERE a IN (SELECT x FROM seeds)),
  near AS (SELECT x FROM one UNION SELECT b FROM u WHERE a IN (SELECT x FROM one)) SELECT src, dst, edge_type FROM ed WHERE src IN (SELECT x FROM near) AND dst IN (SELECT x FROM near)""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = b.typed_edges(spark, sf_dir)
    return graph.induced_subgraph(e, e.filter("edge_type = 'in' and suspicious").select("doc", F.col("src").alias("node")), 2).select("src", "dst", "edge_type")


CHAIN_SQL = f"""WITH RECURSIVE {b.TRANSITIONS_SQL}, w(doc, chain, node, path, kinds) AS (SELECT doc, seq, dst, [src, dst], [edge_type] FROM te WHERE edge_type = 'open'
    UNION ALL SELECT doc, chain, p.dst, list_append(path, p.dst), list_append(kinds, 'next') FROM (SELECT w.doc, w.chain, w.path, w.kinds, arg_min(te.dst, te.seq) AS dst FROM w JOIN te ON te.doc = w.doc AND te.src = w.node AND te.edge_type = 'next'
      WHERE len(w.path) <= 5 AND NOT list_contains(w.path, te.dst) GROUP BY ALL) p(doc, chain, path, kinds, dst)),
  ac AS (SELECT doc, chain, path, kinds FROM w QUALIFY row_number() OVER (PARTITION BY doc, chain ORDER BY len(path) DESC) = 1)"""


@query("action_chains", f"{CHAIN_SQL} SELECT doc, chain, array_to_string(path, '>') AS path FROM ac")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chains(spark, sf_dir).select("doc", "chain", F.array_join("path", ">").alias("path"))


def _chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.action_chains(b.transitions(spark, sf_dir), F.col("edge_type") == "open", F.col("edge_type") == "next", 5)


@query("query_chain_grouping", f"""{CHAIN_SQL}, x AS (SELECT *, kinds[1] AS trigger, path[-1] AS payload, array_to_string(kinds, '>') AS signature FROM ac)
  SELECT doc, arg_min(chain, struct_pack(r := -len(path), c := chain)) AS chain, trigger, payload, signature, count(*) AS members FROM x GROUP BY doc, trigger, payload, signature""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.group_paths(_chains(spark, sf_dir).withColumn("risk", F.size("path") * 0.1)).select("doc", "chain", "trigger", "payload", "signature", "members")
