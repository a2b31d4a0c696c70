"""The library's inputs, derived from the given tables: findings from events, typed edges from orders, and so on.

Each binding comes as a DataFrame and as the same rows in SQL (for the checks).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.schemas import CONFIDENCES, STAGES, SURFACES
from corpuscle.session import read_table

#: The kinds that the number in an event's properties stands for.
KINDS = [
    "js_present", "open_action_present", "launch_action_present", "embedded_file_present", "uri_content_analysis", "submitform_present",
    "xref_conflict", "content_stream_anomaly", "annotation_action_chain", "decoder_risk_present", "image.jbig2_present", "font.dynamic_parse_failure",
    "launch_embedded_file", "embedded_executable_present", "filter_chain_unusual", "stream_high_entropy", "ocg_present", "pdfjs_form_injection",
    "pdfjs_eval_path_risk", "image.decode_skipped", "js_polymorphic", "incremental_update_chain", "content_phishing", "richmedia_present", "label_mismatch_stream_type",
]


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One finding an event; the user is the document, the event number its place."""
    e = read_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "ts", F.get_json_object("props", "$.k").cast("int").alias("k"))
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    v, k, n = F.col("value"), F.col("k"), F.col("event_id")
    severity = F.when(v >= 200, "critical").when(v >= 100, "high").when(v >= 50, "medium").when(v >= 20, "low").otherwise("info")
    meta = F.map_from_arrays(
        F.array(*map(F.lit, ["page.number", "hash", "entropy", "action.target", "js.contains_eval", "chain.stage", "js.obfuscation_score", "buckets", "is_composite", "exploit.preconditions", "exploit.satisfied"])),
        F.array(
            (k % 12).cast("string"), F.concat(F.lit("h"), k % 25), (F.floor(v) / 25).cast("string"), F.concat(F.lit("http://host"), k % 9, F.lit(".example.com/p?x="), n % 5),
            F.when(k % 5 == 0, "true").otherwise("false"), pick(STAGES, k % 5), (k / 100).cast("string"), F.concat(F.lit("loop:"), k % 3, F.lit(",timeout")), F.when(k % 11 == 0, "true").otherwise("false"),
            F.concat(F.lit("cond"), k % 4, F.lit("; cond"), k % 7), F.concat(F.lit("cond"), n % 3),
        ),
    )
    offset = (k * 100 + n % 100).cast("long")
    evidence = F.array(F.struct(F.lit("file").alias("source"), offset.alias("offset"), F.lit(10).alias("length"), F.lit(None).cast("struct<start:bigint,end:bigint>").alias("origin"), F.lit(None).cast("string").alias("note")))
    return e.select(
        F.col("user_id").cast("string").alias("doc"), n.alias("seq"), F.concat(F.lit("f"), n).alias("id"), pick(SURFACES, k % 13).alias("surface"), pick(KINDS, k % 25).alias("kind"), severity.alias("severity"),
        pick(CONFIDENCES, n % 6).alias("confidence"), F.when(k % 3 == 0, "high").alias("impact"), F.col("event_type").alias("title"), F.concat(F.col("event_type"), F.lit(" seen")).alias("description"),
        F.array(F.concat(k % 20, F.lit(" 0 obj")), F.concat(n % 7 + 20, F.lit(" 0 obj"))).alias("objects"), evidence.alias("evidence"), F.lit(None).cast("string").alias("remediation"),
        F.concat(F.lit("p"), k % 12).alias("position"), F.array(F.concat(F.lit("p"), k % 12)).alias("positions"), meta.alias("meta"), F.when(k % 2 == 0, "uri").alias("action_type"),
        F.concat(F.lit("http://host"), k % 9, F.lit(".example.com/")).alias("action_target"), F.when(k % 4 == 0, "automatic").otherwise("user").alias("action_initiation"), "ts",
    )


def _list(names: list[str]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


FINDINGS_SQL = f"""e AS (SELECT event_id n, user_id, event_type, value v, ts, CAST(json_extract(props, '$.k') AS INTEGER) k FROM events),
f AS (SELECT CAST(user_id AS VARCHAR) doc, n seq, 'f' || n id, {_list(SURFACES)}[k % 13 + 1] surface, {_list(KINDS)}[k % 25 + 1] kind,
  CASE WHEN v >= 200 THEN 'critical' WHEN v >= 100 THEN 'high' WHEN v >= 50 THEN 'medium' WHEN v >= 20 THEN 'low' ELSE 'info' END severity,
  CASE WHEN v >= 200 THEN 4 WHEN v >= 100 THEN 3 WHEN v >= 50 THEN 2 WHEN v >= 20 THEN 1 ELSE 0 END sev,
  {_list(CONFIDENCES)}[n % 6 + 1] confidence, CAST(n % 6 AS INTEGER) conf, CASE WHEN k % 3 = 0 THEN 'high' END impact, event_type title, event_type || ' seen' description,
  [(k % 20) || ' 0 obj', (n % 7 + 20) || ' 0 obj'] objects, CAST(k * 100 + n % 100 AS BIGINT) off, 'p' || (k % 12) position, ts, k, n, v, event_type,
  CAST(k % 12 AS VARCHAR) page, 'h' || (k % 25) hash, floor(v) / 25 entropy, 'http://host' || (k % 9) || '.example.com/p?x=' || (n % 5) target, k % 5 = 0 has_eval,
  {_list(STAGES)}[k % 5 + 1] stage, k % 5 stage_rank, k / 100.0::DOUBLE obf, 'uri' action FROM e)"""


def typed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer, order, part, supplier, nation and region as one graph of typed edges."""
    t = {n: read_table(spark, sf_dir, n) for n in ("orders", "lineitem", "supplier", "nation")}
    node = lambda p, c: F.concat(F.lit(p), F.col(c))
    edge = lambda df, a, b, kind, bad: df.select(a.alias("src"), b.alias("dst"), F.lit(kind).alias("edge_type"), bad.alias("suspicious"))
    parts = [
        edge(t["orders"], node("c", "o_custkey"), node("o", "o_orderkey"), "places", F.col("o_totalprice") > 300_000),
        edge(t["lineitem"], node("o", "l_orderkey"), node("s", "l_suppkey"), "made_by", F.lit(False)),
        edge(t["supplier"], node("s", "s_suppkey"), node("n", "s_nationkey"), "in", F.col("s_acctbal") < 0),
        edge(t["nation"], node("n", "n_nationkey"), node("r", "n_regionkey"), "in", F.lit(False)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct().select(F.lit("g").alias("doc"), "src", "dst", "edge_type", "suspicious")


EDGES_SQL = """ed AS (SELECT DISTINCT * FROM (
  SELECT 'c' || o_custkey src, 'o' || o_orderkey dst, 'places' edge_type, o_totalprice > 300000 suspicious FROM orders
  UNION ALL SELECT 'o' || l_orderkey, 's' || l_suppkey, 'made_by', false FROM lineitem
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'in', s_acctbal < 0 FROM supplier
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'in', false FROM nation))"""


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user, edges between the event types that follow one another."""
    from pyspark.sql import Window

    e = read_table(spark, sf_dir, "events")
    after = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    near = e.withColumns({"dst": after, "k": F.get_json_object("props", "$.k").cast("int")}).filter(F.col("dst").isNotNull())
    return near.select(F.col("user_id").cast("string").alias("doc"), F.col("event_type").alias("src"), "dst", F.col("event_id").alias("seq"), F.when(F.col("k") % 2 == 0, "next").otherwise("open").alias("edge_type"))


TRANSITIONS_SQL = """te AS (SELECT CAST(user_id AS VARCHAR) doc, event_type src, dst, event_id seq, CASE WHEN k % 2 = 0 THEN 'next' ELSE 'open' END edge_type FROM (
  SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) dst, CAST(json_extract(props, '$.k') AS INTEGER) k FROM events) WHERE dst IS NOT NULL)"""


def daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, dim, value, n by kind and severity."""
    f = findings(spark, sf_dir).withColumn("date", F.col("ts").cast("date"))
    cells = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("value")) for d in ("kind", "severity")]))
    return f.select("date", cells.alias("c")).groupBy("date", "c.dim", "c.value").agg(F.count("*").alias("n"))


DAILY_SQL = """dc AS (SELECT CAST(ts AS DATE) date, 'kind' dim, kind AS value, count(*) n FROM f GROUP BY ALL UNION ALL SELECT CAST(ts AS DATE), 'severity', severity, count(*) FROM f GROUP BY ALL)"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long features of each document's text: doc, name, value."""
    d = read_table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    cells = {
        "text.chars": F.length(text), "text.bytes": F.octet_length(text), "text.lines": F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1,
        "text.commas": F.length(text) - F.length(F.replace(text, F.lit(","), F.lit(""))), "marks": F.length(text) - F.length(F.replace(text, F.lit("."), F.lit(""))),
    }
    return d.select(F.col("doc_id").cast("string").alias("doc"), F.explode(F.array(*[F.struct(F.lit(n).alias("name"), c.cast("double").alias("value")) for n, c in cells.items()])).alias("x")).select("doc", "x.name", "x.value")


FEATURES_SQL = r"""ft AS (SELECT CAST(doc_id AS VARCHAR) doc, unnest([{'name': 'text.chars', 'value': CAST(length(text) AS DOUBLE)}, {'name': 'text.bytes', 'value': CAST(strlen(text) AS DOUBLE)},
  {'name': 'text.lines', 'value': CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS DOUBLE)}, {'name': 'text.commas', 'value': CAST(length(text) - length(replace(text, ',', '')) AS DOUBLE)},
  {'name': 'marks', 'value': CAST(length(text) - length(replace(text, '.', '')) AS DOUBLE)}], recursive := true) FROM documents)"""


def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc (the page's host) and url."""
    from corpuscle.functions.urls import with_url_parts

    p = with_url_parts(read_table(spark, sf_dir, "pages").select("page_id", "url"), "url")
    return p.select(F.col("u.host").alias("doc"), "page_id", "url")


def event_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of one event graph a user: what happened and a number of its properties, followed by the next; each edge comes from a finding."""
    from pyspark.sql import Window

    e = read_table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    e = e.select(F.col("user_id").cast("string").alias("doc"), "event_id", "ts", "event_type", F.concat("event_type", F.lit("@"), F.col("k") % 10).alias("src"))
    edges = e.withColumn("dst", F.lead("src").over(Window.partitionBy("doc").orderBy("ts", "event_id"))).filter(F.col("dst").isNotNull())
    kind = F.when(F.col("event_type").isin("signup", "click"), "event").when(F.col("event_type").isin("purchase", "error"), "outcome").otherwise("object")
    nodes = e.select("doc", F.col("src").alias("node_id"), kind.alias("node_kind"), F.when(F.col("event_type") == "signup", "page_open").when(F.col("event_type") == "click", "content_stream_exec").alias("event_type"), F.when(F.col("event_type") == "purchase", "network_egress").when(F.col("event_type") == "error", "parser_failure").alias("outcome_type"))
    return nodes.distinct(), edges.select("doc", "src", "dst", F.col("event_id").alias("seq"), F.concat(F.lit("f"), F.col("event_id")).alias("finding_id"))


EVENT_GRAPH_SQL = """ek AS (SELECT CAST(user_id AS VARCHAR) doc, event_id, ts, event_type, event_type || '@' || (CAST(json_extract(props, '$.k') AS INTEGER) % 10) node FROM events),
en AS (SELECT DISTINCT doc, node node_id, CASE WHEN event_type IN ('signup', 'click') THEN 'event' WHEN event_type IN ('purchase', 'error') THEN 'outcome' ELSE 'object' END node_kind,
  CASE event_type WHEN 'signup' THEN 'page_open' WHEN 'click' THEN 'content_stream_exec' END event_type, CASE event_type WHEN 'purchase' THEN 'network_egress' WHEN 'error' THEN 'parser_failure' END outcome_type FROM ek),
ee AS (SELECT * FROM (SELECT doc, node src, lead(node) OVER (PARTITION BY doc ORDER BY ts, event_id) dst, event_id seq, 'f' || event_id finding_id FROM ek) WHERE dst IS NOT NULL)"""


def rings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Edges and node types of many graphs of rings: a customer refers to the next one of its nation and, in another graph, of its region; suppliers
    likewise in their nation, nations (pages) in their region; a nation and its region (page and pages) to each other; a region to itself."""
    from pyspark.sql import Window

    t = {n: read_table(spark, sf_dir, n) for n in ("customer", "supplier", "nation", "region")}
    place = t["nation"].select("n_nationkey", "n_regionkey", "n_name")
    members = lambda df, p, key, of, nation: df.join(place, df[nation] == place["n_nationkey"]).select(F.concat(F.lit(f"{p}:{of}:"), F.col(of)).alias("doc"), F.col(key).alias("key"), F.concat(F.lit(p[0]), F.col(key)).alias("node"), F.lit("other").alias("type"))
    rows = members(t["customer"], "customer", "c_custkey", "n_nationkey", "c_nationkey").unionByName(members(t["customer"], "customer", "c_custkey", "n_regionkey", "c_nationkey"))
    rows = rows.unionByName(members(t["supplier"], "supplier", "s_suppkey", "n_nationkey", "s_nationkey"))
    nations = place.select(F.concat(F.lit("nation:n_regionkey:"), "n_regionkey").alias("doc"), F.col("n_nationkey").alias("key"), F.concat(F.lit("n"), "n_nationkey").alias("node"), F.lit("page").alias("type"))
    rows = rows.unionByName(nations)
    pairs = place.select(F.concat(F.lit("pair:"), "n_nationkey").alias("doc"), F.col("n_nationkey").cast("long").alias("key"), F.concat(F.lit("n"), "n_nationkey").alias("node"), F.lit("page").alias("type")).unionByName(
        place.select(F.concat(F.lit("pair:"), "n_nationkey").alias("doc"), (F.col("n_regionkey") + 1000).cast("long").alias("key"), F.concat(F.lit("r"), "n_regionkey").alias("node"), F.lit("pages").alias("type")))
    alone = t["region"].select(F.concat(F.lit("self:"), "r_regionkey").alias("doc"), F.col("r_regionkey").cast("long").alias("key"), F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit("pages").alias("type"))
    rows = rows.withColumn("key", F.col("key").cast("long")).unionByName(pairs).unionByName(alone)
    w = Window.partitionBy("doc").orderBy("key")
    edges = rows.withColumn("dst", F.coalesce(F.lead("node").over(w), F.first("node").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    return edges.select("doc", F.col("node").alias("src"), "dst"), rows.select("doc", "node", "type")


RINGS_SQL = """rg AS (SELECT 'customer:n_nationkey:' || c_nationkey doc, c_custkey AS key, 'c' || c_custkey node, 'other' AS type FROM customer
  UNION ALL SELECT 'customer:n_regionkey:' || n_regionkey, c_custkey, 'c' || c_custkey, 'other' FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'supplier:n_nationkey:' || s_nationkey, s_suppkey, 's' || s_suppkey, 'other' FROM supplier UNION ALL SELECT 'nation:n_regionkey:' || n_regionkey, n_nationkey, 'n' || n_nationkey, 'page' FROM nation
  UNION ALL SELECT 'pair:' || n_nationkey, n_nationkey, 'n' || n_nationkey, 'page' FROM nation UNION ALL SELECT 'pair:' || n_nationkey, n_regionkey + 1000, 'r' || n_regionkey, 'pages' FROM nation
  UNION ALL SELECT 'self:' || r_regionkey, r_regionkey, 'r' || r_regionkey, 'pages' FROM region)"""


#: Kinds of the composite rules, dealt over the events.
EXPLOIT_KINDS = [
    "form_html_injection", "pdfjs_form_injection", "pdfjs_annotation_injection", "annotation_action_chain", "js_present", "submitform_present", "action_remote_target_suspicious", "pdfjs_eval_path_risk",
    "scattered_payload_assembly", "cross_stream_payload_assembly", "obfuscated_name_encoding", "embedded_type_mismatch", "launch_embedded_file", "launch_action_present", "gotor_present", "richmedia_present", "swf_embedded",
    "3d_present", "ocg_present", "resource.external_reference_obfuscated", "passive_credential_leak_risk", "open_action_present", "aa_present", "aa_event_present", "action_hidden_trigger", "passive_render_pipeline_risk_composite",
    "image.decode_too_large", "icc_profile_oversized", "font_payload_present", "resource.provenance_xref_conflict", "object_reference_cycle", "xref_conflict", "image.zero_click_jbig2", "decoder_risk_present", "parser_resource_exhaustion",
    "embedded_archive_encrypted", "filter_order_invalid", "filter_combination_unusual", "stream_high_entropy", "uri_action_present", "content_phishing",
]


def exploit_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings with the kinds and metadata that composite rules look at."""
    f = findings(spark, sf_dir)
    n, k = F.col("seq"), F.regexp_extract(F.col("meta")["hash"], r"(\d+)", 1).cast("int") + 25 * F.col("meta")["page.number"].cast("int")
    more = F.map_from_arrays(F.array(*map(F.lit, ["field.name", "js.source", "hash.sha256", "launch.embedded_file_hash"])), F.array(F.concat(F.lit("field"), n % 3), F.when(n % 2 == 0, "annotation_action").otherwise("page"), F.concat(F.lit("h"), n % 9), F.concat(F.lit("h"), k % 9)))
    started = F.when(n % 4 == 0, F.map_from_arrays(F.array(F.lit("action.initiation")), F.array(F.when(n % 8 == 0, "user").otherwise("automatic")))).otherwise(F.create_map().cast("map<string,string>"))
    return f.withColumns({"kind": F.element_at(F.array(*map(F.lit, EXPLOIT_KINDS)), ((n * 7 + k) % len(EXPLOIT_KINDS) + 1).cast("int")), "meta": F.map_concat("meta", more, started)})


EXPLOIT_SQL = f"""{FINDINGS_SQL}, xk AS (SELECT *, k % 25 + 25 * (k % 12) AS kk FROM f), xf AS (SELECT doc, seq, id, {_list(EXPLOIT_KINDS)}[(n * 7 + kk) % {len(EXPLOIT_KINDS)} + 1] kind, severity, confidence, conf, objects, stage, 'field' || (n % 3) field, CASE WHEN n % 2 = 0 THEN 'annotation_action' ELSE 'page' END source,
  'h' || (n % 9) digest, 'h' || (kk % 9) launch_digest, CASE WHEN n % 8 = 0 THEN 'user' WHEN n % 4 = 0 THEN 'automatic' END started FROM xk)"""
