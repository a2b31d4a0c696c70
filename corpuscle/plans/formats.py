"""Queries of readers and writers, event records, outcomes, chains and paths, and checks of URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.functions import predicates as P
from corpuscle.functions import signals, text, urls
from corpuscle.operators import compare, correlate, graph
from corpuscle.operators import findings as fo
from corpuscle.plans import bindings as b
from corpuscle.plans.graphs import CHAIN_SQL, _chains
from corpuscle.plans.queries import CHAINS_SQL, SQL, _copies, found, joined, query
from corpuscle.session import read_table, stash_path
from corpuscle.sources import readers, writers

# ---- readers and writers


@query("scan_corpus_files", """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(sum(strlen(line) + 1) AS BIGINT) AS size, sha256(string_agg(line, chr(10) ORDER BY event_id) || chr(10)) AS sha256, 'unknown' AS type
  FROM (SELECT ts, event_id, event_id || ' ' || event_type || ' ' || props AS line FROM events) GROUP BY 1""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file of lines a day, written and scanned again."""
    e = read_table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_id", F.concat_ws(" ", "event_id", "event_type", "props").alias("value"))
    path = stash_path(spark, "corpus")
    e.repartition("day").sortWithinPartitions("day", "event_id").select("day", "value").write.partitionBy("day").text(path)
    files = readers.scan_corpus_files(spark, path, "*.txt")
    return files.select(F.regexp_extract("path", r"day=([^/]*)/", 1).alias("day"), "size", "sha256", text.magic_type(F.col("content")).alias("type"))


META_KEYS = {"action.target": "target", "buckets": "'loop:' || (k % 3) || ',timeout'", "chain.stage": "stage", "entropy": "entropy", "exploit.preconditions": "'cond' || (k % 4) || '; cond' || (k % 7)", "exploit.satisfied": "'cond' || (n % 3)",
             "hash": "hash", "is_composite": "CASE WHEN k % 11 = 0 THEN 'true' ELSE 'false' END", "js.contains_eval": "CASE WHEN has_eval THEN 'true' ELSE 'false' END", "page.number": "page"}


@found("findings_csv_rows", f"""SELECT id, surface, kind, severity, confidence, impact, title, description, array_to_string(objects, '|') AS objects, CAST(1 AS INTEGER) AS evidence_count, CAST(NULL AS VARCHAR) AS remediation,
  {" || chr(10) || ".join(f"'{k}=' || {v}" for k, v in META_KEYS.items())} AS meta FROM f""")
def _(f: DataFrame) -> DataFrame:
    """All twelve columns, written as CSV and read back; the metadata column is read as the JSON that it is (but for one number of many decimals)."""
    path = stash_path(f.sparkSession, "csv")
    rows = writers.findings_csv(f)
    writers.write_csv(rows, path)
    back = f.sparkSession.read.schema(rows.schema).option("header", "true").option("escape", '"').csv(path)
    meta = F.from_json("meta_json", "map<string,string>")
    return back.select(*[c for c in back.columns if c != "meta_json"], F.array_join(F.array(*[F.concat(F.lit(f"{k}="), meta[k]) for k in META_KEYS]), "\n").alias("meta"))


@found("intents_jsonl_round_trip", "SELECT DISTINCT doc AS path, target AS url FROM f")
def _(f: DataFrame) -> DataFrame:
    """Every line is this query's own, so the reader's limit on lines from outside does not hold."""
    path = stash_path(f.sparkSession, "intents")
    writers.intents_jsonl(urls.extract_intents(f)).write.text(path)
    return readers.read_intents(f.sparkSession, path, None)[0]


@query("intents_rejected", "SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'empty_url' WHEN page_id % 4 = 1 THEN 'url_too_long' WHEN page_id % 4 = 2 THEN 'not_printable' ELSE 'line_too_long' END AS reason FROM pages")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every page, each with one of the four faults."""
    p, n = read_table(spark, sf_dir, "pages"), F.col("page_id") % 4
    bad = F.when(n == 0, "  ").when(n == 1, F.rpad("url", 1100, "x")).when(n == 2, F.concat("url", F.lit("é"))).otherwise(F.rpad("url", 11_000, "x"))
    lines = p.select(F.to_json(F.struct(F.col("page_id").cast("string").alias("path"), bad.alias("url"))).alias("value"))
    return readers.parse_intents(lines)[1].select(F.col("path").cast("long").alias("page_id"), "reason")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = b.event_graph(spark, sf_dir)
    kind = F.when(F.startswith("dst", F.lit("view")), "executes").when(F.startswith("dst", F.lit("purchase")) | F.startswith("dst", F.lit("error")), "produces_outcome").otherwise("next")
    meta = {"event_key": F.when(F.col("seq") % 3 == 0, F.concat(F.lit("/K"), F.col("seq") % 7)), "initiation": F.when(F.col("seq") % 2 == 0, "user"), "branch_index": F.when(F.col("seq") % 5 == 0, (F.col("seq") % 11).cast("int"))}
    return compare.event_records(nodes, edges.withColumns({"kind": kind, **meta}))


RECORDS_SQL = f"""WITH {b.EVENT_GRAPH_SQL}, x AS (SELECT *, CASE WHEN starts_with(dst, 'view') THEN 'executes' WHEN starts_with(dst, 'purchase') OR starts_with(dst, 'error') THEN 'produces_outcome' ELSE 'next' END AS kind FROM ee),
links AS (SELECT doc, node, string_agg(DISTINCT finding_id, ',' ORDER BY finding_id) AS findings, count(DISTINCT finding_id) AS n FROM (SELECT doc, src AS node, finding_id FROM ee UNION SELECT doc, dst, finding_id FROM ee) GROUP BY doc, node),
o AS (SELECT doc, src, string_agg(DISTINCT dst, ',' ORDER BY dst) FILTER (kind = 'executes') AS executes, string_agg(DISTINCT dst, ',' ORDER BY dst) FILTER (kind = 'produces_outcome') AS outcomes, arg_min('/K' || (seq % 7), seq) FILTER (seq % 3 = 0) AS event_key,
  CASE WHEN count(*) FILTER (seq % 2 = 0) > 0 THEN 'user' END AS initiation, CAST(arg_min(seq % 11, seq) FILTER (seq % 5 = 0) AS INTEGER) AS branch_index FROM x GROUP BY doc, src),
records AS (SELECT en.doc, en.node_id, en.event_type, coalesce(executes, '') AS executes, coalesce(outcomes, '') AS outcomes, event_key, initiation, branch_index, findings, n FROM en LEFT JOIN o ON o.doc = en.doc AND o.src = en.node_id LEFT JOIN links l ON l.doc = en.doc AND l.node = en.node_id WHERE en.node_kind = 'event')"""


@query("event_record_projection", f"{RECORDS_SQL} SELECT * EXCLUDE (n) FROM records")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).withColumns({"findings": joined("findings"), **{c: joined(F.coalesce(c, F.array())) for c in ("executes", "outcomes")}})


@query("events_csv_round_trip", f"{RECORDS_SQL} SELECT node_id, event_type, 'event' AS level, event_key AS trigger, doc AS source_object, CAST(coalesce(n, 0) AS INTEGER) AS linked_finding_count, replace(findings, ',', '|') AS linked_finding_ids FROM records")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stash_path(spark, "events_csv")
    rows = writers.events_csv(_records(spark, sf_dir).withColumns({"level": F.lit("event"), "trigger": F.col("event_key"), "source_object": F.col("doc"), "findings": F.coalesce("findings", F.array().cast("array<string>"))}))
    writers.write_csv(rows, path)
    return spark.read.schema(rows.schema).option("header", "true").option("escape", '"').csv(path)


@query("finding_to_event_link", f"{RECORDS_SQL} SELECT doc, node AS node_id, findings FROM links")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.link_findings_events(*b.event_graph(spark, sf_dir)).withColumn("findings", joined("findings"))


# ---- outcomes, edges and chains

OUTCOME_SQL = f"""WITH {b.FINDINGS_SQL}, oc AS (SELECT doc, id, seq, 'o' || seq AS node_id, title AS outcome_type, 't' || (n % 3) AS target, CASE WHEN k % 2 = 0 THEN objects[1] END AS source_obj, CAST(n % 6 AS INTEGER) AS score, sev, CAST(off AS VARCHAR) AS ev FROM f),
mo AS (SELECT doc, outcome_type, target, source_obj, arg_min(node_id, seq) AS node_id, max(score) AS confidence_score, ['info', 'low', 'medium', 'high', 'critical'][max(sev) + 1] AS severity, string_agg(DISTINCT ev, ',' ORDER BY ev) AS evidence FROM oc GROUP BY doc, outcome_type, target, source_obj)"""


def _merged(f: DataFrame) -> tuple[DataFrame, DataFrame]:
    fields = {"node_id": F.concat(F.lit("o"), "seq"), "node_kind": F.lit("outcome"), "outcome_type": F.col("title"), "target": F.concat(F.lit("t"), F.col("seq") % 3), "confidence_score": (F.col("seq") % 6).cast("int")}
    even = F.regexp_extract(F.get("objects", F.lit(0)), r"^(\d+)", 1).cast("int") % 2 == 0
    nodes = f.select("doc", "seq", "severity", *[c.alias(n) for n, c in fields.items()], F.when(even, F.get("objects", F.lit(0))).alias("source_obj"), F.transform("evidence", lambda e: e["offset"].cast("string")).alias("evidence"))
    return graph.merge_outcomes(nodes, f.select("doc", F.col("id").alias("src"), F.concat(F.lit("o"), "seq").alias("dst")), "seq")


@found("merge_duplicate_outcomes")
def _(f: DataFrame) -> DataFrame:
    return _merged(f)[0].withColumn("evidence", joined("evidence"))


@found("merged_outcome_edges")
def _(f: DataFrame) -> DataFrame:
    return _merged(f)[1]


@query("dedup_edges", f"WITH {b.EVENT_GRAPH_SQL} SELECT DISTINCT doc, src, dst, seq % 2 AS kind, seq % 3 AS provenance FROM ee")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = b.event_graph(spark, sf_dir)[1].withColumns({"kind": F.col("seq") % 2, "provenance": F.col("seq") % 3, "metadata": F.lit("")})
    return graph.dedup_edges(e.unionByName(e)).select("doc", "src", "dst", "kind", "provenance")


@query("chain_edge_summary", f"""WITH {b.EVENT_GRAPH_SQL}, x AS (SELECT doc, seq, starts_with(dst, 'error') AS bad, CASE WHEN seq % 10 = 0 THEN NULL ELSE (seq % 100) / 100.0::DOUBLE END AS weight, CAST(doc AS BIGINT) % 10 / 10.0::DOUBLE AS risk FROM ee)
  SELECT doc, CAST(count(*) AS INTEGER) AS original, CAST(count(*) FILTER (bad OR coalesce(weight, 0) >= greatest(0.25, risk * 0.4)) AS INTEGER) AS kept, coalesce(string_agg(seq, ',' ORDER BY seq) FILTER (bad OR coalesce(weight, 0) >= greatest(0.25, risk * 0.4)), '') AS edges FROM x GROUP BY doc""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.struct("seq", F.startswith("dst", F.lit("error")).alias("suspicious"), F.when(F.col("seq") % 10 != 0, (F.col("seq") % 100) / 100).alias("weight"))
    chains = b.event_graph(spark, sf_dir)[1].groupBy("doc").agg(F.array_sort(F.collect_list(cell)).alias("edges")).withColumn("risk", F.col("doc").cast("long") % 10 / 10)
    return graph.summarise_edges(chains).select("doc", "original", "kept", F.array_join(F.transform("edges", lambda e: e["seq"].cast("string")), ",").alias("edges"))


@found("filter_chains_predicate", f", {CHAINS_SQL} SELECT doc, object, ids FROM sc WHERE score >= 0.7 AND trigger = 'open_action_present' AND action IS DISTINCT FROM 'submitform_present'")
def _(f: DataFrame) -> DataFrame:
    chains = correlate.score_chain(correlate.object_chains(f))
    hit = P.all_(P.compare(F.col("score"), ">=", 0.7, "number"), P.compare(F.col("trigger"), "==", "OPEN_action_present"), P.not_(P.compare(F.col("action"), "==", "submitform_present")))
    return P.filter_rows(chains, hit).select("doc", "object", "ids")


@query("path_risk_and_pattern", f"""{CHAIN_SQL}, {b.FINDINGS_SQL}, st AS (SELECT doc, chain, unnest(path) AS node, unnest(list_append(kinds, NULL)) AS key FROM ac), kw AS (SELECT doc, kind, sum(CASE sev WHEN 4 THEN 0.2::DOUBLE WHEN 3 THEN 0.15::DOUBLE WHEN 2 THEN 0.08::DOUBLE WHEN 1 THEN 0.03::DOUBLE ELSE 0 END) AS w FROM f GROUP BY doc, kind),
  p AS (SELECT st.doc, st.chain, bool_or(key = 'open') AS opened, bool_or(node = 'click') AS js, bool_or(node IN ('purchase', 'error')) AS ext, count(*) AS n, count(*) FILTER (node = 'error') AS bad, sum(coalesce(w, 0)) AS w FROM st LEFT JOIN kw ON kw.doc = st.doc AND kw.kind = CASE node WHEN 'click' THEN 'js_present' WHEN 'purchase' THEN 'launch_action_present' END GROUP BY st.doc, st.chain)
  SELECT doc, chain, round(least(1, CASE WHEN chain % 2 = 0 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN js THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN ext THEN 0.3::DOUBLE ELSE 0 END + w + bad * 0.1::DOUBLE + greatest(n - 2, 0) * 0.05::DOUBLE), 6) AS risk,
    CASE WHEN opened AND js AND ext THEN 'automatic_js_with_external_action' WHEN opened AND js THEN 'automatic_js_trigger' WHEN js AND ext THEN 'js_to_external_resource' WHEN opened AND ext THEN 'automatic_external_action'
      WHEN chain % 2 = 0 AND js THEN 'automatic_js_chain' WHEN chain % 2 = 0 THEN 'automatic_action_chain' END AS pattern FROM p""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.arrays_zip("path", F.concat("kinds", F.array(F.lit(None).cast("string"))).alias("kinds"))
    sort = lambda n: F.when(n == "click", "JavaScript").when(n == "purchase", "Launch").when(n == "error", "URI").otherwise("Object")
    kinds = lambda n: F.array_compact(F.array(F.when(n == "click", "js_present").when(n == "purchase", "launch_action_present")))
    step = lambda x: F.struct(x["path"].alias("node"), sort(x["path"]).alias("type"), F.when(x["kinds"] == "open", "/OpenAction").otherwise("/Next").alias("key"), (x["path"] == "error").alias("suspicious"), kinds(x["path"]).alias("kinds"))
    paths = _chains(spark, sf_dir).withColumn("steps", F.transform(ends, step))
    seen = lambda *names: F.exists("path", lambda n: n.isin(*names))
    paths = paths.withColumns({"path_id": F.col("chain"), "automatic": F.col("chain") % 2 == 0, "script": seen("click"), "external": seen("purchase", "error")})
    return graph.path_risk(paths, b.findings(spark, sf_dir)).select("doc", "chain", F.round("risk", 6).alias("risk"), "pattern")


# ---- checks


@query("url_checks", r"""SELECT page_id, upper(left(url, 2)) || substr(url, 3) AS given, lower(regexp_extract(url, '^([^:]*)', 1)) || regexp_extract(url, '^[^:]*(:.*)$', 1) AS canonical, url AS restored,
  regexp_matches(regexp_extract(url, '^https?://([^/:]*)', 1), '^([A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,63}$') AS valid, page_id % 2 = 0 AND valid AS derived FROM pages""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "pages").select("page_id", "url")
    given = F.concat(F.upper(F.substring("url", 1, 2)), F.expr("substring(url, 3)"))
    hidden = F.replace(F.replace(F.regexp_replace("url", "^http", "hxxp"), F.lit("://"), F.lit("[:]//")), F.lit("."), F.lit("[.]"))
    domain = urls.extract_domain(F.col("url"))
    return p.select("page_id", given.alias("given"), urls.canonical_uri(given).alias("canonical"), urls.deobfuscate(hidden).alias("restored"), urls.is_valid_domain(domain).alias("valid"), urls.is_valid_domain(F.concat(F.when(F.col("page_id") % 2 == 0, F.lit("sub-1.")).otherwise("-"), domain)).alias("derived"))


@query("data_uri_parts", r"""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'text/html' END AS mime, page_id % 2 = 0 AS base64, CASE WHEN page_id % 2 = 0 THEN 4 * ((strlen(html) + 2) // 3) ELSE strlen(url) END AS length FROM pages""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a data URI: its text in base 64 with a type, or its address without."""
    p = read_table(spark, sf_dir, "pages")
    coded = F.replace(F.replace(F.base64(F.encode("html", "UTF-8")), F.lit("\r"), F.lit("")), F.lit("\n"), F.lit(""))
    uri = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("data:text/html;base64,"), coded)).otherwise(F.concat(F.lit("data:,"), "url"))
    parts = urls.with_url_flags(urls.with_url_parts(p.select("page_id", uri.alias("uri")), "uri"), "uri")
    return parts.select("page_id", F.col("f.data_mime").alias("mime"), F.col("f.data_base64").alias("base64"), F.col("f.data_length").cast("long").alias("length"))


HEADS = {"4D5A": "pe", "25504446": "pdf", "504B0304": "zip", "7F454C46": "elf", "2321": "script", "89504E47": "png", "FFD8FF": "jpeg", "474946": "unknown"}


@query("magic_type", f"SELECT page_id, {list(HEADS.values())}[page_id % {len(HEADS)} + 1] AS type FROM pages")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page behind the first bytes of some format (the last of them cut short)."""
    p = read_table(spark, sf_dir, "pages")
    head = F.unhex(F.element_at(F.array(*map(F.lit, HEADS)), (F.col("page_id") % len(HEADS) + 1).cast("int")))
    return p.select("page_id", text.magic_type(F.concat(head, F.encode("html", "UTF-8"))).alias("type"))


@query("deleted_globals", """SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'window,eval' WHEN 1 THEN 'document' ELSE '' END AS deleted FROM conversations""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of the conversations with statements that delete globals put behind it."""
    more = F.when(F.col("turn") % 3 == 0, "; delete window; delete eval;").when(F.col("turn") % 3 == 1, "; delete document").otherwise("; deleted alert")
    c = read_table(spark, sf_dir, "conversations").withColumn("text", F.concat(F.coalesce("text", F.lit("")), more))
    return signals.deleted_globals(c, "text", "conv_id", "turn").withColumn("deleted", joined("deleted"))


@found("sort_findings", "SELECT id, row_number() OVER (ORDER BY kind, array_to_string(list_sort(list_distinct(objects)), '|'), id) - 1 AS place FROM f")
def _(f: DataFrame) -> DataFrame:
    return fo.sort_findings(f).select("id", "place")


@query("uniform_sample_unique", "SELECT path, hash FROM (SELECT sha256(text) AS hash, min(doc_id) AS path FROM documents GROUP BY 1) QUALIFY row_number() OVER (ORDER BY md5('7:' || hash), hash) <= 100")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.sample_unique(_copies(spark, sf_dir), 100, 7).select("path", "hash")


SQL["merge_duplicate_outcomes"] = OUTCOME_SQL + " SELECT * FROM mo"
SQL["merged_outcome_edges"] = OUTCOME_SQL + " SELECT oc.doc, oc.id AS src, mo.node_id AS dst FROM oc JOIN mo ON mo.doc = oc.doc AND mo.outcome_type = oc.outcome_type AND mo.target = oc.target AND mo.source_obj IS NOT DISTINCT FROM oc.source_obj"


NEEDLES = [".En", ".Th", ".D", "n.S"]


@query("fragment_assembly", f"""WITH c AS (SELECT conv_id, turn, text, right(coalesce(lag(text) OVER w, ''), 2) AS tail FROM conversations WHERE text <> '' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), alone AS (SELECT DISTINCT conv_id FROM conversations WHERE {" OR ".join(f"contains(text, '{n}')" for n in NEEDLES)})
  SELECT conv_id, turn AS at, needle FROM c, (SELECT unnest({NEEDLES}) AS needle) WHERE contains(tail || left(text, 2), needle) AND NOT contains(tail, needle) AND conv_id NOT IN (SELECT conv_id FROM alone)""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.assemble_fragments(read_table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", *NEEDLES)
