"""Document-level profiles, escalations and enrichments over findings, chains and graphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.operators.graph import depths
from corpuscle.schemas import confidence_name, confidence_rank, severity_name, severity_rank, stage_rank

#: Kinds and name parts the rules look for.
RUNTIME_ANOMALIES = ["js_emulation_breakpoint", "js_runtime_unknown_behaviour_pattern", "js_sandbox_timeout", "js_runtime_error"]
DECODER_PRESSURE = ["decoder_risk_present", "decompression_ratio_suspicious", "parser_resource_exhaustion"]
PAYLOAD_SURFACES = ["javascript", "actions", "embedded_files", "content_phishing", "rich_media_3d"]
PAYLOAD_PARTS = ["js_", "uri_", "embedded", "launch"]
STRUCTURE_SURFACES = ["file_structure", "xref_trailer", "object_streams", "streams_filters"]
WEAK_CIPHERS = ["RC4", "DES", "MD5"]


def _part(*names: str) -> Column:
    return reduce(lambda a, n: a | F.contains("kind", F.lit(n)), names, F.lit(False))


def _capped(*terms: Column) -> Column:
    return F.least(F.lit(1.0), reduce(lambda a, b: a + b, terms))


def typed_meta(df: DataFrame) -> DataFrame:
    """Metadata values as number, flag and text."""
    typed = F.transform_values("meta", lambda _, v: F.struct(v.try_cast("double").alias("number"), F.when(F.lower(v).isin("true", "false"), F.lower(v) == "true").alias("flag"), v.alias("text")))
    return df.withColumn("typed", typed)


def risk_profiles(findings: DataFrame) -> DataFrame:
    """doc and the capped URI, structural, supply-chain, content and crypto risks, from one aggregation."""
    meta = F.col("meta")
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    uri = F.col("surface").isin("actions", "forms") & _part("uri", "launch", "url")
    structural = F.col("surface").isin(STRUCTURE_SURFACES)
    supply = _part("producer", "creator", "metadata")
    content = (F.col("surface") == "content_phishing") | _part("content", "text")
    crypto = (F.col("surface") == "crypto_signatures") | _part("crypto", "encryption")
    weak = reduce(lambda a, n: a | F.contains(meta["encryption.algorithm"], F.lit(n)), WEAK_CIPHERS, F.lit(False))
    per = findings.groupBy("doc").agg(
        count(uri).alias("uris"), count(uri & _part("suspicious", "phishing") & meta["uri.domain"].isNotNull()).alias("domains"),
        count(uri & ~meta["uri.scheme"].isin("http", "https")).alias("schemes"), count(uri & _part("phishing")).alias("phishing"),
        count(structural & _part("invalid", "malformed")).alias("violations"), count(structural & _part("xref")).alias("xref"), count(structural & _part("objstm", "object_stream")).alias("objstm"), F.bool_or(_part("encrypted", "encryption")).alias("encrypted"),
        count(supply & _part("suspicious_producer")).alias("producers"), count(supply & _part("signature") & _part("invalid")).alias("signatures"),
        count(content & _part("text_anomaly", "hidden_text")).alias("text"), count(content & _part("font")).alias("fonts"), count(content & _part("phishing") & meta["keyword"].isNotNull()).alias("keywords"),
        F.coalesce(F.bool_or(content & _part("hidden")), F.lit(False)).alias("hidden"), F.coalesce(F.bool_or(content & _part("overlapping")), F.lit(False)).alias("overlapping"),
        count(crypto & weak).alias("weak"), count(crypto & _part("certificate")).alias("certificates"), count(crypto & _part("signature") & _part("anomaly")).alias("anomalies"),
    )
    yes = lambda c, v: F.when(F.col(c), v).otherwise(0.0)
    n = lambda c, v: F.col(c) * v
    return per.select(
        "doc",
        F.when(F.col("uris") > 0, _capped(n("domains", 0.3), n("schemes", 0.2), n("phishing", 0.4), F.lit(0.1))).otherwise(0.0).alias("uri_risk"),
        _capped(n("violations", 0.2), n("xref", 0.3), n("objstm", 0.2), yes("encrypted", 0.1)).alias("structural_risk"),
        _capped(n("producers", 0.3), n("signatures", 0.4)).alias("supply_chain_risk"),
        _capped(n("text", 0.1), n("fonts", 0.1), n("keywords", 0.3), yes("hidden", 0.2), yes("overlapping", 0.1)).alias("content_risk"),
        _capped(n("weak", 0.4), n("certificates", 0.2), n("anomalies", 0.3)).alias("crypto_risk"),
    )


def action_chain_malicious(findings: DataFrame, complex_kinds: list[str], automatic_kinds: list[str], script: Column, depth: int = 3) -> DataFrame:
    """doc, chain, automatic, scripts: complex chains on whose objects both an automatic trigger and a script sit."""
    long = F.coalesce(F.col("meta")["action.chain_depth"].try_cast("int"), F.lit(0)) >= depth
    each = findings.select("doc", "id", "kind", long.alias("long"), script.alias("script"), F.explode(F.array_distinct("objects")).alias("object"))
    chains = each.filter(F.col("kind").isin(complex_kinds) & F.col("long")).select("doc", "object", F.col("id").alias("chain"))
    others = each.filter(F.col("kind").isin(automatic_kinds) | F.col("script")).select("doc", "object", "id", F.col("kind").isin(automatic_kinds).alias("auto"), "script")
    met = chains.join(others, ["doc", "object"]).filter("id <> chain").groupBy("doc", "chain")
    distinct = lambda c: F.count_distinct(F.when(F.col(c), F.col("id")))
    return met.agg(distinct("auto").alias("automatic"), distinct("script").alias("scripts")).filter("automatic > 0 and scripts > 0")


def xfa_data_exfiltration(findings: DataFrame, least: int = 1) -> DataFrame:
    """doc, urls, fields: forms that submit to an outside address and have enough sensitive fields."""
    url = F.when((F.col("kind") == "xfa_submit") & F.col("meta")["xfa.submit.url"].rlike("(?i)^https?://"), F.col("meta")["xfa.submit.url"])
    name = F.when(F.col("kind") == "xfa_sensitive_field", F.col("meta")["xfa.field.name"])
    per = findings.groupBy("doc").agg(F.array_sort(F.collect_set(url)).alias("urls"), F.count(name).alias("fields"))
    return per.filter((F.size("urls") > 0) & (F.col("fields") >= least))


def structure_with(findings: DataFrame, prefix: str, kinds: list[str]) -> DataFrame:
    """doc, structural, paths: documents with kinds of a prefix together with kinds of a list (fonts or images)."""
    per = findings.groupBy("doc").agg(F.count_if(F.startswith("kind", F.lit(prefix))).alias("structural"), F.count_if(F.col("kind").isin(kinds)).alias("paths"))
    return per.filter("structural > 0 and paths > 0")


def upgrade_breakpoints(findings: DataFrame) -> DataFrame:
    """Tentative breakpoints become probable in documents that delete globals."""
    flag = findings.groupBy("doc").agg(F.bool_or(F.col("kind") == "js_global_deletion_sandbox_bypass").alias("__deletes"))
    up = (F.col("kind") == "js_emulation_breakpoint") & (F.lower("confidence") == "tentative") & F.col("__deletes")
    return findings.join(flag, "doc").withColumn("confidence", F.when(up, "probable").otherwise(F.col("confidence"))).drop("__deletes")


def escalate_declared_filters(findings: DataFrame, target: str = "declared_filter_invalid", anomalies: list[str] = RUNTIME_ANOMALIES, pressure: list[str] = DECODER_PRESSURE) -> DataFrame:
    """Target rows rise with script anomalies and decoder pressure in their document; never fall; the reason is kept."""
    flags = findings.groupBy("doc").agg(F.bool_or(F.col("kind").isin(anomalies)).alias("__js"), F.bool_or(F.col("kind").isin(pressure)).alias("__dec"))
    hit = (F.col("kind") == target) & (F.col("__js") | F.col("__dec"))
    both = F.col("__js") & F.col("__dec")
    severity = F.greatest(severity_rank(F.col("severity")), F.when(both, 4).otherwise(3))
    confidence = F.least(confidence_rank(F.col("confidence")), F.when(both, 0).otherwise(1))
    reason = F.concat_ws("+", F.when(F.col("__js"), F.lit("script_anomaly")), F.when(F.col("__dec"), F.lit("decoder_pressure")))
    out = findings.join(flags, "doc")
    return out.withColumns({
        "severity": F.when(hit, severity_name(severity)).otherwise(F.lower("severity")),
        "confidence": F.when(hit, confidence_name(confidence)).otherwise(F.lower("confidence")),
        "escalation": F.when(hit, reason),
    }).drop("__js", "__dec")


def orphan_payload_context(findings: DataFrame, orphan_kinds: list[str]) -> DataFrame:
    """doc, orphan, payloads: orphaned page rows with the suspicious findings on the same object."""
    each = findings.select("doc", "id", "kind", "surface", F.explode(F.array_distinct("objects")).alias("object"))
    suspicious = ~F.col("kind").isin(orphan_kinds) & (F.col("surface").isin(PAYLOAD_SURFACES) | _part(*PAYLOAD_PARTS))
    orphans = each.filter(F.col("kind").isin(orphan_kinds)).select("doc", "object", F.col("id").alias("orphan"))
    met = orphans.join(each.filter(suspicious).select("doc", "object", "id"), ["doc", "object"])
    return met.groupBy("doc", "orphan").agg(F.array_join(F.array_sort(F.collect_set("id")), ",").alias("payloads"))


def findings_with_chain(findings: DataFrame, chains: DataFrame) -> DataFrame:
    """Chains (doc, object or else ids as their name) with the ordered stages of their findings, objects they share and how far these scatter."""
    members = chains.select("doc", F.coalesce("object", "ids").alias("chain"), F.explode(F.split("ids", ",")).alias("id"))
    met = members.join(findings.select("doc", "id", "objects", F.col("meta")["chain.stage"].alias("stage")), ["doc", "id"])
    stages = met.filter("stage is not null").select("doc", "chain", "stage").distinct().withColumn("rank", stage_rank(F.col("stage")))
    ordered = stages.groupBy("doc", "chain").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "stage"))), lambda x: x["stage"]), ",").alias("stages"))
    objects = met.select("doc", "chain", "id", F.explode(F.array_distinct("objects")).alias("o")).groupBy("doc", "chain", "o").agg(F.count("*").alias("n"))
    shared = objects.groupBy("doc", "chain").agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("n") > 1, F.col("o")))), ",").alias("shared"), F.count("*").alias("objects"))
    counts = met.groupBy("doc", "chain").agg(F.count_distinct("id").alias("findings"))
    return counts.join(ordered, ["doc", "chain"], "left").join(shared, ["doc", "chain"], "left")


def group_paths(paths: DataFrame) -> DataFrame:
    """Path chains of a document with one trigger, end and list of edge kinds: the riskiest stands for them (then the lower number)."""
    key = ["doc", "trigger", "payload", "signature"]
    signed = paths.withColumns({"trigger": F.element_at("kinds", 1), "payload": F.element_at("path", -1), "signature": F.array_join("kinds", ">")})
    best = Window.partitionBy(*key).orderBy(F.desc("risk"), "chain")
    ranked = signed.withColumns({"rank": F.row_number().over(best), "members": F.count("*").over(Window.partitionBy(*key))})
    return ranked.filter("rank = 1").drop("rank")


def evidence_chains(parts: DataFrame, findings: DataFrame, rules: dict[str, Column], n: int = 20) -> DataFrame:
    """doc, name, contribution, findings: the n strongest contributions with the findings that their name's prefix points to."""
    order = Window.partitionBy("doc").orderBy(F.abs("contribution").desc(), "name")
    top = parts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    which = F.explode(F.array_compact(F.array(*[F.when(c, F.lit(p)) for p, c in rules.items()])))
    counts = findings.select("doc", which.alias("prefix")).groupBy("doc", "prefix").agg(F.count("*").alias("findings"))
    prefix = F.regexp_extract("name", r"^([^.]*)", 1)
    return top.withColumn("prefix", prefix).join(counts, ["doc", "prefix"], "left").select("doc", "name", "contribution", F.coalesce("findings", F.lit(0)).alias("findings"))


def graph_features(edges: DataFrame, roots: DataFrame, kinds: list[str], most: int = 8, g: tuple[str, ...] = ("doc",)) -> DataFrame:
    """Edge counts by kind, suspicious edges and depth of each graph."""
    counts = edges.groupBy(*g).agg(F.count("*").alias("edges"), F.count_if("suspicious").alias("suspicious"), *[F.count_if(F.col("edge_type") == k).alias(f"n_{k}") for k in kinds])
    return counts.join(depths(edges, roots, most, g).select(*g, "max_depth", "avg_depth"), list(g), "left")
