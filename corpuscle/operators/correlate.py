"""Rule-based composites, intents, taint, chains and recalibration over the finding table, one job for all documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.operators.compare import shares_object
from corpuscle.schemas import confidence_rank, severity_name, severity_rank

KIND = "kind"
#: Kinds by what they stand for.
TRIGGERS = ["action_automatic_trigger", "open_action_present", "action_hidden_trigger", "aa_present", "aa_event_present"]
SCRIPTS = ["js_present", "js_polymorphic", "js_obfuscation_deep"]
STRUCTURAL = ["xref_conflict", "incremental_update_chain", "object_id_shadowing", "objstm_density_high"]
DECODE_PRESSURE = ["decoder_risk_present", "decompression_ratio_suspicious", "huge_image_dimensions"]
PAYLOADS = ["embedded_file_present", "js_present", "launch_embedded_file"]


def _kinds(kinds: tuple[str, ...] | list[str]) -> Column:
    return F.col(KIND).isin(list(kinds))


def launch_obfuscated_executable(findings: DataFrame, entropy: float = 7.5) -> DataFrame:
    """Launch and executable findings with one content hash, where the executable's entropy is high."""
    h = F.col("meta")["hash"]
    launch = findings.filter(F.col("kind") == "launch_embedded_file").select("doc", F.col("id").alias("launch"), h.alias("hash"))
    high = F.col("meta")["entropy"].try_cast("double") >= entropy
    program = findings.filter((F.col("kind") == "embedded_executable_present") & high).select("doc", F.col("id").alias("program"), h.alias("hash"))
    return launch.join(program, ["doc", "hash"]).select("doc", "hash", "launch", "program")


def build_composite(findings: DataFrame, members: DataFrame) -> DataFrame:
    """For (doc, composite, id): the union of objects, the number of evidence spans and the source kinds."""
    met = members.join(findings.select("doc", "id", "kind", "objects", "evidence"), ["doc", "id"])
    return met.groupBy("doc", "composite").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("objects")))).alias("objects"),
        F.sum(F.size("evidence")).alias("evidence"),
        F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("source_kinds"),
    )


#: Bucket, weight and label of a kind; of a metadata flag; of a substring in a metadata value.
INTENT_KINDS = {
    "submitform_present": ("data_exfiltration", 3, "SubmitForm action"), "uri_content_analysis": ("data_exfiltration", 2, "URI action"), "uri_listing": ("data_exfiltration", 2, "URI action"),
    "gotor_present": ("data_exfiltration", 2, "GoToR action"), "launch_action_present": ("sandbox_escape", 3, "Launch action"), "open_action_present": ("sandbox_escape", 1, "OpenAction trigger"),
    "embedded_file_present": ("persistence", 3, "Embedded file"), "filespec_present": ("persistence", 3, "Embedded file"),
    **dict.fromkeys(["content_phishing", "content_overlay_link", "content_invisible_text", "content_image_only_page", "content_html_payload"], ("phishing", 2, "Content deception")),
    "fontmatrix_payload_present": ("exploit_primitive", 3, "FontMatrix injection"),
    **dict.fromkeys(DECODE_PRESSURE, ("exploit_primitive", 2, "Decoder risk")),
    **dict.fromkeys(["parser_object_count_diff", "parser_trailer_count_diff"], ("exploit_primitive", 2, "Parser differential")),
    **dict.fromkeys(STRUCTURAL, ("obfuscation", 1, "Structural anomaly")),
}
INTENT_FLAGS = {
    "js.contains_eval": ("obfuscation", 2, "eval() usage"), "js.contains_unescape": ("obfuscation", 2, "unescape() usage"), "js.contains_fromcharcode": ("obfuscation", 2, "fromCharCode() usage"),
    "js.obfuscation_suspected": ("obfuscation", 3, "Obfuscation suspected"), "js.suspicious_apis": ("sandbox_escape", 2, "Suspicious Acrobat APIs"),
}
WEB, LOCAL = ("http", "mailto:", "data:"), ("file://", "cmd.exe", "powershell", ".exe")
INTENT_TEXT = [
    ("action.target", WEB, ("data_exfiltration", 2, "External target")),
    ("action.target", LOCAL, ("sandbox_escape", 2, "Local execution target")),
    ("payload.preview", WEB, ("data_exfiltration", 1, "External payload string")),
    ("payload.preview", ("<script", "javascript:"), ("phishing", 1, "HTML-like payload")),
    ("payload.decoded_preview", WEB, ("data_exfiltration", 1, "External decoded payload")),
    ("js.ast_call_args", ("geturl(", "submitform(", "launchurl("), ("data_exfiltration", 2, "JS network call arguments")),
]


def intent_signals(findings: DataFrame) -> DataFrame:
    """doc, bucket, weight, label, finding id (null for the bonuses of a whole document)."""
    cell = lambda s: F.struct(F.lit(s[0]).alias("bucket"), F.lit(s[1]).alias("weight"), F.lit(s[2]).alias("label"))
    meta = F.col("meta")
    kinds = F.create_map(*[x for k, s in INTENT_KINDS.items() for x in (F.lit(k), cell(s))])
    cells = [F.try_element_at(kinds, F.col("kind"))]
    cells += [F.when(meta[k] == "true", cell(s)) for k, s in INTENT_FLAGS.items()]
    for key in ("js.ast_domains", "js.ast_urls"):
        cells.append(F.when(F.length(meta[key]) > 0, cell(("data_exfiltration", 2, f"{key[3:]} present"))))
    for key, needles, s in INTENT_TEXT:
        found = F.lit(False)
        for n in needles:
            found = found | F.contains(F.lower(meta[key]), F.lit(n))
        cells.append(F.when(found, cell(s)))
    own = findings.select("doc", "id", F.explode(F.array_compact(F.array(*cells))).alias("s")).select("doc", "s.bucket", "s.weight", "s.label", "id")
    any_kind = lambda *ks: F.bool_or(F.col("kind").isin(*ks))
    flags = findings.groupBy("doc").agg(
        any_kind("js_present").alias("js"), any_kind("uri_listing", "uri_content_analysis", "submitform_present").alias("out"), any_kind("launch_action_present").alias("launch"),
        any_kind("embedded_file_present").alias("embedded"), any_kind("open_action_present", "aa_present", "aa_event_present").alias("open"), F.coalesce(F.bool_or(F.map_contains_key("meta", "action.s")), F.lit(False)).alias("action"),
    )
    bonus = [
        F.when(F.col("js") & F.col("out"), cell(("data_exfiltration", 2, "JS with external action"))),
        F.when(F.col("js") & F.col("launch"), cell(("sandbox_escape", 2, "JS with Launch action"))),
        F.when(F.col("open") & F.col("js"), cell(("sandbox_escape", 1, "Auto-run trigger with JS"))),
        F.when(F.col("embedded") & F.col("action"), cell(("persistence", 2, "Embedded payload with action"))),
    ]
    extra = flags.select("doc", F.explode(F.array_compact(F.array(*bonus))).alias("s")).select("doc", "s.bucket", "s.weight", "s.label", F.lit(None).cast("string").alias("id"))
    return own.unionByName(extra)


def intent_buckets(findings: DataFrame) -> DataFrame:
    """doc, bucket, score, confidence, signals, findings; a bucket of structural signals alone loses one point."""
    per = intent_signals(findings).groupBy("doc", "bucket").agg(F.sum("weight").alias("s"), F.count("*").alias("signals"), F.count_distinct("id").alias("findings"), F.bool_and(F.col("label") == "Structural anomaly").alias("only"))
    score = F.col("s") - F.when(F.col("only"), 1).otherwise(0)
    return per.select("doc", "bucket", score.alias("score"), F.when(score >= 6, "strong").when(score >= 3, "probable").otherwise("heuristic").alias("confidence"), "signals", "findings")


def best_intent(findings: DataFrame) -> DataFrame:
    """doc, id, bucket: the highest-scoring bucket a finding contributes to, the first by name among equals."""
    own = intent_signals(findings).filter("id is not null").select("doc", "bucket", "id").distinct()
    scored = own.join(intent_buckets(findings).select("doc", "bucket", "score"), ["doc", "bucket"])
    best = scored.groupBy("doc", "id").agg(F.min_by(F.struct("bucket", "score"), F.struct(-F.col("score"), F.col("bucket"))).alias("b"))
    return best.select("doc", "id", "b.bucket", "b.score")


#: Taint reasons by kind.
TAINT = {
    "js_present": "JavaScript present", "embedded_file_present": "Embedded file present", "decoder_risk_present": "High-risk decoder present", "stream_length_mismatch": "Stream length mismatch", "xref_conflict": "XRef conflict",
    **dict.fromkeys(["image.jbig2_present", "image.jpx_present", "image.ccitt_present"], "Risky image decoder present"),
    **dict.fromkeys(["image.jbig2_malformed", "image.jpx_malformed", "image.jpeg_malformed", "image.ccitt_malformed", "image.decode_failed", "image.xfa_decode_failed"], "Image decode failure observed"),
    **dict.fromkeys(["image.extreme_dimensions", "image.pixel_count_excessive", "image.suspect_strip_dimensions"], "Suspicious image dimensions"),
}


def taint(findings: DataFrame) -> DataFrame:
    """doc, reasons, sources, edges of tainted documents; edges come from metadata, else from neighbouring objects."""
    reasons = F.create_map(*[F.lit(x) for kv in TAINT.items() for x in kv])
    rows = findings.filter(_kinds(list(TAINT))).withColumn("reason", reasons[F.col("kind")])
    number = lambda c: F.regexp_extract(c, r"(\d+ \d+)", 1)
    pairs = F.when(F.size("objects") > 1, F.transform(F.sequence(F.lit(1), F.size("objects") - 1), lambda i: F.concat(number(F.element_at("objects", i)), F.lit(">"), number(F.element_at("objects", i + 1))))).otherwise(F.array().cast("array<string>"))
    given = F.col("meta")["edge.from"].isNotNull() & F.col("meta")["edge.to"].isNotNull()
    edges = F.when(given, F.array(F.concat(number(F.col("meta")["edge.from"]), F.lit(">"), number(F.col("meta")["edge.to"])))).otherwise(pairs)
    flat = lambda c: F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))), ",")
    return rows.groupBy("doc").agg(F.array_join(F.array_sort(F.collect_set("reason")), "; ").alias("reasons"), flat(F.transform("objects", number)).alias("sources"), flat(edges).alias("edges"))


#: Action kinds of a chain, and flags of its findings' metadata that count for its score.
CHAIN_ACTIONS = ["launch_action_present", "submitform_present", "uri_content_analysis", "gotor_present"]
CHAIN_FLAGS = ["js.obfuscation_suspected", "js.regex_packing", "js.suspicious_apis"]
CHAIN_NUMBERS = ["js.string_concat_density", "js.escape_density"]


def _noted(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, trigger, action, payload (each the first by seq), ids and what the findings' metadata notes."""
    first = lambda kinds, name: F.min_by(F.when(_kinds(kinds), F.col("kind")), F.when(_kinds(kinds), F.col("seq"))).alias(name)
    plain = lambda k: k.replace(".", "_")
    flags = [F.coalesce(F.bool_or(F.col("meta")[k] == "true"), F.lit(False)).alias(plain(k)) for k in CHAIN_FLAGS] + [F.coalesce(F.max(F.col("meta")[k].try_cast("double")), F.lit(0.0)).alias(plain(k)) for k in CHAIN_NUMBERS]
    return rows.groupBy(*keys).agg(first(TRIGGERS, "trigger"), first(CHAIN_ACTIONS, "action"), first(PAYLOADS, "payload"), F.array_join(F.array_sort(F.collect_set("id")), ",").alias("ids"), *flags)


def object_chains(findings: DataFrame) -> DataFrame:
    """doc, object, trigger, action, payload, ids and notes: objects on which two roles or more meet, and (object null) every finding by itself; a role's first finding by seq names it.

    ``structural`` and ``tainted`` are the document's: its structural findings, and whether any of its kinds taints it.
    """
    each = findings.select("doc", "id", "kind", "seq", "meta", F.explode(F.array_distinct("objects")).alias("object")).filter(F.contains("object", F.lit("obj")))
    per = _noted(each, "doc", "object")
    roles = sum((F.col(c).isNotNull().cast("int") for c in ("trigger", "action", "payload")), F.lit(0))
    alone = _noted(findings.withColumn("own", F.col("id")), "doc", "own").withColumn("object", F.lit(None).cast("string")).drop("own")
    document = findings.groupBy("doc").agg(F.count_if(_kinds(STRUCTURAL)).alias("structural"), F.bool_or(_kinds(list(TAINT))).alias("tainted"))
    return per.filter(roles >= 2).unionByName(alone).join(document, "doc")


def score_chain(chains: DataFrame) -> DataFrame:
    """Adds score (the best rule that holds, at least 0.2) and the reasons in order."""
    at = F.col
    number = lambda c: F.format_string("%.3f", at(c))
    rules = [
        (at("trigger").isin("open_action_present", "aa_event_present"), 0.7, F.lit("Auto-trigger: document or event action")),
        (at("action") == "launch_action_present", 0.85, F.lit("Action severity: High (Launch)")),
        (at("action").isin("uri_javascript_scheme", "uri_file_scheme", "uri_data_html_scheme"), 0.85, F.lit("Action severity: High (Dangerous URI scheme — code execution vector)")),
        (at("action") == "uri_command_injection", 0.8, F.lit("Action severity: High (Command injection URI pattern)")),
        (at("action") == "js_present", 0.75, F.lit("Action severity: Medium (JavaScript)")),
        (at("action") == "submitform_present", 0.6, F.lit("Action severity: Medium (SubmitForm)")),
        (at("action") == "uri_content_analysis", 0.5, F.lit("Action severity: Low (URI)")),
        (F.contains("payload", F.lit("stream")), 0.65, F.lit("Payload: stream-based data")),
        (F.contains("payload", F.lit("image")), 0.55, F.lit("Payload: image data")),
        (at("js_obfuscation_suspected"), 0.85, F.lit("Payload: JS obfuscation suspected")),
        (at("js_string_concat_density") > 0.03, 0.7, F.concat(F.lit("Payload: string concat density "), number("js_string_concat_density"))),
        (at("js_escape_density") > 0.05, 0.7, F.concat(F.lit("Payload: escape density "), number("js_escape_density"))),
        (at("js_regex_packing"), 0.75, F.lit("Payload: regex packing patterns")),
        (at("js_suspicious_apis"), 0.8, F.lit("Payload: suspicious JavaScript APIs")),
        (at("structural") > 0, 0.7, F.concat(F.lit("Structure: "), at("structural"), F.lit(" suspicious finding(s)"))),
        (at("tainted"), 0.8, F.lit("Taint: suspicious constructs present")),
    ]
    score = F.greatest(F.lit(0.2), *[F.when(holds, value).otherwise(0.2) for holds, value, _ in rules])
    return chains.withColumns({"score": score, "reasons": F.array_compact(F.array(*[F.when(holds, text) for holds, _, text in rules]))})


def chain_templates(chains: DataFrame) -> DataFrame:
    """trigger, action, payload with the number of instances."""
    named = lambda c: F.coalesce(c, F.lit("-")).alias(c)
    return chains.groupBy(named("trigger"), named("action"), named("payload")).agg(F.count("*").alias("instances"))


def group_chains(chains: DataFrame) -> DataFrame:
    """Chains of a document with one signature: the best represents them, members are counted."""
    sig = F.sha2(F.concat_ws("|", *[F.coalesce(c, F.lit("-")) for c in ("trigger", "action", "payload")]), 256)
    best = Window.partitionBy("doc", "signature").orderBy(F.desc("score"), F.asc_nulls_last("object"), "ids")
    ranked = chains.withColumn("signature", sig).withColumns({"rank": F.row_number().over(best), "members": F.count("*").over(Window.partitionBy("doc", "signature"))})
    return ranked.filter("rank = 1").drop("rank")


def chain_conditions(findings: DataFrame) -> DataFrame:
    """doc, required, unmet: conditions named in metadata, and those without a satisfied one."""
    lists = lambda key: F.array_distinct(F.flatten(F.collect_list(F.transform(F.split(F.coalesce(F.col("meta")[key], F.lit("")), ";"), lambda x: F.trim(x)))))
    clean = lambda a: F.array_sort(F.filter(a, lambda x: x != ""))
    per = findings.groupBy("doc").agg(lists("exploit.preconditions").alias("req"), lists("exploit.satisfied").alias("sat"))
    return per.select("doc", clean(F.col("req")).alias("required"), clean(F.array_except("req", "sat")).alias("unmet"))


def finding_criticality(members: DataFrame, most: int = 30) -> DataFrame:
    """Drop of a chain's best weight when one member is left out, for chains of 2 to ``most`` members: (chain, id, weight)."""
    w = Window.partitionBy("chain")
    sized = members.withColumns({"n": F.count("*").over(w), "best": F.max("weight").over(w)}).filter(F.col("n").between(2, most))
    ties = sized.withColumn("at_best", F.count_if(F.col("weight") == F.col("best")).over(w))
    second = F.max(F.when(F.col("weight") < F.col("best"), F.col("weight"))).over(w)
    drop = F.when((F.col("weight") == F.col("best")) & (F.col("at_best") == 1), F.col("best") - F.coalesce(second, F.lit(0.0))).otherwise(0.0)
    return ties.withColumn("criticality", drop).select("chain", "id", "criticality")


def font_js(findings: DataFrame, most: int = 5) -> DataFrame:
    """doc, fonts, scripts: documents with high font and high script findings (kinds with ``js_``), up to five ids each in order of seq."""
    high = severity_rank(F.col("severity")) >= 3
    font, script = F.startswith("kind", F.lit("font.")) & high, F.contains("kind", F.lit("js_")) & high
    tagged = findings.select("doc", "id", "seq", F.explode(F.array_compact(F.array(F.when(font, "font"), F.when(script, "script")))).alias("role"))
    ranked = tagged.withColumn("rank", F.row_number().over(Window.partitionBy("doc", "role").orderBy("seq", "id"))).filter(F.col("rank") <= most)
    ids = lambda role: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("seq", "id")))), lambda x: x["id"]), ", ")
    return ranked.groupBy("doc").agg(ids("font").alias("fonts"), ids("script").alias("scripts")).filter("fonts <> '' and scripts <> ''")


def raise_fonts(findings: DataFrame) -> DataFrame:
    """Medium font findings become high in documents with obfuscated or polymorphic scripts; all other rows stay."""
    kind = F.col("kind")
    hidden = F.contains(kind, F.lit("js_")) & (F.contains(kind, F.lit("obfusc")) | F.contains(kind, F.lit("polymorphic")))
    medium = F.startswith("kind", F.lit("font.")) & (severity_rank(F.col("severity")) == 2)
    return escalate(findings, medium & F.col("__hidden"), {"__hidden": hidden}, F.lit(3), "js_obfuscation_present")


def escalate(findings: DataFrame, target: Column, flags: dict[str, Column], level: Column, reason: str) -> DataFrame:
    """Raises ``target`` rows to a severity rank computed from document flags; never lowers; says why."""
    doc = findings.groupBy("doc").agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in flags.items()])
    met = findings.join(doc, "doc")
    rank = severity_rank(F.col("severity"))
    new = F.when(target, F.greatest(rank, level)).otherwise(rank)
    changed = new > rank
    return met.withColumns({"severity": F.when(changed, severity_name(new)).otherwise(F.col("severity")), "escalation": F.when(changed, F.concat(F.lit(f"{reason}: "), F.col("severity")))}).drop(*flags)


def noisy_buckets(findings: DataFrame, noisy: list[str]) -> DataFrame:
    """doc, id, bucket of ambiguous kinds: correlated_high_risk, correlated or likely_noise by shared risky objects and scripts."""
    risky = findings.filter(severity_rank(F.col("severity")) >= 3).filter(~_kinds(noisy))
    overlap = shares_object(findings.filter(_kinds(noisy)), risky).select("doc", F.col("a").alias("id")).distinct().withColumn("near", F.lit(True))
    flag = findings.groupBy("doc").agg(F.bool_or(_kinds(SCRIPTS)).alias("js"))
    rows = findings.filter(_kinds(noisy)).select("doc", "id").join(overlap, ["doc", "id"], "left").join(flag, "doc")
    near = F.coalesce("near", F.lit(False))
    return rows.select("doc", "id", F.when(near & F.col("js"), "correlated_high_risk").when(near | F.col("js"), "correlated").otherwise("likely_noise").alias("bucket"))


def attack_pattern(findings: DataFrame) -> DataFrame:
    """doc, pattern: the first label whose document flags hold."""
    has = lambda s: F.bool_or(F.contains("kind", F.lit(s)))
    per = findings.groupBy("doc").agg(has("js").alias("js"), has("launch").alias("launch"), has("embedded").alias("embedded"), has("uri").alias("uri"), has("phishing").alias("phishing"))
    label = (
        F.when(F.col("js") & F.col("embedded"), "JavaScript-delivered payload").when(F.col("launch"), "External program launch").when(F.col("phishing") & F.col("uri"), "Phishing with external link")
        .when(F.col("js"), "JavaScript exploitation").when(F.col("uri"), "Suspicious external reference").otherwise("Unclassified")
    )
    return per.select("doc", label.alias("pattern"))


def yara_rows(findings: DataFrame, scope: int = 3, most: int = 6) -> DataFrame:
    """Rule name, tags and up to six strings for findings at or above a severity rank."""
    name = F.concat(F.lit("corpus_"), F.regexp_replace("kind", "[^A-Za-z0-9_]", "_"))
    strings = F.slice(F.array_distinct(F.concat(F.array_compact(F.array("kind", "action_target")), F.map_values("meta"))), 1, most)
    return findings.filter(severity_rank(F.col("severity")) >= scope).select("doc", "id", name.alias("rule"), F.concat_ws(",", "surface", "severity").alias("tags"), strings.alias("strings"))


def best_confidence(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(confidence_rank(F.col("confidence"))).alias("conf_rank"))
