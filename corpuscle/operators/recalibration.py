"""Severity and confidence of findings raised, or set, by what else their document shows, with the change on record."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.schemas import confidence_name, confidence_rank, severity_name, severity_rank

#: Kinds by what they tell about a document.
FILTER_ANOMALY = ["declared_filter_invalid", "filter_chain_unusual", "filter_order_invalid", "filter_combination_unusual", "label_mismatch_stream_type"]
RUNTIME_ANOMALY = ["js_emulation_breakpoint", "js_runtime_unknown_behaviour_pattern", "js_sandbox_timeout", "js_runtime_error", "js_runtime_error_recovery_patterns", "js_runtime_heap_manipulation", "js_runtime_recursion_limit"]
DECODE_RISK = ["decoder_risk_present", "decompression_ratio_suspicious"]
INCONSISTENCY = ["pdf.trailer_inconsistent", "xref_conflict", "xref_start_offset_oob", "xref_phantom_entries", "structural_evasion_composite", "parser_trailer_count_diff", "parser_diff_structural"]
EXHAUSTION = ["parser_resource_exhaustion"]
ACTION_CHAIN = ["action_chain_complex", "action_chain_malicious", "annotation_action_chain", "action_automatic_trigger"]
SCRIPT_INTENT = ["js_intent_user_interaction", "js_runtime_network_intent", "js_runtime_downloader_pattern", "js_obfuscation_deep", "js_malicious_pattern"]
LAUNCH = ["launch_action_present", "launch_external_program", "launch_embedded_file", "launch_obfuscated_executable"]
PARSER_DIFFERENCE, HAZARD = ["parser_diff_structural", "object_shadow_mismatch"], "creation_date_trailing_timezone_token"


@dataclass(frozen=True)
class Rule:
    """Where a document shows all of ``needs``, findings of ``kinds`` are at least ``severity`` and ``confidence``."""

    needs: tuple[str, ...]
    kinds: list[str]
    severity: str
    confidence: str
    reason: str


#: No kind is under two rules.
RULES = [
    Rule(("filter", "runtime"), FILTER_ANOMALY, "high", "strong", "filter_runtime_anomaly_cooccurrence"),
    Rule(("decode", "structure", "exhaustion"), [*DECODE_RISK, "image_decoder_exploit_chain"], "critical", "strong", "decode_structural_exhaustion_chain"),
    Rule(("decode", "structure", "exhaustion"), [*EXHAUSTION, "pdf.trailer_inconsistent", "xref_conflict", "structural_evasion_composite"], "high", "strong", "decode_structural_exhaustion_chain"),
    Rule(("action", "intent", "launch"), [*ACTION_CHAIN, "launch_action_present", "launch_external_program", "launch_embedded_file"], "high", "strong", "action_js_launch_chain"),
]


def _of(kinds: list[str]) -> Column:
    return F.col("kind").isin(kinds)


def risky() -> Column:
    """Actions, launches and scripts."""
    return F.startswith("kind", F.lit("js_")) | F.startswith("kind", F.lit("action_")) | _of(["annotation_action_chain", *LAUNCH])


def recalibrate(findings: DataFrame) -> DataFrame:
    """All findings, with severity and confidence as the rules leave them, and reason, severity_change and confidence_change (``old->new``) where one did something.

    Parser differences with a harmless hazard are set to low and strong; where an object that they name is one
    of an action, a launch or a script, they are raised to high and strong instead.
    """
    signs = {
        "filter": _of(FILTER_ANOMALY), "runtime": _of(RUNTIME_ANOMALY), "decode": _of(DECODE_RISK), "structure": _of(INCONSISTENCY), "exhaustion": _of(EXHAUSTION), "action": _of(ACTION_CHAIN),
        "intent": _of(SCRIPT_INTENT) | F.coalesce(F.map_contains_key("meta", "js.intent.primary"), F.lit(False)), "launch": _of(LAUNCH),
    }
    document = findings.groupBy("doc").agg(*[F.bool_or(F.coalesce(c, F.lit(False))).alias(f"__{n}") for n, c in signs.items()])
    hazard = _of(PARSER_DIFFERENCE) & F.coalesce(F.contains(F.col("meta")["diff.missing_in_secondary_hazards"], F.lit(HAZARD)), F.lit(False))
    number = lambda c: F.regexp_extract(c, r"(\d+\s+\d+)", 1)
    refs = findings.filter(risky()).select("doc", F.explode(F.array_distinct(F.transform("objects", number))).alias("ref")).filter("ref <> ''").distinct()
    named = findings.filter(hazard).select("doc", "id", F.explode(F.transform(F.split(F.coalesce(F.col("meta")["diff.missing_in_secondary_ids"], F.lit("")), ","), number)).alias("ref"))
    near = named.join(refs, ["doc", "ref"]).select("doc", "id", F.lit(True).alias("__near")).distinct()
    met = findings.join(document, "doc").join(near, ["doc", "id"], "left")
    cell = lambda s, c, why, sets: F.struct(severity_rank(F.lit(s)).alias("s"), confidence_rank(F.lit(c)).alias("c"), F.lit(why).alias("why"), F.lit(sets).alias("sets"))
    rule = F.when(hazard & F.coalesce("__near", F.lit(False)), cell("high", "strong", "parser_hazard_on_action_or_js_object", False)).when(hazard, cell("low", "strong", "parser_hazard_metadata_only", True))
    for r in RULES:
        holds = _of(r.kinds)
        for n in r.needs:
            holds = holds & F.col(f"__{n}")
        rule = rule.when(holds, cell(r.severity, r.confidence, r.reason, False))
    old_s, old_c = severity_rank(F.col("severity")), confidence_rank(F.col("confidence"))
    ruled = met.withColumn("__r", rule).withColumns({"__s": old_s, "__c": old_c})
    ruled = ruled.withColumns({"__ns": F.when(F.col("__r.sets"), F.col("__r.s")).otherwise(F.greatest("__s", "__r.s")), "__nc": F.when(F.col("__r.sets"), F.col("__r.c")).otherwise(F.least("__c", "__r.c"))})
    changed = F.col("__r").isNotNull() & ((F.col("__ns") != F.col("__s")) | (F.col("__nc") != F.col("__c")))
    move = lambda old, new: F.when(changed, F.concat(old, F.lit("->"), new))
    out = ruled.withColumns({
        "reason": F.when(changed, F.col("__r.why")), "severity_change": move(severity_name(F.col("__s")), severity_name(F.col("__ns"))), "confidence_change": move(confidence_name(F.col("__c")), confidence_name(F.col("__nc"))),
        "severity": F.when(changed, severity_name(F.col("__ns"))).otherwise(F.col("severity")), "confidence": F.when(changed, confidence_name(F.col("__nc"))).otherwise(F.col("confidence")),
    })
    return out.select(*findings.columns, "reason", "severity_change", "confidence_change")
