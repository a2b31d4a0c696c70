"""Selections, counts and caps over the finding table. Every group is keyed by document unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.operators.ranks import numbered
from corpuscle.schemas import confidence_rank, severity_name, severity_rank
from corpuscle.session import stash

#: Kinds kept at any severity, and kinds that are replaced by one row each.
ALWAYS_KEPT = [
    "js_emulation_breakpoint", "js_runtime_unknown_behaviour_pattern", "js_sandbox_timeout", "js_runtime_error",
    "launch_external_program", "launch_embedded_file", "action_chain_malicious", "launch_obfuscated_executable",
    "encrypted_payload_delivery", "image_decoder_exploit_chain", "embedded_file_present",
]
NOISY = ["content_stream_anomaly", "label_mismatch_stream_type", "image.decode_skipped", "font.dynamic_parse_failure", "font.ttf_hinting_suspicious"]
ANNOTATION_CHAIN = "annotation_action_chain"


def by_severity(df: DataFrame, severity: str) -> DataFrame:
    return df.filter(F.lower("severity") == severity.lower())


def by_kind(df: DataFrame, kind: str) -> DataFrame:
    return df.filter(F.col("kind") == kind)


def composites(df: DataFrame) -> DataFrame:
    return df.filter(F.col("meta")["is_composite"] == "true")


def compact(df: DataFrame) -> DataFrame:
    """Without info and low rows; rows without severity stay."""
    return df.filter(F.col("severity").isNull() | ~F.lower("severity").isin("info", "low"))


def summary(df: DataFrame, *keys: str) -> DataFrame:
    """total, high (critical counts as high), medium, low, info."""
    level = F.lower("severity")
    counts = [F.count("*").alias("total"), F.count_if(level.isin("high", "critical")).alias("high")]
    return df.groupBy(*keys).agg(*counts, *[F.count_if(level == s).alias(s) for s in ("medium", "low", "info")])


def grouped(df: DataFrame) -> DataFrame:
    """surface, kind, sorted ids of each document."""
    return df.groupBy("doc", "surface", "kind").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def digest(df: DataFrame) -> DataFrame:
    """Counts by severity, by surface and by kind in one pass: dim, value, n."""
    dims = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("value")) for d in ("severity", "surface", "kind")]))
    return df.select(dims.alias("d")).groupBy("d.dim", "d.value").agg(F.count("*").alias("n"))


def bucket_counts(df: DataFrame, key: str) -> DataFrame:
    """Totals of ``name:n,name:n`` metadata; a missing number counts one."""
    parts = df.select(F.explode(F.split(F.col("meta")[key], ",")).alias("part")).filter(F.trim("part") != "")
    name, n = F.trim(F.split("part", ":")[0]), F.coalesce(F.trim(F.get(F.split("part", ":"), F.lit(1))).try_cast("int"), F.lit(1))
    return parts.groupBy(name.alias("bucket")).agg(F.sum(n).alias("n"))


def daily_summary(df: DataFrame, day: Column) -> DataFrame:
    """date, dim, value, n by kind, severity, impact, confidence and surface; missing values are ``unknown``."""
    named = lambda *cs: F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cs], F.lit("unknown"))
    dims = {"kind": ("kind", "id"), "severity": ("severity",), "impact": ("impact",), "confidence": ("confidence",), "surface": ("surface",)}
    cells = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), named(*cs).alias("value")) for d, cs in dims.items()]))
    return df.select(day.alias("date"), cells.alias("c")).groupBy("date", "c.dim", "c.value").agg(F.count("*").alias("n"))


def cap_per_kind(df: DataFrame, cap: int = 25, samples: int = 8) -> DataFrame:
    """The first ``cap`` rows of each kind of a document; the first tells how many there were and samples what was left out.

    Ranks are kept, not lists: samples are taken of the ``samples`` rows after the cap only.
    """
    order = Window.partitionBy("doc", "kind").orderBy("seq", "id")
    ranked = df.withColumns({"rank": F.row_number().over(order), "total": F.count("*").over(Window.partitionBy("doc", "kind"))})
    left_out = ranked.filter((F.col("rank") > cap) & (F.col("rank") <= cap + samples))
    sampled = left_out.groupBy("doc", "kind").agg(F.array_sort(F.collect_set(F.get("objects", F.lit(0)))).alias("sample_objects"))
    kept = ranked.filter(F.col("rank") <= cap).join(sampled, ["doc", "kind"], "left")
    first = (F.col("rank") == 1) & (F.col("total") > cap)
    return kept.withColumns({
        "cap_total": F.when(first, F.col("total")),
        "cap_retained": F.when(first, F.lit(cap).cast("long")),
        "cap_suppressed": F.when(first, F.col("total") - cap),
        "sample_objects": F.when(first, F.col("sample_objects")),
    }).drop("total")


def top_pairs(counts: DataFrame, n: int, key: str = "value", count: str = "n") -> DataFrame:
    return counts.orderBy(F.desc(count), F.asc(key)).limit(n)


def top_pairs_by(counts: DataFrame, group: str, n: int, key: str = "value", count: str = "n") -> DataFrame:
    order = Window.partitionBy(group).orderBy(F.desc(count), F.asc(key))
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def order_by_severity(df: DataFrame) -> DataFrame:
    return df.orderBy(severity_rank(F.col("severity")).desc(), "kind", "id")


def numbered_by_severity(df: DataFrame) -> DataFrame:
    """Every row with its place in that order, from 1: a sort by range, then each partition's rows after those of the ones before."""
    rows = stash(order_by_severity(df).withColumn("at", F.monotonically_increasing_id()), "ordered").withColumn("part", F.shiftright("at", 33))
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"))
    later = sizes.select(F.col("part").alias("other"), "n")
    before = sizes.select("part").join(F.broadcast(later), F.col("other") < F.col("part"), "left").groupBy("part").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("before"))
    inside = F.col("at") - F.shiftleft("part", 33)
    return rows.join(F.broadcast(before), "part").withColumn("place", F.col("before") + inside + 1).drop("at", "part", "before")


def sort_findings(df: DataFrame) -> DataFrame:
    """Every row with its place, from 0, in the order of kind, canonical objects and id, numbered block by block."""
    keyed = df.withColumn("__objects", F.array_join(canonical_objects(F.col("objects")), "|"))
    return numbered(keyed, (), ("kind", "__objects", "id")).drop("__objects")


def canonical_objects(objects: Column) -> Column:
    return F.array_sort(F.array_distinct(objects))


def aggregate_noisy(df: DataFrame, kinds: list[str] = NOISY, signature: Column | None = None) -> DataFrame:
    """One row a document and noisy kind: count, signatures, the eight commonest as ``Nx:sig``, twelve sample objects, level by count."""
    sig = F.concat_ws("|", "surface", F.coalesce(F.get("objects", F.lit(0)), F.lit("-"))) if signature is None else signature
    noisy = df.filter(F.col("kind").isin(kinds)).withColumn("sig", sig)
    by_sig = noisy.groupBy("doc", "kind", "sig").agg(F.count("*").alias("n"))
    ranked = by_sig.withColumn("rank", F.row_number().over(Window.partitionBy("doc", "kind").orderBy(F.desc("n"), "sig")))
    shown = F.array_sort(F.collect_list(F.when(F.col("rank") <= 8, F.struct("rank", F.concat(F.col("n"), F.lit("x:"), F.col("sig")).alias("text")))))
    heads = ranked.groupBy("doc", "kind").agg(F.sum("n").alias("n"), F.count("*").alias("signatures"), F.array_join(F.transform(shown, lambda x: x["text"]), ",").alias("top"))
    objects = noisy.select("doc", "kind", F.explode("objects").alias("o")).distinct()
    objects = objects.withColumn("rank", F.row_number().over(Window.partitionBy("doc", "kind").orderBy("o"))).filter("rank <= 12")
    samples = objects.groupBy("doc", "kind").agg(F.array_join(F.array_sort(F.collect_list("o")), ",").alias("sample_objects"))
    level = F.when(F.col("n") >= 120, "high").when(F.col("n") >= 40, "medium").otherwise("low")
    return heads.join(samples, ["doc", "kind"], "left").withColumns({"severity": level, "confidence": F.when(F.col("n") >= 40, "strong").otherwise("probable")})


def aggregate_annotation(df: DataFrame) -> DataFrame:
    """One row a document for annotation chains: count, distinct pages, level by count."""
    rows = df.filter(F.col("kind") == ANNOTATION_CHAIN)
    out = rows.groupBy("doc").agg(F.count("*").alias("n"), F.count_distinct(F.col("meta")["page.number"]).alias("pages"))
    level = F.when(F.col("n") >= 40, "high").when(F.col("n") >= 20, "medium").otherwise("low")
    return out.withColumns({"severity": level, "confidence": F.when(F.col("n") >= 20, "strong").otherwise("probable")})


def focused_triage(df: DataFrame) -> DataFrame:
    """High and critical rows, always-kept kinds, and one aggregate row for each noisy kind: doc, kind, id, severity."""
    noisy = [*NOISY, ANNOTATION_CHAIN]
    keep = ~F.col("kind").isin(noisy) & (F.lower("severity").isin("high", "critical") | F.col("kind").isin(ALWAYS_KEPT))
    rows = df.filter(keep).select("doc", "kind", "id", F.lower("severity").alias("severity"))
    own = lambda a: a.select("doc", "kind", F.concat(F.lit("aggregate:"), F.col("kind")).alias("id"), "severity")
    annotation = aggregate_annotation(df).withColumn("kind", F.lit(ANNOTATION_CHAIN))
    return rows.unionByName(own(aggregate_noisy(df))).unionByName(own(annotation))


def behavior_patterns(df: DataFrame) -> DataFrame:
    """Objects with two findings or more (their kinds) and kinds with three or more (their objects), with the worst severity."""
    each = df.select("doc", "kind", "id", severity_rank(F.col("severity")).alias("rank"), F.explode("objects").alias("object"))
    by_object = each.groupBy("doc", "object").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("members"), F.max("rank").alias("rank")).filter("n >= 2")
    counted = df.groupBy("doc", "kind").agg(F.count("*").alias("n"), F.max(severity_rank(F.col("severity"))).alias("rank")).filter("n >= 3")
    members = each.groupBy("doc", "kind").agg(F.array_join(F.array_sort(F.collect_set("object")), ",").alias("members"))
    by_kind_ = counted.join(members, ["doc", "kind"], "left")
    shape = lambda d, prefix, name: d.select("doc", F.concat(F.lit(prefix), F.col(name)).alias("pattern"), "n", "members", severity_name(F.col("rank")).alias("severity"))
    return shape(by_object, "object:", "object").unionByName(shape(by_kind_, "kind:", "kind"))


def predict_evolution(patterns: DataFrame) -> DataFrame:
    """What a pattern of kinds may grow into: a dropper (script and embedded), else external execution (launch)."""
    has = lambda s: F.contains("members", F.lit(s))
    threat = F.when(has("js") & has("embedded"), F.struct(F.lit("payload_dropper").alias("threat"), F.lit(0.7).alias("likelihood"))).when(
        has("launch"), F.struct(F.lit("external_execution").alias("threat"), F.lit(0.6).alias("likelihood"))
    )
    return patterns.withColumn("t", threat).filter("t is not null").select("doc", "pattern", "t.threat", "t.likelihood")


#: Kind prefixes of the resource buckets, tried in this order.
RESOURCE_BUCKETS = {"js": "js-runtime", "font": "font", "content": "content", "image": "decode", "decode": "decode", "stream": "decode"}


def resource_contribution(df: DataFrame, n: int = 8) -> DataFrame:
    """The kinds that contribute most to each resource bucket."""
    bucket = F.lit("structural")
    for prefix, name in reversed(RESOURCE_BUCKETS.items()):
        bucket = F.when(F.startswith("kind", F.lit(prefix)), name).otherwise(bucket)
    counts = df.groupBy(bucket.alias("bucket"), "kind").agg(F.count("*").alias("n"))
    return top_pairs_by(counts, "bucket", n, "kind")


def prevalence(df: DataFrame, dims: dict[str, Column], n: int = 8) -> DataFrame:
    """The commonest values of several dimensions as ``k=n`` pairs."""
    cells = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), c.cast("string").alias("value")) for d, c in dims.items()]))
    counts = df.select(cells.alias("c")).filter("c.value is not null").groupBy("c.dim", "c.value").agg(F.count("*").alias("n"))
    top = top_pairs_by(counts, "dim", n)
    pairs = F.array_sort(F.collect_list(F.struct("rank", F.concat_ws("=", "value", "n").alias("text"))))
    return top.groupBy("dim").agg(F.array_join(F.transform(pairs, lambda x: x["text"]), ", ").alias("pairs"))


def batch_report(files: DataFrame) -> DataFrame:
    """Totals over per-file rows (total, high, medium, low, info, duration_ms); the average duration is a whole number."""
    sums = [F.sum(c).alias(c) for c in ("total", "high", "medium", "low", "info")]
    out = files.agg(F.count("*").alias("files"), *sums, F.sum("duration_ms").alias("total_ms"), F.max("duration_ms").alias("max_ms"))
    return out.withColumn("avg_ms", F.expr("total_ms div files"))


def stable_id(df: DataFrame) -> DataFrame:
    """Content hash of kind, surface, objects and evidence spans."""
    spans = F.array_join(F.transform("evidence", lambda e: F.concat_ws(":", e["source"], e["offset"], e["length"])), ",")
    return df.withColumn("stable_id", F.sha2(F.concat_ws("|", "kind", "surface", F.array_join("objects", ","), spans), 256))


def confidence_order(df: DataFrame) -> DataFrame:
    return df.orderBy(confidence_rank(F.col("confidence")), "kind", "id")
