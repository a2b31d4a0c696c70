"""Features, baselines, scores and explanations. Feature tables are long (doc, name, value) until a model needs an array."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.operators.ranks import at_ranks
from corpuscle.schemas import CONFIDENCES, SEVERITIES, SURFACES, confidence_rank, severity_rank

#: Weights by severity (from critical down) and by confidence (from certain on).
SEVERITY_WEIGHT = {"critical": 1.0, "high": 0.8, "medium": 0.5, "low": 0.2, "info": 0.0}
CONFIDENCE_WEIGHT = {"certain": 1.0, "strong": 1.0, "probable": 0.7, "tentative": 0.5, "weak": 0.3, "heuristic": 0.4}
PERCENTILES = [10, 25, 50, 75, 90, 95, 99]


def _weight(c: Column, weights: dict[str, float]) -> Column:
    return reduce(lambda out, kv: F.when(F.lower(c) == kv[0], kv[1]).otherwise(out), weights.items(), F.lit(0.0))


def object_risk(findings: DataFrame) -> DataFrame:
    """doc, object, risk: least(1, sum of severity weights * mean confidence weight / rows)."""
    each = findings.select("doc", F.explode("objects").alias("object"), _weight(F.col("severity"), SEVERITY_WEIGHT).alias("s"), _weight(F.col("confidence"), CONFIDENCE_WEIGHT).alias("c"))
    return each.groupBy("doc", "object").agg(F.count("*").alias("n"), F.least(F.lit(1.0), F.sum("s") * F.avg("c") / F.count("*")).alias("risk"))


def document_summary(findings: DataFrame) -> DataFrame:
    """doc, objects, worst risk, surfaces, findings."""
    risk = object_risk(findings).groupBy("doc").agg(F.count("*").alias("objects"), F.max("risk").alias("max_risk"))
    return risk.join(findings.groupBy("doc").agg(F.count_distinct("surface").alias("surfaces"), F.count("*").alias("findings")), "doc")


def severity_features(findings: DataFrame) -> DataFrame:
    """Counts by severity, mean rank and confidence-weighted mean of a document."""
    rank, conf = severity_rank(F.col("severity")), _weight(F.col("confidence"), CONFIDENCE_WEIGHT)
    counts = [F.count_if(F.lower("severity") == s).alias(f"n_{s}") for s in SEVERITIES]
    return findings.groupBy("doc").agg(*counts, F.avg(rank).alias("avg_rank"), (F.sum(rank * conf) / F.sum(conf)).alias("weighted_rank"), F.max(rank).alias("max_rank"))


def confidence_features(findings: DataFrame) -> DataFrame:
    """Counts by confidence, the same among high and critical rows, and the share of strong ones."""
    level, high = F.lower("confidence"), severity_rank(F.col("severity")) >= 3
    every = [F.count_if(level == c).alias(f"n_{c}") for c in CONFIDENCES]
    among = [F.count_if((level == c) & high).alias(f"high_{c}") for c in CONFIDENCES]
    return findings.groupBy("doc").agg(*every, *among, (F.count_if(confidence_rank(F.col("confidence")) <= 1) / F.count("*")).alias("strong_ratio"))


def surface_features(findings: DataFrame) -> DataFrame:
    return findings.groupBy("doc").agg(*[F.count_if(F.col("surface") == s).alias(f"n_{s}") for s in SURFACES])


def kind_features(findings: DataFrame, kinds: list[str]) -> DataFrame:
    """Presence and count of each kind of a fixed list: doc, name, value."""
    counts = findings.filter(F.col("kind").isin(kinds)).groupBy("doc", "kind").agg(F.count("*").cast("double").alias("value"))
    named = lambda p, v: counts.select("doc", F.concat(F.lit(p), F.col("kind")).alias("name"), v.alias("value"))
    return named("count.", F.col("value")).unionByName(named("present.", F.lit(1.0)))


def signal_features(findings: DataFrame, family: dict[str, str]) -> DataFrame:
    """doc and one column a metadata key: ``max``, ``avg`` or ``count`` (rows where it is true) as the family says."""
    value = lambda k: F.col("meta")[k].try_cast("double")
    how = {"max": lambda k: F.max(value(k)), "avg": lambda k: F.avg(value(k)), "count": lambda k: F.count_if(F.col("meta")[k] == "true")}
    return findings.groupBy("doc").agg(*[how[h](k).alias(k.replace(".", "_")) for k, h in family.items()])


def js_risk_profile(findings: DataFrame) -> DataFrame:
    """doc, count, worst obfuscation, eval use, multi-stage use, evasions and the capped risk of script findings."""
    score = F.col("meta")["js.obfuscation_score"].try_cast("double")
    has = lambda *ss: F.bool_or(reduce(lambda a, s: a | F.contains("kind", F.lit(s)), ss, F.lit(False)))
    evasions = F.count_if(F.map_contains_key("meta", "js.time_evasion")) + F.count_if(F.map_contains_key("meta", "js.environment_detect"))
    per = findings.filter(F.col("surface") == "javascript").groupBy("doc").agg(F.count("*").alias("n"), F.coalesce(F.max(score), F.lit(0.0)).alias("max_obfuscation"), has("eval", "function_constructor").alias("eval_usage"), has("multi_stage", "polymorphic").alias("multi_stage"), evasions.alias("evasions"))
    risk = F.col("max_obfuscation") * 0.4 + F.when(F.col("eval_usage"), 0.3).otherwise(0.0) + F.when(F.col("multi_stage"), 0.2).otherwise(0.0) + F.col("evasions") * 0.1
    return per.withColumn("risk", F.least(F.lit(1.0), risk))


def document_risk(findings: DataFrame) -> DataFrame:
    """doc, counts by severity, surfaces, and both ends of the confidence order (weakest and best rank, named apart)."""
    rank = severity_rank(F.col("severity"))
    counts = [F.count_if(rank == i).alias(s) for i, s in enumerate(SEVERITIES)]
    conf = confidence_rank(F.col("confidence"))
    return findings.groupBy("doc").agg(*counts, F.count_distinct("surface").alias("surfaces"), F.max(conf).alias("weakest_conf"), F.min(conf).alias("best_conf"))


def baseline(features: DataFrame) -> DataFrame:
    """name, n, mean, sd and seven nearest-rank percentiles at ``round(p / 100 * (n - 1))``, exactly; no task holds a whole feature."""
    ranks = at_ranks(features, ("name",), "value", [p / 100 for p in PERCENTILES])
    picked = ranks.select("name", "n", *[F.get("at", F.lit(i)).alias(f"p{p}") for i, p in enumerate(PERCENTILES)])
    return features.groupBy("name").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd")).join(picked, "name")


def comparative(features: DataFrame, base: DataFrame, n: int, least: float = 1.5) -> DataFrame:
    """doc, name, value, z, rank: features beyond ``least`` deviations, the n furthest of a document. No baseline: mean 0, sd 1."""
    met = features.join(base.select("name", "mean", "sd"), "name", "left")
    mean, sd = F.coalesce("mean", F.lit(0.0)), F.coalesce("sd", F.lit(1.0))
    z = F.when(sd > 0, (F.col("value") - mean) / sd).otherwise(0.0)
    far = met.withColumn("z", z).filter(F.abs("z") > least)
    return far.withColumn("rank", F.row_number().over(Window.partitionBy("doc").orderBy(F.abs("z").desc(), "name"))).filter(F.col("rank") <= n).select("doc", "name", "value", "z", "rank")


def percentile_of(value: Column, cuts: list[Column]) -> Column:
    """Interpolated rank of a value among the seven percentiles, 10 to 99; segments of no width give their lower end."""
    out = F.lit(99.0)
    for (p, lo), (q, hi) in reversed(list(zip(zip(PERCENTILES, cuts, strict=True), list(zip(PERCENTILES, cuts, strict=True))[1:], strict=False))):
        inside = F.when(hi > lo, p + (value - lo) / (hi - lo) * (q - p)).otherwise(float(p))
        out = F.when(value <= hi, inside).otherwise(out)
    return F.when(value <= cuts[0], 10.0).otherwise(out)


def feature_interactions(features_z: DataFrame, n: int, least: float = 2.0) -> DataFrame:
    """doc, a, b, score of pairs of far features (|z| at least ``least``), the n strongest of a document."""
    far = features_z.filter(F.abs("z") >= least)
    a, b = far.select("doc", F.col("name").alias("a"), F.abs("z").alias("za")), far.select("doc", F.col("name").alias("b"), F.abs("z").alias("zb"))
    pairs = a.join(b, "doc").filter("a < b").withColumn("score", F.col("za") * F.col("zb"))
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("score"), "a", "b"))).filter(F.col("rank") <= n).select("doc", "a", "b", "score", "rank")


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def linear_score(features: DataFrame, weights: dict[str, float], bias: float) -> DataFrame:
    """doc, score of a linear model over long features; weights are a literal map."""
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    z = features.groupBy("doc").agg((F.sum(F.coalesce(F.try_element_at(w, F.col("name")), F.lit(0.0)) * F.col("value")) + bias).alias("z"))
    return z.withColumn("score", logistic(F.col("z")))


def stacked_score(scores: DataFrame, bases: list[str], weights: list[float], bias: float, threshold: float) -> DataFrame:
    """Base scores into a meta model, with its label."""
    z = reduce(lambda a, x: a + F.col(x[0]) * x[1], zip(bases, weights, strict=True), F.lit(bias))
    return scores.withColumn("score", logistic(z)).withColumn("label", F.col("score") >= threshold)


def calibrate(score: Column, a: float, b: float) -> Column:
    """Platt: struct of probability and the ends of its interval, 0.4 p (1 - p) on either side."""
    p = 1 / (1 + F.exp(-(a * score) - b))
    half = 0.4 * p * (1 - p)
    return F.struct(p.alias("p"), F.greatest(F.lit(0.0), p - half).alias("low"), F.least(F.lit(1.0), p + half).alias("high"))


def isotonic(score: Column, points: list[tuple[float, float]]) -> Column:
    """Linear between the points, level beyond them."""
    out = F.lit(points[-1][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(points, points[1:], strict=False))):
        out = F.when(score <= x1, y0 + (score - x0) * ((y1 - y0) / (x1 - x0) if x1 > x0 else 0.0)).otherwise(out)
    return F.when(score <= points[0][0], F.lit(points[0][1])).otherwise(out)


def contributions(features: DataFrame, base: DataFrame, weights: dict[str, float]) -> DataFrame:
    """doc, name, contribution: how far a linear logit moves from the feature's mean; no second scan."""
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    met = features.join(base.select("name", "mean"), "name", "left")
    return met.select("doc", "name", (F.coalesce(F.try_element_at(w, F.col("name")), F.lit(0.0)) * (F.col("value") - F.coalesce("mean", F.lit(0.0)))).alias("contribution"))


def permutation_importance(features: DataFrame, base: DataFrame, weights: dict[str, float], bias: float) -> DataFrame:
    """doc, name, importance: how far the score falls when that feature alone is set to its baseline mean (0 without one); the model is not run again."""
    moved = contributions(features, base, weights).join(linear_score(features, weights, bias).select("doc", "z"), "doc")
    return moved.select("doc", "name", (logistic(F.col("z")) - logistic(F.col("z") - F.col("contribution"))).alias("importance"))


def explain_top(parts: DataFrame, n: int = 10) -> DataFrame:
    """The n largest positive and negative contributions of each document."""
    side = F.when(F.col("contribution") > 0, "positive").when(F.col("contribution") < 0, "negative")
    signed = parts.withColumn("side", side).filter("side is not null")
    order = Window.partitionBy("doc", "side").orderBy(F.abs("contribution").desc(), "name")
    return signed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def group_importance(parts: DataFrame) -> DataFrame:
    """Sum of absolute contributions by the name's prefix before its last dot (``legacy`` without one)."""
    prefix = F.regexp_extract("name", r"^(.*)\.", 1)
    return parts.groupBy("doc", F.when(prefix == "", "legacy").otherwise(prefix).alias("grp")).agg(F.sum(F.abs("contribution")).alias("importance"))


def counterfactual(parts: DataFrame, logits: DataFrame, target: float, n: int) -> DataFrame:
    """The fewest features, largest drop first, whose return to the mean brings a logit down to the target; at most n."""
    drops = parts.filter("contribution > 0").join(logits.select("doc", "z"), "doc")
    order = Window.partitionBy("doc").orderBy(F.desc("contribution"), "name")
    ranked = drops.withColumns({"rank": F.row_number().over(order), "before": F.coalesce(F.sum("contribution").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))})
    return ranked.filter((F.col("z") - F.col("before") > target) & (F.col("rank") <= n)).select("doc", "name", "contribution", "rank", (F.col("z") - F.col("before") - F.col("contribution")).alias("z_after"))


def evaluate(scored: DataFrame, positive: Column, hit: Column, hit_strict: Column) -> DataFrame:
    """Rates of a classifier: positives by one signal, negatives by a narrower one, and whether they pass the thresholds."""
    rate = lambda c, among: F.avg(F.when(among, c.cast("double")))
    out = scored.agg(F.count("*").alias("n"), rate(hit, positive).alias("tpr"), rate(hit_strict, ~positive).alias("fpr"))
    return out.withColumn("passes", (F.col("tpr") >= 0.85) & (F.col("fpr") < 0.05))


def centroid(counts: DataFrame, vector: str = "stream_id", key: str = "family", n: str = "n") -> DataFrame:
    """Mean share of each key over all vectors (a missing key is 0; negative counts are 0)."""
    own = counts.select(vector, key, F.greatest(F.col(n), F.lit(0)).cast("double").alias("c"))
    share = own.withColumn("share", F.col("c") / F.sum("c").over(Window.partitionBy(vector))).filter("share is not null")
    total = counts.agg(F.count_distinct(vector).alias("vectors"))
    return share.groupBy(key).agg(F.sum("share").alias("s")).join(F.broadcast(total)).select(key, (F.col("s") / F.col("vectors")).alias("share"))


def op_families(tokens: DataFrame, families: dict[str, str], opens: str = "q", closes: str = "Q") -> DataFrame:
    """stream_id, family counts as n by family, deepest nesting and underflows over an ordered token stream."""
    step = F.when(F.col("token") == opens, 1).when(F.col("token") == closes, -1).otherwise(0)
    order = Window.partitionBy("stream_id").orderBy("pos")
    run = tokens.withColumn("depth", F.sum(step).over(order)).withColumn("floor", F.least(F.lit(0), F.min("depth").over(order)))
    family = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in families.items() for x in kv]), F.col("token")), F.lit("other"))
    nest = run.groupBy("stream_id").agg(F.max(F.col("depth") - F.col("floor")).alias("max_depth"), (-F.min("floor")).alias("underflows"))
    return tokens.groupBy("stream_id", family.alias("family")).agg(F.count("*").alias("n")).join(nest, "stream_id")
