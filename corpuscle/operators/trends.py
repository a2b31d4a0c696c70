"""Day, week and month summaries, regressions and histories over long count tables (date, dim, value, n)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.schemas import severity_rank


def run_summary(files: DataFrame, findings: DataFrame, *keys: str) -> DataFrame:
    """Files, bytes, runtime, errors, findings by level and findings a file (two digits, half to even)."""
    left = files.groupBy(*keys).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.sum("runtime_ms").alias("runtime_ms"), F.count_if(F.col("error")).alias("errors"))
    level = F.lower("severity")
    right = findings.groupBy(*keys).agg(F.count("*").alias("findings"), *[F.count_if(level == s).alias(s) for s in ("critical", "high", "medium", "low", "info")])
    out = left.join(right, list(keys), "left").fillna(0, ["findings", "critical", "high", "medium", "low", "info"])
    return out.withColumn("per_file", F.bround(F.col("findings") / F.col("files"), 2))


def weekly_rollup(runs: DataFrame) -> DataFrame:
    """Per Monday and target: sums, mean over seven days, median runtime and the union of new kinds."""
    week = F.date_trunc("week", F.col("date").cast("timestamp")).cast("date")
    kinds = F.array_join(F.array_sort(F.array_distinct(F.filter(F.flatten(F.collect_list(F.split("new_kinds", r"\|"))), lambda k: k != ""))), "|")
    return runs.groupBy(week.alias("week"), "target").agg(
        F.sum("files_scanned").alias("files"), (F.sum("files_scanned") / 7).alias("files_per_day"), F.percentile("runtime_ms", F.lit(0.5)).alias("median_ms"), F.sum("errors").alias("errors"), kinds.alias("new_kinds")
    )


def period_key(date: Column, period: str) -> Column:
    """ISO ``yyyy-Www`` or ``yyyy-MM``."""
    if period == "week":
        return F.concat(F.date_part(F.lit("YEAROFWEEK"), date).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(date).cast("string"), 2, "0"))
    return F.date_format(date, "yyyy-MM")


def period_rollup(daily: DataFrame, period: str) -> DataFrame:
    return daily.groupBy(period_key(F.col("date"), period).alias("period"), "dim", "value").agg(F.sum("n").alias("n"))


def period_delta(rolled: DataFrame) -> DataFrame:
    """Change from the period before on a dense calendar: a value that is absent counts 0."""
    periods = rolled.select("period").distinct().withColumn("i", F.row_number().over(Window.orderBy("period")))
    placed = rolled.join(F.broadcast(periods), "period")
    last = periods.agg(F.max("i").alias("last"))
    now = placed.select("dim", "value", "i", F.col("n").alias("now"), F.lit(0).alias("was"))
    then = placed.select("dim", "value", (F.col("i") + 1).alias("i"), F.lit(0).alias("now"), F.col("n").alias("was"))
    both = now.unionByName(then).groupBy("dim", "value", "i").agg(F.sum("now").alias("now"), F.sum("was").alias("was"))
    kept = both.join(F.broadcast(last)).filter("i <= last").join(F.broadcast(periods), "i")
    return kept.select("period", "dim", "value", F.col("now").alias("n"), (F.col("now") - F.col("was")).alias("delta"))


def regressions(cur: DataFrame, prev: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, what, value: kinds that were there and are gone, and high findings fallen to none.

    With ``keys`` every group is compared with its own earlier self, where both have rows.
    """
    kinds = lambda df: df.filter("dim = 'kind' and n > 0").select(*keys, "value").distinct()
    gone = kinds(prev).join(kinds(cur), [*keys, "value"], "left_anti").select(*keys, F.lit("kind_lost").alias("what"), "value")
    level = F.when((F.col("dim") == "severity") & (F.lower("value") == "high"), F.col("n"))
    high = lambda df, name: df.groupBy(*keys).agg(F.coalesce(F.sum(level), F.lit(0)).alias(name))
    met = high(prev, "was").join(high(cur, "now"), list(keys)) if keys else high(prev, "was").join(high(cur, "now"))
    fell = met.filter("was > 0 and now = 0").select(*keys, F.lit("high_lost").alias("what"), F.col("was").cast("string").alias("value"))
    if keys:
        gone = gone.join(cur.select(*keys).distinct(), list(keys), "left_semi")
    return gone.unionByName(fell)


def new_kinds(df: DataFrame, date: str = "date", key: str = "kind") -> DataFrame:
    """The first date of each kind."""
    return df.groupBy(key).agg(F.min(date).alias("first_seen"))


def new_kinds_since(df: DataFrame, history: DataFrame, key: str = "kind") -> DataFrame:
    """Kinds that a history table does not hold."""
    return df.select(key).distinct().join(history.select(key), key, "left_anti")


def temporal_signals(versions: DataFrame) -> DataFrame:
    """doc, version, kinds first seen, kinds gone since the version before, and new high kinds after the first version."""
    seen = versions.select("doc", "version", "kind", severity_rank(F.col("severity")).alias("rank")).groupBy("doc", "version", "kind").agg(F.max("rank").alias("rank"))
    first = F.min("version").over(Window.partitionBy("doc", "kind"))
    new = seen.withColumn("is_new", F.col("version") == first)
    start = F.min("version").over(Window.partitionBy("doc"))
    new = new.withColumn("late_high", F.col("is_new") & (F.col("rank") >= 3) & (F.col("version") > start))
    shifted = seen.select("doc", (F.col("version") + 1).alias("version"), "kind")
    there = seen.select("doc", "version").distinct()
    gone = shifted.join(seen, ["doc", "version", "kind"], "left_anti").join(there, ["doc", "version"], "left_semi").groupBy("doc", "version").agg(F.count("*").alias("removed"))
    per = new.groupBy("doc", "version").agg(F.count_if("is_new").alias("new"), F.count_if("late_high").alias("new_high"))
    return per.join(gone, ["doc", "version"], "left").fillna(0, ["removed"])


def temporal_risk(scores: DataFrame, flat: float = 0.05, step: float = 0.1) -> DataFrame:
    """doc, change from first to last version, trend and the number of notable steps."""
    order = Window.partitionBy("doc").orderBy("version")
    moved = scores.withColumn("step", F.abs(F.col("score") - F.lag("score").over(order)) >= step)
    per = moved.groupBy("doc").agg(F.min_by("score", "version").alias("first"), F.max_by("score", "version").alias("last"), F.count_if("step").alias("notable"))
    change = F.col("last") - F.col("first")
    return per.select("doc", change.alias("change"), F.when(change > flat, "rising").when(change < -flat, "falling").otherwise("stable").alias("trend"), "notable")


def revision_timeline(versions: DataFrame, most: int | None = None) -> DataFrame:
    """doc, revision: objects added and modified, pages, annotations and catalogs touched, score; the last ``most`` revisions."""
    order = Window.partitionBy("doc", "obj").orderBy("revision")
    before = F.lag("fingerprint").over(order)
    touched = versions.withColumn("change", F.when(F.row_number().over(order) == 1, "added").when(before != F.col("fingerprint"), "modified"))
    moved = lambda c: F.count_if(F.col("change").isNotNull() & F.col(c))
    per = touched.groupBy("doc", "revision").agg(F.count_if(F.col("change") == "added").alias("added"), F.count_if(F.col("change") == "modified").alias("modified"), moved("is_page").alias("pages"), moved("is_annotation").alias("annotations"), moved("is_catalog").alias("catalogs"), moved("has_action").alias("actions"))
    score = F.when(F.col("catalogs") > 0, 3).otherwise(0) + F.when(F.col("actions") > 0, 2).otherwise(0) + F.when(F.col("pages") > 0, 1).otherwise(0) + F.when(F.col("annotations") > 0, 1).otherwise(0)
    out = per.withColumn("score", F.when(F.col("revision") > 1, score).otherwise(0))
    if most is not None:
        out = out.withColumn("back", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("revision")))).filter(F.col("back") <= most).drop("back")
    return out


def slo_gate(profile: DataFrame, base: DataFrame, absolute_ms: float, ratio: float) -> DataFrame:
    """phase, duration, and whether it keeps the absolute bound and the ratio to its baseline."""
    met = profile.join(base.select("phase", F.col("duration_ms").alias("base_ms")), "phase", "left")
    ok = (F.col("duration_ms") <= absolute_ms) & (F.col("base_ms").isNull() | (F.col("duration_ms") <= F.col("base_ms") * ratio))
    return met.withColumn("ok", ok)


def coverage_mismatch(external: DataFrame, findings: DataFrame, mapping: DataFrame) -> DataFrame:
    """indicator, n: documents where an outside tool names an indicator and no mapped finding exists."""
    wanted = external.join(mapping, "indicator")
    covered = wanted.join(findings.select("doc", "kind").distinct(), ["doc", "kind"], "left_semi").select("doc", "indicator").distinct()
    return external.select("doc", "indicator").distinct().join(covered, ["doc", "indicator"], "left_anti").groupBy("indicator").agg(F.count("*").alias("n"))
