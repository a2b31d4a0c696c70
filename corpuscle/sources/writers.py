"""Row forms for sinks: CSV, JSON lines, result envelopes and scanner-interchange records. Writing is Spark's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.schemas import severity_rank


def sorted_json(meta: Column) -> Column:
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.coalesce(meta, F.create_map().cast("map<string,string>"))))))


def findings_csv(df: DataFrame) -> DataFrame:
    """Twelve fixed columns; lists joined by a bar, metadata as JSON with sorted keys."""
    return df.select(
        "id", "surface", "kind", "severity", "confidence", "impact", "title", "description", F.array_join("objects", "|").alias("objects"), F.size("evidence").alias("evidence_count"), "remediation", sorted_json(F.col("meta")).alias("meta_json")
    )


def events_csv(events: DataFrame) -> DataFrame:
    """Event rows with the number and list of their findings."""
    return events.select("node_id", "event_type", "level", "trigger", "source_object", F.size("findings").alias("linked_finding_count"), F.array_join("findings", "|").alias("linked_finding_ids"))


def findings_jsonl(df: DataFrame) -> DataFrame:
    """One ``{path, finding}`` line a finding (``-`` without a document)."""
    rest = [c for c in df.columns if c != "doc"]
    return df.select(F.to_json(F.struct(F.coalesce("doc", F.lit("-")).alias("path"), F.struct(*rest).alias("finding"))).alias("value"))


def intents_jsonl(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(F.col("doc").alias("path"), "url", "domain")).alias("value"))


def write_csv(df: DataFrame, path: str, *partitions: str) -> None:
    out = df.write.mode("overwrite").option("header", "true").option("escape", '"')
    (out.partitionBy(*partitions) if partitions else out).csv(path)


def trend_csv(findings: DataFrame, path: str) -> None:
    """Counts by kind for each day and target, largest first, one folder a day and target."""
    counts = findings.groupBy("date", "target", "kind").agg(F.count("*").alias("n"))
    write_csv(counts.repartition("date", "target").sortWithinPartitions("date", "target", F.desc("n"), "kind"), path, "date", "target")


def batch_envelope(files: DataFrame, result: Column, problem: Column) -> DataFrame:
    """path, status, error_code, message, result, runtime_caps; a failing row stays as a row with zero caps."""
    bad = problem.isNotNull()
    caps = F.when(bad, F.struct(F.lit(0).alias("nodes"), F.lit(0).alias("edges"))).otherwise(F.coalesce(F.col("caps"), F.struct(F.lit(0).alias("nodes"), F.lit(0).alias("edges")))) if "caps" in files.columns else F.struct(F.lit(0).alias("nodes"), F.lit(0).alias("edges"))
    return files.select("path", F.when(bad, "error").otherwise("ok").alias("status"), F.when(bad, "QUERY_ERROR").alias("error_code"), problem.alias("message"), F.when(~bad, result).alias("result"), caps.alias("runtime_caps"))


def sarif_rows(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rule records (first finding of a kind) and result records with level and locations, as JSON."""
    first = F.min_by(F.struct("title", "description"), F.struct("doc", "seq"))
    rules = df.groupBy("kind").agg(first.alias("f")).select(F.to_json(F.struct(F.col("kind").alias("id"), F.col("f.title").alias("name"), F.col("f.description").alias("shortDescription"))).alias("value"))
    rank = severity_rank(F.col("severity"))
    level = F.when(rank >= 3, "error").when(rank == 2, "warning").otherwise("note")
    spans = F.filter("evidence", lambda e: (F.lower(e["source"]) == "file") | e["origin"].isNotNull())
    places = F.transform(spans, lambda e: F.struct(F.coalesce(e["origin"]["start"], e["offset"]).alias("byteOffset"), e["length"].alias("byteLength")))
    results = df.select(F.to_json(F.struct(F.col("kind").alias("ruleId"), level.alias("level"), F.col("description").alias("message"), places.alias("locations"))).alias("value"))
    return rules, results
