"""Readers: corpus files, finding and intent lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscle.schemas import FINDING


def scan_corpus_files(spark: SparkSession, path: str, glob: str = "*", max_files: int = 500_000, max_bytes: int = 50 * 1024**3) -> DataFrame:
    """path, size, mtime, content, sha256 of matching files; the budgets are checked on the listing before contents are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    held = files.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("b")).first()
    if held["n"] > max_files or held["b"] > max_bytes:
        raise ValueError(f"{held['n']} files of {held['b']} bytes exceed the budget of {max_files} files and {max_bytes} bytes")
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content", F.sha2("content", 256).alias("sha256"))


def _line_schema() -> T.StructType:
    finding = T._parse_datatype_string(FINDING)
    return T.StructType([*finding.fields, T.StructField("path", T.StringType()), T.StructField("type", T.StringType()), T.StructField("status", T.StringType()), T.StructField("finding", finding), T.StructField("findings", T.ArrayType(finding)), T.StructField("_corrupt", T.StringType())])


def parse_findings(lines: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Findings of JSON lines (column ``value``), and why other lines were left out.

    A line is a bare finding (strict reading only), ``{path, finding}`` (lenient reading only) or holds ``findings``.
    Type records, error records and broken lines count as skipped; strict reading fails on a broken line.
    """
    schema = _line_schema()
    options = {"mode": "FAILFAST"} if strict else {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    j = lines.filter(F.trim("value") != "").select(F.from_json("value", schema, options).alias("j"))
    bare = F.struct(*[F.col(f"j.{f.name}").alias(f.name) for f in T._parse_datatype_string(FINDING).fields])
    one = F.col("j.kind").isNotNull() if strict else F.lit(False)
    wrapped = F.lit(False) if strict else F.col("j.finding").isNotNull()
    listed = F.when(F.col("j.findings").isNotNull(), F.col("j.findings")).when(wrapped, F.array(F.col("j.finding"))).when(one, F.array(bare))
    reason = (
        F.when(F.col("j").isNull() | F.col("j._corrupt").isNotNull(), "broken").when(F.col("j.status") == "error", "error_record").when(F.col("j.type").isNotNull(), "type_record").when(listed.isNull(), "no_findings")
    )
    marked = j.select(F.col("j.path").alias("path"), listed.alias("fs"), reason.alias("reason"))
    good = marked.filter("reason is null").select("path", F.posexplode("fs").alias("place", "f")).select("f.*", F.coalesce("f.doc", "path", F.lit("-")).alias("__doc"))
    good = good.withColumn("doc", F.col("__doc")).drop("__doc")
    return good, marked.filter("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def read_findings(spark: SparkSession, path: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    return parse_findings(spark.read.text(path), strict)


def parse_intents(lines: DataFrame, most: int | None = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """(path, url) of JSON lines, and rejected lines with a reason; more than ``most`` good lines are an error (none: any number, for lines that are one's own)."""
    raw = lines.filter(F.trim("value") != "").select("value", F.from_json("value", "path string, url string").alias("j"))
    url = F.col("j.url")
    reason = (
        F.when(F.octet_length("value") > 10 * 1024, "line_too_long").when(F.coalesce(F.trim(url), F.lit("")) == "", "empty_url").when(F.octet_length(url) > 1024, "url_too_long").when(~url.rlike(r"^[\x20-\x7E]*$"), "not_printable")
    )
    marked = raw.select(F.coalesce("j.path", F.lit("unknown")).alias("path"), url.alias("url"), reason.alias("reason"))
    good = marked.filter("reason is null").select("path", "url")
    if most is not None and good.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} intents")
    return good, marked.filter("reason is not null")


def read_intents(spark: SparkSession, path: str, most: int | None = 1_000_000) -> tuple[DataFrame, DataFrame]:
    return parse_intents(spark.read.text(path), most)
