"""Interval joins: points of evidence against byte ranges, without meeting all of a document's rows.

A range of length n lies in cells of the smallest power of two that is not below n, so it touches two
cells at most, whatever its length. Points are looked up in the cell of each width that occurs (63 at
most, usually a handful). Rows meet on document, width and cell only; as a cell is shorter than twice a
range in it, candidates outnumber matches by a small factor, and a document of any number of ranges is
dealt over as many tasks as it has cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.schemas import severity_rank

#: Fixed value: the anomaly that a kind points to.
ANOMALIES = {"content_invisible_text": "InvisibleRenderingMode"}


def width_of(length: Column) -> Column:
    """Exponent of the smallest power of two that is at least ``length`` (62 at most)."""
    return F.least(F.when(length <= 1, 0).otherwise(F.length(F.bin(length - 1))), F.lit(62)).cast("int")


def match_intervals(points: DataFrame, ranges: DataFrame, g: tuple[str, ...] = ("doc",)) -> DataFrame:
    """Pairs of points (g, offset, ...) and ranges (g, start, length, ...) with ``start <= offset < start + length``.

    Null offsets, starts and lengths and empty ranges match nothing; an end beyond 64 bits counts as the last offset.
    """
    whole = ranges.filter("start is not null and length > 0").withColumn("width", width_of(F.col("length")))
    widths = sorted(r[0] for r in whole.select("width").distinct().collect())
    if not widths:
        return points.join(ranges, list(g)).limit(0)
    last = F.col("length") - 1
    end = F.when(F.col("start") > F.lit((1 << 63) - 1) - last, F.lit((1 << 63) - 1)).otherwise(F.col("start") + last)
    whole = whole.withColumn("last", end)
    cell = lambda c, w: F.call_function("shiftright", F.col(c).cast("long"), w)
    dealt = whole.withColumn("cell", F.explode(F.array_distinct(F.array(cell("start", F.col("width")), cell("last", F.col("width"))))))
    asked = points.filter("offset is not null").withColumn("width", F.explode(F.array(*map(F.lit, widths)))).withColumn("cell", cell("offset", F.col("width")))
    met = asked.join(dealt, [*g, "width", "cell"]).filter((F.col("offset") >= F.col("start")) & (F.col("offset") <= F.col("last")))
    return met.drop("width", "cell", "last")


def match_streams(findings: DataFrame, streams: DataFrame) -> DataFrame:
    """doc, stream, id of findings with evidence inside a stream's byte range."""
    spans = findings.select("doc", "id", F.explode("evidence").alias("e")).select("doc", "id", F.col("e.offset").alias("offset"))
    return match_intervals(spans, streams.select("doc", "stream", "start", "length")).select("doc", "stream", "id").distinct()


def stream_findings(findings: DataFrame, streams: DataFrame, source: str = "decoded") -> DataFrame:
    """doc, stream, id, kind, severity, anomaly, decoded_offset of the findings that belong to a stream (stream, object, page, start, length).

    A finding belongs to a stream if it names the stream's object or its page's, or has evidence from ``source``
    inside the range, whose first such place (in the order of its evidence) is its decoded offset.
    """
    named = findings.select("doc", "id", F.explode(F.array_distinct("objects")).alias("object"))
    objects = streams.select("doc", "stream", F.explode(F.array_distinct(F.array_compact(F.array("object", "page")))).alias("object"))
    by_name = named.join(objects, ["doc", "object"]).select("doc", "stream", "id")
    spans = findings.select("doc", "id", F.posexplode("evidence").alias("nth", "e")).filter(F.col("e.source") == source).select("doc", "id", "nth", F.col("e.offset").alias("offset"))
    inside = match_intervals(spans, streams.select("doc", "stream", "start", "length")).groupBy("doc", "stream", "id").agg(F.min_by("offset", "nth").alias("decoded_offset"))
    both = by_name.select("*", F.lit(None).cast("long").alias("decoded_offset")).unionByName(inside).groupBy("doc", "stream", "id").agg(F.max("decoded_offset").alias("decoded_offset"))
    about = findings.select("doc", "id", "kind", F.lower("severity").alias("severity"), severity_rank(F.col("severity")).alias("rank"))
    hint = F.try_element_at(F.create_map(*[F.lit(x) for kv in ANOMALIES.items() for x in kv]), F.col("kind"))
    return both.join(about, ["doc", "id"]).select("doc", "stream", "id", "kind", "severity", "rank", hint.alias("anomaly"), "decoded_offset")
