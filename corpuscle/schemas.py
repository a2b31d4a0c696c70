"""The finding table: schema, ordered levels and the binding of level names to ranks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Level names in their order.
SEVERITIES = ["info", "low", "medium", "high", "critical"]
CONFIDENCES = ["certain", "strong", "probable", "tentative", "weak", "heuristic"]
SURFACES = [
    "file_structure", "xref_trailer", "object_streams", "streams_filters", "actions", "javascript", "forms",
    "embedded_files", "rich_media_3d", "crypto_signatures", "metadata", "content_phishing", "images",
]
STAGES = ["input", "decode", "render", "execute", "egress"]

FINDING = (
    "doc string, seq bigint, id string, surface string, kind string, severity string, confidence string, impact string, "
    "title string, description string, objects array<string>, "
    "evidence array<struct<source:string,offset:bigint,length:int,origin:struct<start:bigint,end:bigint>,note:string>>, "
    "remediation string, position string, positions array<string>, meta map<string,string>, "
    "action_type string, action_target string, action_initiation string"
)


def _rank(level: Column, names: list[str]) -> Column:
    out = F.when(F.lower(level) == names[0], 0)
    for i, name in enumerate(names[1:], 1):
        out = out.when(F.lower(level) == name, i)
    return out


def severity_rank(level: Column) -> Column:
    """0 (info) to 4 (critical); order on this, never on the name."""
    return _rank(level, SEVERITIES)


def confidence_rank(level: Column) -> Column:
    """0 (certain) to 5 (heuristic): smaller is better."""
    return _rank(level, CONFIDENCES)


def confidence_score(level: Column) -> Column:
    """6 (certain) to 1 (heuristic): larger is better."""
    return F.lit(6) - confidence_rank(level)


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), (rank + 1).cast("int"))


def confidence_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, CONFIDENCES)), (rank + 1).cast("int"))


def stage_rank(stage: Column) -> Column:
    return F.coalesce(_rank(stage, STAGES), F.lit(len(STAGES)))


def two_valued(condition: Column) -> Column:
    """A missing value makes a comparison false, so that its negation is true."""
    return F.coalesce(condition, F.lit(False))
