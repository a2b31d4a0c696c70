"""Byte and text functions as columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions.rules import any_of, has, inputs

#: Leading bytes in hexadecimal, tried in order.
MAGIC = {"4D5A": "pe", "25504446": "pdf", "504B0304": "zip", "52617221": "rar", "7F454C46": "elf", "FEEDFACE": "macho", "CFFAEDFE": "macho", "2321": "script", "89504E47": "png", "FFD8FF": "jpeg", "47494638": "gif"}
HTML_MARKERS = ["<script", "<iframe", "javascript:", "<svg", "onerror=", "onload="]
STAGING, UPDATING, PERSISTING = ["download", "fetch", "payload", "stage", "loader"], ["update", "upgrade", "patch"], ["startup", "autorun", "registry", "schedule", "cron"]


def entropies(texts: pa.StringArray) -> np.ndarray:
    """Shannon entropy of the UTF-8 bytes of each text, from one count over the buffer of them all."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    sizes = np.diff(ends)
    counts = np.bincount(np.repeat(np.arange(len(sizes)) << 8, sizes) + data, minlength=len(sizes) << 8).reshape(-1, 256)
    share = counts / np.maximum(sizes, 1)[:, None]
    return -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1) + 0.0


def byte_entropy(df: DataFrame, text_col: str, *keys: str, rows: int = 512) -> DataFrame:
    """keys, entropy: Shannon entropy over UTF-8 bytes, ``rows`` texts counted at once; nothing is exploded."""

    @F.pandas_udf("double")
    def entropy(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            parts = [entropies(pa.array(texts.iloc[lo : lo + rows], pa.large_string())) for lo in range(0, len(texts), rows)]
            yield pd.Series(np.concatenate(parts) if parts else [], dtype="float64")

    return df.select(*keys, entropy(F.col(text_col)).alias("entropy"))


def byte_entropy_by_counts(df: DataFrame, text_col: str, *keys: str) -> DataFrame:
    """The same for large values, as two aggregations over exploded bytes."""
    pairs = F.explode(F.regexp_extract_all(F.hex(F.encode(F.col(text_col), "UTF-8")), F.lit("(..)"), F.lit(1)))
    counts = df.select(*keys, pairs.alias("b")).groupBy(*keys, "b").agg(F.count("*").alias("c"))
    sums = counts.groupBy(*keys).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log2("c")).alias("s"))
    return sums.select(*keys, (F.log2("n") - F.col("s") / F.col("n")).alias("entropy"))


def binary_ratio(c: Column) -> Column:
    """Share of bytes outside printable ASCII and white space."""
    n = F.octet_length(c)
    return F.when(n > 0, F.octet_length(F.regexp_replace(c, r"[\x20-\x7E\t\n\r]+", "")) / n).otherwise(0.0)


def byte_density(c: Column, char: str) -> Column:
    n = F.octet_length(c)
    return F.when(n > 0, (n - F.octet_length(F.replace(c, F.lit(char), F.lit("")))) / n).otherwise(0.0)


def magic_type(content: Column) -> Column:
    out, head = F.lit("unknown"), F.hex(F.substring(content, 1, 8))
    for prefix, name in reversed(MAGIC.items()):
        out = F.when(F.startswith(head, F.lit(prefix)), name).otherwise(out)
    return out


def content_hash(path: Column, content: Column) -> Column:
    """sha256, or the file's stem where that is one already."""
    stem = F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)
    return F.when(stem.rlike("^[0-9a-f]{64}$"), stem).otherwise(F.sha2(content, 256))


def preview(c: Column, n: int) -> Column:
    """The first n characters, everything outside printable ASCII as a dot."""
    return F.regexp_replace(F.substring(c, 1, n), r"[^\x20-\x7E]", ".")


def _found(c: Column, needles: list[str], exact: bool = False) -> Column:
    t = inputs(c)
    return F.array_compact(F.array(*[F.when(has(n, exact).column(t), F.lit(n)) for n in needles]))


def html_markers(c: Column) -> Column:
    return _found(c, HTML_MARKERS)


def supply_chain(c: Column) -> Column:
    """Staging and persistence words (as written) and update words (in any case)."""
    return F.struct(_found(c, STAGING, True).alias("staging"), _found(c, UPDATING).alias("updating"), _found(c, PERSISTING, True).alias("persisting"))


def phishing(df: DataFrame, text_col: str, has_external_uri: Column) -> DataFrame:
    """Rows whose text has a phishing keyword while the document links out."""
    words = any_of("verify your account", "password", "login", "confirm your identity", "update your payment", "invoice")
    return df.filter(words.column(inputs(F.col(text_col))) & F.coalesce(has_external_uri, F.lit(False)))


#: Active content by class, as patterns that read the same in Java and RE2.
ACTIVE = {
    "script": r"(?is)<script\b.*?</script>",
    "iframe": r"(?is)<iframe\b.*?</iframe>",
    "handler": r"(?i)\son[a-z]+\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)",
    "javascript_uri": r"(?i)javascript:[^\"'\s>]*",
}


def strip_active(df: DataFrame, html_col: str, *keys: str) -> DataFrame:
    """keys, clean text and how many pieces of each class were taken out."""
    clean, counts, text = F.coalesce(F.col(html_col), F.lit("")), {}, F.coalesce(F.col(html_col), F.lit(""))
    for name, pattern in ACTIVE.items():
        counts[name] = F.regexp_count(text, F.lit(pattern)).cast("long")
        clean = F.regexp_replace(clean, pattern, "")
    return df.select(*keys, clean.alias("clean"), *[c.alias(f"{n}_removed") for n, c in counts.items()])


def normalise_records(c: Column) -> Column:
    """``path type value`` triples split on `` ; ``: references, numbers and strings become their kind."""
    def one(r: Column) -> Column:
        path, kind = F.split(r, " ")[0], F.get(F.split(r, " "), F.lit(1))
        value = F.regexp_replace(r, r"^\S+\s+\S+\s*", "")
        short = F.when(kind == "ref", "<ref>").when(kind.isin("int", "real", "number"), "<num>").when(kind.isin("string", "str"), "<str>").otherwise(value)
        return F.trim(F.concat_ws(" ", path, kind, short))

    return F.array_join(F.transform(F.filter(F.split(c, r" ; "), lambda r: F.trim(r) != ""), lambda r: one(F.trim(r))), " ; ")


def assemble_fragments(df: DataFrame, key: str, order: str, text: str, *needles: str) -> DataFrame:
    """Owners whose fragments show a needle only when joined in order: key, the place of the fragment that completes one, and the needle.

    A needle over borders ends in a fragment's head, after what the fragments before it end with; a window carries
    these tails (one character less than the longest needle, however short the fragments), so no owner's text is put together.
    """
    most = max(map(len, needles)) - 1
    held = df.select(F.col(key).alias("__key"), F.col(order).alias("__at"), F.coalesce(F.col(text), F.lit("")).alias("__t")).filter("__t <> ''")
    before = Window.partitionBy("__key").orderBy("__at").rowsBetween(-max(most, 1), -1)
    tail = F.right(F.array_join(F.collect_list(F.right("__t", F.lit(most))).over(before), ""), F.lit(most))
    seen = lambda c: F.array_compact(F.array(*[F.when(has(n).column(inputs(c)), F.lit(n)) for n in needles]))
    alone = held.filter(any_of(*needles).column(inputs(F.col("__t")))).select("__key").distinct()
    over = held.withColumn("__tail", tail).select("__key", "__at", F.explode(F.array_except(seen(F.concat("__tail", F.left("__t", F.lit(most)))), seen(F.col("__tail")))).alias("needle"))
    return over.join(alone, "__key", "left_anti").select(F.col("__key").alias(key), F.col("__at").alias("at"), "needle")


def humanize(c: Column, labels: dict[str, str] | None = None) -> Column:
    """A label from the table, else underscores as blanks and dots as colons."""
    out = F.replace(F.replace(c, F.lit("_"), F.lit(" ")), F.lit("."), F.lit(": "))
    for key, label in (labels or {}).items():
        out = F.when(c == key, label).otherwise(out)
    return out
