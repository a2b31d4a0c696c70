"""Streaming twins of the day-by-day jobs, on Structured Streaming. Watermarks and windows are parameters of this library."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from corpuscle.session import discard, exists, stash

#: Markers, and those after which a document is done.
MARKERS = [b"/JavaScript", b"/Launch", b"/EmbeddedFile", b"/RichMedia"]
TERMINAL = [b"/JavaScript", b"/Launch", b"/EmbeddedFile"]
SCAN_SCHEMA = "doc string, marker string, chunk_no long, terminal boolean"


def scan_chunks(tail: bytes, chunk: bytes, seen: set[bytes], keep: int, markers: list[bytes] = MARKERS, terminal: list[bytes] = TERMINAL) -> tuple[list[bytes], bytes]:
    """Markers new in tail + chunk, up to the first terminal one, and the next tail."""
    held = tail + chunk
    new = [m for m in sorted((m for m in markers if m not in seen and m in held), key=held.index)]
    for i, m in enumerate(new):
        if m in terminal:
            return new[: i + 1], b""
    return new, held[-keep:] if keep else b""


def stream_indicator_scan(chunks: DataFrame, max_buffer: int = 64, idle_ms: int | None = 1_800_000, markers: list[bytes] = MARKERS, terminal: list[bytes] = TERMINAL, ts: str | None = None, late: str = "0 seconds") -> DataFrame:
    """doc, marker, chunk_no, terminal for chunks (doc, chunk_no, bytes) in order; after a terminal marker a document is ignored.

    State is the tail, the markers seen and whether the document is done; it goes after ``idle_ms`` without a chunk,
    and a chunk that comes later starts the document anew. With ``ts``, an event time, it goes when the watermark
    (``late`` behind the newest chunk) has passed the document's newest chunk by ``idle_ms``; else by the clock. None keeps it, as a run
    that ends by itself needs.
    """
    timed = ts is not None and idle_ms is not None

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tail, names, done, newest = state.get if state.exists else (b"", "", False, 0)
        rows = sorted((int(n), int(t), bytes(b or b"")) for f in frames for n, t, b in zip(f["chunk_no"], f["at_ms"], f["bytes"], strict=True))
        seen, out = {n.encode() for n in names.split("|") if n}, []
        for number, at, data in rows:
            newest = max(newest, at)
            if not done:
                new, tail = scan_chunks(bytes(tail), data, seen, max_buffer, markers, terminal)
                seen |= set(new)
                done = any(m in terminal for m in new)
                out += [(key[0], m.decode(), number, m in terminal) for m in new]
        state.update((bytes(tail), "|".join(sorted(m.decode() for m in seen)), done, newest))
        if timed:
            state.setTimeoutTimestamp(max(newest + idle_ms, state.getCurrentWatermarkMs() + 1))
        elif idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["doc", "marker", "chunk_no", "terminal"])

    timeout = GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    at = F.lit(0).cast("long") if ts is None else F.unix_millis(F.col(ts))
    rows = (chunks.withWatermark(ts, late) if timed else chunks).withColumn("at_ms", at)
    return rows.groupBy("doc").applyInPandasWithState(step, SCAN_SCHEMA, "tail binary, seen string, done boolean, newest long", "append", timeout)


def batch_indicator_scan(chunks: DataFrame, max_buffer: int = 64, markers: list[bytes] = MARKERS, terminal: list[bytes] = TERMINAL) -> DataFrame:
    """The same over a finished table; one document's chunks are one group, streamed in order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, tail, seen, done = None, b"", set(), False
        for f in frames:
            out = []
            for d, number, data in zip(f["doc"], f["chunk_no"], f["bytes"], strict=True):
                if d != doc:
                    doc, tail, seen, done = d, b"", set(), False
                if done:
                    continue
                new, tail = scan_chunks(tail, bytes(data or b""), seen, max_buffer, markers, terminal)
                seen |= set(new)
                done = any(m in terminal for m in new)
                out += [(d, m.decode(), int(number), m in terminal) for m in new]
            yield pd.DataFrame(out, columns=["doc", "marker", "chunk_no", "terminal"])

    ordered = chunks.select("doc", "chunk_no", "bytes").repartition("doc").sortWithinPartitions("doc", "chunk_no")
    return ordered.mapInPandas(run, SCAN_SCHEMA)


def stream_dedupe_hash(rows: DataFrame, key: str = "hash", ts: str = "ts", late: str = "1 day") -> DataFrame:
    """The first row of each hash within the watermark."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def stream_daily_counts(rows: DataFrame, *keys: str, ts: str = "ts", late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Counts by window and keys; append once the watermark has passed a window."""
    return rows.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def stream_new_kinds(rows: DataFrame, key: str = "kind") -> DataFrame:
    """The first sight of each key; the state holds one row a key."""
    return rows.dropDuplicates([key])


class UpsertTable:
    """A keyed table that batches are put into: for each key the row that is last by ``order`` (of equal ones the later batch's).

    Keys are dealt into ``buckets``. A batch writes new files of the buckets that it touches, ``data/v=<batch>/bucket=<b>``,
    and then one small file, ``commits/n=<batch>``, that names the version of every bucket; readers follow the newest
    commit, so a batch that failed half-way leaves nothing. A batch that is put again finds its commit and changes
    nothing. ``vacuum`` deletes files that the newest commit doesn't name.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str, order: str, buckets: int = 16) -> None:
        self.spark, self.path, self.schema, self.key, self.order, self.buckets = spark, path.rstrip("/"), schema, key, order, buckets

    def commits(self) -> DataFrame:
        return self.spark.read.schema("bucket int, version long, n long").option("basePath", f"{self.path}/commits").parquet(f"{self.path}/commits")

    def versions(self) -> tuple[int, dict[int, int]]:
        """The newest batch and the version of each bucket."""
        if not exists(self.spark, f"{self.path}/commits"):
            return -1, {}
        last = self.commits().agg(F.max("n")).collect()[0][0]
        return (-1, {}) if last is None else (last, {r["bucket"]: r["version"] for r in self.commits().filter(F.col("n") == last).collect()})

    def rows(self, versions: dict[int, int]) -> DataFrame | None:
        paths = [f"{self.path}/data/v={v}/bucket={b}" for b, v in versions.items() if v >= 0]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else None

    def read(self) -> DataFrame:
        held = self.rows(self.versions()[1])
        return self.spark.createDataFrame([], self.schema) if held is None else held

    def latest(self, rows: DataFrame) -> DataFrame:
        """One row a key: the last by ``order``, then by batch."""
        cell = F.struct(*self.schema.names)
        best = rows.groupBy(F.col(self.key).alias("__key")).agg(F.max_by(cell, F.struct(F.col(self.order), F.col("__batch"))).alias("r"))
        return best.select("r.*")

    def put(self, batch: DataFrame, number: int) -> None:
        """For ``foreachBatch``."""
        last, versions = self.versions()
        if number <= last:
            return
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        fresh = stash(self.latest(batch.select(*self.schema.names, F.lit(1).alias("__batch"))).withColumn("bucket", bucket), "upsert")
        touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]
        old, new = self.rows({b: v for b, v in versions.items() if b in touched}), fresh.drop("bucket").withColumn("__batch", F.lit(1))
        merged = self.latest(new if old is None else new.unionByName(old.withColumn("__batch", F.lit(0))))
        merged.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/v={number}")
        kept = versions | dict.fromkeys(touched, number)
        self.spark.createDataFrame(list(kept.items()) or [(0, -1)], "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/n={number}")

    def vacuum(self) -> None:
        last, versions = self.versions()
        stale = self.commits().filter(F.col("n") < last).select("bucket", "version", "n").collect() if last >= 0 else []
        for b, v in {(r["bucket"], r["version"]) for r in stale} - set(versions.items()):
            discard(self.spark, f"{self.path}/data/v={v}/bucket={b}")
        for n in {r["n"] for r in stale}:
            discard(self.spark, f"{self.path}/commits/n={n}")
