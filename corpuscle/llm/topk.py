"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors become integers, ``floor(scale * x)``. Queries are sparse rows of non-zero weights; candidates
are read where they lie, in blocks kept by component (a posting for each term). Every query term adds
its weighted posting to a dense array of scores; partition selection keeps the k best of the block,
which are merged into the query's best of the task, and a last merge over tasks keeps the k best of all.

Candidates are never moved. Queries go to the tasks in chunks of about ``query_rows`` rows, one pass over
the candidates a chunk; a chunk's results are written out and its copy in the driver and the tasks is
dropped before the next one is read, so no more than one chunk is held anywhere. A task gives back ``k``
rows a query, and takes up to ``task_rows`` candidates.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part, nor
do rows with a null id. Vectors of different lengths score over the components both have. Equal scores
go to the smaller id. Repeated ids are separate candidates, but none is its own query's; an id that is
asked with several vectors has one list over all. Fewer than k candidates give fewer rows; an empty
table none. Scores wrap around beyond 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.session import Scratch, stash_path


def quantised(vectors: DataFrame, is_query: Column, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """id, q (integer components) and asked for every vector that takes part."""
    x = F.col(vec_col).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & finite)
    return rows.select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v * scale)).alias("q"), F.coalesce(is_query, F.lit(False)).alias("asked"))


def dense(lists: pa.ListArray) -> np.ndarray:
    """Lists of numbers as rows of one matrix; shorter ones end in zeros."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(sizes.max(initial=0))
    if len(flat) == len(sizes) * width:
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest (score, id), smaller ids first among equals."""
    keep = min(len(ids), k)
    floor = -np.partition(-scores, keep - 1)[keep - 1]
    at = np.flatnonzero(scores >= floor)
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


class Accumulator:
    """The best k candidates of each query, over blocks of candidates."""

    def __init__(self, own: np.ndarray, queries: np.ndarray, k: int) -> None:
        self.own, self.queries, self.k = own, queries, k
        self.found: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(own)
        self.terms = [np.flatnonzero(row) for row in queries]

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        postings = np.ascontiguousarray(vectors.T)
        if float(np.abs(self.queries).max(initial=1)) * float(np.abs(postings).max(initial=1)) * len(postings) < 2**31:
            postings = postings.astype(np.int32)
        scores, part = np.empty(len(ids), postings.dtype), np.empty(len(ids), postings.dtype)
        for i, (own, row) in enumerate(zip(self.own, self.queries, strict=True)):
            scores[:] = 0
            for term in self.terms[i]:
                if term < len(postings):
                    np.multiply(postings[term], postings.dtype.type(row[term]), out=part)
                    np.add(scores, part, out=scores)
            held, value = self.found[i]
            full = len(held) == self.k
            at = np.flatnonzero((scores >= value[-1] if full else np.ones(len(ids), bool)) & (ids != own))
            if len(at):
                held, value = np.concatenate([held, ids[at]]), np.concatenate([value, scores[at].astype(np.int64)])
                top = best(value, held, self.k)
                self.found[i] = held[top], value[top]

    def rows(self) -> pa.RecordBatch:
        sizes = [len(ids) for ids, _ in self.found]
        columns = [np.repeat(self.own, sizes), *(np.concatenate([f[j] for f in self.found]) if sizes else self.own for j in (0, 1))]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0, block_rows: int = 4096, query_rows: int = 16_384, task_rows: int = 1_000_000) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of each row for which ``is_query`` holds."""
    spark = vectors.sparkSession
    every = quantised(vectors, is_query, id_col, vec_col, scale)
    held = Scratch(spark)
    asked = held.stash(every.filter("asked").select("id", "q").distinct(), "asked")
    n, chunks = every.count(), max(1, -(-asked.count() // query_rows))
    rows = every.select("id", "q").coalesce(max(spark.sparkContext.defaultParallelism, -(-n // task_rows)))
    path = stash_path(spark, "top")
    for c in range(chunks):
        part = asked.filter(F.pmod(F.xxhash64("id", "q"), F.lit(chunks)) == c).toArrow().combine_chunks()
        queries = spark.sparkContext.broadcast((part.column("id").combine_chunks().to_numpy(zero_copy_only=False), dense(part.column("q").combine_chunks())))
        searched(rows, queries, k, block_rows).write.mode("append").parquet(path)
        queries.destroy()
    held.clear()
    return spark.read.schema(TOP).parquet(path)


TOP = "query_id long, rank int, vec_id long, score long"


def searched(rows: DataFrame, queries: Broadcast, k: int, block_rows: int) -> DataFrame:
    """The k best rows of each query of a chunk."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_of = Accumulator(*queries.value, k)
        for b in batches:
            for at in range(0, b.num_rows, block_rows):
                part = b.slice(at, block_rows)
                best_of.add(part.column(0).to_numpy(zero_copy_only=False), dense(part.column(1)))
        yield best_of.rows()

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = rows.mapInArrow(search, "query_id long, vec_id long, score long")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
