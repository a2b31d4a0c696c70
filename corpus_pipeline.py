"""The corpus pipeline: quality, near duplicates, decontamination, mixture, shards.

``run(spark, sf_dir)`` applies STAGES to the table ``documents``; each stage's rows are written as
Parquet and read again as the next one's documents. All stages but the last return the columns of
documents. No SQL is given: a trained classifier and alignment are not expressible in it; the tests
hold the stages against brute-force versions instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm import decontam, minhash, mixing, quality, sharding
from corpuscle.session import read_table, small_batches, stash

ORACLE_SQL = None
SHARDS = 16


#: Ids that are sent to every task at once, at most (eight bytes each); more are joined by a shuffle.
SENT_IDS = 2_000_000


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose doc_id is not among ``ids``; texts are moved only if there are too many ids to send."""
    gone = stash(ids.select("doc_id").filter("doc_id is not null").distinct(), "gone")
    if gone.count() <= SENT_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier does not reject (learnt as in its query), each judged by its own text."""
    small_batches(spark)
    train = F.crc32(F.col("doc_id").cast("string")) % 3 != 1
    model = quality.learnt(docs, read_table(spark, sf_dir, "labels"), train)
    return docs.filter(quality.quality_of(model, F.col("text")) >= 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity of 0.8.

    Of rows with one id and text one is kept; rows without id are kept.
    """
    small_batches(spark)
    found = minhash.near_duplicates(docs, words=5, percent=80)
    rest = without(docs, found.filter("not kept"))
    repeated = docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1")
    again = stash(repeated.select("doc_id"), "repeated")
    copies = rest.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return without(rest, again).unionByName(copies)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; rows without id are kept."""
    small_batches(spark)
    return without(docs, decontam.leaks(docs, read_table(spark, sf_dir, "benchmark")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them: the flattest weights that repeat no source more than 1.25 times."""
    return mixing.mix_rows(docs, mixing.MixSpec(repetition=1.25)).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row, byte-balanced with equal texts together."""
    return sharding.shard_table(docs, SHARDS)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
