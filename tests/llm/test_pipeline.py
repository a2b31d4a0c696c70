"""The pipeline's stages on the smallest tables, against the plain statement of what each keeps."""

import os
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpuscle.llm import quality
from corpuscle.llm.queries import QUERIES, SQL
from corpuscle.session import read_table, stash

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def five_word_sets(texts):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for i, t in texts.items()}
    return {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} for i, w in words.items()}


def test_stages(spark):
    docs = read_table(spark, DATA, "documents")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stash(stage(spark, docs, DATA), name)
        kept[name] = docs
        if name != "sharding":
            assert docs.columns == columns
    ids = {n: [r.doc_id for r in d.select("doc_id").collect()] for n, d in kept.items()}
    source = {r.doc_id: r.text for r in read_table(spark, DATA, "documents").collect()}

    truth = {r.doc_id: r.quality for r in read_table(spark, DATA, "labels").collect()}
    scored = [i for i in truth if i in source]
    right = sum((i in set(ids["quality"])) == bool(truth[i]) for i in scored)
    assert right / len(scored) > 0.95

    sets = five_word_sets({i: source[i] for i in ids["quality"]})
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    order = sorted(sets)
    for n, a in enumerate(order):
        for b in order[n + 1 :]:
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert sorted(ids["near_duplicates"]) == sorted({find(i) for i in sets})

    plain = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    items = [f" {plain(r.text)} " for r in read_table(spark, DATA, "benchmark").collect()]
    holds = {i for i in ids["near_duplicates"] if any(x in f" {plain(source[i])} " for x in items)}
    assert holds.isdisjoint(ids["decontamination"])
    assert len(ids["near_duplicates"]) - len(ids["decontamination"]) <= len(holds) + 1

    assert set(ids["mixing"]) <= set(ids["decontamination"])
    assert len(ids["sharding"]) == len(ids["mixing"])
    assert kept["sharding"].select("shard", "slot").distinct().count() == len(ids["sharding"])


def test_run_gives_the_same(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"] and out.count() > 0


def test_every_query_is_there():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES} == set(range(1, 14)) and set(SQL) <= set(QUERIES)


def test_stages_without_rows(spark):
    none = read_table(spark, DATA, "documents").filter("false").withColumn("extra", F.lit(1))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, DATA).count() == 0, name


def test_nulls_pass_the_quality_stage(spark):
    odd = spark.createDataFrame([(None, "text", "en", "s", 4), (-1, None, None, None, None)], read_table(spark, DATA, "documents").schema)
    docs = read_table(spark, DATA, "documents").unionByName(odd)
    out = {r.doc_id for r in corpus_pipeline.keep_quality(spark, docs, DATA).collect()}
    assert None in out
    assert quality.statistics(None).shape == quality.statistics("").shape


def test_stages_on_odd_rows(spark):
    """Nulls in any column, repeated ids, long and empty texts and columns named like the stages' own: all columns come back, and no row is lost but by the stage's own rule."""
    long = " ".join(f"word{i}" for i in range(9000))
    item = read_table(spark, DATA, "benchmark").orderBy("item_id").first().text
    rows = [(None, "a text without id, said plainly and in full.", "en", "s", 1), (None, None, None, None, None), (-1, None, "en", "s", None), (-2, "", None, None, 0), (-3, "the same row again and again here.", "en", "s", 1), (-3, "the same row again and again here.", "en", "s", 1), (-3, "another text under that very id.", "en", None, 1), (-4, long, "en", "s", 1), (-5, long + " tail", "en", "s", 1), (-6, f"before {item} after", "en", "s", 1), (None, f"before {item} after", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("clash") for c in ("id", "size", "shard", "bucket", "gone", "kept", "h", "count", "tokens", "component", "score", "g", "bin")})
    told = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    every = sorted(((r[0], r[1]) for r in rows), key=str)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DATA).columns == docs.columns, name
    twice = (-3, "the same row again and again here.")
    near = told(corpus_pipeline.drop_near_duplicates(spark, docs, DATA))
    assert near == sorted([x for i, x in enumerate(every) if x not in ((-4, long),) and not (x == twice and every.index(x) != i)], key=str)
    assert told(corpus_pipeline.drop_leaks(spark, docs, DATA)) == [x for x in every if x[0] != -6]
    sharded = corpus_pipeline.shard(spark, docs, DATA).collect()
    assert len(sharded) == len(rows) and {r.shard for r in sharded} <= set(range(16)) and len({(r.shard, r.slot) for r in sharded}) == len(rows)
    mixed = told(corpus_pipeline.mix_sources(spark, docs, DATA))
    assert set(mixed) <= set(every) and mixed
