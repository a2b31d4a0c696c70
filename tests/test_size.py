"""What let queries fail on large tables: plans that grew with hops, files that stood for many more rows than their bytes, caps, rows that carried whole cycles."""

import re

import duckdb
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from corpuscle.operators import cycles, graph
from corpuscle.plans import queries
from corpuscle.sources import readers


@pytest.fixture
def written(spark, monkeypatch):
    """The plans of all tables written, with a limit for broadcasts that the files keep to and their rows do not."""
    plans, write = [], DataFrameWriter.parquet

    def parquet(self, *args, **named):
        plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return write(self, *args, **named)

    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "40k")
    yield plans
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


@pytest.fixture
def many(spark):
    """Edges of 120 graphs of 48 nodes, each node with two ways on; read from Parquet like the tables."""
    from corpuscle.session import stash

    n = F.col("id") % 48
    rows = spark.range(120 * 48).select("id", n.alias("n"), F.explode(F.array((n + 1) % 48, (n * 5 + 3) % 48)).alias("to"))
    return stash(rows.select(F.concat(F.lit("d"), F.floor(F.col("id") / 48)).alias("doc"), F.concat(F.lit("n"), "n").alias("src"), F.concat(F.lit("n"), "to").alias("dst")), "many")


def small_plans(plans):
    return bool(plans) and all(p.count("Join") <= 2 and "BroadcastHashJoin" not in p for p in plans)


def hops_of_one(first):
    """Hops from the first node in one of these graphs."""
    far, front = {first: 0}, {first}
    for hop in range(1, 48):
        front = {m for n in front for m in ((n + 1) % 48, (n * 5 + 3) % 48)} - far.keys()
        far |= dict.fromkeys(front, hop)
    return far


def test_depths_in_small_plans_without_broadcasts(spark, many, written):
    """four hops were one plan, in which each hop was made again and again, and broadcast by the size of its files."""
    roots = many.filter("src = 'n1'").select("doc", F.col("src").alias("node"))
    rows = graph.depths(many, roots, 30).collect()
    want = hops_of_one(1)
    assert len(rows) == 120 and {(r.max_depth, r.nodes, round(r.avg_depth, 9)) for r in rows} == {(max(want.values()), len(want), round(sum(want.values()) / len(want), 9))}
    assert small_plans(written)


def test_reach_of_each_in_small_plans_without_broadcasts(spark, many, written):
    """three hops of every seed were one plan."""
    far = graph.distances(many, many.filter("src in ('n1', 'n7')").select("doc", F.col("src").alias("node")), 3)
    rows = far.collect()
    want = {(f"n{seed}", f"n{node}", hops) for seed in (1, 7) for node, hops in hops_of_one(seed).items() if hops <= 3}
    assert {(r.seed, r.node, r.hops) for r in rows} == want and len(rows) == 120 * len(want)
    assert small_plans(written) and "Join" not in far._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("grown", [16, 0])
def test_shortest_cycles_in_small_plans_without_broadcasts(spark, many, written, grown):
    """seven hops of every node were two plans, whether or not a node had met itself."""
    rows = cycles.shortest_cycles(many, 8, grown=grown).collect()
    back = {f"n{n}": min([hops + 1 for m, hops in hops_of_one(n).items() if n in ((m + 1) % 48, (m * 5 + 3) % 48)], default=99) for n in range(48)}
    want = {(n, hops) for n, hops in back.items() if hops <= 8}
    assert {(r.node, r.length) for r in rows} == want and len(rows) == 120 * len(want)
    assert len({hops for _, hops in want}) > 1 and max(p.count("Join") for p in written) <= 8


def odd_texts(spark, folder, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    return str(folder), lambda name: sorted(map(repr, con.execute(queries.SQL[name]).fetchall()))


def test_entropy_of_texts_of_no_and_of_one_byte(spark, tmp_path):
    """SQL has no row for texts without bytes, and minus nothing for one byte over and over."""
    folder, want = odd_texts(spark, tmp_path, [None, "", "a", "aaaa", "aabb", "a\x00é", "a" * 64 + "b" * 32 + "c" * 32])
    got = sorted(repr(tuple(r)) for r in queries.QUERIES["byte_entropy"](spark, folder).select("doc_id", "entropy").collect())
    assert got == want("byte_entropy") and len(got) == 5


def test_ratios_of_texts_without_bytes_and_of_ties(spark, tmp_path):
    """F8: no text has no share, a share of nothing is no number, and halves of the seventh place are rounded as SQL does."""
    folder, want = odd_texts(spark, tmp_path, [None, "", ",", "é,", *["," * k + "a" * (n - k) for k, n in [(41, 640), (323, 640), (333, 640), (82, 1280)]]])
    got = sorted(repr(tuple(r)) for r in queries.QUERIES["byte_ratios"](spark, folder).select("doc_id", "binary_ratio", "commas").collect())
    assert got == want("byte_ratios") and "(1, nan, nan)" in got and "(0, None, None)" in got


def test_round_trip_of_more_intents_than_the_reader_takes_from_outside(spark, monkeypatch):
    """the reader's limit of a million lines was an error of the query's own lines."""
    name = "intents_jsonl_round_trip"
    whole = queries.QUERIES[name](spark, "/root/testdata/sf0.001").count()
    monkeypatch.setattr(readers.read_intents, "__defaults__", (10,))
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() == whole > 10
    with pytest.raises(ValueError, match="more than 2 intents"):
        readers.parse_intents(spark.createDataFrame([(f'{{"path": "p", "url": "http://a.example/{i}"}}',) for i in range(3)], "value string"), 2)


def test_a_large_ring_goes_along_once(spark):
    """each node of a ring carried the whole ring to its type: 9 million names for a ring of 3,000, 32 billion for one of 180,000."""
    n = 3000
    found = spark.range(1).select(F.lit("d").alias("doc"), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.concat(F.lit("n"), i)).alias("cycle"), F.lit(n).alias("length"))
    types = spark.range(n).select(F.lit("d").alias("doc"), F.concat(F.lit("n"), "id").alias("node"), F.lit("page").alias("type"))
    got = cycles.classify_cycles(found, types)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.doc, len(r.cycle), r.sort, r.severity) for r in got.collect()] == [("d", n, "extremely_large_cycle", "critical")]
    assert re.search(r"Generate explode\(cycle#\d+\), \[1\], false", plan), "the cycle is needed beside its nodes"


def test_dangling_chains_in_small_plans_without_broadcasts(spark, many, written):
    """goal distances were few large plans, and paths were broadcast by the size of their files."""
    there = many.filter("src not in ('n5', 'n30')").select("doc", F.col("src").alias("node_id")).distinct()
    rows = graph.dangling_chains(many, there, 3, 5).collect()
    want = set()

    def follow(path):
        for m in sorted({(path[-1] + 1) % 48, (path[-1] * 5 + 3) % 48} - set(path)):
            if m in (5, 30):
                want.add(tuple(f"n{n}" for n in (*path, m)))
            elif len(path) < 5:
                follow((*path, m))

    for n in set(range(48)) - {5, 30}:
        follow((n,))
    by_start = {}
    for path in sorted((p for p in want if len(p) > 3), key=lambda p: (len(p), p)):
        by_start.setdefault(path[0], []).append(path)
    kept = {path for paths in by_start.values() for path in paths[:4]}
    assert {tuple(r.path) for r in rows} == kept and len(rows) == 120 * len(kept) > 0
    assert max(p.count("Join") for p in written) <= 3
