"""Bindings and graph work over whole tables, against plain Python."""

import os
from collections import defaultdict

import pytest

from corpuscle.operators import graph
from corpuscle.plans import bindings, queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def test_every_transition(spark):
    events = spark.read.parquet(f"{DATA}/events.parquet").select("user_id", "ts", "event_id", "event_type").collect()
    want, last = set(), {}
    for e in sorted(events, key=lambda e: (e.user_id, e.ts, e.event_id)):
        if (before := last.get(e.user_id)) is not None:
            want.add((str(e.user_id), before.event_type, e.event_type, before.event_id))
        last[e.user_id] = e
    rows = bindings.transitions(spark, DATA).collect()
    assert {(r.doc, r.src, r.dst, r.seq) for r in rows} == want and len(rows) == len(want) > 0


def test_scores_of_one_graph_spread(spark):
    """One graph key is no partition: its maximum comes from partial ones, and scores stay what they were."""
    edges = spark.createDataFrame([("g", f"a{i}", "hub", True) for i in range(4)] + [("h", "x", "y", True)], "doc string, src string, dst string, suspicious boolean")
    scores = graph.propagate_scores(edges, 1)
    assert {(r.doc, r.node): round(r.score, 6) for r in scores.collect()} == {("g", "hub"): 1.0, **{("g", f"a{i}"): 0.15 for i in range(4)}, ("h", "x"): 0.3, ("h", "y"): 0.5}
    assert "Window" not in scores._jdf.queryExecution().optimizedPlan().toString()


def hops_from(edges, seed, depth):
    """Nodes within ``depth`` of the seed, with their hops."""
    far, front = {seed: 0}, {seed}
    for hop in range(1, depth + 1):
        front = {b for a in front for b in edges[a]} - far.keys()
        far |= dict.fromkeys(front, hop)
    return far


def test_reach_of_every_seed(spark):
    """each seed's own reach, not only the nodes that any seed reaches."""
    edges, seeds = defaultdict(set), set()
    for e in bindings.typed_edges(spark, DATA).collect():
        edges[e.src].add(e.dst)
        if e.edge_type == "places" and e.suspicious:
            seeds.add(e.src)
    want = {(seed, node, hops) for seed in seeds for node, hops in hops_from(edges, seed, 3).items()}
    rows = queries.QUERIES["reachable_from"](spark, DATA).select("seed", "node", "hops").collect()
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)
    assert len(seeds) > 1 and len(want) > len({node for _, node, _ in want})


@pytest.mark.parametrize("cut_every", [1, 2, 4])
def test_cuts_do_not_change_distances(spark, cut_every):
    ring = [("d", f"n{i}", f"n{(i + 1) % 7}") for i in range(7)] + [("d", "n0", "n4")]
    edges = defaultdict(set)
    for _, a, b in ring:
        edges[a].add(b)
    seeds = spark.createDataFrame([("d", "n0"), ("d", "n3")], "doc string, node string")
    rows = graph.distances(spark.createDataFrame(ring, "doc string, src string, dst string"), seeds, 9, cut_every=cut_every).collect()
    want = {("d", seed, node, hops) for seed in ("n0", "n3") for node, hops in hops_from(edges, seed, 9).items()}
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)


def test_suppliers_and_nations_within_three_hops(spark):
    """every type of edge and three hops at once, so nations of the region (without suppliers too) and those behind shared orders."""
    edges = defaultdict(set)
    for e in bindings.typed_edges(spark, DATA).collect():
        edges[e.src].add(e.dst)
        edges[e.dst].add(e.src)
    want = {(node, to, hops) for node in list(edges) if node[0] == "s" for to, hops in hops_from(edges, node, 3).items() if to[0] == "n"}
    rows = queries.QUERIES["shortest_hops_within"](spark, DATA).select("supplier", "nation", "hops").collect()
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)
    assert {hops for _, _, hops in want} == {1, 3}
