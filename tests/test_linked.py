"""Interval joins, places in an order, searches, cycles, paths, upserts and composites against brute force and hand-made tables."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscle.functions import urls
from corpuscle.operators import alignment, composites, cycles, graph, intervals, ranks
from corpuscle.session import stash_path
from corpuscle.streaming import jobs

# ---- intervals


def test_intervals_of_all_lengths(spark):
    rng = random.Random(1)
    ranges = [(rng.choice("ab"), i, rng.randrange(-500, 5000), rng.choice([0, 1, 2, 3, 17, 64, 65, 1000, 1 << 40, -5])) for i in range(200)]
    ranges += [("a", 900, (1 << 63) - 10, 100), ("a", 901, None, 5), ("a", 902, 5, None), ("b", 903, -(1 << 63), 3)]
    points = [(rng.choice("abc"), j, rng.randrange(-600, 6000)) for j in range(300)] + [("a", 900, (1 << 63) - 1), ("a", 901, None), ("b", 902, -(1 << 63)), ("a", 903, 1 << 39)]
    got = intervals.match_intervals(spark.createDataFrame(points, "doc string, id int, offset long"), spark.createDataFrame(ranges, "doc string, stream int, start long, length long"))
    want = {(d, s, i) for d, i, o in points for e, s, a, n in ranges if d == e and None not in (o, a, n) and a <= o < a + n}
    rows = got.select("doc", "stream", "id").collect()
    assert len(rows) == len(want) and {tuple(r) for r in rows} == want


def test_a_document_of_many_ranges_is_dealt_over_cells(spark):
    """No join on the document alone: the keys of one document of 200,000 ranges are many, and the largest task holds a small part."""
    ranges = spark.range(200_000).select(F.lit("d").alias("doc"), F.col("id").alias("stream"), (F.col("id") * 50).alias("start"), F.lit(40).cast("long").alias("length"))
    points = spark.range(200_000).select(F.lit("d").alias("doc"), F.col("id"), (F.col("id") * 50 + F.col("id") % 50).alias("offset"))
    met = intervals.match_intervals(points, ranges)
    assert met.count() == 160_000
    keys = ranges.select(F.call_function("shiftright", F.col("start"), F.lit(6)).alias("cell")).groupBy("cell").count().agg(F.max("count")).collect()[0][0]
    assert keys <= 2


# ---- ranks


def test_numbers_in_groups_of_any_size(spark):
    rng = random.Random(2)
    rows = [(None if i % 50 == 0 else "big", rng.randrange(900), i) for i in range(3000)] + [("small", 5, 0)]
    df = spark.createDataFrame(rows, "g string, v int, i int")
    dealt, sizes = ranks.in_blocks(df, ("g",), ("v",), parts=8)
    assert sizes.filter("g = 'big'").count() > 4 and sizes.filter("g = 'big'").agg(F.max("size")).collect()[0][0] < 1000
    got = ranks.numbered(df, ("g",), ("v", "i"), "place").collect()
    for g in ("big", "small", None):
        own = sorted((r for r in got if r.g == g), key=lambda r: r.place)
        assert [r.place for r in own] == list(range(len(own))) and own == sorted(own, key=lambda r: (r.v, r.i))


def test_first_rows_cut_one_class(spark):
    rng = random.Random(3)
    rows = [(f"g{rng.randrange(4)}", rng.randrange(3), rng.randrange(10**6)) for _ in range(400)]
    df = spark.createDataFrame(rows, "g string, p int, v int")
    for most in (0, 1, 40, 77, 1000):
        got = {tuple(r) for r in ranks.first_rows(df, ("g",), F.col("p"), ("v",), most).collect()}
        want = {x for g in {r[0] for r in rows} for x in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2]))[:most]}
        assert got == want


def test_exact_percentiles(spark):
    rng = np.random.default_rng(4)
    values = {"ties": rng.integers(0, 3, 999).astype(float), "wide": np.exp(rng.normal(0, 30, 1200)) * rng.choice([-1, 1], 1200), "one": np.array([7.0]), "odd": np.array([float("inf"), -0.0, 0.0, 5e-324])}
    df = spark.createDataFrame([(n, float(v)) for n, vs in values.items() for v in vs], "name string, value double")
    shares = [0.0, 0.1, 0.25, 0.5, 0.99, 1.0]
    got = {r.name: (r.n, r.at) for r in ranks.at_ranks(df, ("name",), "value", shares).collect()}
    for n, vs in values.items():
        assert got[n] == (len(vs), [sorted(vs)[int(np.floor(s * (len(vs) - 1) + 0.5))] for s in shares])


def test_campaigns_come_in_pages(spark):
    rows = [(f"d{i:03}", "big.com") for i in range(95)] + [(f"d{i}", "small.org") for i in (1, 2)] + [("d1", "one.net"), ("d1", "small.org"), (None, "one.net"), ("d2", None)]
    got = {(r.domain, r.page): r.docs for r in urls.campaigns(spark.createDataFrame(rows, "doc string, domain string"), size=40).collect()}
    assert got == {("big.com", k): [f"d{i:03}" for i in range(40 * k, min(40 * k + 40, 95))] for k in range(3)} | {("small.org", 0): ["d1", "d2"]}


# ---- searches and paths


def drawn_graphs(rng, graphs, nodes, links):
    return [(f"g{k}", f"n{rng.randrange(nodes)}", f"n{rng.randrange(nodes)}") for k in range(graphs) for _ in range(links)]


def hops_of(edges, start, both):
    far, front = {start: 0}, [start]
    while front:
        step = [b for x in front for a, b in (edges + [(b, a) for a, b in edges] if both else edges) if a == x and b not in far]
        far |= {b: far[front[0]] + 1 for b in step}
        front = list(dict.fromkeys(step))
    return far


def test_both_ends_meet_at_the_distance(spark):
    rng = random.Random(5)
    rows = drawn_graphs(rng, 4, 14, 13)
    e = spark.createDataFrame(rows, "doc string, src string, dst string")
    seeds = e.select("doc", F.col("src").alias("node")).filter("node < 'n5'")
    ends = e.select("doc", F.col("dst").alias("node")).filter("node >= 'n3'")
    for most in (0, 1, 2, 3, 5):
        got = {(r.doc, r.a, r.b): r.hops for r in graph.meetings(e, seeds, ends, most).collect()}
        want = {}
        for d in {r[0] for r in rows}:
            own = [(a, b) for g, a, b in rows if g == d]
            for a in {a for a, _ in own if a < "n5"}:
                want |= {(d, a, b): h for b, h in hops_of(own, a, True).items() if h <= most and b in {y for _, y in own if y >= "n3"}}
        assert got == want


def test_first_shortest_paths(spark):
    rng = random.Random(6)
    rows = drawn_graphs(rng, 3, 9, 16)
    e = spark.createDataFrame(rows, "doc string, src string, dst string")
    got = {(r.doc, r.node): r.path for r in graph.reachable_paths(e, e.filter("src = 'n1'").select("doc", F.col("src").alias("node")), 4).collect()}
    for d in {r[0] for r in rows if r[1] == "n1"}:
        own, best = [(a, b) for g, a, b in rows if g == d], {}
        paths = [["n1"]]
        for _ in range(5):
            for p in paths:
                best[p[-1]] = min(best.get(p[-1], p), p, key=lambda q: (len(q), q))
            paths = [[*p, b] for p in paths for b in sorted({b for a, b in own if a == p[-1]}) if b not in p]
        assert {n: p for (g, n), p in got.items() if g == d} == best


def test_chains_to_missing_nodes(spark):
    e = spark.createDataFrame([("d", a, b) for a, b in itertools.pairwise(["a", "b", "c", "e", "gone", "after"])] + [("d", "b", "x"), ("d", "x", "y"), ("d", "y", "b")], "doc string, src string, dst string")
    nodes = spark.createDataFrame([("d", n) for n in "abcexy"] + [("d", "after")], "doc string, node_id string")
    got = {(r.start, ">".join(r.path), r.depth, r.severity) for r in graph.dangling_chains(e, nodes, 2, 6).collect()}
    assert got == {("a", "a>b>c>e>gone", 4, "medium"), ("b", "b>c>e>gone", 3, "medium"), ("c", "c>e>gone", 2, "medium"), ("y", "y>b>c>e>gone", 4, "medium"), ("x", "x>y>b>c>e>gone", 5, "high")}


# ---- cycles


def brute_components(edges):
    reach = {a: {b for b, h in hops_of(edges, a, False).items() if h} | ({a} if any(b == a for x, b in edges if x in hops_of(edges, a, False)) else set()) for a, _ in edges}
    return {a: min(b for b in reach[a] if a in reach.get(b, ())) for a in reach if a in reach[a]}


def test_components_of_random_graphs(spark):
    rng = random.Random(7)
    rows = [r for k, (n, m) in enumerate([(6, 9), (12, 14), (20, 24), (5, 4), (9, 30)]) for r in ((f"g{k}", a, b) for _, a, b in drawn_graphs(rng, 1, n, m))]
    rows += [("chain", f"c{i:02}", f"c{i + 1:02}") for i in range(12)] + [("chain", "c12", "c00"), ("chain", "c05", "c02"), ("chain", "out", "c03"), ("chain", "c07", "away")]
    e = spark.createDataFrame(rows, "doc string, src string, dst string")
    got = {(r.doc, r.node): (r.component, r.size) for r in cycles.strong_components(e).collect()}
    want = {}
    for d in {r[0] for r in rows}:
        own = brute_components([(a, b) for g, a, b in rows if g == d])
        want |= {(d, n): (c, list(own.values()).count(c)) for n, c in own.items()}
    assert got == want


def test_cycles_of_all_severities_and_a_ring_of_150(spark):
    ring = lambda d, n: [(d, f"{d}{i:03}", f"{d}{(i + 1) % n:03}") for i in range(n)]
    rows = ring("r", 150) + ring("m", 7) + ring("p", 2) + ring("s", 5) + ring("w", 3) + [("l", "l000", "l000"), ("t", "t1", "t2"), ("t", "t2", "t3"), ("t", "t3", "t1"), ("t", "t2", "t1"), ("t", "t3", "t4")]
    e = spark.createDataFrame(rows, "doc string, src string, dst string")
    types = spark.createDataFrame([("p", "p000", "page"), ("p", "p001", "pages"), *[("w", f"w{i:03}", "page") for i in range(3)]], "doc string, node string, type string")
    got = {(r.doc, r.length): (r.sort, r.severity, r.cycle) for r in cycles.classify_cycles(cycles.find_cycles(e, 4), types).collect()}
    assert {k: v[1] for k, v in got.items()} == {("r", 150): "critical", ("m", 7): "high", ("p", 2): "info", ("s", 5): "medium", ("w", 3): "low", ("l", 1): "high", ("t", 2): "medium", ("t", 3): "medium"}
    assert got["r", 150][2] == [f"r{i:03}" for i in [0, *range(1, 150)]] and got["l", 1][0] == "self_reference" and got["t", 2][2] == ["t1", "t2"]
    near = {(r.doc, r.node): r.length for r in cycles.shortest_cycles(e, 5).collect()}
    assert near["r", "r077"] == 150 and near["t", "t1"] == 2 and near["t", "t3"] == 3 and ("t", "t4") not in near and near["l", "l000"] == 1


# ---- limits


def test_limit_of_one_large_graph(spark):
    nodes = spark.range(5000).select(F.lit("g").alias("doc"), F.format_string("n%04d", "id").alias("node_id"), F.when(F.col("id") % 10 == 0, "event").when(F.col("id") % 10 < 3, "outcome").otherwise("object").alias("node_kind"))
    edges = nodes.select("doc", F.col("node_id").alias("src"), F.lit("n0000").alias("dst"))
    kept, inside, lost = graph.limit_graph(nodes, edges, 1000, 700)
    want = sorted((n for n in range(5000)), key=lambda n: (0 if n % 10 == 0 else 1 if n % 10 < 3 else 2, n))[:1000]
    assert {r.node_id for r in kept.collect()} == {f"n{n:04}" for n in want}
    assert {r.src for r in inside.collect()} == {f"n{n:04}" for n in sorted(want)[:700]}
    r = lost.collect()[0]
    assert (r.nodes, r.edges, r.dropped_nodes, r.dropped_edges, r.label) == (5000, 5000, 4000, 4300, "Truncated graph (nodes 5000, edges 5000)")
    assert graph.limit_graph(nodes, edges, 5000, 5000)[2].count() == 0


# ---- upserts


def test_upsert_rewrites_touched_buckets_and_repeats_nothing(spark):
    schema = spark.createDataFrame([], "k long, at int, v string").schema
    table = jobs.UpsertTable(spark, stash_path(spark, "t"), schema, "k", "at", 4)
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    read = lambda: {r.k: (r.at, r.v) for r in table.read().collect()}
    assert read() == {}
    table.put(rows(*[(i, 1, "a") for i in range(40)], (3, 0, "older"), (None, 1, "null key")), 0)
    assert len(read()) == 41 and read()[3] == (1, "a") and read()[None] == (1, "null key")
    table.put(rows((5, 2, "b"), (5, 1, "late"), (6, 0, "late"), (7, 1, "same time")), 1)
    first = table.versions()
    assert read()[5] == (2, "b") and read()[6] == (1, "a") and read()[7] == (1, "same time") and sorted(first[1].values()).count(1) <= 3
    table.put(rows((5, 9, "again")), 1)  # a batch that is put again
    table.put(rows((5, 9, "again")), 0)
    assert table.versions() == first and read()[5] == (2, "b")
    table.put(rows(), 2)
    before = read()
    table.vacuum()
    assert read() == before and len(before) == 41


# ---- composites


def findings(spark, rows):
    """(doc, seq, kind, objects, meta), confidence strong."""
    return spark.createDataFrame([(d, i, f"f{i}", k, "medium", "strong", list(o), m) for d, i, k, o, m in rows], "doc string, seq int, id string, kind string, severity string, confidence string, objects array<string>, meta map<string,string>")


def test_composites_by_hand(spark):
    f = findings(spark, [
        ("d", 1, "form_html_injection", ["1"], {"field.name": "x", "chain.stage": "execute"}), ("d", 2, "pdfjs_form_injection", ["2"], {"field.name": "x", "chain.stage": "egress"}), ("d", 3, "pdfjs_form_injection", ["1"], {}),
        ("d", 4, "pdfjs_form_injection", ["1"], {}), ("d", 5, "embedded_type_mismatch", ["7"], {"hash.sha256": "h"}), ("d", 6, "launch_embedded_file", ["8"], {"launch.embedded_file_hash": "h"}), ("d", 7, "gotor_present", ["7"], {}),
        ("d", 8, "passive_credential_leak_risk", [], {}), ("d", 9, "aa_present", [], {"action.trigger_type": "automatic"}), ("d", 10, "ocg_present", ["50"], {}), ("d", 11, "swf_embedded", ["60"], {}), ("d", 12, "js_present", ["60"], {"chain.stage": "egress"}),
        ("e", 1, "passive_credential_leak_risk", [], {}), ("e", 2, "aa_event_present", [], {}), ("e", 3, "ocg_present", ["1"], {}), ("e", 4, "gotor_present", ["1"], {}), ("e", 5, "font_payload_present", [], {}), ("e", 6, "font.provenance_incremental_override", [], {}),
        ("g", 1, "icc_profile_oversized", [], {}), ("g", 2, "icc_profile_oversized", [], {}),
    ])
    got = {(r.doc, r.reason, r.shared): (r.a, r.b, r.chain_severity, r.chain_confidence) for r in composites.edge_bridges(f).collect()}
    assert got == {("d", "form_html_to_pdfjs_form", ""): ("f1", "f2", "high", "strong"), ("d", "form_html_to_pdfjs_form", "1"): ("f1", "f3", "medium", "strong")}
    assert {(r.doc, r.link, r.confidence, r.a, r.b) for r in composites.embedded_relationships(f).collect()} == {("d", "hash", "strong", "f5", "f6"), ("d", "object", "probable", "f5", "f7")}
    assert {(r.doc, r.kind, r.severity, r.confidence) for r in composites.document_composites(f).collect()} == {
        ("d", "composite.resource_external_with_trigger_surface", "high", "strong"), ("d", "composite.multi_stage_chain", "high", "strong"), ("e", "composite.resource_external_with_trigger_surface", "medium", "probable"),
        ("e", "composite.resource_overrides_with_decoder_pressure", "high", "probable"), ("g", "composite.decode_amplification_chain", "high", "strong"),
    }
    assert {(r.doc, r.confidence, r.sources) for r in composites.hidden_layer(f).collect()} == {("d", "probable", "f6,f7,f10"), ("e", "strong", "f3,f4")}
    assert {(r.from_kind, r.to_kind, r.severity) for r in composites.rich_media_paths(f).collect()} == {("swf_embedded", "js_present", "high")}


def test_a_common_object_pairs_kinds_not_findings(spark):
    f = findings(spark, [("d", i, ("form_html_injection", "submitform_present")[i % 2], ["1 0 obj"], {}) for i in range(2000)])
    got = composites.edge_bridges(f).collect()
    assert len(got) == 1 and (got[0].reason, got[0].a, got[0].b) == ("injection_to_submitform", "f0", "f1")


def test_alignment_without_a_graph(spark):
    f = findings(spark, [("d", 1, "content_stream_anomaly", ["1"], {"event.node_id": "n1"}), ("d", 2, "submitform_present", ["1"], {}), ("d", 3, "submitform_present", ["1"], {}), ("d", 4, "other", ["1"], {"chain.stage": "egress"}), ("d", 5, "xfa_submit", ["2"], {})])
    got = {(r.event_node, r.outcome_node, r.outcome_kind, r.finding_ids, r.hops) for r in alignment.align_by_object(f).collect()}
    assert got == {("n1", "unknown_outcome_node", "submitform_present", "f1,f2", 1), ("n1", "unknown_outcome_node", "other", "f1,f4", 1)}


@pytest.mark.parametrize("depth", [1, 3])
def test_nearest_is_the_least_over_seeds(spark, depth):
    rng = random.Random(9)
    rows = drawn_graphs(rng, 2, 10, 12)
    e = spark.createDataFrame(rows, "doc string, src string, dst string")
    seeds = e.select("doc", F.col("src").alias("node")).filter("node in ('n1', 'n2', 'n3')")
    far = graph.distances(e, seeds, depth).groupBy("doc", "node").agg(F.min("hops").alias("hops"))
    assert {tuple(r) for r in graph.nearest(e, seeds, depth).collect()} == {tuple(r) for r in far.collect()}
