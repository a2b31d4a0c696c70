"""Graph work over edge tables (graph key, src, dst): bounded loops of joins, lineage cut through the shared folder.

``g`` names the columns that tell graphs apart (such as doc); all joins and groups include them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.operators.ranks import first_rows, joined_on, numbered
from corpuscle.schemas import severity_rank
from corpuscle.session import stash, stash_sized, stash_wide, unbroadcast


def steps(edges: DataFrame, g: tuple[str, ...] = ("doc",), undirected: bool = False) -> DataFrame:
    """g, node, next: each step once, written out."""
    step = edges.select(*g, F.col("src").alias("node"), F.col("dst").alias("next"))
    if undirected:
        step = step.union(edges.select(*g, "dst", "src"))
    return stash(step.distinct(), "steps")


def distances(edges: DataFrame, seeds: DataFrame, depth: int, g: tuple[str, ...] = ("doc",), undirected: bool = False, cut_every: int = 1, step: DataFrame | None = None) -> DataFrame:
    """g, seed, node, hops: the fewest hops from each seed, up to ``depth``.

    ``step``: the steps, where they have been written out already.
    """
    step = steps(edges, g, undirected) if step is None else step
    return _outward(step, seeds.select(*g, F.col("node").alias("seed"), "node"), depth, (*g, "seed", "node"), g, cut_every)


def nearest(edges: DataFrame, seeds: DataFrame, depth: int, g: tuple[str, ...] = ("doc",), cut_every: int = 1, step: DataFrame | None = None) -> DataFrame:
    """g, node, hops: the fewest hops from any seed, up to ``depth``; a node is carried once, however many seeds reach it.

    ``step``: the steps, where they have been written out already.
    """
    step = steps(edges, g) if step is None else step
    return _outward(step, seeds.select(*g, "node"), depth, (*g, "node"), g, cut_every)


def _outward(step: DataFrame, seeds: DataFrame, depth: int, key: tuple[str, ...], g: tuple[str, ...], cut_every: int) -> DataFrame:
    """``key`` (with node in it), hops: from the seeds on, hop by hop, to keys not met before.

    A hop's rows are written out, so that no hop is made twice and a plan holds two joins; files that stand for many rows are not broadcast.
    """
    known, size = stash_sized(seeds.distinct().withColumn("hops", F.lit(0)), "seeds")
    frontier = unbroadcast(known, size)
    for hop in range(1, depth + 1):
        ahead = frontier.select(*key).join(step, [*g, "node"]).select(*[F.col("next").alias(c) if c == "node" else c for c in key]).distinct()
        frontier = ahead.join(unbroadcast(known, size), list(key), "left_anti").withColumn("hops", F.lit(hop))
        if hop % cut_every:
            known = known.unionByName(frontier)
            continue
        frontier, more = stash_sized(frontier, "frontier")
        if frontier.isEmpty():
            break
        known, size = known.unionByName(frontier), size + more
        frontier = unbroadcast(frontier, more)
        if hop % max(cut_every, 8) == 0:
            known, size = stash_sized(known, "known")
    return known


def reversed_edges(edges: DataFrame, g: tuple[str, ...] = ("doc",)) -> DataFrame:
    return edges.select(*g, F.col("dst").alias("src"), F.col("src").alias("dst"))


def meetings(edges: DataFrame, starts: DataFrame, ends: DataFrame, most: int, g: tuple[str, ...] = ("doc",)) -> DataFrame:
    """g, a, b, hops: starts and ends whose undirected distance is at most ``most``, with it.

    Both sides search, each half of the way; pairs arise only at the nodes where their fronts meet, and the least
    sum over these is the distance. Of an odd ``most`` the starts go the step more, so the fewer nodes should be the starts.
    """
    step = steps(edges, g, undirected=True)
    one = distances(edges, starts, most - most // 2, g, undirected=True, step=step).withColumnsRenamed({"seed": "a", "hops": "from_a"})
    two = distances(edges, ends, most // 2, g, undirected=True, step=step).withColumnsRenamed({"seed": "b", "hops": "from_b"})
    return one.join(two, [*g, "node"]).groupBy(*g, "a", "b").agg(F.min(F.col("from_a") + F.col("from_b")).alias("hops"))


def hop_distance(edges: DataFrame, pairs: DataFrame, most: int, g: tuple[str, ...] = ("doc",)) -> DataFrame:
    """Pairs (a, b) with their undirected distance where it is at most ``most``."""
    far = meetings(edges, pairs.select(*g, F.col("a").alias("node")), pairs.select(*g, F.col("b").alias("node")), most, g)
    return pairs.join(far, [*g, "a", "b"])


def reachable_paths(edges: DataFrame, seeds: DataFrame, depth: int, g: tuple[str, ...] = ("doc",)) -> DataFrame:
    """g, seed, node, path: for each node the first path in order among the shortest.

    A node keeps one parent and its place among the nodes of its hop (the order of their paths: the parent's
    place, then the node), so no path is carried along; at the end pointers are doubled to put the paths together.
    """
    step = edges.select(*g, F.col("src").alias("node"), F.col("dst").alias("next")).distinct()
    known = seeds.select(*g, F.col("node").alias("seed"), "node").distinct()
    known = known.withColumns({"parent": F.lit(None).cast(known.schema["node"].dataType), "place": F.lit(0).cast("long")})
    known = frontier = stash(known, "first_nodes")
    group, cell = (*g, "seed"), F.struct(F.col("place").alias("p"), F.col("node").alias("parent"))
    for _ in range(depth):
        ahead = frontier.join(step, [*g, "node"]).groupBy(*group, F.col("next").alias("next")).agg(F.min(cell).alias("from"))
        ahead = ahead.select(*group, F.col("next").alias("node"), F.col("from.parent").alias("parent"), F.col("from.p").alias("parent_place")).join(known, [*group, "node"], "left_anti")
        frontier = numbered(ahead, group, ("parent_place", "node"), "place").select(*group, "node", "parent", F.col("place").cast("long").alias("place"))
        frontier = stash(frontier, "frontier")
        if frontier.isEmpty():
            break
        known = stash(known.unionByName(frontier), "known")
    text = lambda c: F.array(F.col(c).cast("string"))
    at, made = known.select(*group, "node", F.col("parent").alias("to"), text("node").alias("path")), 1
    while made <= depth:
        ahead = at.select(*group, F.col("node").alias("to"), F.col("to").alias("to2"), F.col("path").alias("before"))
        met = at.join(ahead, [*group, "to"], "left")
        at = stash(met.select(*group, "node", F.col("to2").alias("to"), F.when(F.col("before").isNull(), F.col("path")).otherwise(F.concat("before", "path")).alias("path")), "path_pointers")
        made *= 2
    return at.select(*group, "node", "path")


def induced_subgraph(edges: DataFrame, seeds: DataFrame, hops: int, g: tuple[str, ...] = ("doc",)) -> DataFrame:
    """Edges between nodes within ``hops`` undirected hops of a seed."""
    near = distances(edges, seeds, hops, g, undirected=True).select(*g, "node").distinct()
    inside = edges.join(near.withColumnRenamed("node", "src"), [*g, "src"], "left_semi")
    return inside.join(near.withColumnRenamed("node", "dst"), [*g, "dst"], "left_semi")


def subgraph(nodes: DataFrame, edges: DataFrame, wanted: Column, g: tuple[str, ...] = ("doc",)) -> DataFrame:
    """Edges among the nodes that match and the objects next to them (one fixed step)."""
    hit = nodes.filter(wanted).select(*g, F.col("node_id").alias("node"))
    objects = nodes.filter("node_kind = 'object'").select(*g, F.col("node_id").alias("node"))
    both = edges.select(*g, F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select(*g, "dst", "src"))
    near = both.join(hit.withColumnRenamed("node", "a"), [*g, "a"], "left_semi").select(*g, F.col("b").alias("node")).join(objects, [*g, "node"], "left_semi")
    keep = hit.union(near).distinct()
    inside = edges.join(keep.withColumnRenamed("node", "src"), [*g, "src"], "left_semi")
    return inside.join(keep.withColumnRenamed("node", "dst"), [*g, "dst"], "left_semi")


def reaches(nodes: DataFrame, edges: DataFrame, outcome_types: list[str], most: int = 32, g: tuple[str, ...] = ("doc",)) -> DataFrame:
    """Graphs in which some event reaches an outcome of the given types; searched backwards from the outcomes."""
    ends = nodes.filter(F.col("outcome_type").isin(outcome_types)).select(*g, F.col("node_id").alias("node"))
    seen = nearest(reversed_edges(edges, g), ends, most, g).filter("hops > 0").select(*g, F.col("node").alias("node_id"))
    return seen.join(nodes.filter("node_kind = 'event'").select(*g, "node_id"), [*g, "node_id"], "left_semi").select(*g).distinct()


def simple_paths(edges: DataFrame, starts: DataFrame, ends: DataFrame, depth: int, g: tuple[str, ...] = ("doc",)) -> DataFrame:
    """All simple paths with at most ``depth`` edges from a start to the first end on the way: g, path.

    Distances to the ends come first, and a path goes on only to nodes from which an end is still within its remaining hops.
    """
    step = steps(edges, g)
    left, size = stash_sized(nearest(reversed_edges(step.select(*g, F.col("node").alias("src"), F.col("next").alias("dst")), g), ends, depth, g), "goal_distances")
    step = stash(step.join(unbroadcast(left, size).select(*g, F.col("node").alias("next"), F.col("hops").alias("left")), [*g, "next"]), "goal_steps")
    front = stash_wide(starts.select(*g, "node", F.array(F.col("node").cast("string")).alias("path")).distinct(), "path_starts")
    found = None
    for made in range(1, depth + 1):
        front = front.join(step, [*g, "node"]).filter((F.col("left") <= depth - made) & ~F.array_contains("path", F.col("next").cast("string")))
        front = stash_wide(front.select(*g, F.col("next").alias("node"), "left", F.concat("path", F.array(F.col("next").cast("string"))).alias("path")), "path_front")
        hit = front.filter("left = 0").select(*g, "path")
        found = hit if found is None else found.unionByName(hit)
        front = front.filter("left > 0").drop("left")
    return found


def action_chains(edges: DataFrame, triggers: Column, eligible: Column, most: int = 10, g: tuple[str, ...] = ("doc",)) -> DataFrame:
    """From each trigger edge the first eligible edge (by seq) to an unvisited node, again and again: one path a trigger."""
    step = edges.filter(eligible).select(*g, F.col("src").alias("node"), F.col("dst").alias("next"), F.col("edge_type").alias("kind"), "seq")
    text = lambda c: F.col(c).cast("string")
    live = edges.filter(triggers).select(*g, F.col("seq").alias("chain"), F.col("dst").alias("node"), F.array(text("src"), text("dst")).alias("path"), F.array("edge_type").alias("kinds"))
    done = None
    for _ in range(most - 1):
        met = live.join(step, [*g, "node"], "left").withColumn("ok", F.col("next").isNotNull() & ~F.array_contains("path", text("next")))
        best = F.min_by(F.when(F.col("ok"), F.struct("next", "kind")), F.when(F.col("ok"), F.col("seq")))
        went = stash(met.groupBy(*g, "chain", "node", "path", "kinds").agg(best.alias("b")), "chain_front")
        over = went.filter("b is null").select(*g, "chain", "path", "kinds")
        done = over if done is None else done.unionByName(over)
        live = went.filter("b is not null").select(*g, "chain", F.col("b.next").alias("node"), F.concat("path", F.array(F.col("b.next").cast("string"))).alias("path"), F.concat("kinds", F.array("b.kind")).alias("kinds"))
    rest = live.select(*g, "chain", "path", "kinds")
    return rest if done is None else done.unionByName(rest)


def depths(edges: DataFrame, roots: DataFrame, most: int, g: tuple[str, ...] = ("doc",)) -> DataFrame:
    """g, max_depth, avg_depth, nodes over what a root reaches."""
    far = nearest(edges, roots, most, g).withColumnRenamed("hops", "d")
    return far.groupBy(*g).agg(F.max("d").alias("max_depth"), F.avg("d").alias("avg_depth"), F.count("*").alias("nodes"))


def propagate_scores(edges: DataFrame, rounds: int = 3, fade: float = 0.7, least: float = 0.1, g: tuple[str, ...] = ("doc",)) -> DataFrame:
    """Suspicious edges seed their ends (0.3 and 0.5 each); scores then flow along edges; a graph above 1 is scaled to 1."""
    seeds = edges.filter("suspicious").select(*g, F.col("src").alias("node"), F.lit(0.3).alias("s")).unionByName(edges.filter("suspicious").select(*g, F.col("dst").alias("node"), F.lit(0.5).alias("s")))
    nodes = edges.select(*g, F.col("src").alias("node")).union(edges.select(*g, "dst")).distinct()
    score = nodes.join(seeds.groupBy(*g, "node").agg(F.sum("s").alias("score")), [*g, "node"], "left").fillna(0.0, ["score"])
    for _ in range(rounds):
        sent = edges.join(score.withColumnRenamed("node", "src"), [*g, "src"]).filter(F.col("score") > least)
        got = sent.groupBy(*g, F.col("dst").alias("node")).agg((F.max("score") * fade).alias("in"))
        score = stash(score.join(got, [*g, "node"], "left").select(*g, "node", F.greatest("score", F.coalesce("in", F.lit(0.0))).alias("score")), "scores")
    tops = score.groupBy(*g).agg(F.max("score").alias("top")).filter("top > 1")
    return joined_on(score, tops, g, "left").select(*g, "node", F.when(F.col("top") > 1, F.col("score") / F.col("top")).otherwise(F.col("score")).alias("score"))


def suspicious_targets(edges: DataFrame, g: tuple[str, ...] = ("doc",)) -> DataFrame:
    return edges.filter("suspicious").select(*g, F.col("dst").alias("node")).distinct()


def references(edges: DataFrame, node: str, incoming: bool = True) -> DataFrame:
    return edges.filter(F.col("dst" if incoming else "src") == node)


def edge_stats(edges: DataFrame, g: tuple[str, ...] = ("doc",)) -> DataFrame:
    return edges.groupBy(*g, "edge_type").agg(F.count("*").alias("n"))


def reference_depth(edges: DataFrame, roots: DataFrame, most: int = 64, g: tuple[str, ...] = ("doc",)) -> DataFrame:
    deep = depths(edges, roots, most, g)
    return deep.withColumns({"capped": F.col("max_depth") >= most, "severity": F.when(F.col("max_depth") > 50, "high").when(F.col("max_depth") > 20, "medium").otherwise("info")})


def dangling_chains(edges: DataFrame, nodes: DataFrame, shortest: int = 3, most: int = 16, per_key: int = 4, g: tuple[str, ...] = ("doc",)) -> DataFrame:
    """Reference chains that end in a missing node, ``shortest`` to ``most`` edges long, at most four a start.

    A chain ends at the first missing node. Distances to missing nodes come first, and only chains that can still reach one are followed.
    """
    step = stash_wide(edges.select(*g, F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")).distinct(), "reference_steps")
    there = stash_wide(nodes.select(*g, F.col("node_id").cast("string").alias("node")).distinct(), "present_nodes")
    gone = step.select(*g, F.col("dst").alias("node")).distinct().join(there, [*g, "node"], "left_anti")
    found = simple_paths(step, step.select(*g, F.col("src").alias("node")).join(there, [*g, "node"], "left_semi"), gone, most, g)
    long = found.select(*g, F.element_at("path", 1).alias("start"), "path", (F.size("path") - 1).alias("depth")).filter(F.col("depth") >= shortest)
    ranked = long.withColumn("rank", F.row_number().over(Window.partitionBy(*g, "start").orderBy("depth", "path"))).filter(F.col("rank") <= per_key)
    return ranked.withColumn("severity", F.when(F.col("depth") >= 5, "high").otherwise("medium"))


def edge_index(nodes: DataFrame, edges: DataFrame, g: tuple[str, ...] = ("doc",)) -> DataFrame:
    """Edges over dense node numbers of each graph; missing ends count as nodes."""
    every = nodes.select(*g, F.col("node_id").alias("node")).union(edges.select(*g, "src")).union(edges.select(*g, "dst")).distinct()
    known = stash(numbered(every, g, ("node",), "i"), "node_numbers")
    a, b = known.select(*g, F.col("node").alias("src"), F.col("i").alias("src_i")), known.select(*g, F.col("node").alias("dst"), F.col("i").alias("dst_i"))
    return edges.join(a, [*g, "src"]).join(b, [*g, "dst"]).select(*g, "src_i", "dst_i")


def limit_graph(nodes: DataFrame, edges: DataFrame, most: int, most_edges: int | None = None, g: tuple[str, ...] = ("doc",)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The first ``most`` nodes of each graph (events, outcomes, objects, then collapses), of the edges among them the first ``most_edges``, and what was dropped.

    The third table has g, nodes, edges (as many as there were), dropped_nodes, dropped_edges and label for each graph that lost something: its collapse node.
    """
    order = F.when(F.col("node_kind") == "event", 0).when(F.col("node_kind") == "outcome", 1).when(F.col("node_kind") == "object", 2).otherwise(3)
    kept = stash(first_rows(nodes, g, order, ("node_id",), most), "kept_nodes")
    ids = kept.select(*g, "node_id")
    inside = edges.join(ids.withColumnRenamed("node_id", "src"), [*g, "src"], "left_semi").join(ids.withColumnRenamed("node_id", "dst"), [*g, "dst"], "left_semi")
    if most_edges is not None:
        inside = stash(first_rows(inside, g, F.lit(0), tuple(c for c in edges.columns if c not in g), most_edges), "kept_edges")
    count = lambda df, name: df.groupBy(*g).agg(F.count("*").alias(name))
    totals = count(nodes, "nodes").join(count(kept, "kept_nodes"), list(g), "left").join(count(edges, "edges"), list(g), "left").join(count(inside, "kept_edges"), list(g), "left")
    totals = totals.fillna(0, ["kept_nodes", "edges", "kept_edges"]).withColumns({"dropped_nodes": F.col("nodes") - F.col("kept_nodes"), "dropped_edges": F.col("edges") - F.col("kept_edges")})
    label = F.concat(F.lit("Truncated graph (nodes "), "nodes", F.lit(", edges "), "edges", F.lit(")"))
    return kept, inside, totals.filter("dropped_nodes > 0 or dropped_edges > 0").select(*g, "nodes", "edges", "dropped_nodes", "dropped_edges", label.alias("label"))


def merge_outcomes(nodes: DataFrame, edges: DataFrame, order: str = "node_id", g: tuple[str, ...] = ("doc",)) -> tuple[DataFrame, DataFrame]:
    """Outcome nodes of a graph equal on type, target and source become the first of them by ``order``; edges follow.

    The survivor has the highest confidence, the worst severity and the evidence of all.
    """
    keys = ("outcome_type", "target", "source_obj")
    outcomes = nodes.filter("node_kind = 'outcome'")
    rank = severity_rank(F.col("severity"))
    merged = outcomes.groupBy(*g, *keys).agg(
        F.min_by("node_id", order).alias("node_id"), F.max("confidence_score").alias("confidence_score"), F.max_by("severity", rank).alias("severity"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence")
    )
    merged = stash(merged, "merged_outcomes")
    back = joined_on(outcomes.select(*g, *keys, F.col("node_id").alias("old")), merged.select(*g, *keys, F.col("node_id").alias("new")), (*g, *keys)).select(*g, "old", "new").filter("old <> new")
    at = lambda side: back.select(*g, F.col("old").alias(side), F.col("new").alias(f"{side}_new"))
    moved = edges.join(at("src"), [*g, "src"], "left").join(at("dst"), [*g, "dst"], "left")
    return merged, moved.select(*[F.coalesce(f"{c}_new", c).alias(c) if c in ("src", "dst") else F.col(c) for c in edges.columns]).distinct()


def dedup_edges(edges: DataFrame, g: tuple[str, ...] = ("doc",)) -> DataFrame:
    return edges.dropDuplicates([*g, "src", "dst", "kind", "provenance", "metadata"])


def summarise_edges(chains: DataFrame, level: str = "events") -> DataFrame:
    """Of a chain's edges (array) only the suspicious ones and those that weigh at least max(0.25, 0.4 of its risk) at level ``events``, none at ``minimal``, all at ``full``; with how many there were and are."""
    kept = {"minimal": F.slice("edges", 1, 0), "full": F.col("edges"), "events": F.filter("edges", lambda e: F.coalesce(e["suspicious"], F.lit(False)) | (F.coalesce(e["weight"], F.lit(0.0)) >= F.greatest(F.lit(0.25), F.coalesce("risk", F.lit(0.0)) * 0.4)))}[level]
    return chains.withColumn("original", F.size("edges")).withColumn("edges", kept).withColumn("kept", F.size("edges"))


#: What a finding on a path adds to its risk.
PATH_WEIGHT = {4: 0.2, 3: 0.15, 2: 0.08, 1: 0.03}


def path_risk(paths: DataFrame, findings: DataFrame) -> DataFrame:
    """Adds risk and pattern to paths (doc, path_id, automatic, script, external, steps of node, type, key, suspicious and kinds).

    Risk counts the flags, the findings of the document whose kinds a node names (summed by kind before they meet
    the paths), suspicious edges and length, at most 1.
    """
    rank = severity_rank(F.col("severity"))
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in PATH_WEIGHT.items() for x in kv])[rank], F.lit(0.0))
    by_kind = findings.groupBy("doc", "kind").agg(F.sum(weight).alias("w"))
    named = paths.select("doc", "path_id", F.explode("steps").alias("s")).select("doc", "path_id", F.explode("s.kinds").alias("kind"))
    met = named.join(by_kind, ["doc", "kind"]).groupBy("doc", "path_id").agg(F.sum("w").alias("__w"))
    loud = F.size(F.filter("steps", lambda s: F.coalesce(s["suspicious"], F.lit(False))))
    flags = F.when(F.col("automatic"), 0.3).otherwise(0.0) + F.when(F.col("script"), 0.4).otherwise(0.0) + F.when(F.col("external"), 0.3).otherwise(0.0)
    risk = F.least(F.lit(1.0), flags + F.coalesce("__w", F.lit(0.0)) + loud * 0.1 + F.greatest(F.size("steps") - 2, F.lit(0)) * 0.05)
    typed = lambda *names: F.exists("steps", lambda s: s["type"].isin(*names))
    opened, script, outward = F.exists("steps", lambda s: F.coalesce(s["key"] == "/OpenAction", F.lit(False))), typed("JavaScript"), typed("URI", "Launch")
    pattern = (
        F.when(opened & script & outward, "automatic_js_with_external_action").when(opened & script, "automatic_js_trigger").when(~opened & script & outward, "js_to_external_resource").when(opened & ~script & outward, "automatic_external_action")
        .when(F.col("automatic") & F.col("script"), "automatic_js_chain").when(F.col("automatic"), "automatic_action_chain").when(F.col("script") & F.col("external"), "js_external_chain")
    )
    return paths.join(met, ["doc", "path_id"], "left").withColumns({"risk": risk, "pattern": pattern}).drop("__w")
