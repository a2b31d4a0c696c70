"""Strongly connected components and cycles of any length, for many graphs at once.

Chains of nodes with one way in and one way out are followed by pointer doubling: a ring of a thousand
nodes takes ten rounds, and what is no ring shrinks to one weighted edge. The rest is trimmed of nodes
that no cycle can hold and coloured forwards and backwards (the largest node that reaches a node colours
it; what reaches that node inside its colour is its component). Enumeration of cycles goes on only inside
components. Every round's table is written out, so lineage stays short and a lost executor costs tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.session import Scratch, stash, stash_sized, stash_wide, unbroadcast

ROUNDS = 10_000


def plain_edges(edges: DataFrame, g: tuple[str, ...]) -> DataFrame:
    return edges.select(*g, F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")).filter("src is not null and dst is not null").distinct()


def doubled(pointers: DataFrame, g: tuple[str, ...], steps: int) -> DataFrame:
    """Pointers (node, to, len, least, last) followed until they leave the table or ``steps`` steps are made; ``last`` is the last node of the table on the way."""
    held, at, made = Scratch(pointers.sparkSession), pointers, 1
    while made < steps:
        ahead = at.select(*g, F.col("node").alias("to"), F.col("to").alias("to2"), F.col("len").alias("len2"), F.col("least").alias("least2"), F.col("last").alias("last2"))
        met = at.join(ahead, [*g, "to"], "left").select(*g, "node", F.coalesce("to2", "to").alias("to"), (F.col("len") + F.coalesce("len2", F.lit(0))).alias("len"), F.least("least", "least2").alias("least"), F.coalesce("last2", "last").alias("last"))
        following = Scratch(pointers.sparkSession)
        at = following.stash_wide(met, "pointers")
        held.clear()
        held, made = following, made * 2
    return at


def chains(edges: DataFrame, g: tuple[str, ...] = ("doc",)) -> tuple[DataFrame, DataFrame]:
    """Rings of nodes with one way in and out (g, node, ring, length), and for other such nodes where their chain leads (g, node, to, last): the node after it and its last one."""
    step = stash_wide(plain_edges(edges, g), "steps")
    out = step.groupBy(*g, F.col("src").alias("node")).agg(F.count("*").alias("outs"), F.max("dst").alias("to"))
    into = step.groupBy(*g, F.col("dst").alias("node")).agg(F.count("*").alias("ins"))
    inner = stash_wide(out.join(into, [*g, "node"]).filter("outs = 1 and ins = 1 and to <> node").select(*g, "node", "to", F.lit(1).cast("long").alias("len"), F.col("node").alias("least"), F.col("node").alias("last")), "inner")
    most = inner.groupBy(*g).agg(F.count("*").alias("n")).agg(F.max("n")).collect()[0][0] or 0
    followed = doubled(inner, g, most + 1)
    ends = followed.join(inner.select(*g, F.col("node").alias("to"), F.lit(True).alias("inside")), [*g, "to"], "left")
    ends = stash_wide(ends, "chains")
    rings = ends.filter("inside").select(*g, "node", F.col("least").alias("ring"))
    sizes = rings.groupBy(*g, "ring").agg(F.count("*").alias("length"))
    return stash_wide(rings.join(sizes, [*g, "ring"]).select(*g, "node", "ring", "length"), "rings"), ends.filter("inside is null").select(*g, "node", "to", "last")


def trimmed(edges: DataFrame, g: tuple[str, ...]) -> DataFrame:
    """Edges left when nodes without a way in or out are taken off, again and again."""
    held, at = Scratch(edges.sparkSession), edges
    before = at.count()
    for _ in range(ROUNDS):
        ins, outs = at.select(*g, F.col("dst").alias("src")).distinct(), at.select(*g, F.col("src").alias("dst")).distinct()
        following = Scratch(edges.sparkSession)
        at = following.stash_wide(at.join(ins, [*g, "src"], "left_semi").join(outs, [*g, "dst"], "left_semi").select(*edges.columns), "trimmed")
        held.clear()
        held, after = following, at.count()
        if after in (0, before):
            return at
        before = after
    raise RuntimeError("trimming has not settled")


def coloured(edges: DataFrame, g: tuple[str, ...]) -> DataFrame:
    """g, node, component of some components at least: those of the nodes that colour themselves."""
    nodes = edges.select(*g, F.col("src").alias("node")).union(edges.select(*g, "dst")).distinct()
    label = stash_wide(nodes.withColumn("label", F.col("node")), "colours")
    for _ in range(ROUNDS):
        sent = edges.join(label.withColumnRenamed("node", "src"), [*g, "src"]).groupBy(*g, F.col("dst").alias("node")).agg(F.max("label").alias("sent"))
        label = stash_wide(label.join(sent, [*g, "node"], "left").select(*g, "node", F.greatest("label", "sent").alias("label"), (F.coalesce(F.col("sent") > F.col("label"), F.lit(False))).alias("moved")), "colours")
        moved = not label.filter("moved").isEmpty()
        label = label.drop("moved")
        if not moved:
            break
    ends = lambda c: label.withColumnsRenamed({"node": c, "label": f"{c}_label"})
    inside = stash_wide(edges.join(ends("src"), [*g, "src"]).join(ends("dst"), [*g, "dst"]).filter("src_label = dst_label").select(*g, "src", "dst", F.col("src_label").alias("label")), "inside")
    found = stash_wide(label.filter("node = label"), "roots")
    front = found
    while not front.isEmpty():
        back = inside.join(front.withColumnRenamed("node", "dst"), [*g, "label", "dst"]).select(*g, F.col("src").alias("node"), "label").distinct()
        front = stash_wide(back.join(found, [*g, "node", "label"], "left_anti"), "front")
        found = stash_wide(found.unionByName(front), "reached")
    return found.withColumnRenamed("label", "component")


def strong_components(edges: DataFrame, g: tuple[str, ...] = ("doc",), known: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """g, node, component (its smallest node), size for every node that lies on a cycle; ``known`` are the edges' ``chains``."""
    step = plain_edges(edges, g)
    rings, passed = known or chains(step, g)
    inner = passed.select(*g, "node").unionByName(rings.select(*g, "node"))
    outer = step.join(inner.withColumnRenamed("node", "src"), [*g, "src"], "left_anti")
    jump = passed.select(*g, F.col("node").alias("dst"), "to", "last")
    left = stash_wide(outer.join(jump, [*g, "dst"], "left").select(*g, "src", F.coalesce("to", "dst").alias("dst"), "last"), "left")
    found, rest = rings.select(*g, "node", F.col("ring").alias("component")), trimmed(left.select(*g, "src", "dst").distinct(), g)
    for _ in range(ROUNDS):
        if rest.isEmpty():
            break
        own = coloured(rest, g)
        found = found.unionByName(own)
        done = own.select(*g, "node")
        rest = trimmed(rest.join(done.withColumnRenamed("node", "src"), [*g, "src"], "left_anti").join(done.withColumnRenamed("node", "dst"), [*g, "dst"], "left_anti"), g)
    found = stash_wide(found, "components")
    end = lambda c: found.withColumnsRenamed({"node": c, "component": f"{c}_component"})
    closed = left.filter("last is not null").join(end("src"), [*g, "src"]).join(end("dst"), [*g, "dst"]).filter("src_component = dst_component")
    between = passed.join(closed.select(*g, "last", F.col("src_component").alias("component")), [*g, "last"]).select(*g, "node", "component")
    every = found.unionByName(between).distinct()
    loops = step.filter("src = dst").select(*g, F.col("src").alias("node")).distinct()
    sizes = every.groupBy(*g, "component").agg(F.count("*").alias("size"), F.min("node").alias("least"))
    real = every.join(sizes, [*g, "component"]).join(loops.withColumn("loop", F.lit(True)), [*g, "node"], "left").filter("size > 1 or loop")
    return stash_wide(real, "strong_components").select(*g, "node", F.col("least").alias("component"), "size")


def inside_components(edges: DataFrame, components: DataFrame, g: tuple[str, ...] = ("doc",)) -> DataFrame:
    """Edges whose ends are in one component."""
    end = lambda c: components.select(*g, F.col("node").alias(c), F.col("component").alias(f"{c}_component"))
    met = plain_edges(edges, g).join(end("src"), [*g, "src"]).join(end("dst"), [*g, "dst"])
    return met.filter("src_component = dst_component").select(*g, "src", "dst")


def ring_cycles(edges: DataFrame, rings: DataFrame, g: tuple[str, ...] = ("doc",)) -> DataFrame:
    """g, cycle, length of every ring, from its smallest node on."""
    step = plain_edges(edges, g).join(rings.select(*g, F.col("node").alias("src"), "ring", "length"), [*g, "src"])
    pointers = step.filter("src <> ring").select(*g, F.col("src").alias("node"), F.col("dst").alias("to"), F.lit(1).cast("long").alias("len"), F.col("src").alias("least"), F.col("src").alias("last"))
    most = rings.agg(F.max("length")).collect()[0][0] or 0
    away = doubled(stash_wide(pointers, "ring_steps"), g, most).select(*g, "node", "len")
    placed = rings.join(away, [*g, "node"], "left").withColumn("place", F.coalesce(F.col("length") - F.col("len"), F.lit(0)))
    cycle = F.transform(F.array_sort(F.collect_list(F.struct("place", "node"))), lambda x: x["node"])
    return placed.groupBy(*g, "ring").agg(cycle.alias("cycle"), F.max("length").cast("int").alias("length")).drop("ring")


def canonical(found: DataFrame, g: tuple[str, ...]) -> DataFrame:
    """Of the two directions of a cycle (from its smallest node on) the smaller one, once."""
    turned = F.concat(F.slice("cycle", 1, 1), F.reverse(F.slice("cycle", F.lit(2), F.size("cycle"))))
    return found.select(*g, F.least("cycle", turned).alias("cycle")).distinct().withColumn("length", F.size("cycle"))


def find_cycles(edges: DataFrame, most: int, g: tuple[str, ...] = ("doc",)) -> DataFrame:
    """g, cycle, length: rings of any length, and inside the other components all simple cycles of at most ``most`` edges."""
    known = chains(edges, g)
    rings = ring_cycles(edges, known[0], g)
    inside = inside_components(edges, strong_components(edges, g, known), g)
    tangled = stash_wide(inside.join(known[0].select(*g, F.col("node").alias("src")), [*g, "src"], "left_anti"), "tangled")
    loops = tangled.filter("src = dst").select(*g, F.array("src").alias("cycle"))
    forward = tangled.filter("src <> dst").select(*g, F.col("src").alias("node"), F.col("dst").alias("next"))
    front = forward.filter("next > node").select(*g, F.col("node").alias("start"), F.col("next").alias("node"), F.array("node", "next").alias("path"))
    found = rings.select(*g, "cycle").unionByName(loops)
    for _ in range(most - 1):
        if front.isEmpty():
            break
        on = front.join(forward, [*g, "node"])
        found = found.unionByName(on.filter("next = start").select(*g, F.col("path").alias("cycle")))
        on = on.filter((F.col("next") > F.col("start")) & ~F.array_contains("path", F.col("next")))
        front = stash_wide(on.select(*g, "start", F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path")), "cycle_front")
    return canonical(found, g)


def classify_cycles(found: DataFrame, types: DataFrame, g: tuple[str, ...] = ("doc",)) -> DataFrame:
    """Severity and sort of each cycle by its length and the types (g, node, type) of its nodes.

    Nodes meet their types under a number of their cycle: with the cycle itself a ring would go along as often as it has nodes.
    """
    found = stash(found.select(*g, "cycle", "length", F.monotonically_increasing_id().alias("cycle_id")), "found_cycles")
    each = found.select(*g, "cycle_id", F.explode("cycle").alias("node")).join(types.select(*g, "node", "type"), [*g, "node"], "left")
    per = each.groupBy("cycle_id").agg(F.count_if(F.col("type") == "page").alias("page"), F.count_if(F.col("type") == "pages").alias("pages"))
    per = found.join(per, "cycle_id")
    n, paged = F.col("length"), F.col("page") + F.col("pages") == F.col("length")
    sort = (
        F.when(n == 1, "self_reference").when((n == 2) & paged & (F.col("pages") >= 1), "page_tree_parent_child").when((n <= 6) & paged, "page_tree_small_cycle")
        .when(n <= 6, "small_cycle").when(n > 100, "extremely_large_cycle").otherwise("large_cycle")
    )
    level = F.create_map(*[F.lit(x) for kv in SEVERITY_OF.items() for x in kv])
    return per.withColumn("sort", sort).withColumn("severity", level[F.col("sort")]).select(*g, "cycle", "length", "sort", "severity")


#: Severity by the sort of a cycle.
SEVERITY_OF = {"self_reference": "high", "page_tree_parent_child": "info", "page_tree_small_cycle": "low", "small_cycle": "medium", "large_cycle": "high", "extremely_large_cycle": "critical"}


def shortest_cycles(edges: DataFrame, most: int, g: tuple[str, ...] = ("doc",), grown: int = 16) -> DataFrame:
    """g, node, length: the shortest cycle through each node; rings of any length, others up to ``most`` edges.

    Every node searches on only until it has met itself. Once the fronts have ``grown`` so many times as many rows as there
    are edges, what lies outside components (where no search can end) is left out first.
    """
    edges = stash_wide(plain_edges(edges, g), "plain_edges")
    known = chains(edges, g)
    rings = known[0].select(*g, "node", F.col("length").cast("int").alias("length"))
    step = stash_wide(edges.join(rings.select(*g, F.col("node").alias("src")), [*g, "src"], "left_anti"), "tangled")
    limit, whole = step.count() * grown, True
    seen = front = None
    found = rings
    for made in range(1, most + 1):
        if front is None:
            ahead = step
        else:
            onward = step.select(*g, F.col("src").alias("dst"), F.col("dst").alias("next"))
            ahead = front.join(onward, [*g, "dst"]).select(*g, "src", F.col("next").alias("dst")).distinct().join(unbroadcast(seen, size), [*g, "src", "dst"], "left_anti")
            ahead = stash_wide(ahead, "cycle_hops")
        met = ahead.filter("src = dst").select(*g, "src")
        found = found.unionByName(met.select(*g, F.col("src").alias("node"), F.lit(made).alias("length")))
        front, more = stash_sized(ahead.join(met, [*g, "src"], "left_anti"), "cycle_front")
        if made == most or front.isEmpty():
            break
        if whole and front.count() > limit:
            whole, components = False, strong_components(edges, g, known)
            step = stash_wide(inside_components(step, components, g), "tangled")
            front, more = stash_sized(inside_components(front, components, g), "cycle_front")
        seen, size = (front, more) if seen is None else (seen.unionByName(front), size + more)
        front = unbroadcast(front, more)
    return found
