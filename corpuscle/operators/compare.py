"""Diffs, links and de-duplication between and within tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.operators.findings import canonical_objects
from corpuscle.schemas import confidence_rank, severity_rank, stage_rank


def normal_target(target: Column) -> Column:
    """Without query and fragment."""
    return F.regexp_extract(target, r"^([^?#]*)", 1)


def fingerprint(stable_meta: tuple[str, ...] = ("action.target",)) -> Column:
    """kind, canonical objects, stable metadata and the first evidence offset."""
    meta = F.concat_ws(",", *[F.concat(F.lit(f"{k}="), normal_target(F.col("meta")[k])) for k in stable_meta])
    offset = F.coalesce(F.get("evidence", F.lit(0))["offset"].cast("string"), F.lit("-"))
    return F.concat_ws("::", "kind", F.array_join(canonical_objects(F.col("objects")), "|"), meta, offset)


def diff_findings(base: DataFrame, comp: DataFrame) -> DataFrame:
    """doc, fingerprint, status (new, removed, changed), before and after; the best confidence stands for a repeated key."""

    def side(df: DataFrame, name: str) -> DataFrame:
        keyed = df.withColumn("fingerprint", fingerprint())
        level = F.struct(F.lower("severity").alias("severity"), F.lower("confidence").alias("confidence"))
        best = F.min_by(level, F.struct(confidence_rank(F.col("confidence")), -severity_rank(F.col("severity")), "seq"))
        return keyed.groupBy("doc", "fingerprint").agg(best.alias(name))

    both = side(base, "before").join(side(comp, "after"), ["doc", "fingerprint"], "full_outer")
    status = F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "changed")
    return both.withColumn("status", status).filter("status is not null")


def diff_kind_counts(a: DataFrame, b: DataFrame, key: str = "kind") -> DataFrame:
    """Signed count difference (b minus a) for each key, zeros left out."""
    signed = a.select(key, F.lit(-1).alias("s")).unionByName(b.select(key, F.lit(1).alias("s")))
    return signed.groupBy(key).agg(F.sum("s").alias("delta")).filter("delta <> 0")


def delta_counts(cur: DataFrame, prev: DataFrame, key: str = "value", count: str = "n") -> DataFrame:
    """Difference of two count tables, largest first; equal ones by key."""
    both = cur.select(key, F.col(count).alias("c")).join(prev.select(key, F.col(count).alias("p")), key, "full_outer")
    return both.select(key, (F.coalesce("c", F.lit(0)) - F.coalesce("p", F.lit(0))).alias("delta")).orderBy(F.abs("delta").desc(), key)


def reconcile(a: DataFrame, b: DataFrame, key: str, n: int = 8) -> DataFrame:
    """side, count and the first n ids that the other side lacks; only n ids a side are ever gathered."""

    def missing(x: DataFrame, y: DataFrame, side: str) -> DataFrame:
        gone = x.select(key).distinct().join(y.select(key).distinct(), key, "left_anti")
        first = gone.orderBy(key).limit(n).agg(F.array_sort(F.collect_list(key)).alias("ids"))
        return gone.agg(F.count("*").alias("n")).join(first).select(F.lit(side).alias("side"), "n", "ids")

    return missing(a, b, "missing_in_second").unionByName(missing(b, a, "missing_in_first"))


def link_by_key(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Pairs (a, b) of findings of one document that agree on metadata keys."""
    pick = lambda df, name: df.select("doc", F.col("id").alias(name), *[F.col("meta")[k].alias(f"k{i}") for i, k in enumerate(keys)])
    on = ["doc", *[f"k{i}" for i in range(len(keys))]]
    return pick(left, "a").join(pick(right, "b"), on).filter("a <> b").select("doc", "a", "b")


def shares_object(a: DataFrame, b: DataFrame) -> DataFrame:
    """doc, a, b, shared objects of findings with a common object: an equi-join on the exploded objects."""
    one = a.select("doc", F.col("id").alias("a"), F.explode(F.array_distinct("objects")).alias("object"))
    two = b.select("doc", F.col("id").alias("b"), F.explode(F.array_distinct("objects")).alias("object"))
    met = one.join(two, ["doc", "object"]).filter("a <> b")
    return met.groupBy("doc", "a", "b").agg(F.array_sort(F.collect_set("object")).alias("shared"))


def assign_revision(objects: DataFrame, starts: DataFrame) -> DataFrame:
    """As-of: the revision whose start is the last at or before an object's offset; one window over the union of both."""
    numbered = starts.withColumn("revision", F.row_number().over(Window.partitionBy("doc").orderBy("offset")))
    both = numbered.select("doc", "offset", "revision", F.lit(None).cast("string").alias("obj"), F.lit(0).alias("side")).unionByName(
        objects.select("doc", "offset", F.lit(None).cast("int").alias("revision"), F.col("obj").cast("string").alias("obj"), F.lit(1).alias("side"))
    )
    order = Window.partitionBy("doc").orderBy("offset", "side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("revision", F.last("revision", True).over(order)).filter("side = 1").select("doc", "obj", "offset", "revision")


def object_context(findings: DataFrame) -> DataFrame:
    """For each object: findings, worst severity, kinds, and how many other objects of the document have the same kinds."""
    each = findings.select("doc", "id", "kind", severity_rank(F.col("severity")).alias("rank"), F.explode(F.array_distinct("objects")).alias("object"))
    per = each.groupBy("doc", "object").agg(F.count("*").alias("n"), F.max("rank").alias("max_rank"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    return per.withColumn("similar", F.count("*").over(Window.partitionBy("doc", "kinds")) - 1)


def link_findings_events(nodes: DataFrame, edges: DataFrame, g: tuple[str, ...] = ("doc",)) -> DataFrame:
    """g, node_id and the findings that its edges come from, either way."""
    ends = edges.filter("finding_id is not null").select(*g, F.explode(F.array("src", "dst")).alias("node_id"), "finding_id").distinct()
    return nodes.select(*g, "node_id").join(ends, [*g, "node_id"]).groupBy(*g, "node_id").agg(F.array_sort(F.collect_set("finding_id")).alias("findings"))


def event_records(nodes: DataFrame, edges: DataFrame, g: tuple[str, ...] = ("doc",)) -> DataFrame:
    """Event nodes with the objects that they execute, the outcomes they produce, their findings either way, and event_key, initiation and branch_index: of their outgoing edges the first by seq that names each.

    Edges have kind (``executes``, ``produces_outcome`` or other), seq, finding_id and these three.
    """
    events = nodes.filter("node_kind = 'event'").select(*g, "node_id", "event_type")
    outcomes = nodes.filter("node_kind = 'outcome'").select(*g, F.col("node_id").alias("dst"), F.lit(True).alias("is_outcome"))
    first = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    kinds = F.col("kind")
    out = edges.join(outcomes, [*g, "dst"], "left").groupBy(*g, F.col("src").alias("node_id")).agg(
        F.array_sort(F.collect_set(F.when(kinds == "executes", F.col("dst")))).alias("executes"),
        F.array_sort(F.collect_set(F.when((kinds == "produces_outcome") & F.col("is_outcome"), F.col("dst")))).alias("outcomes"),
        first("event_key"), first("initiation"), first("branch_index"),
    )
    return events.join(out, [*g, "node_id"], "left").join(link_findings_events(events, edges, g), [*g, "node_id"], "left")


def ordered_stages(df: DataFrame, *keys: str) -> DataFrame:
    """Distinct stages in rank order, the confirmed ones (probable or better) and their share of the five."""
    stage = F.col("meta")["chain.stage"]
    own = df.filter(stage.isNotNull()).select(*keys, stage.alias("stage"), stage_rank(stage).alias("rank"), (confidence_rank(F.col("confidence")) <= 2).alias("sure"))
    per = own.groupBy(*keys, "stage", "rank").agg(F.bool_or("sure").alias("sure"))
    names = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["stage"]), ",")
    cell = F.struct("rank", "stage")
    return per.groupBy(*keys).agg(names(cell).alias("stages"), names(F.when(F.col("sure"), cell)).alias("confirmed"), (F.count_if("sure") / 5).alias("completeness"))


def scan_plan(days: DataFrame, seen: DataFrame, n: int | None = None, seed: int = 0) -> DataFrame:
    """date, path, hash, decision: content that an earlier day or path has is skipped; beyond n a day are sampled out."""
    fresh = days.join(seen.select("hash").distinct().withColumn("old", F.lit(True)), "hash", "left")
    rank = F.row_number().over(Window.partitionBy("hash").orderBy("date", "path"))
    marked = fresh.withColumn("first", F.col("old").isNull() & (rank == 1))
    place = F.row_number().over(Window.partitionBy("date", "first").orderBy(F.xxhash64(F.lit(seed), "hash"), "path"))
    decision = F.when(~F.col("first"), "dedup.hash_duplicate").otherwise("selected")
    if n is not None:
        marked = marked.withColumn("place", place)
        decision = F.when(~F.col("first"), "dedup.hash_duplicate").when(F.col("place") > n, "dedup.sampled_out").otherwise("selected")
    return marked.withColumn("decision", decision).select("date", "path", "hash", "decision")


def sample_unique(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """One row (its smallest path) a content hash, of these n in the order of the md5 of ``seed:hash``, listed by path."""
    unique = df.groupBy("hash").agg(F.min("path").alias("path"))
    return unique.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "hash")), "hash").limit(n).orderBy("path")


def duplicate_hashes(df: DataFrame, n: int = 12) -> DataFrame:
    return df.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").orderBy("hash").limit(n)


def set_delta(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key and where it occurs: first, second or both."""
    sides = a.select(key, F.lit(1).alias("s")).distinct().unionByName(b.select(key, F.lit(2).alias("s")).distinct())
    total = sides.groupBy(key).agg(F.sum("s").alias("s"))
    return total.select(key, F.when(F.col("s") == 1, "first").when(F.col("s") == 2, "second").otherwise("both").alias("side"))


def upsert(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace those with the same key."""
    return existing.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def two_pass(df: DataFrame, cheap: Column, interesting: Column, deep: Column) -> DataFrame:
    """A cheap result for every row, a deep one only where it is of interest, the better of the two, and why."""
    first = df.withColumn("cheap", cheap).withColumn("flag", F.coalesce(interesting, F.lit(False)))
    second = first.withColumn("deep", F.when(F.col("flag"), deep))
    reason = F.when(~F.col("flag"), "not_selected").when(F.col("deep").isNull(), "deep_failed").otherwise("deep")
    return second.withColumns({"result": F.coalesce("deep", "cheap"), "reason": reason})
