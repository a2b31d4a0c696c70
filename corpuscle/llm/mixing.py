"""Mixing sources to target weights, in built-in functions only.

Temperature mixing: source token shares are raised to an exponent between 1 (as found) and 0 (uniform)
and normalised. The exponent is bisected to the smallest that keeps every source within a repetition
limit, or to the largest that reaches a target entropy. Weights become token budgets; a source is
dealt into hash blocks, and each pass over it takes them in a permutation of its own (``block_rank`` is
the block's place in that pass). A source is gone through as often as its budget allows; the last pass
takes a prefix of its permutation and, of the block where the budget ends, the first rows in hash order
that still fit.

Only sums a (source, block) are gathered. A source has ``blocks`` blocks, or more of ``block_tokens``
tokens each, so a hot source is spread over blocks of bounded size; rows meet in one task only in the one
block of a source where its budget ends, and are ordered there by hashes.

Defined cases: a null source is a source of its own. Every row has at least one token (null and empty
texts too). Repeated rows are taken as often as they occur. A row's place hangs on
its id and text (null counts as a value of its own).
An empty table gives no rows. Further columns pass through ``mix_rows``; its own are prefixed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.session import stash

STEPS = 50


@dataclass(frozen=True)
class MixSpec:
    """``budget`` of tokens (None: as many as there are), and one of the two goals."""

    repetition: float | None = 2.0
    entropy: float | None = None
    budget: int | None = None
    blocks: int = 64
    block_tokens: int = 16_000_000
    seed: int = 7
    bytes_per_token: int = 4
    max_sources: int = 10_000
    broadcast_rows: int = 500_000


def tokens_of(text: Column, per: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / per)).cast("long")


def drawn(*parts: Column) -> Column:
    """60 bits that depend on the parts alone."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("-")) for p in parts))), 1, 15), 16, 10).cast("long")


def bisected(shares: Column, scale: Column, spec: MixSpec) -> Column:
    """The exponent; ``scale`` is budget over tokens."""
    power = lambda a: F.transform(shares, lambda p: F.pow(p, a))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    span = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))

    def most_repeated(a: Column) -> Column:
        return scale * F.aggregate(shares, F.lit(0.0), lambda m, p: F.greatest(m, F.pow(p, a - 1))) / total(power(a))

    def spread(a: Column) -> Column:
        z = total(power(a))
        return -F.aggregate(shares, F.lit(0.0), lambda s, p: s + F.pow(p, a) / z * (a * F.ln(p) - F.ln(z)))

    def search(high_enough) -> Column:
        def step(s: Column, _: Column) -> Column:
            mid = (s["lo"] + s["hi"]) / 2
            good = high_enough(mid)
            return span(F.when(good, s["lo"]).otherwise(mid), F.when(good, mid).otherwise(s["hi"]))

        return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), span(F.lit(0.0), F.lit(1.0)), step)

    found = []
    if spec.repetition is not None:
        found.append(search(lambda a: most_repeated(a) <= spec.repetition)["hi"])
    if spec.entropy is not None:
        found.append(search(lambda a: spread(a) < spec.entropy)["lo"])
    return F.greatest(*found) if len(found) > 1 else found[0] if found else F.lit(1.0)


def _keyed(docs: DataFrame, spec: MixSpec, id_col: str, text_col: str, source_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.withColumns({
        "__mix_source": F.coalesce(F.concat(F.lit("s:"), F.col(source_col).cast("string")), F.lit("null")),
        "__mix_u": drawn(F.lit(spec.seed), F.col(id_col), F.md5(text)),
        "__mix_tokens": tokens_of(text, spec.bytes_per_token),
    })


def weights(keyed: DataFrame, spec: MixSpec) -> DataFrame:
    """For each source: number of blocks, weight, whole passes and the tokens left for the last one."""
    sources = stash(keyed.groupBy("__mix_source").agg(F.sum("__mix_tokens").alias("t")), "mix-sources")
    n = sources.count()
    if n > spec.max_sources:
        raise ValueError(f"{n} sources; their shares are gathered in one row, at most {spec.max_sources}")
    listed = F.array_sort(F.collect_list(F.struct(F.col("t"), F.col("__mix_source").alias("source")))).alias("all")
    row = sources.agg(listed, F.sum("t").alias("total")).select("all", F.col("total").cast("double").alias("total"), F.transform("all", lambda x: x["t"] / F.col("total")).alias("shares"))
    budget = F.lit(float(spec.budget)) if spec.budget is not None else F.col("total")
    row = row.select("all", "shares", budget.alias("budget"), bisected(F.col("shares"), budget / F.col("total"), spec).alias("a"))
    z = F.aggregate("shares", F.lit(0.0), lambda s, p: s + F.pow(p, F.col("a")))
    row = row.select("all", "budget", "a", z.alias("z"), "shares")
    cells = F.explode(F.zip_with("all", "shares", lambda x, p: F.struct(x["source"].alias("source"), x["t"].alias("t"), (F.pow(p, F.col("a")) / F.col("z")).alias("weight"))))
    each = row.select("budget", cells.alias("c")).select(F.col("c.source").alias("__mix_source"), F.col("c.t").alias("t"), F.round("c.weight", 12).alias("__mix_weight"), "budget")
    each = each.withColumn("own", F.floor(F.col("__mix_weight") * F.col("budget") + 0.5).cast("long"))
    blocks = F.greatest(F.lit(spec.blocks), F.ceil(F.col("t") / spec.block_tokens).cast("int")).alias("blocks")
    return stash(each.select("__mix_source", blocks, "__mix_weight", F.floor(F.expr("own div t")).cast("int").alias("whole"), (F.col("own") % F.col("t")).alias("left")), "mix-weights")


def block_plan(keyed: DataFrame, each: DataFrame, spec: MixSpec) -> DataFrame:
    """(source, block, pass) of every block taken: weight, its rank in that pass, and the tokens left if the budget ends in it."""
    sums = keyed.groupBy("__mix_source", "__mix_block").agg(F.sum("__mix_tokens").alias("block_tokens"))
    met = sums.join(F.broadcast(each), "__mix_source")
    passes = met.withColumn("__mix_pass", F.explode(F.sequence(F.lit(1), F.col("whole") + (F.col("left") > 0).cast("int"))))
    drawn_ = passes.filter("__mix_pass > 0").withColumn("draw", drawn(F.lit(spec.seed), F.col("__mix_source"), F.col("__mix_block"), F.col("__mix_pass")))
    order = Window.partitionBy("__mix_source", "__mix_pass").orderBy("draw", "__mix_block")
    ranked = drawn_.withColumns({"__mix_rank": F.row_number().over(order), "upto": F.sum("block_tokens").over(order)})
    full = (F.col("__mix_pass") <= F.col("whole")) | (F.col("upto") <= F.col("left"))
    before = F.col("upto") - F.col("block_tokens")
    taken = ranked.filter(full | (before < F.col("left")))
    return stash(taken.select("__mix_source", "__mix_block", "__mix_pass", "__mix_weight", "__mix_rank", F.when(~full, F.col("left") - before).alias("__mix_rest")), "mix-plan")


def mix_rows(docs: DataFrame, spec: MixSpec = MixSpec(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, as often as the mixture takes them, with ``__mix_`` columns (tokens, weight, pass, block, rank)."""
    keyed = _keyed(docs, spec, id_col, text_col, source_col)
    each = weights(keyed, spec)
    keyed = keyed.join(F.broadcast(each.select("__mix_source", "blocks")), "__mix_source").withColumn("__mix_block", F.pmod("__mix_u", "blocks").cast("int")).drop("blocks")
    plan = block_plan(keyed, each, spec)
    if plan.count() <= spec.broadcast_rows:
        plan = F.broadcast(plan)
    met = keyed.join(plan, ["__mix_source", "__mix_block"])
    order = Window.partitionBy("__mix_source", "__mix_block").orderBy("__mix_u", F.col(id_col), "__mix_tokens")
    ending = met.filter(F.col("__mix_rest").isNotNull()).withColumn("__mix_upto", F.sum("__mix_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    own = ["__mix_tokens", "__mix_weight", "__mix_pass", "__mix_block", "__mix_rank"]
    columns = [*[F.col(f"`{c}`") for c in docs.columns], *own]
    return met.filter(F.col("__mix_rest").isNull()).select(*columns).unionByName(ending.filter(F.col("__mix_upto") <= F.col("__mix_rest")).select(*columns))


def mix_table(docs: DataFrame, spec: MixSpec = MixSpec(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, tokens, weight, pass, block, block_rank: one row for each time a document is taken."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    mixed = mix_rows(rows, spec)
    return mixed.select("doc_id", "source", F.col("__mix_tokens").alias("tokens"), F.col("__mix_weight").alias("weight"), F.col("__mix_pass").cast("int").alias("pass"), F.col("__mix_block").alias("block"), F.col("__mix_rank").cast("int").alias("block_rank"))
