"""Places in an order within groups of any size: numbering, the first so many, exact percentiles.

Rows are dealt by ranges of (group, order), so that a large group lies in many blocks. A block's rows are
counted, a group's blocks (as many as tasks at most) give what comes before each, and only inside a block
are rows put in order. Nothing holds a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.session import stash


def in_blocks(rows: DataFrame, g: tuple[str, ...], order: tuple[str, ...], weight: Column | None = None, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``rows`` with their block, and (g, block, before, size): the weight before a block in its group and in it. Equal places share a block."""
    n = parts or max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = stash(rows.repartitionByRange(n, *g, *order).withColumn("block", F.spark_partition_id()), "blocks")
    sizes = dealt.groupBy(*g, "block").agg(F.sum(F.lit(1) if weight is None else weight).alias("size"))
    upto = F.sum("size").over(Window.partitionBy(*g).orderBy("block"))
    return dealt, sizes.withColumn("before", upto - F.col("size"))


def joined_on(a: DataFrame, b: DataFrame, keys: tuple[str, ...], how: str = "inner") -> DataFrame:
    """An equi-join in which null keys meet, with the keys of ``a``."""
    right = b.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in b.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return a.join(right, on, how).drop(*[f"__{k}" for k in keys])


def numbered(rows: DataFrame, g: tuple[str, ...], order: tuple[str, ...], name: str = "place") -> DataFrame:
    """``rows`` with their number from 0 in their group, in ascending order; ties are numbered in any order."""
    dealt, sizes = in_blocks(rows, g, order)
    here = F.row_number().over(Window.partitionBy(*g, "block").orderBy(*order)) - 1
    own = dealt.withColumn("__here", here)
    return joined_on(own, sizes.select(*g, "block", "before"), (*g, "block")).withColumn(name, F.col("before") + F.col("__here")).drop("before", "block", "__here")


def first_rows(rows: DataFrame, g: tuple[str, ...], priority: Column, order: tuple[str, ...], most: int) -> DataFrame:
    """The ``most`` rows of each group that come first by (priority, order).

    Classes of one priority are counted; those that fit are kept as they are, those beyond are left, and only
    the class that the limit cuts is put in order.
    """
    ranked = rows.withColumn("__class", priority)
    counts = ranked.groupBy(*g, "__class").agg(F.count("*").alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(*g).orderBy("__class"))
    known = counts.select(*g, "__class", (upto - F.col("__n")).alias("__before"), upto.alias("__upto"))
    placed = joined_on(ranked, known, (*g, "__class")).filter(F.col("__before") < most)
    whole = placed.filter(F.col("__upto") <= most)
    cut = numbered(placed.filter(F.col("__upto") > most), g, order, "__place").filter(F.col("__before") + F.col("__place") < most)
    return whole.select(*rows.columns).unionByName(cut.select(*rows.columns))


def at_ranks(values: DataFrame, g: tuple[str, ...], value: str, shares: list[float]) -> DataFrame:
    """g, n and an array of the values at the nearest ranks ``round(share * (n - 1))`` of each group, exactly.

    Distinct values with their counts are dealt into blocks; of these only the ones that hold a wanted rank are put in order.
    """
    counts = values.groupBy(*g, value).agg(F.count("*").alias("c"))
    dealt, sizes = in_blocks(counts, g, (value,), F.col("c"))
    total = sizes.groupBy(*g).agg(F.sum("size").alias("n"))
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), F.round(F.lit(s) * (F.col("n") - 1)).cast("long").alias("rank")) for i, s in enumerate(shares)])
    wanted = total.select(*g, "n", F.explode(ranks).alias("w")).select(*g, "n", "w.i", "w.rank")
    blocks = joined_on(wanted, sizes, g).filter((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("size")))
    held = blocks.groupBy(*g, "block", "before", "n").agg(F.collect_list(F.struct("i", "rank")).alias("asked"))
    upto = F.sum("c").over(Window.partitionBy(*g, "block").orderBy(value))
    inside = joined_on(dealt, held, (*g, "block")).withColumn("upto", F.col("before") + upto)
    hit = inside.select(*g, "n", value, "c", "upto", F.explode("asked").alias("a")).filter((F.col("a.rank") < F.col("upto")) & (F.col("a.rank") >= F.col("upto") - F.col("c")))
    return hit.groupBy(*g, "n").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("a.i").alias("i"), F.col(value).alias("v")))), lambda x: x["v"]).alias("at"))
