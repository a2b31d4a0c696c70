"""Near-duplicate detection with b-bit MinHash.

Every text becomes its set of word shingles. Rows with equal sets form a class with its smallest id as
representative. Representatives have ``bands * rows`` minima: bands of them make bucket keys, and the
low ``BITS`` bits of each are packed. Members of a bucket are compared with the bucket's smallest id:
matching bits give a similarity corrected for chance collisions, and pairs that may reach the threshold
are confirmed on full sets. A bucket whose members then lie in different components is taken up again:
members outside the bucket's component meet the others (small buckets as pairs, large ones block against
block inside tasks, which return only confirmed links), so no link between different sets is lost to
bucket size. What remains is the chance that two similar sets share no band at all, 1.3e-7 at 0.8.

Defined cases: null or blank texts have an empty set, link with nothing and are kept. A text with fewer
words than a shingle has one shingle, its whole sequence. Repeated rows are rows of one class. Rows of
one id with several texts have the size of their own text and share the links of all. Rows with a null
id take no part; they come back with a null component and are kept. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.bytehash import Ranges, batches, mixed
from corpuscle.llm.components import SALTS, components
from corpuscle.session import Scratch, stash

BANDS, ROWS, BITS = 40, 5, 2
#: Standard errors below the threshold down to which an estimate is still confirmed.
MARGIN = 6.0
SMALL_BUCKET = 12
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
BLANKS = (b"\t", b"\n", b"\v", b"\f", b"\r", b" ")
BLANK = np.zeros(256, bool)
BLANK[[b[0] for b in BLANKS]] = True
_RNG = np.random.default_rng(20)
FACTORS = _RNG.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def cut_at_blanks(text: bytes, size: int) -> Iterator[bytes]:
    """Pieces of about ``size`` bytes that cut no word."""
    lo = 0
    while len(text) - lo > size:
        hi = max(text.rfind(b, lo + 1, lo + size) for b in BLANKS)
        if hi < 0:
            hi = min((x for b in BLANKS if (x := text.find(b, lo + size)) >= 0), default=len(text))
        yield text[lo:hi]
        lo = hi
    yield text[lo:]


def word_hashes(texts: list[bytes], size: int = 1_000_000) -> Iterator[np.ndarray]:
    """Hashes of each text's words, in order."""
    of, pieces = [], []
    for i, text in enumerate(texts):
        for piece in cut_at_blanks(text, size):
            of.append(i)
            pieces.append(piece)
    held: list[np.ndarray] = []
    for first, raw, offsets in batches(pieces, size):
        data = FOLD[raw]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        inside = ~BLANK[data]
        before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
        start = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.concatenate([inside[1:], [False]]) if len(data) else inside
        end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        h = Ranges(data).of(start, end)
        bounds = np.searchsorted(start, offsets)
        for k, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            held.append(h[lo:hi])
            if first + k + 1 == len(of) or of[first + k + 1] != of[first + k]:
                yield held[0] if len(held) == 1 else np.concatenate(held)
                held = []


def shingle_sets(texts: list[bytes], words: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for h in word_hashes(texts):
        if len(h) >= words:
            grams = h[: len(h) - words + 1].copy()
            for j in range(1, words):
                grams = mixed(grams * np.uint64(0x9E3779B97F4A7C15) + h[j : len(grams) + j])
            yield np.unique(grams)
        elif len(h):
            whole = h[:1]
            for j in range(1, len(h)):
                whole = mixed(whole * np.uint64(0x9E3779B97F4A7C15) + h[j])
            yield mixed(whole ^ np.uint64(len(h)))
        else:
            yield h


def minima(grams: np.ndarray) -> np.ndarray:
    out = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(grams), 256):
        np.minimum(out, (FACTORS[:, None] * grams[i : i + 256] + SHIFTS[:, None]).min(axis=1), out=out)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + least[j::ROWS])
    return keys


def packed(least: np.ndarray) -> bytes:
    """The low bits of the minima, plane by plane."""
    return b"".join(np.packbits((mixed(least) >> np.uint64(b) & np.uint64(1)).astype(np.uint8)).tobytes() for b in range(BITS))


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from packed signatures (uint8, planes in the last axis), corrected for chance matches."""
    differ = (a ^ b).reshape(*np.broadcast_shapes(a.shape, b.shape)[:-1], BITS, -1)
    differ = np.bitwise_or.reduce(differ, axis=-2)
    miss = np.bitwise_count(differ).sum(axis=-1) / len(FACTORS)
    return 1 - miss / (1 - 0.5**BITS)


def lowest_estimate(threshold: float) -> float:
    match = threshold + (1 - threshold) * 0.5**BITS
    return threshold - MARGIN * (match * (1 - match) / len(FACTORS)) ** 0.5 / (1 - 0.5**BITS)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = sorted((len(a), len(b)))
    if 100 * small < percent * large:
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (small + large - common)


def class_of(grams: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set."""
    spread = mixed(grams)
    return int(grams.sum(dtype=np.uint64).view(np.int64)), int((spread * spread).sum(dtype=np.uint64).view(np.int64)) ^ len(grams)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """id, n (size of the set), two class hashes, packed bits and band keys; an empty set has neither bits nor keys."""

    def run(record_batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in record_batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                texts = [(t or "").encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()]
                n, one, two, bits, keys = [], [], [], [], []
                for grams in shingle_sets(texts, words):
                    n.append(len(grams))
                    c1, c2 = class_of(grams)
                    one.append(c1)
                    two.append(c2)
                    least = minima(grams) if len(grams) else None
                    bits.append(None if least is None else packed(least))
                    keys.append(None if least is None else band_keys(least).view(np.int64).tolist())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(bits, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["id", "n", "c1", "c2", "bits", "keys"])

    return docs.mapInArrow(run, "id long, n long, c1 long, c2 long, bits binary, keys array<long>")


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """id, the two class hashes and the set itself as bytes."""

    def run(record_batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in record_batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                texts = [(t or "").encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()]
                sets = list(shingle_sets(texts, words))
                ones, twos = zip(*map(class_of, sets), strict=True) if sets else ((), ())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ones, pa.int64()), pa.array(twos, pa.int64()), pa.array([g.tobytes() for g in sets], pa.binary())], ["id", "c1", "c2", "grams"])

    return docs.mapInArrow(run, "id long, c1 long, c2 long, grams binary")


def likely(pairs: DataFrame, signed: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose packed bits allow the threshold."""
    floor = lowest_estimate(threshold)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                x, y = (np.frombuffer(b"".join(pdf[c]), np.uint8).reshape(len(pdf), -1) for c in ("x", "y"))
                yield pdf.loc[estimates(x, y) >= floor, ["a", "b"]]

    x = signed.select(F.col("id").alias("a"), F.col("bits").alias("x"))
    y = signed.select(F.col("id").alias("b"), F.col("bits").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInPandas(run, "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets reach the threshold."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            keep = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(pdf["x"], pdf["y"], strict=True)]
            yield pdf.loc[keep, ["a", "b"]]

    x = sets.select(F.col("id").alias("a"), F.col("grams").alias("x"))
    y = sets.select(F.col("id").alias("b"), F.col("grams").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInPandas(run, "a long, b long")


def blocks_compared(crowd: DataFrame, sets: DataFrame, signed: DataFrame, percent: int, threshold: float, block: int) -> DataFrame:
    """Links across components inside crowds (crowd, id, component), block against block.

    A crowd is dealt into hash blocks. The members outside its largest component meet every block, so all
    members go to those blocks alone that hold one; only confirmed links leave the task, at most one for
    two components of a pair of blocks.
    """
    floor = lowest_estimate(threshold)
    full = crowd.join(sets, "id").join(signed.select("id", "c1", "c2", "bits"), ["id", "c1", "c2"])
    main = crowd.groupBy("crowd", "component").agg(F.count("*").alias("k")).groupBy("crowd").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.sum("k").alias("k"))
    laid = full.join(main, "crowd").withColumn("parts", F.ceil(F.col("k") / block).cast("int"))
    laid = laid.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("side", F.col("component") != F.col("main"))
    lines = laid.filter("side").select("crowd", F.col("part").alias("i"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j"), F.lit(0).alias("role"), "id", "component", "bits", "grams", "side")
    asked = laid.filter("side").select("crowd", F.col("part").alias("i")).distinct()
    facing = laid.join(asked, "crowd").select("crowd", "i", F.col("part").alias("j"), F.lit(1).alias("role"), "id", "component", "bits", "grams", "side")

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        ours, theirs = pdf[pdf["role"] == 0], pdf[pdf["role"] == 1]
        links = []
        if len(ours) and len(theirs):
            right = np.frombuffer(b"".join(theirs["bits"]), np.uint8).reshape(len(theirs), -1)
            comps, ids, other_side = theirs["component"].to_numpy(), theirs["id"].to_numpy(), theirs["side"].to_numpy()
            sets_right = [np.frombuffer(g, np.uint64) for g in theirs["grams"]]
            joined: dict[int, int] = {}

            def root(x: int) -> int:
                while joined.get(x, x) != x:
                    x = joined[x]
                return x

            for own, comp, bits, grams in zip(ours["id"], ours["component"], ours["bits"], ours["grams"], strict=True):
                fit = estimates(np.frombuffer(bits, np.uint8), right)
                at = np.flatnonzero((fit >= floor) & (comps != comp) & (~other_side | (ids > own)))
                mine = np.frombuffer(grams, np.uint64)
                for k in at[np.argsort(-fit[at])]:
                    if root(int(comp)) != root(int(comps[k])) and similar(mine, sets_right[k], percent):
                        links.append((int(own), int(ids[k])))
                        joined[root(int(comp))] = root(int(comps[k]))
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    return lines.unionByName(facing).groupBy("crowd", "i", "j").applyInPandas(meet, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block: int = 1024) -> DataFrame:
    """id, n_shingles, component_id (smallest id reachable over links) and kept for every row."""
    threshold = percent / 100
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = stash(signatures(rows, words), "signatures")
    real = signed.filter("id is not null and n > 0")
    first = F.min(F.struct("id", "bits", "keys")).alias("first")
    classes = stash(real.groupBy("n", "c1", "c2").agg(first).select("n", "c1", "c2", F.col("first.id").alias("id"), F.col("first.bits").alias("bits"), F.col("first.keys").alias("keys")), "classes")
    scratch = Scratch(spark)
    in_band = classes.select("id", F.explode("keys").alias("key"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    heads = in_band.groupBy("key").agg(F.min("id").alias("head"), F.count("*").alias("k")).filter("k > 1")
    heads = heads.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    buckets = scratch.stash(in_band.join(heads, ["key", "salt"]).select("key", "id", "head", "k"), "buckets")
    pairs = buckets.filter("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
    pairs = scratch.stash(likely(pairs, classes, threshold), "pairs")
    crowded = buckets.filter("k > 2").select("id").union(pairs.select("a")).union(pairs.select("b")).distinct()
    once = rows.join(crowded, "id", "left_semi").withColumn("th", F.xxhash64("text")).dropDuplicates(["id", "th"])
    sets = scratch.stash(full_sets(once, words).join(classes.select("id", "c1", "c2"), ["id", "c1", "c2"], "left_semi"), "sets")
    links = scratch.stash(confirmed(pairs, sets, percent), "confirmed")
    found = components(links)
    member = buckets.filter("k > 2").join(found.withColumnRenamed("node", "id"), "id", "left").select("key", "head", "k", "id", F.coalesce("component", "id").alias("component"))
    member = scratch.stash(member, "members")
    split = member.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key")
    open_ = scratch.stash(member.join(split, "key", "left_semi"), "open")
    few = open_.filter(F.col("k") <= SMALL_BUCKET)
    a, b = few.select("key", F.col("id").alias("a"), F.col("component").alias("ca")), few.select("key", F.col("id").alias("b"), F.col("component").alias("cb"))
    met = a.join(b, "key").filter("a < b and ca <> cb").select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti")
    more = confirmed(likely(met, classes, threshold), sets, percent)
    many = open_.filter(F.col("k") > SMALL_BUCKET)
    groups = components(many.select(F.col("head").alias("a"), F.col("id").alias("b")).distinct())
    crowd = groups.select(F.col("component").alias("crowd"), F.col("node").alias("id")).join(many.groupBy("id").agg(F.first("component").alias("component")), "id")
    across = blocks_compared(scratch.stash(crowd, "crowds"), sets, classes, percent, threshold, block)
    final = components(links.union(more).union(across))
    scratch.clear()
    rep = classes.select("n", "c1", "c2", F.col("id").alias("rep")).join(final.withColumnRenamed("node", "rep"), "rep", "left")
    rep = rep.select("n", "c1", "c2", F.coalesce("component", "rep").alias("component"))
    out = signed.select("id", "n", "c1", "c2").join(rep, ["n", "c1", "c2"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), component).alias("component_id")).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
