"""Benchmark decontamination: rare n-gram seeds joined to test items, then Smith-Waterman alignment.

Words are maximal runs of letters and digits, lower-cased. The index of the items (their words as hashes,
and postings from seeds to items) goes to the tasks; a text is read where it lies, and no text, pair or
passage is shuffled. Stretches of a text around seeds are cut out. A stretch and an item go on if

* they share a seed that at most ``rare`` items hold, or two different ones of any kind, or one of any
  kind where the item has no rare seed, and
* the words they share, all taken as matches, reach ``threshold``: no alignment scores more.

Local alignment of words (match +2, mismatch -1, gap -1) over the item's best possible score then finds
exact, edited and reordered-in-part copies; a document leaks an item at ``threshold`` or more.

Seeds of an item of ``long_item`` words or more are its n-grams; edited copies that keep none are lost
(README has the recall). Seeds of a shorter one are its rarest words, as many that whatever reaches the
threshold holds one of them, so nothing is lost. An item of fewer than ``n`` words leaks only where it
stands as a whole.

A stretch has at most ``span`` words (four times the longest item there, if that is more) and overlaps
the next by more than an alignment can cover, so memory doesn't follow the length of texts. Equal
stretches are aligned once a batch. The index takes some 40 bytes a word of the items and is built for at
most ``max_seeds`` words at once; a larger benchmark takes one reading of the texts a part.

Defined cases: null and empty texts and items leak nothing. Repeated document rows give one result each
id and item; rows with a null id take no part. Repeated items are found under each of their ids, items of
one id as that id's best. Ties between passages go to the first. An empty table or an empty benchmark
gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.bytehash import mixed

WORD = re.compile(r"[^\W_]+")
MATCH, MISMATCH, GAP = 2, -1, -1
#: Cells of the padded texts that are aligned at once.
AREA = 1 << 19


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


class WordHashes(dict):
    """64-bit hashes of words, kept for the words that come again."""

    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return value


def hashed(words: list[str], hashes: WordHashes) -> np.ndarray:
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


def grams_of(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of hashed words."""
    if len(h) < n:
        return h[:0]
    grams = h[: len(h) - n + 1].copy()
    for j in range(1, n):
        grams = mixed(grams * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - n + 1 + j])
    return grams


def stretches(at: np.ndarray, longest: np.ndarray, n_words: int, n: int, span: int) -> list[tuple[int, int]]:
    """(from, to) of what lies around seeds at ``at`` of items of ``longest`` words, long stretches in overlapping parts.

    An alignment that reaches half of the best score covers at most twice the item's words.
    """
    lo, hi = np.maximum(at - 2 * longest, 0), np.minimum(at + n + 2 * longest, n_words)
    before = np.concatenate([[-1], np.maximum.accumulate(hi)[:-1]])
    reach = np.minimum.accumulate(lo[::-1])[::-1]
    begin = np.flatnonzero(reach > before)
    end = np.concatenate([begin[1:], [len(at)]])
    out = []
    for b, e in zip(begin.tolist(), end.tolist(), strict=True):
        first, last, most = int(reach[b]), int(hi[b:e].max()), int(longest[b:e].max())
        size, overlap = max(span, 4 * most + n), 2 * most + n
        while last - first > size:
            out.append((first, first + size))
            first += size - overlap
        out.append((first, last))
    return out


def align(item: np.ndarray, texts: list[np.ndarray]) -> list[tuple[int, int, int]]:
    """Best local score of the item in each text, with the first and last word it covers there."""
    width = max(map(len, texts))
    padded = np.full((len(texts), width), -1, np.int64)
    for i, t in enumerate(texts):
        padded[i, : len(t)] = t
    steps = np.arange(width + 1) * -GAP
    above = np.zeros((len(texts), width + 1), np.int64)
    came = np.tile(np.arange(width + 1), (len(texts), 1))
    best, first, last = (np.zeros(len(texts), np.int64) for _ in range(3))
    rows = np.arange(len(texts))
    for word in item:
        here, start = np.zeros_like(above), np.tile(np.arange(width + 1), (len(texts), 1))
        diagonal = above[:, :-1] + np.where(padded == word, MATCH, MISMATCH)
        down = above[:, 1:] + GAP
        here[:, 1:] = np.maximum(np.maximum(diagonal, down), 0)
        start[:, 1:] = np.where(here[:, 1:] == 0, start[:, 1:], np.where(diagonal >= down, came[:, :-1], came[:, 1:]))
        lifted = here + steps
        top = np.maximum.accumulate(lifted, axis=1)
        reached = np.maximum.accumulate(np.where(lifted == top, np.arange(width + 1), 0), axis=1)
        wide = top - steps
        start = np.where(wide > here, np.take_along_axis(start, reached, axis=1), start)
        above, came = np.maximum(here, wide), start
        at = above.argmax(axis=1)
        score = above[rows, at]
        better = score > best
        best, first, last = np.where(better, score, best), np.where(better, came[rows, at], first), np.where(better, at - 1, last)
    return list(zip(best.tolist(), first.tolist(), last.tolist(), strict=True))


def item_rows(benchmark: DataFrame, item_col: str, item_text: str) -> DataFrame:
    """item_id and words (hashes, in order) of every item with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            words = [hashed(words_of(t), hashes).view(np.int64).tolist() for t in b.column(1).to_pylist()]
            out = pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.list_(pa.int64()))], ["item_id", "words"])
            yield out.filter(pa.array([len(w) > 0 for w in words], pa.bool_()))

    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).filter("item_id is not null and text is not null").distinct()
    return items.mapInArrow(run, "item_id long, words array<long>")


def runs(sizes: np.ndarray) -> np.ndarray:
    """Offsets of runs of these sizes."""
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def spread_out(starts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places of the elements of the runs ``at``, one run after another."""
    sizes = starts[at + 1] - starts[at]
    return np.repeat(starts[at] - runs(sizes)[:-1], sizes) + np.arange(sizes.sum())


@dataclass(frozen=True)
class Postings:
    """Seeds of one size, sorted: the items of each, whether it is rare, and the longest of its items."""

    seeds: np.ndarray
    starts: np.ndarray
    items: np.ndarray
    rare: np.ndarray
    longest: np.ndarray


@dataclass(frozen=True)
class Index:
    """Distinct items: ids, words in order, distinct words with counts, words needed, and postings by seed size."""

    ids: list[list[int]]
    words: list[np.ndarray]
    kinds: np.ndarray
    counts: np.ndarray
    starts: np.ndarray
    needed: np.ndarray
    alone: np.ndarray
    postings: dict[int, Postings]


def seeds_of(words: np.ndarray, kinds: np.ndarray, counts: np.ndarray, held_by: np.ndarray, needed: float, n: int, long_item: int) -> tuple[int, np.ndarray]:
    """Size and hashes of the seeds of an item; ``kinds`` are its distinct words, ``counts`` theirs, ``held_by`` the items that hold each."""
    if len(words) < n:
        return len(words), grams_of(words, len(words))
    if len(words) >= long_item:
        return n, np.unique(grams_of(words, n))
    order = np.lexsort((kinds, held_by))
    spare = len(words) - int(np.ceil(needed))
    return 1, np.sort(kinds[order][: int(np.searchsorted(np.cumsum(counts[order]), spare, side="right")) + 1])


def build_index(rows: list[tuple[int, list[int]]], n: int, threshold: float, rare: int, long_item: int) -> Index:
    by_words: dict[bytes, list[int]] = {}
    for item_id, words in rows:
        by_words.setdefault(np.array(words, np.int64).tobytes(), []).append(item_id)
    items = [np.frombuffer(w, np.uint64) for w in by_words]
    distinct = [np.unique(w, return_counts=True) for w in items]
    kinds, counts = (np.concatenate([d[k] for d in distinct]) for k in (0, 1))
    starts = runs(np.array([len(d[0]) for d in distinct]))
    every, where, held = np.unique(kinds, return_inverse=True, return_counts=True)
    needed = np.array([len(w) if len(w) < n else threshold * len(w) for w in items])
    found = [seeds_of(w, *distinct[i], held[where[starts[i] : starts[i + 1]]], needed[i], n, long_item) for i, w in enumerate(items)]
    postings, alone = {}, np.ones(len(items), bool)
    for size in sorted({s for s, _ in found}):
        own = [i for i, (s, _) in enumerate(found) if s == size]
        seeds, of = np.concatenate([found[i][1] for i in own]), np.repeat(own, [len(found[i][1]) for i in own])
        order = np.lexsort((of, seeds))
        known, first, number = np.unique(seeds[order], return_index=True, return_counts=True)
        lengths = np.array([len(w) for w in items])[of[order]]
        few = (number <= rare) | (size < n)
        postings[size] = Postings(known, runs(number), of[order], few, np.maximum.reduceat(lengths, first))
        alone[of[order][np.repeat(few, number)]] = False
    return Index(list(by_words.values()), items, kinds, counts, starts, needed, alone, postings)


def met(index: Index, words: np.ndarray, n: int, span: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(from, to, items) of the stretches of a text that go on to alignment."""
    at, size, seed = [], [], []
    for k, p in index.postings.items():
        grams = grams_of(words, k)
        if len(grams):
            place = np.minimum(np.searchsorted(p.seeds, grams), len(p.seeds) - 1)
            hit = np.flatnonzero(p.seeds[place] == grams)
            at.append(hit)
            size.append(np.full(len(hit), k))
            seed.append(place[hit])
    at, size, seed = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (at, size, seed))
    if not len(at):
        return
    order = np.argsort(at, kind="stable")
    at, size, seed = at[order], size[order], seed[order]
    longest = np.zeros(len(at), np.int64)
    for k, p in index.postings.items():
        longest[size == k] = p.longest[seed[size == k]]
    for lo, hi in stretches(at, longest, len(words), n, span):
        inside = np.arange(np.searchsorted(at, lo), np.searchsorted(at, hi))
        inside = inside[at[inside] + size[inside] <= hi]
        items, weight = [], []
        for k, p in index.postings.items():
            own = np.unique(seed[inside[size[inside] == k]])
            if len(own):
                items.append(p.items[spread_out(p.starts, own)])
                weight.append(np.repeat(np.where(p.rare[own], 2, 1), p.starts[own + 1] - p.starts[own]))
        if not items:
            continue
        some, inverse = np.unique(np.concatenate(items), return_inverse=True)
        some = some[(np.bincount(inverse, np.concatenate(weight)) >= 2) | index.alone[some]]
        if not len(some):
            continue
        here, count = np.unique(words[lo:hi], return_counts=True)
        own = spread_out(index.starts, some)
        place = np.minimum(np.searchsorted(here, index.kinds[own]), len(here) - 1)
        shared = np.where(here[place] == index.kinds[own], np.minimum(count[place], index.counts[own]), 0)
        ends = runs(index.starts[some + 1] - index.starts[some])
        some = some[np.add.reduceat(shared, ends[:-1]) >= index.needed[some]]
        if len(some):
            yield lo, hi, some


def aligned(index: Index, pairs: dict[int, dict[bytes, list[tuple[int, int]]]], n: int, threshold: float) -> list[tuple]:
    """(id, item_id, score, first_word, last_word) of pairs, by item and stretch, that reach the threshold."""
    out = []
    for i, stretches_of in pairs.items():
        kinds, item = np.unique(index.words[i], return_inverse=True)
        least = 1.0 if len(item) < n else threshold
        codes = {}
        for raw in stretches_of:
            h = np.frombuffer(raw, np.uint64)
            place = np.minimum(np.searchsorted(kinds, h), len(kinds) - 1)
            codes[raw] = np.where(kinds[place] == h, place, -2)
        order = sorted(codes, key=lambda raw: len(codes[raw]))
        while order:
            part = [order.pop()]
            while order and (len(part) + 1) * len(codes[part[0]]) <= AREA:
                part.append(order.pop())
            for raw, (best, first, last) in zip(part, align(item, [codes[raw] for raw in part]), strict=True):
                if best > 0 and best >= least * MATCH * len(item):
                    out += [(doc, item_id, best / (MATCH * len(item)), at + first, at + last) for doc, at in stretches_of[raw] for item_id in index.ids[i]]
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, n: int = 3, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rare: int = 64, long_item: int = 12, max_seeds: int = 4_000_000, span: int = 2048) -> DataFrame:
    """doc_id, item_id, score, first_word, last_word: each document's best passage for every item that it leaks (``threshold`` 0.5 or more)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null and text is not null")
    items = item_rows(benchmark, item_col, item_text)
    parts, found = max(1, -(-(items.agg(F.sum(F.size("words"))).collect()[0][0] or 0) // max_seeds)), None
    for p in range(parts):
        own = items.filter(F.pmod(F.xxhash64("words"), F.lit(parts)) == p).orderBy("words", "item_id").collect()
        if own:
            some = leaked_in(rows, spark.sparkContext.broadcast(build_index([tuple(r) for r in own], n, threshold, rare, long_item)), n, threshold, span)
            found = some if found is None else found.unionByName(some)
    if found is None:
        found = spark.createDataFrame([], LEAK)
    best = found.groupBy("id", "item_id").agg(F.max_by(F.struct("score", "first_word", "last_word"), F.struct("score", -F.col("first_word"))).alias("b"))
    return best.select(F.col("id").alias(id_col), F.col("item_id").alias(item_col), "b.score", "b.first_word", "b.last_word")


LEAK = "id long, item_id long, score double, first_word long, last_word long"


def leaked_in(rows: DataFrame, held: Broadcast, n: int, threshold: float, span: int) -> DataFrame:
    """What one part of the items finds; ``held`` is its broadcast index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, hashes = held.value, WordHashes()
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
        names = ["id", "item_id", "score", "first_word", "last_word"]
        for b in batches:
            pairs, size = {}, 0
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = hashed(words_of(text.as_py()), hashes)
                for lo, hi, some in met(index, words, n, span):
                    raw = words[lo:hi].tobytes()
                    for i in some.tolist():
                        pairs.setdefault(i, {}).setdefault(raw, []).append((doc, lo))
                    size += hi - lo
                    if size > 500_000:
                        out, pairs, size = aligned(index, pairs, n, threshold), {}, 0
                        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)], names)
            out = aligned(index, pairs, n, threshold)
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)], names)

    return rows.mapInArrow(run, LEAK)
