"""Dedup of byte strings repeated over ``WIDTH`` bytes: suffixes grouped to that depth.

Windows are suffixes cut at depth ``WIDTH``; equal groups are the repeated windows. A group is known by
its earliest suffix (smaller id, then smaller start), and every other member's bytes are removed.

Groups are not formed by radix passes over leading bytes: the first such pass shuffles a key and a
position for every byte of text, many times the input (README has the figures). Content-anchored hashes,
by which neighbouring suffixes travel together, refine the groups instead.

Passes. (1) Key: the anchor of a window, its 48-byte substring of smallest hash, leftmost among equals.
Equal windows have equal anchors, so neighbouring suffixes with one anchor travel as one stretch: the
anchor's hash, a hash of the whole stretch and its position. (2) Key: the stretch. Equal stretches are
runs of equal windows; the earliest represents them, the others are done. (3) Of the representatives,
those alone with their anchor have no equal suffix and are done. (4) Key: the window. Only suffixes in
stretches that share an anchor are taken singly.

Keys are 64-bit hashes, two of them in each group key. Each pass is an aggregation to the smallest
position, combined before the shuffle, so a passage that every document has is one row a task. What
comes back to a document are the positions that stayed first; all others of its windows are covered.
Texts are gone through in pieces of ``PIECE`` bytes that overlap by ``WIDTH - 1``, so what a task holds
beside a text doesn't grow with it, except a byte of mask for each of its bytes.

Defined cases: null and empty texts have no bytes and no spans; texts shorter than ``WIDTH`` keep all.
Rows with a null id take no part and come back whole. Rows that share an id and text are one document
and get one result each; they do not cover each other. Otherwise ids are taken to be unique. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.bytehash import BASES, Ranges, batches
from corpuscle.session import discard, release, stash, stash_by_key, stash_path

WIDTH, ANCHOR = 100, 48
PIECE = 1_000_000


def least_ahead(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


class Stretches:
    """Runs of neighbouring windows with one anchor in a buffer of texts: text, first and last start (in the text), hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.offsets, self.hashes = offsets, Ranges(data, BASES[0])
        starts = [np.arange(s, e - WIDTH + 1) for s, e in zip(offsets[:-1], offsets[1:], strict=True) if e - s >= WIDTH]
        at = np.concatenate(starts) if starts else np.empty(0, np.int64)
        if not len(at):
            self.text = self.first = self.last = at
            self.anchor = self.whole = np.empty(0, np.uint64)
            return
        grams = self.hashes.sliding(ANCHOR)
        key = grams & np.uint64(0xFFFFFFFF00000000) | np.arange(len(grams), dtype=np.uint64)
        place = (least_ahead(key, WIDTH - ANCHOR + 1)[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        begin = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)]))
        lo, hi = at[begin], at[np.concatenate([begin[1:], [len(at)]]) - 1]
        self.anchor, self.whole = grams[place[begin]], Ranges(data, BASES[1]).of(lo, hi + WIDTH)
        self.text = np.searchsorted(offsets, lo, side="right") - 1
        self.first, self.last = lo - offsets[self.text], hi - offsets[self.text]

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Stretch number and start (in the text) of every window of the chosen stretches."""
        sizes = (self.last - self.first + 1)[chosen]
        of = np.repeat(chosen, sizes)
        step = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return of, self.first[of] + step


def _packed(text: np.ndarray, start: np.ndarray) -> np.ndarray:
    return text.astype(np.int64) << 32 | start


def _listed(lists: list) -> np.ndarray:
    """Packed (text, start) of each text's list."""
    own = [np.asarray(x if x is not None else (), np.int64) for x in lists]
    return _packed(np.repeat(np.arange(len(own)), [len(x) for x in own]), np.concatenate(own)) if own else np.empty(0, np.int64)


def _texts(column: pa.Array) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in column.to_pylist()]


def _slices(record_batches: Iterator[pa.RecordBatch], rows: int = 1000, size: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of at most ``rows`` rows and, unless it is one row, ``size`` bytes of text."""
    for b in record_batches:
        lengths = pc.fill_null(pc.binary_length(b.column(1)), 0).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(lengths):
            if i > start and (i - start == rows or held + n > size):
                yield b.slice(start, i - start)
                start, held = i, 0
            held += n
        if len(lengths) > start:
            yield b.slice(start)


def _pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, Stretches]]:
    """For runs of pieces: the text of each, its start there, offsets in the buffer, and their stretches (of the pieces)."""
    of, base, cut = [], [], []
    for i, t in enumerate(texts):
        for lo in range(0, max(len(t) - WIDTH + 1, 1), PIECE - WIDTH + 1):
            of.append(i)
            base.append(lo)
            cut.append(t[lo : lo + PIECE] if len(t) > PIECE else t)
    of_, base_ = np.array(of, np.int64), np.array(base, np.int64)
    for start, data, offsets in batches(cut):
        end = start + len(offsets) - 1
        yield of_[start:end], base_[start:end], offsets, Stretches(data, offsets)


def stretch_rows(docs: DataFrame, low: int, bits: int) -> DataFrame:
    """(anchor, whole, pos) of every stretch."""

    def run(record_batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(record_batches):
            ids = np.array(b.column(0).to_pylist(), np.int64)
            for of, base, _, s in _pieces(_texts(b.column(1))):
                pos = (ids[of[s.text]] - low) << bits | base[s.text] + s.first
                yield pa.RecordBatch.from_arrays([pa.array(s.anchor.view(np.int64)), pa.array(s.whole.view(np.int64)), pa.array(pos)], ["anchor", "whole", "pos"])

    return docs.mapInArrow(run, "anchor long, whole long, pos long")


def window_rows(listed: DataFrame, low: int, bits: int) -> DataFrame:
    """(anchor, rest, pos) of every window in the stretches named by ``shared``."""

    def run(record_batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(record_batches):
            ids, shared = np.array(b.column(0).to_pylist(), np.int64), _listed(b.column(2).to_pylist())
            for of, base, offsets, s in _pieces(_texts(b.column(1))):
                chosen = np.flatnonzero(np.isin(_packed(of[s.text], base[s.text] + s.first), shared))
                stretch, at = s.windows(chosen)
                begin = offsets[s.text[stretch]] + at
                rest = s.hashes.of(begin, begin + WIDTH)
                pos = (ids[of[s.text[stretch]]] - low) << bits | base[s.text[stretch]] + at
                yield pa.RecordBatch.from_arrays([pa.array(s.anchor[stretch].view(np.int64)), pa.array(rest.view(np.int64)), pa.array(pos)], ["anchor", "rest", "pos"])

    return listed.mapInArrow(run, "anchor long, rest long, pos long")


def cut_rows(listed: DataFrame) -> DataFrame:
    """id, n_bytes, spans and kept bytes, from the positions that stayed first."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(record_batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(record_batches):
            first, shared, alone = (_listed(b.column(i).to_pylist()) for i in (2, 3, 4))
            texts, known = _texts(b.column(1)), np.array([i is not None for i in b.column(0).to_pylist()], bool)
            gone = [np.zeros(len(t), bool) for t in texts]
            for of, base, offsets, s in _pieces(texts):
                text, place = of[s.text], _packed(of[s.text], base[s.text] + s.first)
                own = known[text]
                later = own & ~np.isin(place, first)
                stretch, at = s.windows(np.flatnonzero(own & ~later & np.isin(place, shared)))
                again = ~np.isin(_packed(text[stretch], base[s.text[stretch]] + at), alone)
                edge = np.zeros(int(offsets[-1]) + 1, np.int32)
                np.add.at(edge, offsets[s.text[later]] + s.first[later], 1)
                np.add.at(edge, offsets[s.text[later]] + s.last[later] + WIDTH, -1)
                begin = offsets[s.text[stretch[again]]] + at[again]
                np.add.at(edge, begin, 1)
                np.add.at(edge, begin + WIDTH, -1)
                covered = np.cumsum(edge[:-1]) > 0
                for k, (lo, hi) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                    gone[of[k]][base[k] : base[k] + hi - lo] |= covered[lo:hi]
            sizes, spans, kept = [], [], []
            for t, mask in zip(texts, gone, strict=True):
                turns = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]]).astype(np.int8)))
                sizes.append(len(t))
                spans.append([{"start": int(x), "end": int(y)} for x, y in zip(turns[::2], turns[1::2], strict=True)])
                kept.append(np.frombuffer(t, np.uint8)[~mask].tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], ["id", "n_bytes", "spans", "kept"])

    return listed.mapInArrow(run, "id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def _starts(rows: DataFrame, low: int, bits: int, name: str) -> DataFrame:
    """Positions as sorted starts by id."""
    start: Column = F.col("pos").bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
    return rows.groupBy((F.shiftright("pos", bits) + F.lit(low)).alias("id")).agg(F.collect_list(start).alias(name))


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, spans (removed byte ranges), kept (remaining bytes) for every row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    reach = rows.agg(F.min("id").alias("low"), F.max("id").alias("high"), F.max(F.octet_length("text")).alias("longest")).first()
    low, bits = reach["low"] or 0, max(1, (reach["longest"] or 0).bit_length())
    if ((reach["high"] or 0) - low).bit_length() + bits > 63:
        return _renumbered(rows, id_col)
    paths = [stash_path(spark, "suffix") for _ in range(3)]
    named = rows.filter("id is not null")
    heads = stretch_rows(named, low, bits).groupBy("anchor", "whole").agg(F.min("pos").alias("pos")).select("anchor", "pos")
    heads = stash(heads, "stretches", paths[0])
    release(spark)
    meeting = heads.groupBy("anchor").agg(F.count("*").alias("k")).filter("k > 1").select("anchor")
    shared = stash(heads.join(meeting, "anchor", "left_semi").select("pos"), "shared", paths[1])
    release(spark)
    lists = _starts(heads, low, bits, "first").join(_starts(shared, low, bits, "shared"), "id", "left")
    lists = stash(lists, "first", paths[2])
    discard(spark, paths[0])
    release(spark)
    listed = stash_by_key(rows.join(lists, "id", "left"), "listed", "id")
    discard(spark, paths[1])
    discard(spark, paths[2])
    release(spark)
    alone = window_rows(listed.filter("shared is not null").select("id", "text", "shared"), low, bits)
    alone = stash(_starts(alone.groupBy("anchor", "rest").agg(F.min("pos").alias("pos")), low, bits, "alone"), "windows")
    release(spark)
    return cut_rows(listed.join(alone, "id", "left").select("id", "text", "first", "shared", "alone")).withColumnRenamed("id", id_col)


def _renumbered(rows: DataFrame, id_col: str) -> DataFrame:
    """The same over dense numbers in id order, for ids too far apart to be packed with a start."""
    known = rows.filter("id is not null").select("id").distinct().orderBy("id")
    dense = known.rdd.zipWithIndex().map(lambda p: (p[0][0], p[1])).toDF("id long, number long")
    dense = stash(dense, "numbers")
    met = rows.join(dense, "id", "left")
    out = cut_repeats(met.select("number", "text"), "number")
    back = out.join(dense, "number", "left")
    return back.select(F.col("id").alias(id_col), "n_bytes", "spans", "kept")
