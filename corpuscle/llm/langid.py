"""Language ID: a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on a bounded sample of labelled text. The
labelled unit is a stretch of ``LENGTH`` bytes: of all stretches of all rows with a language, each
language gives about ``max_stretches`` over the number of languages (all it has, if fewer), drawn evenly
over rows and places, so that every part of every labelled text may count. Only the drawn ones reach the
driver. More languages than ``max_languages`` are an error. A whole text is read in stretches by both
directions; every position gets language probabilities, and a document's are their mean over the
positions of letters. Long texts go through in bounded parts.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, as is everything where no
language was learnt. One learnt language is predicted with score 1. Null languages are not learnt from; equal
stretches of a language are learnt once. Ties go to the language that sorts first. Repeated rows and null
ids are predicted as they are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LENGTH = 64
#: Bytes as the network reads them: A-Z as a-z.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


@dataclass(frozen=True)
class Network:
    """``inputs``: a row of gate inputs (update, reset, candidate) for each byte and direction."""

    languages: tuple[str, ...]
    inputs: tuple[np.ndarray, np.ndarray]
    gates: tuple[np.ndarray, np.ndarray]
    out: tuple[np.ndarray, np.ndarray]
    bias: np.ndarray

    def states(self, data: np.ndarray, way: int) -> np.ndarray:
        """Hidden states after each byte of (length, rows) codes, as (length, hidden, rows).

        Both logistic and tanh are written with ``exp`` of negated, doubled sums.
        """
        table, u = -2 * self.inputs[way].T, -2 * self.gates[way].T
        length, rows = data.shape
        hidden = len(u) // 3
        states = np.zeros((length + 1, hidden, rows), np.float32)
        x, g = np.empty((3 * hidden, rows), np.float32), np.empty((3 * hidden, rows), np.float32)
        last = length
        for t in range(length) if way == 0 else range(length - 1, -1, -1):
            h, new = states[last], states[t]
            np.take(table, data[t], axis=1, out=x, mode="clip")
            np.matmul(u, h, out=g)
            zr, n, part = x[: 2 * hidden], x[2 * hidden :], g[2 * hidden :]
            zr += g[: 2 * hidden]
            logistic(zr)
            part *= zr[hidden:]
            n += part
            logistic(n)
            n *= 2
            n -= 1
            np.subtract(h, n, out=new)
            new *= zr[:hidden]
            new += n
            last = t
        return states[:length]

    def probabilities(self, data: np.ndarray) -> np.ndarray:
        """Language probabilities at each position of (rows, length) stretches, as (length, languages, rows)."""
        codes = np.ascontiguousarray(data.T).astype(np.intp)
        with np.errstate(over="ignore"):
            probs = np.matmul(self.out[0].T, self.states(codes, 0))
            probs += np.matmul(self.out[1].T, self.states(codes, 1))
        probs += self.bias[:, None]
        probs -= probs.max(axis=1, keepdims=True)
        np.exp(probs, out=probs)
        probs /= probs.sum(axis=1, keepdims=True)
        return probs


def logistic(negated: np.ndarray) -> None:
    """In place: ``1 / (1 + exp(negated))``."""
    np.exp(negated, out=negated)
    negated += 1
    np.reciprocal(negated, out=negated)


def stretches(texts: list[bytes], at_once: int = 65_536) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All texts cut into rows of ``LENGTH`` bytes (padded with zero) and the text of each row, ``at_once`` bytes of a text at most."""
    rows, of, held = [], [], 0
    for i, text in enumerate(texts):
        for lo in range(0, len(text), at_once):
            part = text[lo : lo + at_once]
            n = -(-len(part) // LENGTH)
            rows.append(part.ljust(n * LENGTH, b"\0"))
            of.append((i, n))
            held += n * LENGTH
            if held >= at_once:
                yield _laid(rows, of)
                rows, of, held = [], [], 0
    if rows:
        yield _laid(rows, of)


def _laid(rows: list[bytes], of: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(rows), np.uint8).reshape(-1, LENGTH), np.repeat([i for i, _ in of], [n for _, n in of])


def pooled(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean probabilities over the letters of each text."""
    total, letters = np.zeros((len(texts), len(net.languages))), np.zeros(len(texts))
    for data, of in stretches(texts):
        mask = LETTER[data.T].astype(np.float32)
        sums = (net.probabilities(FOLD[data]) * mask[:, None]).sum(axis=0).T
        np.add.at(total, of, sums)
        np.add.at(letters, of, mask.sum(axis=0))
    return total / np.maximum(letters, 1)[:, None]


class Trainer:
    """Backpropagation through time with Adam; gates keep inputs doubled so that tanh serves as the logistic."""

    def __init__(self, languages: int, hidden: int, seed: int) -> None:
        self.rng = np.random.default_rng(seed)
        self.hidden = hidden
        draw = lambda *shape, s: self.rng.normal(0, s, shape).astype(np.float32)
        self.p = {}
        for way in (0, 1):
            self.p |= {f"x{way}": draw(256, 3 * hidden, s=0.3), f"u{way}": draw(hidden, 3 * hidden, s=0.8 / hidden**0.5), f"v{way}": draw(hidden, languages, s=0.3)}
        self.p["b"] = np.zeros(languages, np.float32)
        self.m = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.s = {k: np.zeros_like(v) for k, v in self.p.items()}

    def forward(self, data: np.ndarray, way: int) -> list[tuple]:
        h, tape, n_h = np.zeros((len(data), self.hidden), np.float32), [], self.hidden
        for t in range(data.shape[1]) if way == 0 else range(data.shape[1] - 1, -1, -1):
            x, g = self.p[f"x{way}"][data[:, t]], h @ self.p[f"u{way}"]
            zr = 0.5 * np.tanh(x[:, : 2 * n_h] + g[:, : 2 * n_h]) + 0.5
            n = np.tanh(x[:, 2 * n_h :] + zr[:, n_h:] * g[:, 2 * n_h :])
            new = n + zr[:, :n_h] * (h - n)
            tape.append((t, h, zr, g[:, 2 * n_h :], n, new))
            h = new
        return tape

    def step(self, data: np.ndarray, label: np.ndarray, mask: np.ndarray, i: int, rate: float) -> None:
        rows, length = data.shape
        n_h, tapes = self.hidden, [self.forward(data, 0), self.forward(data, 1)]
        logits = np.tile(self.p["b"], (length, rows, 1))
        for way, tape in enumerate(tapes):
            for t, *_, new in tape:
                logits[t] += new @ self.p[f"v{way}"]
        e = np.exp(logits - logits.max(axis=-1, keepdims=True))
        d = e / e.sum(axis=-1, keepdims=True)
        d[:, np.arange(rows), label] -= 1
        d *= (mask.T / max(mask.sum(), 1))[:, :, None]
        grad = {"b": d.sum(axis=(0, 1))}
        for way, tape in enumerate(tapes):
            u, v = self.p[f"u{way}"], self.p[f"v{way}"]
            gx, gu, gv = np.zeros_like(self.p[f"x{way}"]), np.zeros_like(u), np.zeros_like(v)
            dh, index, steps = np.zeros((rows, n_h), np.float32), [], []
            for t, h, zr, gn, n, new in reversed(tape):
                gv += new.T @ d[t]
                dh = dh + d[t] @ v.T
                z, r = zr[:, :n_h], zr[:, n_h:]
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (h - n) * 2 * z * (1 - z)
                dr = dn * gn * 2 * r * (1 - r)
                into = np.hstack([dz, dr, dn * r])
                gu += h.T @ into
                index.append(data[:, t])
                steps.append(np.hstack([dz, dr, dn]))
                dh = dh * z + into @ u.T
            np.add.at(gx, np.concatenate(index), np.concatenate(steps))
            grad |= {f"x{way}": gx, f"u{way}": gu, f"v{way}": gv}
        size = np.sqrt(sum(float((g**2).sum()) for g in grad.values()))
        for k, g in grad.items():
            g = g * min(1.0, 1.0 / (size + 1e-8))
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.s[k] = 0.99 * self.s[k] + 0.01 * g * g
            self.p[k] -= rate * (self.m[k] / (1 - 0.9**i)) / (np.sqrt(self.s[k] / (1 - 0.99**i)) + 1e-6)


def train(data: np.ndarray, langs: list[str], hidden: int = 8, steps: int = 160, rows: int = 256, seed: int = 5) -> Network:
    """A network from labelled stretches; every language is drawn equally often."""
    names = tuple(sorted(set(langs)))
    trainer = Trainer(max(len(names), 1), hidden, seed)
    rng, label = np.random.default_rng(seed), np.array([names.index(x) for x in langs], np.int64)
    if len(names) > 1:
        pools = [np.flatnonzero(label == k) for k in range(len(names))]
        for i in range(1, steps + 1):
            at = np.concatenate([rng.choice(p, max(1, rows // len(pools))) for p in pools])
            trainer.step(FOLD[data[at]], label[at], LETTER[data[at]].astype(np.float32), i, 0.03 * (1 - i / (steps + 1)) + 0.001)
    p = trainer.p
    return Network(names, (p["x0"], p["x1"]), (p["u0"], p["u1"]), (p["v0"], p["v1"]), p["b"])


def drawn_stretches(text: bytes, pieces: int) -> list[bytes]:
    """``pieces`` of the text's stretches (all, if fewer), drawn by a generator that the text seeds."""
    n = -(-len(text) // LENGTH)
    at = np.random.default_rng(zlib.crc32(text)).permutation(n)[:pieces]
    return [text[i * LENGTH : (i + 1) * LENGTH].ljust(LENGTH, b"\0") for i in at.tolist()]


def labelled_sample(docs: DataFrame, train_on: Column, max_stretches: int, max_languages: int, id_col: str, text_col: str, lang_col: str) -> tuple[np.ndarray, list[str]]:
    """Stretches and their languages; a row gives its share of the drawn ones, rounded up or down by a hash of its id, and each language one at least."""
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & train_on)
    text = F.col(text_col).cast("string")
    u = F.pmod(F.xxhash64(F.lit("lang"), F.col(id_col)), F.lit(1 << 30)) / float(1 << 30)
    known = known.select(F.col(lang_col).cast("string").alias("lang"), text.alias("text"), F.ceil(F.octet_length(text) / LENGTH).alias("n"), u.alias("u"))
    totals = known.groupBy("lang").agg(F.sum("n").alias("n"), F.max(F.when(F.col("n") > 0, F.col("u"))).alias("u")).filter("n > 0").orderBy("lang").limit(max_languages + 1).collect()
    if len(totals) > max_languages:
        raise ValueError(f"more than {max_languages} languages: raise max_languages")
    if not totals:
        return np.zeros((0, LENGTH), np.uint8), []
    rate = F.create_map(*[F.lit(x) for r in totals for x in (r["lang"], min(1.0, max_stretches / len(totals) / r["n"]))])
    top = F.create_map(*[F.lit(x) for r in totals for x in (r["lang"], r["u"])])
    draws = F.greatest(F.floor(F.element_at(rate, F.col("lang")) * F.col("n") + F.col("u")), F.when(F.col("u") == F.element_at(top, F.col("lang")), 1).otherwise(0))
    drawn = known.filter("n > 0").withColumn("draws", draws).filter("draws > 0").select("lang", "text", "draws")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(lang, piece) for lang, text, n in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True) for piece in drawn_stretches(text.as_py().encode("utf-8", "surrogatepass"), n)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.binary())], ["lang", "piece"])

    rows = drawn.mapInArrow(cut, "lang string, piece binary").distinct().orderBy("lang", "piece").collect()
    return np.frombuffer(b"".join(bytes(r["piece"]) for r in rows), np.uint8).reshape(-1, LENGTH), [r["lang"] for r in rows]


def predict_language(docs: DataFrame, train_on: Column, max_stretches: int = 20_000, max_languages: int = 200, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, lang_pred and score of every row."""
    net = train(*labelled_sample(docs, train_on, max_stretches, max_languages, id_col, text_col, lang_col))

    def label(texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        if not net.languages:
            return out
        at = [i for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)]
        probs = pooled(net, [texts[i].encode("utf-8", "surrogatepass") for i in at])
        for i, p in zip(at, probs, strict=True):
            out[i] = (net.languages[int(p.argmax())], float(min(p.max(), 1.0)))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, start, size, found = b.column(1).to_pylist(), 0, 0, []
            for i, t in enumerate(texts):
                size += len(t or "")
                if size > 1_000_000:
                    found += label(texts[start : i + 1])
                    start, size = i + 1, 0
            found += label(texts[start:])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, lang_pred string, score double").withColumnRenamed("id", id_col)
