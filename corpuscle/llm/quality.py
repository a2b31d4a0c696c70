"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text is reduced to a fixed set of transformed statistics. Class means and covariances come from
sums over labelled rows (one row of moments a class and task): all of them, or in hash order of their ids
a share that leaves about ``max_labels``; every covariance is shrunk to the pooled one (``to_pooled``,
0.3: the classes share most of their shape) and to its diagonal (``to_diagonal``, 0.05: enough to keep
statistics that never vary invertible), and its Cholesky factor is inverted once.
The score is the logistic of the difference of log densities, i.e. of Mahalanobis distances and log
determinants, tempered by ``bytes / (bytes + SHORT)`` since ratios of short texts say little (at SHORT
bytes, about a line, they count half), plus the log odds of the classes. Texts are scored where they are
read: nothing but the labelled rows' statistics is moved.

Defined cases: null and empty texts have the statistics of an empty text and get a score. A null id is
scored and never learnt from. Several labels of one document count as their largest; null labels are
left out. Without two labelled rows of each class the score is the share of label 1 (1 if none).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.session import stash

#: Bytes by kind: letters (all non-ASCII bytes count), capitals, digits, blanks, line ends, sentence marks, other marks.
KINDS = np.zeros((256, 7), np.float64)
for _byte in range(256):
    _char = chr(_byte)
    KINDS[_byte, 0] = _byte >= 128 or _char.isalpha()
    KINDS[_byte, 1] = _byte < 128 and _char.isupper()
    KINDS[_byte, 2] = _byte < 128 and _char.isdigit()
    KINDS[_byte, 3] = _char in " \t"
    KINDS[_byte, 4] = _char in "\r\n"
    KINDS[_byte, 5] = _char in ".,;:!?'\"-()"
    KINDS[_byte, 6] = 32 < _byte < 127 and not _char.isalnum() and _char not in ".,;:!?'\"-()"
ODD_END = re.compile(r"[^\w\s.,;:!?'\"()\-]+(?=\s|$)")
SHORT = 100
STATISTICS = ["log_bytes", "letters", "capitals", "digits", "lines", "marks", "symbols", "word_length", "distinct_words", "top_word", "odd_ends", "distinct_lines", "word_spread"]


def statistics(text: str | None) -> np.ndarray:
    """Transformed statistics of one text: logs of lengths and of smoothed ratios."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    kinds = np.bincount(data, minlength=256) @ KINDS
    n = len(data)
    words = (text or "").split()
    counts = Counter(words)
    m = len(words)
    sizes = np.fromiter(map(len, counts), np.float64, len(counts))
    lines = [x for x in (text or "").split("\n") if x.strip()]
    share = lambda part, whole, s: np.log((part + s) / (whole + 2 * s))
    return np.array([
        np.log1p(n),
        share(n - kinds[3] - kinds[4] - kinds[0], n, 1.0),
        share(kinds[1], n, 1.0),
        share(kinds[2], n, 1.0),
        share(kinds[4], n, 1.0),
        share(kinds[5], n, 1.0),
        share(kinds[6], n, 1.0),
        np.log1p((n - kinds[3] - kinds[4]) / max(m, 1)),
        np.log((len(counts) + 1.0) / (m + 1.0) ** 0.8),
        share(max(counts.values(), default=0), m, 1.0),
        share(len(ODD_END.findall(text or "")), m, 1.0),
        share(len(set(lines)), len(lines), 0.5),
        np.log1p(sizes.std() if len(sizes) else 0.0),
    ])


@dataclass(frozen=True)
class Discriminant:
    """Means, inverted Cholesky factors, log determinants and log odds of the classes; without factors, a constant score."""

    means: tuple[np.ndarray, ...]
    factors: tuple[np.ndarray, ...]
    determinants: float
    odds: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.factors:
            return np.full(len(x), self.odds)
        far = [(((x - m) @ f.T) ** 2).sum(axis=1) for m, f in zip(self.means, self.factors, strict=True)]
        size = np.expm1(x[:, 0])
        log_odds = self.odds + size / (size + SHORT) * (self.determinants + (far[0] - far[1]) / 2)
        return 1 / (1 + np.exp(-np.clip(log_odds, -700, 700)))


def fit(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], to_pooled: float, to_diagonal: float) -> Discriminant:
    """From (rows, sum of x, sum of x xT) of classes 0 and 1."""
    if any(moments.get(c, (0,))[0] < 2 for c in (0, 1)):
        n = sum(m[0] for m in moments.values())
        return Discriminant((), (), 0.0, moments[1][0] / n if 1 in moments else 0.0 if n else 1.0)
    rows = np.array([moments[c][0] for c in (0, 1)])
    means = [moments[c][1] / moments[c][0] for c in (0, 1)]
    covs = [moments[c][2] / moments[c][0] - np.outer(means[c], means[c]) for c in (0, 1)]
    pooled = (covs[0] * rows[0] + covs[1] * rows[1]) / rows.sum()
    factors, determinants = [], 0.0
    for c, sign in ((0, 1), (1, -1)):
        s = (1 - to_pooled) * covs[c] + to_pooled * pooled
        s = (1 - to_diagonal) * s + to_diagonal * np.diag(np.diag(s)) + 1e-4 * np.eye(len(s))
        low = np.linalg.cholesky(s)
        factors.append(np.linalg.inv(low))
        determinants += sign * float(np.log(np.diag(low)).sum())
    return Discriminant(tuple(means), tuple(factors), determinants, float(np.log(rows[1] / rows[0])))


def moments(labelled: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Sums of each class over the statistics of (label, text); one row a class and task is shuffled, two reach the driver."""
    d = len(STATISTICS)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for c, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = np.concatenate([[1.0], statistics(text.as_py())])
                held[c] = held.get(c, 0) + np.outer(x, x)
        for c, m in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([c] * m.size, pa.int32()), pa.array(range(m.size), pa.int32()), pa.array(m.reshape(-1))], ["label", "cell", "v"])

    sums = labelled.mapInArrow(partial, "label int, cell int, v double").groupBy("label", "cell").agg(F.sum("v").alias("v")).collect()
    out = {}
    for c in {r["label"] for r in sums}:
        m = np.zeros((d + 1) ** 2)
        for r in sums:
            if r["label"] == c:
                m[r["cell"]] = r["v"]
        m = m.reshape(d + 1, d + 1)
        out[c] = (m[0, 0], m[0, 1:], m[1:, 1:])
    return out


def learnt(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", to_pooled: float = 0.3, to_diagonal: float = 0.05, max_labels: int = 200_000) -> Discriminant:
    """The discriminant of the labelled rows for which ``train`` (on the labels' id) holds."""
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & train).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    known = stash(known, "labels")
    parts = max(1, -(-known.count() // max_labels))
    chosen = known.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == 0)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return fit(moments(texts.join(F.broadcast(chosen), "id").select("label", "text")), to_pooled, to_diagonal)


def quality_of(model: Discriminant, text: Column) -> Column:
    """The score of a text, 0 to 1."""

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(np.array([statistics(t.as_py()) for t in texts])) if len(texts) else [], pa.float64())

    return scored(text.cast("string"))


def score_quality(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", **fitting) -> DataFrame:
    """id and score (0 to 1) of every row; ``train`` (on the labels' id) says which labelled rows are learnt from."""
    model = learnt(docs, labels, train, id_col, text_col, **fitting)
    return docs.select(F.col(id_col).cast("long").alias(id_col), quality_of(model, F.col(text_col)).alias("score"))
