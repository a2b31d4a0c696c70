"""Personal data: base patterns, and a character-level bidirectional LSTM with a CRF for other spellings.

Base spans (email, ip, card, phone) are found by their patterns in linear time and always stay. The
network learns from labelled spans: base matches in a bounded sample of rows (at most ``max_rows`` rows,
``per_row`` spans each; only they and ``LEARNT`` characters beside them reach the driver), as they stand
and respelt ("anna (at) mail [dot] org", grouped cards, numbers without a plus), among plain text and
look-alikes (dates, amounts, versions, tokens) labelled as outside. It is trained in numpy: the CRF's
likelihood by forward and backward recursions, its gradient through both LSTMs by backpropagation
through time.

Whole texts are read in windows of ``WINDOW`` characters that overlap by ``OVERLAP``; each window is
decoded by Viterbi. The windows of a text are then reconciled together: spans of one kind that a window's
edge cuts are joined with those that meet them in the next window, equal spans count once, and of spans
that overlap the set of the highest total score is kept (weighted interval scheduling over the whole
text). A span is added if its digits pass the same check as the base's (parts to 255, Luhn, 8 to 15
digits; an email needs signs for "at" and "dot") and it touches no base span.

Every valid span holds a digit, ``@`` or a bracket, so a window with none of these is outside throughout
and isn't run through the network.

Defined cases: null and empty texts have no spans. Repeated rows and null ids are judged as they are.
Where the sample holds no base span nothing is learnt and only base spans come out. Long texts go through
the network in blocks of windows, so memory beyond the text itself is bounded. Offsets are code points,
end exclusive. Ties between sets of spans go to the earlier span. An empty table gives no rows. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
TRIGGER = re.compile(r"[0-9@()\[\]{}]")

WINDOW, OVERLAP, LEARNT = 256, 64, 72
STRIDE = WINDOW - OVERLAP
CODES = 64
Span = tuple[int, int, int]


def parts_fit(parts: list[str]) -> bool:
    return len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def card_fits(digits: str) -> bool:
    return 16 <= len(digits) <= 19 and luhn(digits)


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the email pattern from left to right: what stands before each ``@``, from the last match on, then the domain."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        done = found.end() if found else at + 1
        at = text.find("@", done)


def shapes(text: str) -> list[Span]:
    """(start, end, kind) of every match of a base pattern, whether or not its digits pass."""
    out = [(s, e, 0) for s, e in emails(text)]
    return out + [(*m.span(), k) for k, pattern in ((1, IP), (2, CARD), (3, PHONE)) for m in pattern.finditer(text)]


def fits(text: str, kind: int) -> bool:
    """Whether a match of a base pattern passes the check of its digits."""
    if kind == 1:
        return parts_fit(text.split("."))
    digits = digits_of(text) if kind else ""
    return kind == 0 or (card_fits(digits) if kind == 2 else 8 <= len(digits) <= 15)


def base_spans(text: str) -> list[Span]:
    """(start, end, kind), kind by kind and by start."""
    found = [s for s in shapes(text) if fits(text[s[0] : s[1]], s[2])]
    return sorted(found, key=lambda s: (s[2], s[0]))


def loosely_fits(text: str, kind: int) -> bool:
    """The same check for spellings that the patterns don't know."""
    digits = digits_of(text)
    if kind == 0:
        low = text.lower()
        return ("@" in low or re.search(r"[(\[{]\s?at\s?[)\]}]", low) is not None) and ("." in low or re.search(r"[(\[{]\s?dot\s?[)\]}]", low) is not None)
    if kind == 1:
        return parts_fit([p for p in re.split(r"[^0-9]+", text) if p])
    return card_fits(digits) if kind == 2 else 8 <= len(digits) <= 15


def table() -> np.ndarray:
    """Codes of characters below 256: letters folded, all digits one, other marks by themselves; beyond, one code for all."""
    out, n = np.zeros(257, np.uint8), 4
    for c in range(257):
        ch = chr(c)
        if c < 128 and ch.isalpha():
            out[c] = 5 + ord(ch.lower()) - 97
        elif ch.isdigit() and c < 128:
            out[c] = 1
        elif c >= 128:
            out[c] = 3 if c == 160 else 2
        elif ch.isspace():
            out[c] = 3
        elif c < 32 or c == 127:
            out[c] = 4
        else:
            out[c] = 31 + n - 4
            n += 1
    return out


CODE = table()


def codes_of(text: str) -> np.ndarray:
    return CODE[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 256)]


@dataclass(frozen=True)
class Tagger:
    """``inputs``: gate inputs (input, forget, output, candidate) of each code, a direction each; ``moves``: CRF scores from tag (row) to tag, tag 0 is outside."""

    inputs: tuple[np.ndarray, np.ndarray]
    gates: tuple[np.ndarray, np.ndarray]
    out: tuple[np.ndarray, np.ndarray]
    bias: np.ndarray
    moves: np.ndarray

    def states(self, codes: np.ndarray, way: int) -> np.ndarray:
        """Hidden states (length, hidden, rows) of codes (length, rows); sigmoid and tanh by exp of negated (doubled) sums."""
        length, rows = codes.shape
        h4 = self.gates[way].shape[1]
        n = h4 // 4
        sign = np.repeat(np.array([-1, -1, -1, -2], np.float32), n)[:, None]
        known, u = np.ascontiguousarray(self.inputs[way].T * sign), np.ascontiguousarray(self.gates[way].T * sign)
        states = np.zeros((length + 1, n, rows), np.float32)
        x, g, c, part = np.empty((h4, rows), np.float32), np.empty((h4, rows), np.float32), np.zeros((n, rows), np.float32), np.empty((n, rows), np.float32)
        last = length
        for t in range(length) if way == 0 else range(length - 1, -1, -1):
            np.take(known, codes[t], axis=1, out=x, mode="clip")
            np.matmul(u, states[last], out=g)
            x += g
            np.exp(x, out=x)
            x += 1
            np.reciprocal(x, out=x)
            c *= x[n : 2 * n]
            np.multiply(x[3 * n :], 2, out=part)
            part -= 1
            part *= x[:n]
            c += part
            np.tanh(c, out=part)
            np.multiply(part, x[2 * n : 3 * n], out=states[t])
            last = t
        return states[:length]

    def emissions(self, codes: np.ndarray) -> np.ndarray:
        """Tag scores (length, tags, rows) of windows (rows, length)."""
        steps = np.ascontiguousarray(codes.T).astype(np.intp)
        with np.errstate(over="ignore"):
            scores = np.matmul(self.out[0].T, self.states(steps, 0))
            scores += np.matmul(self.out[1].T, self.states(steps, 1))
        scores += self.bias[:, None]
        return scores

    def decode(self, scores: np.ndarray) -> np.ndarray:
        """The best path of tags (rows, length) under the CRF."""
        length, tags, rows = scores.shape
        best = scores[0].copy()
        back = np.zeros((length, tags, rows), np.int8)
        for t in range(1, length):
            top, came = best[0] + self.moves[0][:, None], np.zeros((tags, rows), np.int8)
            for k in range(1, tags):
                other = best[k] + self.moves[k][:, None]
                better = other > top
                np.copyto(top, other, where=better)
                np.copyto(came, np.int8(k), where=better)
            best, back[t] = top + scores[t], came
        path = np.zeros((length, rows), np.int8)
        path[-1] = best.argmax(axis=0)
        at = np.arange(rows)
        for t in range(length - 1, 0, -1):
            path[t - 1] = back[t, path[t], at]
        return path.T


def logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def crf_gradient(scores: np.ndarray, moves: np.ndarray, tags: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Negative log-likelihood of tags (rows, length) summed over rows, and its gradients by scores (length, rows, k) and moves."""
    length, rows, k = scores.shape
    alpha, beta = np.empty_like(scores), np.zeros_like(scores)
    alpha[0] = scores[0]
    for t in range(1, length):
        alpha[t] = logsumexp(alpha[t - 1][:, :, None] + moves, 1) + scores[t]
    for t in range(length - 2, -1, -1):
        beta[t] = logsumexp(moves + (scores[t + 1] + beta[t + 1])[:, None, :], 2)
    whole = logsumexp(alpha[-1], 1)
    d_scores = np.exp(alpha + beta - whole[:, None])
    pair = np.exp(alpha[:-1, :, :, None] + moves + (scores[1:] + beta[1:])[:, :, None, :] - whole[:, None, None])
    d_moves = pair.sum(axis=(0, 1))
    i, at, own = np.arange(rows), np.arange(length)[:, None], tags.T
    gold = scores[at, i, own].sum() + moves[own[:-1], own[1:]].sum()
    d_scores[at, i, own] -= 1
    np.subtract.at(d_moves, (own[:-1], own[1:]), 1)
    return float(whole.sum() - gold), d_scores, d_moves


class Trainer:
    """Adam over backpropagation through time."""

    def __init__(self, hidden: int, tags: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.hidden, self.p = hidden, {"b": np.zeros(tags, np.float32), "m": np.zeros((tags, tags), np.float32)}
        for way in (0, 1):
            self.p |= {f"x{way}": rng.normal(0, 0.4, (CODES, 4 * hidden)).astype(np.float32), f"u{way}": rng.normal(0, 0.8 / hidden**0.5, (hidden, 4 * hidden)).astype(np.float32), f"v{way}": rng.normal(0, 0.4, (hidden, tags)).astype(np.float32)}
            self.p[f"x{way}"][:, hidden : 2 * hidden] += 1
        self.first = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.second = {k: np.zeros_like(v) for k, v in self.p.items()}

    def forward(self, codes: np.ndarray, way: int) -> list[tuple]:
        n, tape = self.hidden, []
        h = c = np.zeros((len(codes), n), np.float32)
        for t in range(codes.shape[1]) if way == 0 else range(codes.shape[1] - 1, -1, -1):
            z = self.p[f"x{way}"][codes[:, t]] + h @ self.p[f"u{way}"]
            s = 1 / (1 + np.exp(-z[:, : 3 * n]))
            g = np.tanh(z[:, 3 * n :])
            new = s[:, n : 2 * n] * c + s[:, :n] * g
            th = np.tanh(new)
            tape.append((t, h, c, s, g, th))
            h, c = s[:, 2 * n :] * th, new
        return tape

    def gradient(self, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        n, (rows, length) = self.hidden, codes.shape
        tapes = [self.forward(codes, 0), self.forward(codes, 1)]
        scores = np.tile(self.p["b"], (length, rows, 1)).astype(np.float32)
        for way, tape in enumerate(tapes):
            for t, _, _, s, _, th in tape:
                scores[t] += (s[:, 2 * n :] * th) @ self.p[f"v{way}"]
        loss, d, d_moves = crf_gradient(scores, self.p["m"], tags)
        size = rows * length
        d, grad = (d / size).astype(np.float32), {"m": d_moves / size}
        grad["b"] = d.sum(axis=(0, 1))
        for way, tape in enumerate(tapes):
            u, v = self.p[f"u{way}"], self.p[f"v{way}"]
            gu, gv, index, steps = np.zeros_like(u), np.zeros_like(v), [], []
            dh, dc = np.zeros((rows, n), np.float32), np.zeros((rows, n), np.float32)
            for t, h, c, s, g, th in reversed(tape):
                gv += (s[:, 2 * n :] * th).T @ d[t]
                dh = dh + d[t] @ v.T
                dc = dc + dh * s[:, 2 * n :] * (1 - th * th)
                gate = np.hstack([dc * g, dc * c, dh * th]) * s * (1 - s)
                dz = np.hstack([gate, dc * s[:, :n] * (1 - g * g)])
                gu += h.T @ dz
                index.append(codes[:, t])
                steps.append(dz)
                dh, dc = dz @ u.T, dc * s[:, n : 2 * n]
            of_code = (np.concatenate(index) == np.arange(CODES, dtype=np.uint8)[:, None]).astype(np.float32)
            grad |= {f"x{way}": of_code @ np.concatenate(steps), f"u{way}": gu, f"v{way}": gv}
        return loss / size, grad

    def step(self, codes: np.ndarray, tags: np.ndarray, i: int, rate: float) -> float:
        loss, grad = self.gradient(codes, tags)
        size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        for k, g in grad.items():
            g = g * min(1.0, 0.5 / (size + 1e-8))
            self.first[k] = 0.9 * self.first[k] + 0.1 * g
            self.second[k] = 0.99 * self.second[k] + 0.01 * g * g
            self.p[k] -= (rate * (self.first[k] / (1 - 0.9**i)) / (np.sqrt(self.second[k] / (1 - 0.99**i)) + 1e-6)).astype(np.float32)
        return loss

    def tagger(self) -> Tagger:
        p = self.p
        return Tagger((p["x0"], p["x1"]), (p["u0"], p["u1"]), (p["v0"], p["v1"]), p["b"], p["m"])


# ---- labelled spans

NAMES = ["anna", "jo", "max.lee", "sales", "info", "r_diaz", "support", "kim-21", "lea.roth", "ops", "hr.team", "zoe99", "t.olsen", "mail", "web.admin", "x"]
PLACES = ["mail", "example", "post", "firm-a", "uni", "corp", "web", "shop24", "news", "cs.lab", "acme", "inbox", "my-host"]
ENDS = ["com", "org", "net", "de", "fr", "es", "io", "co.uk", "edu", "info"]


def email_words(rng: random.Random) -> list[str]:
    return [rng.choice(NAMES) + (str(rng.randrange(100)) if rng.random() < 0.3 else ""), rng.choice(PLACES) + (str(rng.randrange(10)) if rng.random() < 0.3 else ""), *rng.choice(ENDS).split(".")]


def respelt(span: str, kind: int, rng: random.Random) -> str:
    """Another spelling of a base match, one that the patterns don't know or another of theirs."""
    digits = digits_of(span)
    if kind == 0:
        name, *domain = email_words(rng) if rng.random() < 0.7 else [span.partition("@")[0], *span.partition("@")[2].split(".")]
        at = rng.choice(["@", " @ ", "(at)", " (at) ", "[at]", " [at] ", "{at}", " {at} ", "@"])
        dot = rng.choice([".", " (dot) ", "[dot]", "(dot)", " [dot] ", "."]) if at != "@" else rng.choice(["[dot]", "(dot)", " (dot) ", ".", "."])
        return f"{name}{at}{dot.join(domain)}"
    if kind == 1:
        dot = rng.choice(["[.]", "(.)", " . ", "[dot]", " [.] ", "(dot)", "."])
        return dot.join(str(rng.randrange(1, 256)) for _ in range(4))
    if kind == 2:
        digits = "".join(rng.choice("0123456789") for _ in range(16))
        sep = rng.choice([".", "/", "_", "  ", " - ", " ", ":", " ", "-", ""])
        return sep.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    a, b, c = (digits + "5551234567")[1:4], "555", digits[-4:].rjust(4, "0")
    form = rng.choice(["({a}) {b}-{c}", "1-{a}-{b}-{c}", "{a}.{b}.{c}", "+1/{a}/{b}-{c}", "00 1 {a} {b} {c}", "1 ({a}) {b}-{c}", "+ 1 {a} {b} {c}", "({a}){b}-{c}", "+1 ({a}) {b}-{c}", "+1{a}{b}{c}"])
    return form.format(a=a, b=b, c=c)


def lookalike(rng: random.Random) -> str:
    """Digits and signs that are no personal data."""
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    forms = [f"20{n(2)}-{n(2)}-{n(2)}", f"{n(2)}/{n(2)}/20{n(2)}", f"20{n(2)}-{n(2)}-{n(2)} {n(2)}:{n(2)}:{n(2)}", f"20{n(2)}-{n(2)}-{n(2)}T{n(2)}:{n(2)}:{n(2)}Z", f"{n(1)},{n(3)}.{n(2)}", f"{n(3)},{n(3)},{n(3)}", f"v{n(1)}.{n(1)}.{n(2)}", f"{n(1)}.{n(1)}", n(rng.randrange(1, 8)), f"({n(4)})", f"[{n(2)}]", f"{n(2)}-{n(2)}", f"{n(3)}-{n(3)}", f'"{"".join(rng.choice("0123456789abcdef") for _ in range(32))}"', f"(see {rng.choice(PLACES)})", f"[{rng.choice(NAMES)}]", f"@{rng.choice(PLACES)}", f"{n(2)}.", f"{n(1)}) {rng.choice(PLACES)}", f"{n(8)}-{n(4)}-4{n(3)}", f"0x{n(8)}", f"#{n(9)}", f"{n(12)}ms", f"$ {n(4)}.{n(2)}"]
    return rng.choice(forms)


def contexts(text: str, most: int) -> list[tuple[str, str, str, int]]:
    """(before, span, after, kind) of up to ``most`` spans of a text, drawn by a generator that the text seeds; digits and ``@`` beside them are masked."""
    found = sorted(s for s in shapes(text) if s[2] != 2 or 16 <= len(digits_of(text[s[0] : s[1]])) <= 19)
    found = [s for i, s in enumerate(found) if i == 0 or s[0] >= found[i - 1][1]]
    drawn = random.Random(zlib.crc32(text.encode("utf-8", "surrogatepass"))).sample(found, min(most, len(found)))
    masked = lambda t: re.sub(r"[0-9@+]", "e", t)
    return [(masked(text[max(0, s - LEARNT) : s]), text[s:e], masked(text[e : e + LEARNT]), k) for s, e, k in drawn]


def examples(known: list[tuple[str, str, str, int]], n: int, rng: random.Random) -> tuple[np.ndarray, np.ndarray]:
    """codes and tags (n, LEARNT): spans as they stand or respelt, look-alikes and plain text, in contexts of the sample, all kinds equally often."""
    texts, tags, of_kind = [], np.zeros((n, LEARNT), np.uint8), {k: [c for c in known if c[3] == k] for k in {c[3] for c in known}}
    for i in range(n):
        _, span, _, kind = rng.choice(of_kind[rng.choice(list(of_kind))])
        before, after = rng.choice(known)[0], rng.choice(known)[2]
        draw = rng.random()
        middle = span if draw < 0.2 else respelt(span, kind, rng) if draw < 0.65 else lookalike(rng) if draw < 0.92 else ""
        start = min(rng.randrange(4, LEARNT - 20), len(before))
        end = start + len(middle)
        texts.append((before[len(before) - start :] + middle + after)[:LEARNT].ljust(LEARNT, "\0"))
        if draw < 0.65:
            tags[i, start:end] = kind + 1
    return codes_of("".join(texts)).reshape(n, LEARNT), tags


def train(known: list[tuple[str, str, str, int]], hidden: int = 16, steps: int = 300, rows: int = 160, seed: int = 11) -> Tagger | None:
    """A tagger from labelled spans in their contexts, or None where there is no span."""
    if not known:
        return None
    trainer, rng = Trainer(hidden, len(KINDS) + 1, seed), random.Random(seed)
    for i in range(1, steps + 1):
        trainer.step(*examples(known, rows, rng), i, 0.03 * (1 - i / (steps + 1)) + 0.001)
    return trainer.tagger()


def labelled_spans(docs: DataFrame, max_rows: int, per_row: int, id_col: str, text_col: str) -> list[tuple[str, str, str, int]]:
    """Base spans with ``LEARNT`` characters before and after, at most ``per_row`` a row, of the ``max_rows`` rows with digits or ``@`` whose hashes come first."""
    text = F.col(text_col).cast("string")
    h = F.xxhash64(F.lit("pii"), F.col(id_col), text)
    rows = docs.filter(text.isNotNull() & (F.contains(text, F.lit("@")) | text.rlike(r"[0-9]\.[0-9]|[0-9]{4}|\+[0-9]"))).select(h.alias("h"), text.alias("text"))
    last = rows.select("h").orderBy("h").limit(max_rows).agg(F.max("h")).collect()[0][0]
    if last is None:
        return []
    names = ["before", "span", "after", "kind"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [c for text in b.column(0) for c in contexts(text.as_py(), per_row)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int32() if k == 3 else pa.string()) for k in range(4)], names)

    short = F.length("span") <= LEARNT - 24
    found = rows.filter(F.col("h") <= last).select("text").mapInArrow(cut, "before string, span string, after string, kind int").filter(short).distinct()
    return [tuple(r) for r in found.orderBy(*names).limit(max_rows * per_row).collect()]


# ---- decoding


def windows_of(text: str) -> list[tuple[int, int]]:
    """(start, end) of overlapping windows over the whole text."""
    return [(lo, min(lo + WINDOW, len(text))) for lo in range(0, max(len(text) - OVERLAP, 1), STRIDE)]


def found_in(tags: np.ndarray, scores: np.ndarray, lo: int, size: int, whole: int) -> list[tuple]:
    """(start, end, kind, score, cut at left, cut at right) of the runs of a window's tags."""
    own = tags[:size]
    if not own.any():
        return []
    cuts = np.flatnonzero(np.diff(own)) + 1
    out = []
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), size], strict=True):
        if own[a]:
            gain = float((scores[a:b, own[a]] - scores[a:b, 0]).sum())
            out.append((lo + a, lo + b, int(own[a]) - 1, gain, a == 0 and lo > 0, b == size and lo + size < whole))
    return out


def reconciled(spans: list[tuple]) -> list[Span]:
    """Of the spans of all windows of a text: those cut by an edge joined with what meets them, then the set without overlap of the highest total score."""
    joined: list[list] = []
    for s in sorted(spans):
        if joined and joined[-1][2] == s[2] and s[0] < joined[-1][1] and (joined[-1][5] or s[4]):
            last = joined[-1]
            last[1], last[3], last[5] = max(last[1], s[1]), max(last[3], s[3]), s[5] if s[1] >= last[1] else last[5]
        else:
            joined.append(list(s))
    distinct: dict[Span, float] = {}
    for start, end, kind, score, *_ in joined:
        key = (start, end, kind)
        distinct[key] = max(score, distinct.get(key, score))
    order = sorted((k for k in distinct if distinct[k] > 0), key=lambda k: (k[1], k[0]))
    ends, best, take = [k[1] for k in order], [0.0], []
    for i, k in enumerate(order):
        before = bisect_right(ends, k[0], 0, i)
        value = best[before] + distinct[k]
        take.append(before if value > best[i] else -1)
        best.append(max(value, best[i]))
    out, i = [], len(order)
    while i > 0:
        if take[i - 1] >= 0:
            out.append(order[i - 1])
            i = take[i - 1]
        else:
            i -= 1
    return out[::-1]


def network_spans(tagger: Tagger, texts: list[str], at_once: int = 2048) -> list[list[Span]]:
    """Reconciled spans of each text; ``at_once`` windows go through the network together."""
    found: list[list[tuple]] = [[] for _ in texts]
    held: list[tuple[int, int, int, np.ndarray]] = []

    def run() -> None:
        data = np.zeros((len(held), WINDOW), np.uint8)
        for k, (_, _, _, codes) in enumerate(held):
            data[k, : len(codes)] = codes
        scores = tagger.emissions(data)
        tags = tagger.decode(scores)
        for k in np.flatnonzero(tags.any(axis=1)).tolist():
            i, lo, whole, codes = held[k]
            found[i] += found_in(tags[k], scores[:, :, k], lo, len(codes), whole)
        held.clear()

    for i, text in enumerate(texts):
        if TRIGGER.search(text):
            for lo, hi in windows_of(text):
                if TRIGGER.search(text, lo, hi):
                    held.append((i, lo, len(text), codes_of(text[lo:hi])))
                    if len(held) >= at_once:
                        run()
    if held:
        run()
    return [reconciled(spans) for spans in found]


LAST_NAME = re.compile(r".*(?:\.|[(\[{]\s?dot\s?[)\]}])\s?[A-Za-z0-9-]+", re.S | re.I)


def settled(text: str, start: int, end: int, kind: int) -> tuple[int, int]:
    """The span with whole words at its ends, up to ``OVERLAP`` characters more, without blanks and closing marks there; an email ends with the word after its last dot."""
    while start < end and text[start] in " \t\n\r\x0b\x0c.,;:!?\"'":
        start += 1
    while start < end and text[end - 1] in " \t\n\r\x0b\x0c.,;:!?\"'":
        end -= 1
    if start < end:
        first, last = max(0, start - OVERLAP), min(len(text), end + OVERLAP)
        while start > first and text[start].isalnum() and text[start - 1].isalnum():
            start -= 1
        while end < last and text[end - 1].isalnum() and text[end].isalnum():
            end += 1
    if kind == 0 and (found := LAST_NAME.match(text, start, end)):
        end = found.end()
    return start, end


def all_spans(tagger: Tagger | None, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and added spans of each text."""
    base = [base_spans(t) for t in texts]
    more: list[list[Span]] = [[] for _ in texts]
    if tagger is not None:
        for i, spans in enumerate(network_spans(tagger, texts)):
            taken = sorted((s, e) for s, e, _ in base[i])
            starts, reach, far = [s for s, _ in taken], [], 0
            for _, e in taken:
                far = max(far, e)
                reach.append(far)
            for start, end, kind in spans:
                start, end = settled(texts[i], start, end, kind)
                j = bisect_right(starts, end - 1) - 1
                if start < end and (j < 0 or reach[j] <= start) and loosely_fits(texts[i][start:end], kind):
                    more[i].append((start, end, kind))
    return list(zip(base, more, strict=True))


def told(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in sorted(spans, key=lambda s: (s[2], s[0], s[1])))


def learnt(docs: DataFrame, max_rows: int = 2000, per_row: int = 4, id_col: str = "doc_id", text_col: str = "text") -> Tagger | None:
    """A tagger learnt from the sample of ``docs``."""
    return train(labelled_spans(docs, max_rows, per_row, id_col, text_col))


def find_pii(docs: DataFrame, tagger: Tagger | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone and base_sha256 (of base spans), spans (all) and added (the tagger's own) of every row."""
    held = docs.sparkSession.sparkContext.broadcast(tagger)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            start, column = 0, b.column(1)
            while start < b.num_rows:
                texts, size = [], 0
                while start + len(texts) < b.num_rows and (not texts or size < 2_000_000):
                    texts.append(column[start + len(texts)].as_py() or "")
                    size += len(texts[-1])
                found = all_spans(held.value, texts)
                counts = [pa.array([sum(s[2] == k for s in base) for base, _ in found], pa.int64()) for k in range(len(KINDS))]
                digests = pa.array([hashlib.sha256(told(base).encode()).hexdigest() for base, _ in found], pa.string())
                lists = [pa.array([told(base + more) for base, more in found], pa.string()), pa.array([told(more) for _, more in found], pa.string())]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(texts)), *counts, digests, *lists], ["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "added"])
                start += len(texts)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, added string").withColumnRenamed("id", id_col)
