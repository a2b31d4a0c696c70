"""Personal data: base patterns against the plain ones, CRF and gradients against enumeration, held-out accuracy, reconciliation, odd inputs."""

import hashlib
import itertools
import random
import re
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscle.llm import pii

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn_plain(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) if 2 * int(c) < 10 else 2 * int(c) - 9) for i, c in enumerate(reversed(d))) % 10 == 0


def plain(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(digits) <= 19 and luhn_plain(digits or "0"), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_spans_are_the_patterns():
    rng, seen = random.Random(3), 0
    pieces = ["a", "Z9", "@", ".", "-", "_", "+1", "(555)", " ", "1", "25", "256", "1.2.3.4", "a.b@c-d.ef", "4111 1111 1111 1111", "4111-1111-1111-1111", "0000000000000000", "é", "\x00", "00.0.0.007", "+49 30 123456", "5500005555555559", "漢", "@@", "%", "\n"]
    for _ in range(6000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(14)))
        got = pii.told(pii.base_spans(text))
        assert got == ",".join(plain(text)), repr(text)
        seen += bool(got)
    assert seen > 1000


def test_long_runs_take_linear_time():
    """Runs on which the plain patterns take quadratic time: a second each would be far too much."""
    for unit in ("a", "9", "1 ", "@", "a@", "+1", "1.", "a.", "(", "a@b."):
        began = time.process_time()
        long = pii.told(pii.base_spans(unit * 100_000))
        assert time.process_time() - began < 3, unit
        assert pii.told(pii.base_spans(unit * 40)) == ",".join(plain(unit * 40)) and (long != "") == (pii.told(pii.base_spans(unit * 40)) != "")


def test_crf_against_enumeration():
    rng = np.random.default_rng(1)
    scores, moves, tags = rng.normal(size=(4, 2, 3)), rng.normal(size=(3, 3)), rng.integers(0, 3, (2, 4))
    value = lambda s, m, r, path: sum(s[t, r, k] for t, k in enumerate(path)) + sum(m[a, b] for a, b in itertools.pairwise(path))
    paths = list(itertools.product(range(3), repeat=4))
    loss = lambda s, m: sum(np.log(sum(np.exp(value(s, m, r, p)) for p in paths)) - value(s, m, r, tags[r]) for r in range(2))
    got, d_scores, d_moves = pii.crf_gradient(scores, moves, tags)
    assert got == pytest.approx(loss(scores, moves))
    for place in [(0, 0, 1), (3, 1, 2), (2, 0, 0)]:
        up = scores.copy()
        up[place] += 1e-5
        assert d_scores[place] == pytest.approx((loss(up, moves) - got) / 1e-5, abs=1e-3)
    for place in [(0, 1), (2, 2)]:
        up = moves.copy()
        up[place] += 1e-5
        assert d_moves[place] == pytest.approx((loss(scores, up) - got) / 1e-5, abs=1e-3)
    net = pii.Tagger((None, None), (None, None), (None, None), None, moves.astype(np.float32))
    best = net.decode(np.ascontiguousarray(scores.transpose(0, 2, 1)).astype(np.float32))
    assert [tuple(r) for r in best.tolist()] == [max(paths, key=lambda p: value(scores, moves, r, p)) for r in range(2)]


def test_gradients_through_both_directions():
    rng = np.random.default_rng(2)
    t = pii.Trainer(3, 5, 4)
    t.p = {k: v.astype(np.float64) for k, v in t.p.items()}
    codes, tags = rng.integers(0, 6, (3, 7)).astype(np.uint8), rng.integers(0, 5, (3, 7))
    loss, grad = t.gradient(codes, tags)
    for name in t.p:
        at = np.unravel_index(np.abs(grad[name]).argmax(), grad[name].shape)
        was = t.p[name][at]
        t.p[name][at] = was + 1e-3
        up = t.gradient(codes, tags)[0]
        t.p[name][at] = was - 1e-3
        down = t.gradient(codes, tags)[0]
        t.p[name][at] = was
        assert grad[name][at] == pytest.approx((up - down) / 2e-3, rel=0.03, abs=1e-5), name


def test_fast_states_are_the_trained_ones():
    t = pii.Trainer(4, 5, 7)
    codes = np.random.default_rng(3).integers(0, pii.CODES, (6, 20)).astype(np.uint8)
    net = t.tagger()
    for way in (0, 1):
        slow = {at: s[:, 8:12] * th for at, _, _, s, _, th in t.forward(codes, way)}
        fast = net.states(np.ascontiguousarray(codes.T).astype(np.intp), way)
        assert all(np.allclose(fast[at].T, slow[at], atol=1e-5) for at in range(20))


@pytest.fixture(scope="module")
def texts():
    return [t for (t,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' WHERE text IS NOT NULL ORDER BY doc_id").fetchall()]


@pytest.fixture(scope="module")
def net(spark):
    return pii.learnt(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("doc_id % 3 <> 0"))


def card(rng):
    digits = "".join(rng.choice("0123456789") for _ in range(15))
    return next(digits + c for c in "0123456789" if luhn_plain(digits + c))


def test_held_out_spellings_are_found_and_clean_texts_left_alone(net, texts):
    """In texts that were not learnt from: unknown spellings of all kinds, and no span where there is none."""
    rng, found, clean = random.Random(12), dict.fromkeys(range(4), 0), [re.sub(r"[0-9@+()\[\]{}]", "", t) for t in texts[::3] if len(t) > 400]
    n = 40
    for i in range(4 * n):
        kind, text = i % 4, rng.choice(clean)
        digits = card(rng)
        span = [f"{rng.choice(['karl', 'eva.m', 'desk'])}{rng.choice([' (at) ', '[at]', ' [at] '])}{rng.choice(['labor', 'mailbox', 'site7'])}{rng.choice(['[dot]', ' (dot) '])}{rng.choice(['com', 'org', 'net'])}",
                "[.]".join(str(rng.randrange(1, 256)) for _ in range(4)), rng.choice([".", "/", "_"]).join(digits[k : k + 4] for k in (0, 4, 8, 12)), f"({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"][kind]
        at = text.index(" ", rng.randrange(200))
        whole = f"{text[:at]} {span} {text[at + 1 :]}"
        base, more = pii.all_spans(net, [whole])[0]
        found[kind] += (at + 1, at + 1 + len(span), kind) in base + more
    assert all(v >= 0.85 * n for v in found.values()), found
    assert not any(base or more for base, more in pii.all_spans(net, clean))
    dated = [f"{t[:300]} {pii.lookalike(rng)} {t[300:600]}" for t in clean for _ in range(3)]
    wrong = [d for d, (base, more) in zip(dated, pii.all_spans(net, dated), strict=True) if more]
    assert len(wrong) <= 0.02 * len(dated), wrong[:5]


def test_windows_of_a_long_text_agree_with_short_ones(net, texts):
    """A span counts once wherever window edges fall, also across an edge."""
    span, pad = "karl (at) mailbox (dot) com", "then the others of that place were said to be there "
    for shift in range(0, pii.STRIDE + 30, 9):
        text = (pad * 12)[: 300 + shift] + " " + span + " " + pad * 10
        base, more = pii.all_spans(net, [text])[0]
        assert base == [] and more == [(301 + shift, 301 + shift + len(span), 0)], shift


def test_reconciliation_keeps_the_best_set():
    spans = [(0, 10, 0, 5.0, False, False), (0, 10, 0, 4.0, False, False), (8, 20, 2, 6.0, False, False), (20, 30, 0, 1.0, False, True), (25, 40, 0, 2.0, True, False), (50, 60, 1, -1.0, False, False)]
    assert pii.reconciled(spans) == [(8, 20, 2), (20, 40, 0)]
    assert pii.reconciled([]) == []
    rng = random.Random(5)
    for _ in range(200):
        some = [(a := rng.randrange(30), a + rng.randrange(1, 12), rng.randrange(4), float(rng.randrange(1, 50)), False, False) for _ in range(7)]
        value = {s[:3]: max(x[3] for x in some if x[:3] == s[:3]) for s in some}
        sets = [c for n in range(8) for c in itertools.combinations(value, n) if all(x[1] <= y[0] or y[1] <= x[0] for x, y in itertools.combinations(c, 2))]
        assert sum(value[s] for s in pii.reconciled(some)) == max(sum(value[s] for s in c) for c in sets)


def test_query_rows(spark, net, texts):
    rows = [(None, "a@b.cd", "x"), (2, None, "x"), (3, "", "x"), (4, "漢字 a@b.cd and 1.2.3.4, +1 (555) 555-1234 4111 1111 1111 1111", "x"), (5, "call karl (at) mailbox (dot) com now", "x"), (5, "call karl (at) mailbox (dot) com now", "x"), (6, "word " * 60_000 + "1.2.3.4", "x"), (7, "( " * 3000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit("clash") for c in ("id", "h", "spans", "n_email", "codes")})
    got = pii.find_pii(docs, net).collect()
    assert [r.doc_id for r in got] == [r[0] for r in rows]
    for r, (_, text, _) in zip(got, rows, strict=True):
        base = plain(text)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b.startswith(k) for b in base) for k in pii.KINDS]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r.spans.split(",")) and sorted(r.spans.split(",")) == sorted([x for x in base + r.added.split(",") if x] or [""])
    assert [r.added for r in got if r.doc_id != 4] == ["", "", "", "email:5:32", "email:5:32", "", ""]
    assert pii.find_pii(docs, None).filter("added <> ''").count() == 0
    empty = docs.filter("false")
    assert pii.learnt(empty) is None and pii.find_pii(empty, net).count() == 0
    assert pii.learnt(docs.filter("doc_id = 2 OR doc_id = 3")) is None


def test_all_documents_have_their_base_spans(spark, net):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {d: hashlib.sha256(",".join(plain(t)).encode()).hexdigest() for d, t in docs.select("doc_id", "text").collect()}
    assert {r.doc_id: r.base_sha256 for r in pii.find_pii(docs, net).collect()} == want
