"""The training-data operators against brute force and on odd inputs: nulls, empty and long texts, ties, repeats, clashing columns, no rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscle.llm import bytehash, components, decontam, langid, licenses, minhash, mixing, quality, sharding, suffix, topk, urlfilter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "theta", "kappa", "lambda", "zeta", "eta", "iota", "rho", "tau", "phi"]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def odd_docs(spark, extra=()):
    """Nulls anywhere, empty, blank, long and repeated texts, and columns named like the operators' own."""
    rng = random.Random(3)
    long = sentence(rng, 6000)
    rows = [(None, "a text without id", "en", "s1", 1), (2, None, "en", "s1", None), (3, "", None, None, 0), (4, " \n\t ", "en", "s1", 3), (5, "one", "en", "s2", 3), (6, "one", "en", "s2", 3), (7, long, "en", "s2", len(long)), (7, long, "en", "s2", len(long)), (8, long + " tail", "fr", "s1", 9), (9, "\x00Ünï퟿ café 漢字", "fr", "s1", 5), *extra]
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in ("id", "size", "shard", "tokens", "bits", "keys", "key", "x", "h", "words", "spaced", "slot", "component", "pos", "anchor")})


def no_docs(spark):
    return odd_docs(spark).filter("false")


# ---- 1


RULES = [urlfilter.prefix_rule("com/en/", "block"), urlfilter.prefix_rule("example.com/en/7", "allow"), urlfilter.pattern_rule("^spam^", "block"), urlfilter.pattern_rule("^spam*/ok^", "allow")]


def test_url_rules(spark):
    urls = ["http://example.com/en/70", "http://example.com/en/8", "http://notexample.com/en/7", "http://x.EXAMPLE.com/en/7?q", "no scheme", None, "http://com/en/", "http://spam.org/ok/x", "http://spam.org/no", "http://spammer.org/", "http://example.com"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    out = {r.page_id: r for r in urlfilter.filter_urls(df, RULES).collect()}
    assert [out[i].rule for i in range(11)] == ["example.com/en/7", "com/en/", "com/en/", "example.com/en/7", None, None, "com/en/", None, None, None, None]
    assert [out[i].verdict for i in range(11)] == ["allow", "block", "block", "allow", "allow", "allow", "block", "allow", "block", "allow", "allow"]
    assert (out[3].host, out[3].path, out[4].host, out[5].path) == ("x.example.com", "/en/7", "", "")
    assert urlfilter.filter_urls(df.filter("false"), RULES).count() == 0 and urlfilter.filter_urls(df, []).filter("verdict = 'allow'").count() == 11


def test_url_index_finds_what_trying_all_finds():
    rng, index = random.Random(1), urlfilter.build_index(RULES, {})
    plain = [(r.name, r.action, r.regex, r.prefix) for r in RULES]
    indexed, every = urlfilter.Judge(plain, index), urlfilter.Judge(plain, {"": list(range(len(RULES)))})
    for _ in range(500):
        host, path = ".".join(rng.choices(["spam", "example", "com", "x"], k=rng.randrange(1, 4))), "/" + "/".join(rng.choices(["en", "7", "71", "ok", "spam"], k=2))
        url = f"http://{host}{path}"
        assert indexed(url, host, path) == every(url, host, path)


def test_url_index_of_many_rules(spark):
    """20,000 rules of all kinds: the same as trying every one, and only fetched rules are compiled."""
    rng = random.Random(41)
    rules = [urlfilter.prefix_rule(f"site{i}.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'de', ''])}{'/' if i % 2 else ''}", rng.choice(["allow", "block"])) for i in range(12_000)]
    rules += [urlfilter.pattern_rule(rng.choice(["^name{}^", "/dir{}/*.html^", "^q{}=", "://host{}."]).format(i), rng.choice(["allow", "block"])) for i in range(7_985)]
    rules += [urlfilter.pattern_rule(f"*part{i}*", "block") for i in range(5)]
    rules += [urlfilter.prefix_rule(f"{x}.com/aa/{y}", "block") for x in ("one", "two") for y in ("", "b", "c", "bb", "b")]
    near = lambda: rng.randrange(12_000)
    urls = [rng.choice(["http://site{}.com/en/x", "http://a.site{}.net/de/y?q{}=1", "http://name{}.org/dir{}/z.html", "http://host{}.example/part{}x", "HTTP://SITE{}.COM/"]).replace("{}", str(near())) for _ in range(40)]
    urls += ["http://one.com/aa/bb", "http://x.two.com/aa/c", "http://two.com/aa/b" + "/long" * 5000, "http://one.com/aa/bb"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    out = {r.page_id: r for r in urlfilter.filter_urls(df, rules).collect()}
    every = [(r, re.compile(r.regex, re.S)) for r in rules]
    hits = 0
    for i, url in enumerate(urls):
        place, low, best, found = out[i].host + out[i].path, url.lower(), None, {}
        for r, regex in every:
            if r.prefix and regex.search(place) and (best is None or len(r.name) > len(best.name)):
                best = r
            elif not r.prefix and regex.search(low):
                found.setdefault(r.action, r.name)
        verdict = best.action if best else "block" if "block" in found and "allow" not in found else "allow"
        assert (out[i].rule, out[i].verdict, out[i].pattern) == (best and best.name, verdict, found.get("allow") or found.get("block")), url[:80]
        hits += best is not None or bool(found)
    assert hits >= 10
    judge = urlfilter.Judge([(r.name, r.action, r.regex, r.prefix) for r in rules], urlfilter.build_index(rules, {}))
    judge("http://one.com/aa/bb", "one.com", "/aa/bb")
    assert len(judge.ready) < 20


# ---- 2


def test_mixing_weights_and_budget(spark):
    rng = random.Random(5)
    rows = [(i, sentence(rng, rng.randrange(5, 60)), "en", "big" if i % 3 else f"small{i % 5}", 1) for i in range(600)]
    docs = spark.createDataFrame(rows, DOCS)
    out = mixing.mix_table(docs, mixing.MixSpec(repetition=1.5, blocks=16)).collect()
    tokens = {r[0]: max(1, -(-len(r[1].encode()) // 4)) for r in rows}
    source = {r[0]: r[3] for r in rows}
    total = sum(tokens.values())
    have = {s: sum(t for i, t in tokens.items() if source[i] == s) for s in set(source.values())}
    took = {s: sum(r.tokens for r in out if r.source == s) for s in have}
    weight = {r.source: r.weight for r in out}
    assert abs(sum(weight.values()) - 1) < 1e-9
    assert max(weight[s] * total / have[s] for s in have) == pytest.approx(1.5, abs=1e-6)
    for s in have:  # the last row that does not fit is the only loss
        assert 0 <= weight[s] * total + 1 - took[s] <= max(tokens.values()) + 1
    assert len({(r.doc_id, getattr(r, "pass")) for r in out}) == len(out)
    again = mixing.mix_table(docs.repartition(7), mixing.MixSpec(repetition=1.5, blocks=16)).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))


def test_mixing_passes_have_orders_of_their_own(spark):
    """Every whole pass takes all blocks, in an order that is not the other passes'; a large source gets more blocks."""
    rows = [(i, "x" * (40 + i % 7), "en", "big" if i % 10 else "small", 1) for i in range(2000)]
    docs = spark.createDataFrame(rows, DOCS)
    out = mixing.mix_table(docs, mixing.MixSpec(repetition=5.0, blocks=16, block_tokens=500)).collect()
    order = {}
    for r in out:
        order.setdefault((r.source, getattr(r, "pass")), {})[r.block] = r.block_rank
    small = [order["small", p] for p in (1, 2, 3, 4)]
    assert all(sorted(o.values()) == list(range(1, len(o) + 1)) and set(o) == set(small[0]) for o in small) and len({tuple(sorted(o.items())) for o in small}) == 4
    assert len(small[0]) <= 16 < len(order["big", 1]) and max(sum(r.tokens for r in out if (r.source, r.block, getattr(r, "pass")) == ("big", b, 1)) for b in order["big", 1]) < 1500


def test_mixing_entropy_goal(spark):
    docs = spark.createDataFrame([(i, "x" * 40, "en", "a" if i % 10 else "b", 1) for i in range(200)], DOCS)
    out = mixing.mix_table(docs, mixing.MixSpec(repetition=None, entropy=0.6)).select("source", "weight").distinct().collect()
    assert -sum(r.weight * np.log(r.weight) for r in out) == pytest.approx(0.6, abs=1e-6)


def test_mixing_odd_rows(spark):
    docs = odd_docs(spark)
    out = mixing.mix_rows(docs, mixing.MixSpec(repetition=1.0))
    assert out.count() == docs.count() and set(docs.columns) <= set(out.columns)
    assert mixing.mix_rows(no_docs(spark)).count() == 0


# ---- 3


def test_differencing_balances():
    rng = random.Random(2)
    sizes = [rng.randrange(1, 1000) for _ in range(300)]
    shard = sharding.differencing(sizes, 7)
    loads = [sum(s for s, k in zip(sizes, shard, strict=True) if k == j) for j in range(7)]
    assert max(loads) - min(loads) <= 3 and sum(loads) == sum(sizes)
    assert sharding.differencing([], 3) == [] and sharding.differencing([5, 5, 5], 3) in ([0, 1, 2], [2, 1, 0], [1, 0, 2], [0, 2, 1], [1, 2, 0], [2, 0, 1])


def plain_differencing(sizes, shards):
    """Loads by the method told plainly: the two lists of loads of largest spread are added, the one's largest to the other's smallest, until one is left."""
    lists = [([0] * (shards - 1) + [s], -i) for i, s in enumerate(sizes)]
    serial = len(sizes)
    while len(lists) > 1:
        lists.sort(key=lambda x: (x[0][-1] - x[0][0], x[1]))
        (a, _), (b, _) = lists.pop(), lists.pop()
        joined = sorted(x + y for x, y in zip(a, reversed(b), strict=True))
        lists.append(([x - joined[0] for x in joined], -serial))
        serial += 1
    return lists[0][0]


def test_differencing_against_a_plain_one_and_the_optimum():
    rng = random.Random(51)
    for _ in range(60):
        shards, sizes = rng.randrange(2, 6), [rng.choice([rng.randrange(1, 9), rng.randrange(1, 10_000)]) for _ in range(rng.randrange(1, 40))]
        placed, loads = sharding.differencing(sizes, shards), [0] * shards
        for size, shard in zip(sizes, placed, strict=True):
            loads[shard] += size
        assert [x - min(loads) for x in sorted(loads)] == plain_differencing(sizes, shards)
    for _ in range(40):
        sizes = [rng.randrange(1, 40) for _ in range(rng.randrange(3, 9))]
        placed = sharding.differencing(sizes, 2)
        best = min(abs(sum(sizes) - 2 * sum(s for i, s in enumerate(sizes) if mask >> i & 1)) for mask in range(1 << len(sizes)))
        got = abs(sum(s if p else -s for s, p in zip(sizes, placed, strict=True)))
        assert best <= got <= max(sizes)


def test_shards(spark):
    rng = random.Random(4)
    docs = odd_docs(spark, [(i, sentence(rng, 1 + i % 50), "en", "s", 1) for i in range(20, 900)] + [(i, "hot copy of one text", "en", "s", 1) for i in range(1000, 1100)])
    rows, out = docs.collect(), sharding.shard_table(docs, 16, slot_buckets=8).collect()
    assert len(out) == len(rows)
    size = {r.doc_id: len((r.text or "").encode()) + 1 for r in rows}
    crc = {r.doc_id: None if r.text is None else zlib.crc32(r.text.encode()) for r in rows}
    assert all(o["size"] == size[o.doc_id] and o.text_crc32 == crc[o.doc_id] and o.law == "bytes" and o.grown_shard is None for o in out)
    assert len({o.shard for o in out if o.text_crc32 == zlib.crc32(b"hot copy of one text")}) == 1
    for k in {o.shard for o in out}:
        assert sorted(o.slot for o in out if o.shard == k) == list(range(sum(o.shard == k for o in out)))
    assert sharding.shard_table(no_docs(spark)).count() == 0


def test_shard_bytes_are_near_equal(spark):
    rng = random.Random(6)
    docs = spark.createDataFrame([(i, sentence(rng, rng.randrange(1, 80)), "en", "s", 1) for i in range(3000)], DOCS)
    loads = [r.b for r in sharding.shard_table(docs).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(loads) == 16 and max(loads) - min(loads) < 0.002 * sum(loads) / 16


# ---- 4


def brute_licenses(text):
    low = (text or "").translate(str.maketrans(licenses.UPPER, licenses.LOWER))
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    hits = [(i, label) for p, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in hits]
    return len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def test_licenses(spark):
    texts = ["MIT License, mit license; MIT-License", "cc by cc by CC-BY-SA 3.0", "Licensed under the Apache License, Version 2.0", "gnu general public license version 3 or gnu general public license", "Kelvin Kit license", "İmit license", "nothing", "all rights reserved", "\u212a MIT LICENSE \u0130 CC BY"]
    docs = odd_docs(spark, [(100 + i, t, "en", "s", 1) for i, t in enumerate(texts)])
    text = {(r.doc_id): r.text for r in docs.collect()}
    out = licenses.scan_licenses(docs).collect()
    assert len(out) == docs.count()
    for r in out:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_licenses(text[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    labels = {r.doc_id: r.labels for r in out}
    assert labels[101] == "cc-by,cc-by-sa-3.0" and labels[102] == "apache,apache-2.0" and labels[103] == "gpl,gpl-3" and labels[107] == "all-rights-reserved"
    assert licenses.scan_licenses(no_docs(spark)).count() == 0


def test_licenses_by_name_alone(spark):
    plain = {
        "uses the Mozilla Public License": "mpl", "see the GNU Lesser General Public License for more details": "lgpl", "Boost Software License applies": "bsl", "Creative Commons Attribution photo": "cc-by",
        "see the Eclipse Public License text": "epl", "License: Unlicense": "unlicense", "license = WTFPL": "wtfpl", "License: MIT": "mit", "License: BSD 3-Clause": "bsd-3-clause", "License: Apache 2.0": "apache-2.0",
        "an AGPL tool": "agpl", "covered by the Affero GPL": "agpl", "the lesser GPL": "lgpl", "GFDL text": "gfdl", "cc by-nc-sa": "cc-by,cc-by-nc-sa", "the European Union Public Licence": "eupl", "the PHP license": "php",
        "This is free and unencumbered software released into the public domain.": "unlicense", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "isc",
        "you can redistribute it": "", "MIT is a school, Apache a people and BSD a system": "",
    }
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(plain)], DOCS)
    out = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    assert {t: out[i].labels for i, t in enumerate(plain)} == plain
    assert all((out[i].score > 0) == bool(label) for i, label in enumerate(plain.values()))


def plain_scan(text, rules):
    """Labels and score by every rule whose keyword is a word, over the whole text; all pairs of hits compared."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans(licenses.UPPER, licenses.LOWER)))
    spaced, hits = f" {' '.join(words)} ", []
    for r in rules:
        if r.keyword in words:
            for m in re.finditer(r.pattern, spaced):
                start = spaced[: m.start()].count(" ") - 1
                version = re.search(r" (?:version |v ?)?([0-9]+)(?: ([0-9]+))?$", m[0]) if r.versioned else None
                tail = "-" + ".".join(filter(None, version.groups())) if version else ""
                hits.append((start, -(start + m[0].count(" ") + 1), -r.priority, r.number, r.label + tail, r.score))
    labels, score, before = set(), 0.0, []
    for h in sorted(hits):
        if not any(e <= h[1] and p <= h[2] for e, p in before):
            labels.add(h[4])
            score = max(score, h[5])
        before.append((h[1], h[2]))
    base = brute_licenses(text)
    named = set(filter(None, base[4].split(",")))
    return ",".join(sorted(labels | named)), max(score, 0.9 if named else 0.0)


def test_licenses_against_all_rules_on_whole_texts(spark):
    """Gating and windows change nothing: texts made of rule words, near one another, far apart and cut short."""
    rng, rules = random.Random(23), licenses.signatures()
    names = [n for _, _, name in licenses.FAMILIES for n in re.split(r"\|(?![^(]*\))", name) if "(" not in n and "?" not in n]
    notices = [n[2] for n in licenses.NOTICES if not set("(?|[{") & set(n[2])]
    frames = ["{} version 2.0", "licensed under the {}", "License: {}", "SPDX-License-Identifier: MIT OR {} 3.0", "{} license", "{}", "under the terms of the {} v3"]
    texts = []
    for i in range(160):
        parts = []
        for _ in range(rng.randrange(1, 7)):
            parts.append(rng.choice(frames).format(rng.choice(names)) if rng.random() < 0.6 else " ".join(rng.choice(notices).split()[rng.randrange(3) :]))
            parts.append(sentence(rng, rng.choice([0, 1, 5, 23, 24, 25, 47, 49, 120])))
        texts.append(", ".join(parts))
    texts += ["mit license " * 3000, "gnu gpl open source " * 500, "rights reserved all " * 400]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    for r in licenses.scan_licenses(docs).collect():
        assert (r.labels, r.score) == plain_scan(texts[r.doc_id], rules), texts[r.doc_id][:300]


def test_license_rules_find_their_own_words():
    """No rule asks for a name that repeats its last word, and all fit the stretch around a keyword."""
    rules = licenses.signatures()
    assert not [r.pattern for r in rules if re.search(r" licen(?:se|\[cs\]e)\) licen\[cs\]e", r.pattern)]
    assert all(len(n[2].split()) <= licenses.REACH and n[0] in n[2] for n in licenses.NOTICES)


def test_license_rules_are_many_and_compile():
    rules = licenses.signatures()
    assert len(rules) > 300 and all(re.compile(r.pattern) for r in rules)


# ---- 5


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = [(int(i), [float(x) for x in rng.normal(0, 0.2, 6)]) for i in range(400)] + [(400, None), (450, [float("nan")] * 6), (500, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (550, [float("inf")] * 6)]
    vectors += [(600 + i, vectors[0][1]) for i in range(12)]
    df = spark.createDataFrame([(i, v, "clash") for i, v in vectors], "vec_id long, embedding array<float>, id string")
    got: dict[int, list] = {}
    for r in topk.top_k(df, F.col("vec_id") % 50 == 0, block_rows=64, query_rows=4, task_rows=100).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    good = {i: np.floor(256 * np.float32(v).astype(float)).astype(int) for i, v in vectors if v is not None and None not in v and np.isfinite(v).all()}
    for q in [i for i in good if i % 50 == 0]:
        best = sorted(((-int(good[q] @ v), i) for i, v in good.items() if i != q))[:5]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert set(got) == {i for i in good if i % 50 == 0}
    assert topk.top_k(df.filter("false"), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.top_k(df.filter("vec_id < 3"), F.col("vec_id") % 50 == 0).count() == 2


def test_topk_of_uneven_and_repeated_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (0, [1.0, 2.0]), (50, [1.0]), (1, [0.5, 0.5, 9.0]), (2, [-1.0, 1.0]), (2, [-1.0, 1.0]), (None, [9.0, 9.0])], "vec_id long, embedding array<double>")
    out = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, k=3).collect())
    one = 256 * 256
    assert out == [(0, 1, 1, int(1.5 * one)), (0, 2, 2, one), (0, 3, 2, one), (50, 1, 0, one), (50, 2, 0, one), (50, 3, 1, one // 2)]


# ---- 6


def brute_components(texts, k):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans(licenses.UPPER, licenses.LOWER))) for i, t in texts.items()}
    sets = {i: ({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()) for i, w in words.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("small_bucket", [12, 0])
def test_near_duplicates_against_brute_force(spark, monkeypatch, small_bucket):
    """With no small buckets every open bucket goes through the block comparison."""
    monkeypatch.setattr(minhash, "SMALL_BUCKET", small_bucket)
    rng, extra = random.Random(7), []
    for g in range(4):
        base = sentence(rng, 90).split()
        for c in range(12):
            w = list(base)
            for _ in range(rng.randrange(0, 9)):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(10_000)}"
            extra.append((100 + 20 * g + c, "  ".join(w).upper() if c % 2 else " ".join(w), "en", "s", 1))
    docs = odd_docs(spark, extra)
    out = minhash.near_duplicates(docs, words=2, block=8).collect()
    assert len(out) == docs.count()
    want = brute_components({r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}, 2)
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    assert minhash.near_duplicates(no_docs(spark)).count() == 0


def test_words_of_long_texts_in_pieces():
    rng = random.Random(43)
    texts = [("".join(rng.choice(["a", "bc", "def", " ", "\n", "  "]) for _ in range(rng.randrange(300)))).encode() for _ in range(30)] + [b"", b" ", b"x" * 400, b"\t" * 90]
    for piece in (7, 50, 10_000):
        for text, h in zip(texts, minhash.word_hashes(texts, piece), strict=True):
            assert len(h) == len(text.split()) and [int(x) for x in h] == [int(next(minhash.word_hashes([w]))[0]) for w in text.split()]


def test_near_duplicates_of_ids_with_several_texts(spark):
    """Such an id is one document with the links of each of its texts, whichever row comes first."""
    rng = random.Random(37)
    a, b = sentence(rng, 60), sentence(rng, 60)
    docs = spark.createDataFrame([(1, a), (5, a + " more"), (5, b), (9, b + " again"), (7, "alone")], "doc_id long, text string")
    for rows in (docs, docs.orderBy(F.desc("text"))):
        out = {(r.doc_id, r.n_shingles): r.component_id for r in minhash.near_duplicates(rows, words=2).collect()}
        assert out == {(1, 59): 1, (5, 60): 1, (5, 59): 1, (9, 60): 1, (7, 1): 7}


def test_estimates_follow_similarity():
    rng = np.random.default_rng(3)
    for share in (0.5, 0.8, 0.95):
        both = rng.integers(0, 2**63, int(2000 * share), dtype=np.uint64)
        rest = rng.integers(0, 2**63, 2000 - len(both), dtype=np.uint64)
        a, b = np.concatenate([both, rest[::2]]), np.concatenate([both, rest[1::2]])
        x, y = (np.frombuffer(minhash.packed(minhash.minima(s)), np.uint8) for s in (a, b))
        assert float(minhash.estimates(x, y)) == pytest.approx(share, abs=0.15)
    assert minhash.lowest_estimate(0.8) < 0.65


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(200, 201), (201, 202), (None, 3), (5, 5)], "a long, b long")
    out = {r.node: r.component for r in components.components(links).collect()}
    assert all(out[i] == 0 for i in range(61)) and out[202] == 200
    assert components.components(links.filter("false")).count() == 0


# ---- 7


def brute_repeats(texts):
    seen, out = set(), {}
    for i in sorted(texts):
        b = (texts[i] or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s : s + 100] = True
            seen.add(w)
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out[i] = (len(b), int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup_against_brute_force(spark):
    rng = random.Random(9)
    shared = [sentence(rng, 40) for _ in range(3)]
    extra = [(100 + i, sentence(rng, rng.randrange(5, 60)) + rng.choice(shared)[rng.randrange(40) :] + sentence(rng, 20), "en", "s", 1) for i in range(60)]
    extra += [(300, "ab" * 400, "en", "s", 1), (301, "é" * 300, "en", "s", 1), (302, "x" * 99, "en", "s", 1), (303, "x" * 100, "en", "s", 1), (304, "x" * 101, "en", "s", 1)]
    docs = odd_docs(spark, extra).filter("doc_id is null or doc_id <> 7").unionByName(odd_docs(spark).filter("doc_id = 7").limit(1))
    out = suffix.cut_repeats(docs).collect()
    assert len(out) == docs.count()
    want = brute_repeats({r.doc_id: r.text for r in docs.collect() if r.doc_id is not None})
    for r in out:
        got = (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest())
        assert got == (want[r.doc_id] if r.doc_id is not None else (len("a text without id"), 0, 0, hashlib.sha256(b"a text without id").hexdigest()))
    assert suffix.cut_repeats(no_docs(spark)).count() == 0


def test_suffix_dedup_in_pieces(spark, monkeypatch):
    """Texts of many pieces, cut at other places than their copies, give what one piece gives."""
    rng = random.Random(31)
    shared = sentence(rng, 500)
    texts = {i: sentence(rng, rng.randrange(0, 200)) + shared[rng.randrange(900) :] + sentence(rng, 50) + "z" * rng.randrange(300) for i in range(12)} | {20: "ab" * 3000, 21: sentence(rng, 16)[:100], 22: ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute_repeats(texts)
    for piece in (250, 1001):
        monkeypatch.setattr(suffix, "PIECE", piece)
        out = suffix.cut_repeats(docs).collect()
        assert {r.doc_id: (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in out} == want


def test_suffix_dedup_with_ids_far_apart(spark):
    text = sentence(random.Random(1), 60)
    docs = spark.createDataFrame([(-(2**62), text), (2**62, text + " more"), (5, "short")], "doc_id long, text string")
    assert {r.doc_id: sum(s.end - s.start for s in r.spans) for r in suffix.cut_repeats(docs).collect()} == {-(2**62): 0, 2**62: len(text), 5: 0}


def test_range_hashes():
    data = np.frombuffer(b"abcabcabc", np.uint8)
    r = bytehash.Ranges(data)
    assert len(set(r.of(np.array([0, 3, 6]), np.array([3, 6, 9])).tolist())) == 1 and len(set(r.sliding(3).tolist())) == 3


# ---- 8


def test_quality_learns_junk(spark):
    rng, rows, labels = random.Random(11), [], []
    for i in range(400):
        good = i % 4 > 0
        t = sentence(rng, 60).capitalize() + "." if good else " ".join(w + rng.choice(["###", "%%%", "$$$"]) for w in sentence(rng, 60).split())
        rows.append((1000 + i, t, "en", "s", 1))
        labels.append((1000 + i, int(good)))
    docs = odd_docs(spark, rows)
    lab = spark.createDataFrame([*labels, (None, 1), (1000, None), (1001, 1)], "doc_id long, quality int")
    train = F.col("doc_id") % 2 == 0
    out = quality.score_quality(docs, lab, train).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    truth = dict(labels)
    assert np.mean([(r.score >= 0.5) == bool(truth[r.doc_id]) for r in out if (r.doc_id or 0) >= 1000 and r.doc_id % 2]) > 0.97
    assert quality.score_quality(no_docs(spark), lab, train).count() == 0
    assert {r.score for r in quality.score_quality(docs, lab.filter("false"), train).collect()} == {1.0}


def test_quality_is_a_quadratic_discriminant(spark):
    """Scores against densities written out: shrunk covariances, their determinants and inverses."""
    rng, rows, labels = random.Random(12), [], []
    for i in range(300):
        t = sentence(rng, rng.randrange(3, 80)) if i % 3 else " ".join(w * rng.randrange(1, 4) + rng.choice(["#", "!", "9"]) for w in sentence(rng, 30).split())
        rows.append((i, t, "en", "s", 1))
        labels.append((i, int(i % 3 > 0)))
    docs, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int")
    out = {r.doc_id: r.score for r in quality.score_quality(docs, lab, F.col("doc_id") < 200).collect()}
    x = np.array([quality.statistics(r[1]) for r in rows])
    y = np.array([q for _, q in labels])
    own = [x[:200][y[:200] == c] for c in (0, 1)]
    covs = [np.cov(o.T, bias=True) for o in own]
    pooled = sum(c * len(o) for c, o in zip(covs, own, strict=True)) / 200
    logs = []
    for o, c in zip(own, covs, strict=True):
        s = 0.7 * c + 0.3 * pooled
        s = 0.95 * s + 0.05 * np.diag(np.diag(s)) + 1e-4 * np.eye(len(s))
        d = x - o.mean(axis=0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d) - 0.5 * np.linalg.slogdet(s)[1])
    size = np.expm1(x[:, 0])
    z = np.log(len(own[1]) / len(own[0])) + size / (size + 100) * (logs[1] - logs[0])
    assert [out[i] for i in range(300)] == pytest.approx((1 / (1 + np.exp(-z))).tolist(), abs=1e-6)
    few = quality.score_quality(docs, lab, F.lit(True), max_labels=120).collect()
    assert np.mean([(r.score >= 0.5) == bool(y[r.doc_id]) for r in few]) > 0.9


# ---- 9


def test_alignment_of_copies_and_edits():
    item = np.arange(10)
    exact, gap, swap, other = np.r_[[99] * 3, item, [98]], np.r_[item[:5], 77, item[5:]], np.r_[item[:4], 55, item[5:]], np.full(4, -2)
    assert decontam.align(item, [exact, gap, swap, other]) == [(20, 3, 12), (19, 0, 10), (17, 0, 9), (0, 0, 0)]


def test_leaks(spark):
    rng = random.Random(13)
    items = [sentence(rng, 20) for _ in range(6)]
    edited = items[1].split()
    edited[7] = "changed"
    edited.insert(12, "inserted")
    extra = [(100, sentence(rng, 50) + " " + items[0].upper() + " " + sentence(rng, 50), "en", "s", 1), (101, sentence(rng, 30) + " " + " ".join(edited), "en", "s", 1), *[(200 + i, sentence(rng, 100), "en", "s", 1) for i in range(30)], *[(300 + i, f"{sentence(rng, 9)} {items[2]}.", "en", "s", 1) for i in range(40)]]
    bench = spark.createDataFrame([*enumerate(items), (50, None), (51, "too short"), (None, "no id at all here")], "item_id long, text string").withColumn("id", F.lit("clash"))
    docs = odd_docs(spark, extra)
    out = {(r.doc_id, r.item_id): r for r in decontam.leaks(docs, bench).collect()}
    assert {k for k in out if k[0] < 200} == {(100, 0), (101, 1)} and {k for k in out if k[0] >= 200} == {(300 + i, 2) for i in range(40)}
    assert out[100, 0].score == 1.0 and (out[100, 0].first_word, out[100, 0].last_word) == (50, 69) and 0.8 < out[101, 1].score < 1
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench, max_seeds=20).collect()} == set(out)
    assert decontam.leaks(no_docs(spark), bench).count() == 0 and decontam.leaks(docs, bench.filter("false")).count() == 0


def brute_alignment(item, text):
    """Best local score of two word lists over the item's own, by the whole table."""
    best, above = 0, [0] * (len(text) + 1)
    for w in item:
        here = [0]
        for j, x in enumerate(text):
            here.append(max(0, above[j] + (2 if w == x else -1), above[j + 1] - 1, here[j] - 1))
        best, above = max(best, max(here)), here
    return best / (2 * len(item))


def test_leaks_with_few_seeds_left(spark):
    """Edited copies that keep one or two of an item's 3-grams, alone, in numbers and beside an intact copy."""
    rng = random.Random(19)
    items = [sentence(rng, 12) for _ in range(4)]

    def edited(k, places):
        return " ".join(f"edit{rng.randrange(10_000)}" if j in places else w for j, w in enumerate(items[k].split()))

    one, two = (2, 5, 8), (2, 5)
    texts = [edited(0, one), *[edited(1, one) for _ in range(5)], items[2], edited(2, one), edited(3, two), edited(3, (1, 3, 5, 7, 9))]
    docs = spark.createDataFrame([(i, f"{sentence(rng, 15)} {t} {sentence(rng, 15)}", "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = {(r.doc_id, k): brute_alignment(item.split(), r.text.split()) for r in docs.collect() for k, item in enumerate(items)}
    got = {(r.doc_id, r.item_id): r.score for r in decontam.leaks(docs, bench).collect()}
    assert got == pytest.approx({k: v for k, v in want.items() if v >= 0.5}) and got[0, 0] == pytest.approx(0.625) and len(got) == 9


def test_leaks_against_aligning_everything(spark):
    """Every document against every item, items of many lengths in short and long texts, with random edits: share found and scores."""
    rng = random.Random(29)
    items = [sentence(rng, rng.choice([3, 5, 8, 12, 20, 40])) for _ in range(12)]
    texts = []
    for i in range(90):
        words = items[i % 12].split()
        for _ in range(rng.randrange(0, 1 + len(words) * 2 // 5)):
            at, what = rng.randrange(len(words)), rng.random()
            words[at : at + 1] = [f"edit{rng.randrange(99)}"] if what < 0.5 else [] if what < 0.7 else [words[at], "more"]
        texts.append(f"{sentence(rng, rng.choice([0, 3, 30]))} {' '.join(words)} {sentence(rng, rng.choice([0, 3, 30]))}")
    texts += [" ".join(sentence(rng, 25) + " " + items[j % 12] for j in range(60)), " ".join(items[:12]) * 2, items[3]]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = {(i, k): v for i, t in enumerate(texts) for k, item in enumerate(items) if (v := brute_alignment(item.split(), t.split())) >= 0.5}
    grams = lambda t: set(zip(w := t.split(), w[1:], w[2:], strict=False))
    seeded = {(i, k): v for (i, k), v in want.items() if len(items[k].split()) < 12 or grams(texts[i]) & grams(items[k])}
    long = [k for k in want if len(items[k[1]].split()) >= 12]
    assert sum(k in seeded for k in long) >= 0.99 * len(long) > 50
    for span in (2048, 64):
        assert {(r.doc_id, r.item_id): r.score for r in decontam.leaks(docs, bench, span=span).collect()} == pytest.approx(seeded)


def test_leaks_of_short_items(spark):
    """Items of 1 and 2 words only as a whole; of 3 to 11 words all that aligning everything finds, whatever the edits."""
    rng = random.Random(37)
    items = ["solo", "twin words", *[sentence(rng, n) for n in range(3, 12) for _ in range(3)]]
    texts = ["a solo voice", "twin of words", "so twin words go", "words twin"]
    for i in range(150):
        words = items[2 + i % 27].split()
        for _ in range(rng.randrange(0, 1 + len(words) // 2)):
            at, what = rng.randrange(len(words)), rng.random()
            words[at : at + 1] = [f"edit{rng.randrange(99)}"] if what < 0.5 else [] if what < 0.7 and len(words) > 1 else [words[at], "more"]
        texts.append(f"{sentence(rng, 6)} {' '.join(words)} {sentence(rng, 6)}")
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    score = lambda item, t: brute_alignment(item.split(), t.split())
    want = {(i, k): v for i, t in enumerate(texts) for k, item in enumerate(items) if (v := score(item, t)) >= (0.5 if len(item.split()) > 2 else 1)}
    assert {(r.doc_id, r.item_id): r.score for r in decontam.leaks(docs, bench).collect()} == pytest.approx(want) and {(0, 0), (2, 1)} <= set(want)


def test_common_seeds_form_no_pairs(spark):
    """One 3-gram that all items and texts hold pairs none of them, and items all of whose seeds are common are still found."""
    rng = random.Random(43)
    common = "one of the"
    items = [f"{sentence(rng, 7)} {common} {sentence(rng, 7)}" for _ in range(400)] + [" ".join([common] * 5)] * 2
    index = decontam.build_index([(k, decontam.hashed(decontam.words_of(t), decontam.WordHashes()).view(np.int64).tolist()) for k, t in enumerate(items)], 3, 0.5, 64, 12)
    texts = [f"{sentence(rng, 30)} {common} {sentence(rng, 30)}" for _ in range(1000)]
    words = [decontam.hashed(decontam.words_of(t), decontam.WordHashes()) for t in texts]
    assert sum(len(some) for w in words for _, _, some in decontam.met(index, w, 3, 2048)) < 40  # by other seeds that texts and items happen to share
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *items[:20], f"x {items[-1]} y", f"{common} {common} and {common} {common}"])], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    assert got == {(1000 + i, i) for i in range(20)} | {(d, k) for d in (1020, 1021) for k in (400, 401)}


def test_recall_of_edited_copies():
    """Share of randomly edited copies at the threshold or above that have a stretch which goes on, by length of the item."""
    rng = random.Random(47)
    items = [sentence(rng, n) for n in range(3, 41) for _ in range(12)]
    index = decontam.build_index([(k, decontam.hashed(t.split(), decontam.WordHashes()).view(np.int64).tolist()) for k, t in enumerate(items)], 3, 0.5, 64, 12)
    found, every = {}, {}
    for k, item in enumerate(items):
        for _ in range(6):
            words = item.split()
            for _ in range(rng.randrange(1, 2 + len(words) * 2 // 5)):
                at, what = rng.randrange(len(words)), rng.random()
                words[at : at + 1] = [f"edit{rng.randrange(99)}"] if what < 0.6 else [] if what < 0.8 and len(words) > 1 else [words[at], "more"]
            if brute_alignment(item.split(), words) >= 0.5:
                n = len(item.split())
                every[n] = every.get(n, 0) + 1
                met = decontam.met(index, decontam.hashed(words, decontam.WordHashes()), 3, 2048)
                found[n] = found.get(n, 0) + any(k in some for _, _, some in met)
    assert all(found[n] == every[n] for n in range(3, 12)) and all(found[n] >= 0.9 * every[n] for n in range(12, 41))
    assert sum(found[n] for n in range(12, 41)) >= 0.98 * sum(every[n] for n in range(12, 41))


def test_leaks_of_ties_and_long_repetitive_texts(spark):
    item = "one two three four five six"
    texts = [f"{item} and {item}", "one two three " * 30_000, "one two three four " * 2_000 + item]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS).union(spark.createDataFrame([(0, texts[0], "en", "s", 1)], DOCS))
    out = {r.doc_id: tuple(r)[2:] for r in decontam.leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert out[0] == (1.0, 0, 5) and out[1][0] == 0.5 and out[2][0] == 1.0 and out[2][2] - out[2][1] == 5 and len(out) == 3


# ---- 10


def test_language(spark):
    rng = random.Random(17)
    make = {"xx": lambda: " ".join(rng.choice(["the", "that", "and", "hand", "with"]) for _ in range(40)), "yy": lambda: " ".join(rng.choice(["quoi", "où", "élève", "ça", "peu"]) for _ in range(40))}
    rows = [(1000 + i, make[lang](), lang, "s", 1) for i in range(120) for lang in ("xx" if i % 2 else "yy",)]
    docs = odd_docs(spark, [*rows, (900, "12345 !!", "xx", "s", 1)]).withColumn("lang", F.when(F.col("doc_id") >= 1000, F.col("lang")))
    out = langid.predict_language(docs, F.col("doc_id") % 5 != 0, max_stretches=400).collect()
    assert len(out) == docs.count()
    got = {r.doc_id: r for r in out}
    assert (got[2].lang_pred, got[3].lang_pred, got[4].lang_pred, got[900].lang_pred) == ("und",) * 4 and got[900].score == 0.0
    assert np.mean([got[r[0]].lang_pred == r[2] for r in rows if r[0] % 5 == 0]) > 0.95
    assert langid.predict_language(no_docs(spark), F.lit(True)).count() == 0
    assert {r.lang_pred for r in langid.predict_language(docs, F.lit(False)).collect()} == {"und"}


def test_language_sample_is_bounded(spark):
    """Stretches are the labelled unit: every language has its share of the bound, from rows of any length, and none is left out."""
    rows = [(i, " ".join(f"{i}w{j}" for j in range(60)), "xx") for i in range(900)] + [(5000, " ".join(f"long{i}" for i in range(20_000)), "yy")] + [(7, "rows alike", "zz")] * 900 + [(i, "rare", f"r{i:04}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    data, langs = langid.labelled_sample(docs, F.lit(True), 4300, 50, "doc_id", "text", "lang")
    count = {x: langs.count(x) for x in set(langs)}
    assert len(count) == 43 and 60 < count["xx"] < 140 and 60 < count["yy"] < 140 and count["zz"] == 1 and len(data) == len(langs)
    with pytest.raises(ValueError, match="max_languages"):
        langid.labelled_sample(docs, F.lit(True), 4300, 42, "doc_id", "text", "lang")


def test_language_sample_reaches_every_part_of_long_texts():
    text = b"".join(b"%063d\n" % i for i in range(5000))
    assert [int(p) for p in langid.drawn_stretches(text, 5000)] != list(range(5000)) and len({int(p) for p in langid.drawn_stretches(text, 5000)}) == 5000
    assert len(langid.drawn_stretches(text, 6)) == 6 and langid.drawn_stretches(b"", 6) == [] and langid.drawn_stretches(b"ab", 6) == [b"ab" + b"\0" * 62]


def test_fast_states_are_the_trainers():
    """What prediction computes at each position is what training does, and long texts in parts give what they give at once."""
    rng = np.random.default_rng(3)
    trainer = langid.Trainer(3, 4, 2)
    data = rng.integers(0, 256, (5, 9)).astype(np.uint8)
    p = trainer.p
    net = langid.Network(("a", "b", "c"), (p["x0"], p["x1"]), (p["u0"], p["u1"]), (p["v0"], p["v1"]), p["b"])
    logits = np.tile(p["b"], (9, 5, 1))
    for way in (0, 1):
        states = net.states(np.ascontiguousarray(data.T).astype(np.intp), way)
        for t, *_, new in trainer.forward(data, way):
            assert states[t].T == pytest.approx(new, abs=1e-5)
            logits[t] += new @ p[f"v{way}"]
    plain = np.exp(logits) / np.exp(logits).sum(-1, keepdims=True)
    assert net.probabilities(data).transpose(0, 2, 1) == pytest.approx(plain, abs=1e-5)
    text = bytes(rng.integers(65, 91, 300_000).astype(np.uint8))
    whole = net.probabilities(langid.FOLD[np.frombuffer(text.ljust(300_032, b"\0"), np.uint8).reshape(-1, 64)]).transpose(0, 2, 1).transpose(1, 0, 2).reshape(-1, 3)[:300_000].mean(axis=0)
    assert langid.pooled(net, [b"x", text])[1] == pytest.approx(whole, abs=1e-4)


def test_gradients_by_differences():
    """Backpropagation through time against finite differences."""
    rng = np.random.default_rng(0)
    data, label, mask = rng.integers(1, 256, (3, 5)).astype(np.uint8), np.array([0, 1, 1]), np.ones((3, 5), np.float32)
    trainer = langid.Trainer(2, 3, 1)
    trainer.p = {k: v.astype(np.float64) for k, v in trainer.p.items()}

    def loss():
        logits = np.tile(trainer.p["b"], (5, 3, 1))
        for way in (0, 1):
            for t, *_, new in trainer.forward(data, way):
                logits[t] += new @ trainer.p[f"v{way}"]
        p = np.exp(logits) / np.exp(logits).sum(-1, keepdims=True)
        return -np.log(p[:, np.arange(3), label]).sum() / mask.sum()

    before = {k: v.copy() for k, v in trainer.p.items()}
    seen = {}
    trainer.m = {k: np.zeros_like(v) for k, v in before.items()}
    trainer.s = {k: np.zeros_like(v) for k, v in before.items()}
    trainer.step(data, label, mask, 1, 0.0)
    seen = {k: v / 0.1 for k, v in trainer.m.items()}
    scale = None
    for key in ("u0", "u1", "v0", "b", "x1"):
        at = (data[0, 0], 4) if key[0] == "x" else (1, 1) if key != "b" else (1,)
        trainer.p = {k: v.copy() for k, v in before.items()}
        trainer.p[key][at] += 1e-5
        up = loss()
        trainer.p[key][at] -= 2e-5
        numeric = (up - loss()) / 2e-5
        ratio = seen[key][at] / numeric
        scale = scale or ratio
        assert ratio == pytest.approx(scale, rel=1e-2)
