"""Hand tables with expected results for rules that the given tables do not reach."""

from pyspark.sql import functions as F

from corpuscle.functions import predicates as P
from corpuscle.functions import signals, text, urls
from corpuscle.operators import compare, correlate, cycles, features, findings, graph
from corpuscle.plans.planted import PLANTED
from corpuscle.sources import readers, writers
from corpuscle.streaming import jobs

META = "map<string,string>"


def rows(spark, data, schema="doc string, seq long, id string, kind string, surface string, severity string, confidence string, objects array<string>, meta map<string,string>"):
    df = spark.createDataFrame(data, schema)
    one = F.array(F.struct(F.lit("file").alias("source"), F.lit(1).cast("long").alias("offset"), F.lit(1).alias("length"), F.lit(None).cast("struct<start:bigint,end:bigint>").alias("origin"), F.lit(None).cast("string").alias("note")))
    none = F.lit(None).cast("string")
    return df.withColumns({"evidence": one, "impact": none, "title": none, "description": none, "action_type": none, "action_target": none})


def f(i, kind, severity="low", confidence="strong", objects=("1 0 obj",), meta=None, doc="d", surface="actions"):
    return (doc, i, f"f{i}", kind, surface, severity, confidence, list(objects), meta or {})


def test_predicates_on_missing_values(spark):
    df = rows(spark, [f(1, "a", None)])
    out = df.select(P.field("severity", "!=", "high").alias("ne"), P.not_(P.field("severity", "==", "high")).alias("n"), P.field("severity", "<", "z").alias("lt")).first()
    assert (out.ne, out.n, out.lt) == (False, True, False)


def test_meta_compares_as_number_only_with_number(spark):
    df = rows(spark, [f(1, "a", meta={"Score": "7"}), f(2, "a", meta={"score": "x"})])
    assert [r.id for r in df.filter(P.field("score", ">", 5)).collect()] == ["f1"]
    assert [r.id for r in df.filter(P.field("score", "==", "X")).collect()] == ["f2"]


def test_cap(spark):
    df = rows(spark, [f(i, "a") for i in range(30)] + [f(100 + i, "b") for i in range(25)])
    out = findings.cap_per_kind(df).collect()
    assert len(out) == 50
    first = next(r for r in out if r.kind == "a" and r.rank == 1)
    assert (first.cap_total, first.cap_retained, first.cap_suppressed) == (30, 25, 5)
    assert next(r for r in out if r.kind == "b" and r.rank == 1).cap_total is None


def test_diff(spark):
    base = rows(spark, [f(1, "a"), f(2, "b", "medium", "probable", ["2 0 obj"])])
    comp = rows(spark, [f(1, "a", "high"), f(3, "c", "critical", "certain", ["3 0 obj"])])
    out = {r.fingerprint.split("::")[0]: r.status for r in compare.diff_findings(base, comp).collect()}
    assert out == {"a": "changed", "b": "removed", "c": "new"}


def test_diff_target_without_query(spark):
    one = rows(spark, [f(1, "a", meta={"action.target": "http://x/collect?sid=1#f"})])
    two = rows(spark, [f(1, "a", meta={"action.target": "http://x/collect?sid=2"})])
    assert compare.diff_findings(one, two).count() == 0


def test_launch_by_hash(spark):
    df = rows(spark, [f(1, "embedded_executable_present", meta={"hash": "deadbeef", "entropy": "8.1"}), f(2, "launch_embedded_file", objects=["9 0 obj"], meta={"hash": "deadbeef"})])
    assert correlate.launch_obfuscated_executable(df).count() == 1


def test_taint(spark):
    df = rows(spark, [f(1, "js_present", objects=["6 0 obj"]), f(2, "stream_length_mismatch", objects=["7 0 obj"], meta={"edge.from": "obj 7 0", "edge.to": "obj 8 0"})])
    out = correlate.taint(df).first()
    assert out.edges == "7 0>8 0" and "6 0" in out.sources


def test_stages(spark):
    df = rows(spark, [f(1, "a", confidence="probable", meta={"chain.stage": "render"}), f(2, "b", confidence="tentative", meta={"chain.stage": "execute"})])
    out = compare.ordered_stages(df, "doc").first()
    assert (out.stages, out.confirmed, out.completeness) == ("render,execute", "render", 0.2)


def test_dedupe_over_days(spark):
    days = spark.createDataFrame([(1, "p1", "a"), (1, "p2", "b"), (2, "p3", "a")], "date int, path string, hash string")
    out = {r.path: r.decision for r in compare.scan_plan(days, days.filter("false")).collect()}
    assert out == {"p1": "selected", "p2": "selected", "p3": "dedup.hash_duplicate"}


def test_sample_is_stable(spark):
    df = spark.createDataFrame([(f"p{i}", f"h{i}") for i in range(10)], "path string, hash string")
    assert compare.sample_unique(df, 3, 1).collect() == compare.sample_unique(df.repartition(7), 3, 1).collect()


def test_percentiles(spark):
    df = spark.createDataFrame([("d", "x", float(v)) for v in range(1, 11)] + [("d", "one", 4.0)], "doc string, name string, value double")
    out = {r.name: r for r in features.baseline(df).collect()}
    assert [out["x"][f"p{p}"] for p in features.PERCENTILES] == [2.0, 3.0, 6.0, 8.0, 9.0, 10.0, 10.0]
    assert all(out["one"][f"p{p}"] == 4.0 for p in features.PERCENTILES)


def test_urls(spark):
    df = spark.createDataFrame([
        ("https://user@Login.Example.tk.:8443/a.exe?x=1&x=2",), ("hxxp://a[.]b",), ("data:text/html;base64,QUJD",), ("http://10.0.0.1/p",), ("http://1-2-3-4.x.org/",), ("http://xn--a.b.c.d/",), ("mailto:a@b.c?subject=x",), ("javascript:alert(1)",), ("",),
    ], "url string")
    out = {r.url: r for r in urls.scored_urls(df).collect()}
    first = out["https://user@Login.Example.tk.:8443/a.exe?x=1&x=2"]
    assert (first.u.host, first.u.port, first.u.userinfo, first.u.path) == ("Login.Example.tk", 8443, True, "/a.exe")
    assert first.f.suspicious_tld and first.f.suspicious_extension and first.f.odd_port and "at_symbol" in first.f.phishing
    assert out["data:text/html;base64,QUJD"].f.data_mime == "text/html" and out["data:text/html;base64,QUJD"].score == 70
    assert out["http://10.0.0.1/p"].f.ip_host and out["http://1-2-3-4.x.org/"].f.embedded_ip
    assert "punycode_domain" in out["http://xn--a.b.c.d/"].f.patterns
    assert out["javascript:alert(1)"].score == 70 and out["javascript:alert(1)"].u.host is None
    assert df.select(urls.deobfuscate(F.lit("hxxp://a[.]b(.)c")).alias("x")).first().x == "http://a.b.c"
    assert df.select(urls.canonical_uri(F.lit("HTTP://A/B")).alias("x")).first().x == "http://A/B"


SHOWS = {
    "contains_eval": "EVAL(x)", "dynamic_eval_construction": "a[b]", "jsfuck_encoding": "[]()!+" * 10, "heap_grooming": "for(;;){new ArrayBuffer(8)} new DataView(b).setUint32(0, base + 0x10)",
    "debugger_detection": "performance.now() Date.now()", "exception_abuse": "try{}catch(e){}" * 5, "time_bomb": "if (new Date() > 1 && a < 2 || b == 3 || c != 4)", "control_flow_flattening": "while(true){switch(s){}}",
    "dead_code_injection": "if(false){} if (0) {}", "identifier_mangling": " ".join(f"a{i}0x1" for i in range(12)), "eval_sink": "setTimeout(code)", "bitcoin_address": "pay 1BoatSLRHtKNngkdXEeobR76b53LETtpyT now",
    "ransom_note": "Encrypted! send bitcoin payment", "zero_width_chars": "a​b", "rtl_override": "a‮b", "homoglyph_attack": "pаypal", "comment_payload": "/*" + "a" * 120 + "*/", "recursive_bomb": "function " * 4,
    "constant_spray": "0x1234567 " * 15, "unicode_shellcode": "\\u9090" * 20 + "unescape", "port_scan": "for(;;){fetch(u + ':80')}", "opaque_predicates": "Math.abs( Math.floor( " + "if " * 5, "memory_bomb": "a.push(1) for(", "xfa_exploitation": "XFA",
}
QUIET = {
    "contains_eval": "evil", "jsfuck_encoding": "[]()!+" * 8, "debugger_detection": "Date.now()", "exception_abuse": "try{}catch(e){}" * 4, "eval_sink": "eval('x')", "bitcoin_address": "1BoatSLR0tKNngkdXEeobR76b53", "ransom_note": "encrypted bitcoin",
    "recursive_bomb": "function " * 3, "constant_spray": "0x1234567 " * 14, "xfa_exploitation": "axf", "contains_unescape": "uneſcape", "control_flow_flattening": "switch while(true)"[:6],
}


def test_signals_fire_and_stay_quiet(spark):
    data = [(f"+{k}", v) for k, v in SHOWS.items()] + [(f"-{k}", v) for k, v in QUIET.items()] + [("null", None)]
    shown: dict[str, set] = {}
    for r in signals.text_signals(spark.createDataFrame(data, "k string, t string"), "t", "k").collect():
        shown.setdefault(r.k, set()).add(r.signal)
    assert {k for k in SHOWS if k not in shown.get(f"+{k}", ())} == set()
    assert {k for k in QUIET if k in shown.get(f"-{k}", ())} == set()
    assert "null" not in shown


def test_every_signal_has_a_text_that_shows_it_and_one_that_misses_it(spark):
    assert set(PLANTED) == set(signals.SIGNALS)
    data = [(f"{sign}{k}", v) for k, pair in PLANTED.items() for sign, v in zip("+-", pair, strict=True)]
    shown = {(r.k, r.signal) for r in signals.text_signals(spark.createDataFrame(data, "k string, t string"), "t", "k").collect()}
    assert {k for k in PLANTED if (f"+{k}", k) not in shown} == set()
    assert {k for k in PLANTED if (f"-{k}", k) in shown} == set()


def test_names_end_at_accented_letters(spark):
    """Twelve odd names among 24 are not more than half, whatever the JVM takes for a word bound."""
    df = spark.createDataFrame([("few", "ñcoco " * 12 + "_ " * 12), ("many", "ñcoco " * 11 + "_ " * 12)], "k string, t string")
    shown = {r.k for r in signals.text_signals(df, "t", "k").collect() if r.signal == "identifier_mangling"}
    assert shown == {"many"}


def test_densities(spark):
    df = spark.createDataFrame([(1, "a+b\\"), (2, ""), (3, None)], "k int, t string")
    out = {r.k: (r.string_concat_density, r.escape_density) for r in signals.text_densities(df, "t", "k").collect()}
    assert out == {1: (0.25, 0.25), 2: (0.0, 0.0), 3: (0.0, 0.0)}


def test_entropy_both_ways(spark):
    df = spark.createDataFrame([(1, "aabb"), (2, "é"), (3, "")], "k int, t string")
    one = {r.k: round(r.entropy, 9) for r in text.byte_entropy(df, "t", "k").collect()}
    assert one == {1: 1.0, 2: 1.0, 3: 0.0}
    assert {r.k: round(r.entropy, 9) for r in text.byte_entropy_by_counts(df, "t", "k").collect()} == {1: 1.0, 2: 1.0}


def test_fragments(spark):
    df = spark.createDataFrame([("a", 1, "ev"), ("a", 2, "al("), ("b", 1, "eval("), ("b", 2, "x")], "o string, n int, t string")
    assert [tuple(r) for r in text.assemble_fragments(df, "o", "n", "t", "eval(").collect()] == [("a", 2, "eval(")]
    short = spark.createDataFrame([("c", i, ch) for i, ch in enumerate("xeval(y")] + [("d", 1, "e"), ("d", 2, None), ("d", 3, ""), ("d", 4, "val"), ("d", 5, "(eva"), ("d", 6, "l")], "o string, n int, t string")
    assert {tuple(r) for r in text.assemble_fragments(short, "o", "n", "t", "eval(", "al(e").collect()} == {("c", 5, "eval("), ("d", 5, "eval("), ("d", 5, "al(e")}


def graph_edges(spark, pairs):
    return spark.createDataFrame([("d", a, b, i, "next", False) for i, (a, b) in enumerate(pairs)], "doc string, src string, dst string, seq int, edge_type string, suspicious boolean")


def test_cycles_in_both_directions_and_self(spark):
    e = graph_edges(spark, [("a", "a"), ("b", "c"), ("c", "b"), ("x", "y"), ("y", "z"), ("z", "x")])
    assert {tuple(r.cycle) for r in cycles.find_cycles(e, 5).collect()} == {("a",), ("b", "c"), ("x", "y", "z")}


def test_diamond_paths_and_hops(spark):
    e = graph_edges(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e")])
    s = spark.createDataFrame([("d", "a")], "doc string, node string")
    t = spark.createDataFrame([("d", "d")], "doc string, node string")
    assert {tuple(r.path) for r in graph.simple_paths(e, s, t, 4).collect()} == {("a", "b", "d"), ("a", "c", "d")}
    assert {(r.node, r.hops) for r in graph.distances(e, s, 9).collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2), ("e", 3)}
    assert {tuple(r.path) for r in graph.reachable_paths(e, s, 2).filter("node = 'd'").collect()} == {("a", "b", "d")}


def test_chain_of_25_and_dangling(spark):
    e = graph_edges(spark, [(f"n{i:02}", f"n{i + 1:02}") for i in range(25)])
    s = spark.createDataFrame([("d", "n00")], "doc string, node string")
    assert graph.depths(e, s, 30).first().max_depth == 25
    nodes = spark.createDataFrame([("d", f"n{i:02}") for i in range(25)], "doc string, node_id string")
    gone = graph.dangling_chains(e, nodes, most=5).collect()
    assert {(r.start, r.depth) for r in gone} == {("n20", 5), ("n21", 4), ("n22", 3)}


def test_greedy_action_chain_takes_the_first_edge(spark):
    e = spark.createDataFrame([("d", "t", "a", 0, "open"), ("d", "a", "c", 2, "next"), ("d", "a", "b", 1, "next"), ("d", "b", "t", 3, "next")], "doc string, src string, dst string, seq int, edge_type string")
    out = graph.action_chains(e, F.col("edge_type") == "open", F.col("edge_type") == "next").collect()
    assert [tuple(r.path) for r in out] == [("t", "a", "b")]


def test_line_shapes(spark):
    lines = spark.createDataFrame([('{"path":"p","finding":{"id":"1","kind":"k"}}',), ('{"findings":[{"id":"2","kind":"k"},{"id":"3","kind":"k"}]}',), ('{"id":"4","kind":"k"}',), ('{"type":"summary"}',), ('{"status":"error"}',), ("{broken",), ("",)], "value string")
    good, skipped = readers.parse_findings(lines)
    assert sorted(r.id for r in good.collect()) == ["1", "2", "3"]
    assert {r.reason: r.n for r in skipped.collect()} == {"no_findings": 1, "type_record": 1, "error_record": 1, "broken": 1}


def test_intents(spark):
    lines = spark.createDataFrame([('{"path":"p","url":"http://a"}',), ('{"url":"http://b"}',), ('{"url":" "}',), ('{"url":"http://é"}',), ('{"url":"' + "x" * 1100 + '"}',)], "value string")
    good, bad = readers.parse_intents(lines)
    assert {(r.path, r.url) for r in good.collect()} == {("p", "http://a"), ("unknown", "http://b")}
    assert sorted(r.reason for r in bad.collect()) == ["empty_url", "not_printable", "url_too_long"]


def test_sarif_levels(spark):
    df = rows(spark, [f(1, "a", "critical"), f(2, "a", "medium"), f(3, "b", "low")])
    rules, results = writers.sarif_rows(df)
    assert rules.count() == 2
    assert sorted(r.x for r in results.select(F.get_json_object("value", "$.level").alias("x")).collect()) == ["error", "note", "warning"]


def test_chunk_scan():
    new, tail = jobs.scan_chunks(b"", b"xx/Java", set(), 16)
    assert new == [] and tail.endswith(b"/Java")
    new, tail = jobs.scan_chunks(tail, b"Script /Launch", set(), 16)
    assert new == [b"/JavaScript"] and tail == b""
    assert jobs.scan_chunks(b"", b"a" * 100 + b"/RichMedia", set(), 4)[0] == [b"/RichMedia"]


def test_files_budget(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"MZ1")
    (tmp_path / "b.bin").write_bytes(b"%PDF-1")
    df = readers.scan_corpus_files(spark, str(tmp_path), "*.bin")
    assert sorted(r.m for r in df.select(text.magic_type(F.col("content")).alias("m")).collect()) == ["pdf", "pe"]
    try:
        readers.scan_corpus_files(spark, str(tmp_path), "*.bin", max_files=1)
    except ValueError:
        return
    raise AssertionError("budget not enforced")
