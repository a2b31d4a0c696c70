"""Text signals: script, obfuscation, evasion and abuse indicators as one rule table.

``text_signals`` evaluates all rules in one projection. The needles are fixed values; what is case
sensitive says ``exact``. A null text has no signal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.functions.rules import Number, Rule, all_of, any_of, count_of, has, hits, inputs, left_by, matches, octets, only_if, words_where
from corpuscle.session import spread


def unquoted(sink: str) -> Rule:
    """The first occurrence of the sink goes on with something that is no quote."""
    n = len(sink)

    def column(t: dict[str, Column]) -> Column:
        at = F.instr(t["text"], sink)
        return t["("] & (at > 0) & ~F.substring(t["text"], at + n, F.lit(1)).isin("", "'", '"')

    return Rule(column, f"(strpos(text, '{sink}') > 0 AND substr(text, strpos(text, '{sink}') + {n}, 1) NOT IN ('', chr(39), chr(34)))")


def ascii_bounds(pattern: str) -> str:
    """The pattern with word bounds that know ASCII only, as in RE2; Java's own ``\\b`` takes accented letters in, by its version."""
    first, last = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
    return first + pattern.removeprefix(r"\b").removesuffix(r"\b") + (last if pattern.endswith(r"\b") else "")


LOOP = any_of("for(", "while(")
LOOP_SPACED = any_of("for(", "for (", "while(", "while (")
ENDLESS = any_of("while(true)", "while(1)", "while (true)", "while (1)")
DRAWING = any_of("getContext('2d')", 'getContext("2d")')
SCRIPT_TAG = any_of("createElement('script')", 'createElement("script")')
PACKED = Rule(lambda t: F.octet_length(t["text"]) == F.length(t["text"]), "strlen(text) = length(text)")
VISIBLE = left_by(r"[\t\n\f\r ]+")
SYMBOLS = r"[^\[\]()!+]+"
DENSE = r"""[^\[\]()!+,"$.:;_{}~=]+"""

ANGLER = hits("window.external.Flash", "unescape('%u9090%u9090')", "Flash.ocx").at_least(2)
MAGNITUDE = (has("rc4") | (any_of("decrypt", "decode") & has("key"))) & has("for(")
RIG = any_of("Shockwave Flash", "Flash Player", "javaEnabled()", "Java Plug-in") & all_of("if(", "else")
BASE64 = matches(r"[A-Za-z0-9+/=]{40,}")
AFTER_STOP = Number(
    lambda t: F.when(F.contains(t["text"], F.lit("return")) | F.contains(t["text"], F.lit("throw")), F.size(F.regexp_extract_all(t["text"], F.lit(r"(?:return|throw)[^;\n]*[;\n][\t\n\f\r ]*([^\t\n\f\r }/;])"), F.lit(1)))).otherwise(0),
    r"len(regexp_extract_all(text, '(?:return|throw)[^;\n]*[;\n][\t\n\f\r ]*([^\t\n\f\r }/;])', 1))",
)
DEAD = count_of("if(false)") + count_of("if (false)") + count_of("if(0)") + count_of("if (0)") + count_of("while(false)") + count_of("while (false)") + AFTER_STOP
LIVE = count_of("if(") + count_of("if (") + count_of("for(") + count_of("while(") + count_of("function ") + count_of("=>")

NAME = r"\b[A-Za-z_][A-Za-z0-9_]*"
ODD_NAME = r"\b(?:[A-Za-z_][A-Za-z0-9_]*[0-9][A-Za-z0-9_]*|[A-Za-z_])\b"
MANGLED_SQL = "(length(w) = 1 AND NOT regexp_matches(w, '^[ijkxyz]$')) OR contains(w, '0x') OR (length(w) > 5 AND length(regexp_replace(w, '[^0-9]', '', 'g')) > length(w) // 2)"
NAMES = Number(lambda t: F.size(F.regexp_extract_all(t["text"], F.lit(ascii_bounds(NAME)), F.lit(0))), f"len(regexp_extract_all(text, '{NAME}'))")
MANGLED = Number(
    lambda t: F.size(
        F.filter(
            F.regexp_extract_all(t["text"], F.lit(ascii_bounds(ODD_NAME)), F.lit(0)),
            lambda w: ((F.length(w) == 1) & ~w.rlike("^[ijkxyz]$")) | F.contains(w, F.lit("0x")) | ((F.length(w) > 5) & (F.length(F.regexp_replace(w, "[^0-9]", "")) > F.floor(F.length(w) / 2))),
        )
    ),
    f"len(list_filter(regexp_extract_all(text, '{ODD_NAME}'), lambda w: {MANGLED_SQL}))",
)


def multibyte(t: dict[str, Column]) -> Column:
    return F.octet_length(t["text"]) > F.length(t["text"])


def marked(*chars: str):
    """Any of the characters occurs."""
    def gate(t: dict[str, Column]) -> Column:
        out = F.lit(False)
        for c in chars:
            out = out | F.contains(t["text"], F.lit(c))
        return out

    return gate


#: Needles and thresholds are fixed values.
SIGNALS: dict[str, Rule] = {
    "has_base64_like": BASE64,
    "long_token_run": matches(r"[A-Za-z0-9_]{32,}"),
    "contains_hex_escapes": has("\\x"),
    "contains_unicode_escapes": has("\\u"),
    "contains_eval": has("eval"),
    "contains_unescape": has("unescape"),
    "contains_fromcharcode": has("fromCharCode"),
    "dynamic_eval_construction": (any_of("'ev'", '"ev"', "'a'", '"a"', "'l'", '"l"') & has("+"))
    | all_of("[", "]")
    | any_of(
        "function*(){}).constructor", "function* () {}).constructor", "function *(){}).constructor", "async function(){}).constructor", "async function () {}).constructor",
        "getPrototypeOf(function*", "getPrototypeOf(function *", "Function.prototype.constructor",
    ),
    "hex_fromcharcode_pattern": has("fromCharCode") & any_of("0x", "parseInt"),
    "environment_fingerprinting": any_of("app.plugIns.length", "app.viewerType", "app.platform", "app.viewerVersion", "this.info.title", "this.info.author") & has("if") & any_of(">", "==", "!="),
    "jsfuck_encoding": only_if(marked("[", "]", "(", ")", "!", "+"), PACKED & VISIBLE.at_least(50) & left_by(SYMBOLS).share_at_least(VISIBLE, 80)),
    "jjencode_encoding": only_if(marked("[", "]", "$_"), left_by(r"[\t\n\f\r ]+", octets=True).at_least(60)
    & (any_of("$=~[]", "$_", exact=True) | (left_by(DENSE, octets=True).share_at_least(left_by(r"[\t\n\f\r ]+", octets=True), 70) & left_by(r"[^\[\]]+").at_least(12)))),
    "aaencode_encoding": has("(function(", exact=True) & has("constructor") & left_by("[^＀-￯]+").at_least(8) & left_by("[^＀-￯]+").share_at_least(VISIBLE, 8),
    "regex_packing": all_of("/", ".replace"),
    "suspicious_apis": any_of(
        "app.launchURL", "util.printf", "this.getURL", "submitForm", "importDataObject", "exportDataObject", "app.mailMsg", "app.doc.syncAnnotScan", "app.doc.getAnnots",
        "app.doc.addAnnot", "app.doc.removeAnnot", ".subject", "app.plugIns.length", "app.viewerType", "app.platform", "this.media.newPlayer", "app.media.newPlayer", "this.getOCGs", "app.doc.getOCGs",
    ),
    "type_confusion_risk": any_of("Array.prototype.__proto__", "Array.prototype.constructor", ".prototype.__proto__") | hits(".length = 0x", ".length = -", "arr.length").at_least(2),
    "integer_overflow_setup": any_of("0x7fffffff", "0xffffffff", "MAX_SAFE_INTEGER", "Number.MAX_VALUE") & any_of(">>>", "<< ", ">> ", "& 0x", "| 0x"),
    "array_manipulation_exploit": hits(".push(", ".pop(", ".shift(", ".unshift(", ".splice(", "Array(", "new Array").at_least(4),
    "heap_grooming": hits(
        LOOP_SPACED & has("ArrayBuffer("),
        any_of("new Uint8Array(", "new Uint16Array(", "new Uint32Array(", "new Float64Array(") & any_of("byteOffset", "subarray(", ", 0x", ",0x", ", 0,", ",0,"),
        has("new DataView(") & any_of("setUint32(", "setUint16(", "setFloat64(", "getUint32(", "getFloat64(") & any_of("+ 0x", "<<", "offset"),
    ).at_least(2),
    "lfh_priming": has("ArrayBuffer(") & (LOOP_SPACED | any_of("do{", "do {")) & any_of("= null", ".fill(0)", ".splice(", ".length = 0") & any_of("new DataView(", "new Uint32Array(", "new Float64Array("),
    "rop_chain_construction": (
        any_of("0x7ff", "0x10000000", "0x140000000", "kernel32", "ntdll") & any_of("+ 0x", "- 0x", "<<", ">>>") & any_of("setUint32(", "setBigUint64(", "setFloat64(") & any_of("rop", "gadget", "chain", "pivot", "returnAddress")
    )
    | (count_of("0x", exact=False).at_least(6) & any_of("setUint32(i", "setUint32(idx", "setBigUint64(i", "setFloat64(i") & has("DataView")),
    "info_leak_primitive": has("ArrayBuffer(")
    & any_of("Uint8Array(", "Uint32Array(", "Float64Array(", "DataView(")
    & has(".length")
    & any_of("byteLength", "!=", ">", "<")
    & ((any_of("[i + ", "[idx + ", "[offset + ", "getUint32(", "getFloat64(") & has("byteLength")) | any_of("oob", "outOfBounds", "leak", "addrOf", "fakeobj")),
    "debugger_detection": hits("eval.toString().length", "Function.prototype.toString", "performance.now()", "Date.now()", ".toString.call(", "constructor.name").at_least(2),
    "sandbox_evasion": hits("typeof window", "typeof document", "typeof navigator", "app.viewerType", "app.platform", "app.viewerVersion", "screen.width", "screen.height", "navigator.plugins").at_least(3),
    "global_deletion_bypass": hits("delete window", "delete document", "delete confirm", "delete alert", "delete Function", "delete eval").at_least(2),
    "exception_abuse": count_of("try").at_least(5) & count_of("catch").at_least(5),
    "time_bomb": any_of("Date()", "getTime()", "getHours()", "getDate()", "getMonth()") & all_of("if", ">", "<", "==", "!="),
    "form_manipulation": hits("createElement('form')", 'createElement("form")', ".submit(", 'type="hidden"', "type='hidden'").at_least(2),
    "credential_harvesting": hits('type="password"', "type='password'", "addEventListener('input'", 'addEventListener("input"', ".value", "clipboard").at_least(2),
    "encoded_transmission": any_of("btoa(", "encodeURIComponent(", "encodeURI(") & any_of("submitForm", "app.launchURL", "mailMsg"),
    "control_flow_flattening": count_of("switch").at_least(3)
    | (ENDLESS & count_of("switch").at_least(1))
    | (any_of("[state++]", "[++state]", "[idx++]", "[++idx]", "[i++]", exact=True) & has("](", exact=True))
    | all_of("[keys[", "]](", exact=True),
    "dead_code_injection": DEAD.at_least(4) | (DEAD.at_least(2) & Rule(lambda t: DEAD.column(t) >= F.greatest(LIVE.column(t), F.lit(1)) * 0.3, f"({DEAD.sql} >= greatest({LIVE.sql}, 1) * 0.3)")),
    "array_rotation_decode": all_of(".push(", ".shift(", exact=True)
    & ((has("(function(", exact=True) & any_of("})(", "}(", exact=True) & any_of("0x", "while(--", "while (--)", "for(;--", exact=True)) | (any_of("[_0x", "[arr[", "[0x", "[0X", exact=True) & has("0x", exact=True))),
    "opaque_predicates": hits("Math.abs(", "Math.floor(", "Math.ceil(", "Math.random()").at_least(2) & count_of("if").at_least(5),
    "identifier_mangling": MANGLED.above(5) & NAMES.above(10) & Rule(lambda t: MANGLED.column(t) * 2 > NAMES.column(t), f"({MANGLED.sql} * 2 > {NAMES.sql})"),
    "font_exploitation": hits("FontMatrix", "CIDFont", "Type1Font", "TrueType", "FontFile", "FontDescriptor").at_least(2),
    "annotation_abuse": hits("getAnnots", "syncAnnotScan", ".subject", "addAnnot", "removeAnnot").at_least(2),
    "xfa_exploitation": has("XFA"),
    "dga_pattern": any_of("Math.random()", "getTime()", "getDate()") & any_of("String.fromCharCode", ".concat(") & any_of("http://", "https://"),
    "beaconing_pattern": hits("launchURL", "submitForm", "mailMsg", "getURL").at_least(3),
    "cryptomining_library": any_of("coinhive", "cryptonight", "crypto-loot", "CryptoLoot", "stratum+tcp", "xmr-stak", "monero"),
    "wasm_mining": hits("WebAssembly.instantiate", "WebAssembly.Module", "new Worker(", "SharedArrayBuffer", "Atomics.").at_least(2),
    "unicode_obfuscation": only_if(multibyte, octets().above(0)) & Rule(lambda t: F.octet_length(F.regexp_replace(t["text"], r"[\x00-\x7F]+", "")) * 10 > F.octet_length(t["text"]), r"(strlen(regexp_replace(text, '[\x00-\x7F]+', '', 'g')) * 10 > strlen(text))"),
    "rtl_override": has("‮", exact=True),
    "homoglyph_attack": only_if(multibyte, matches("[Ͱ-ӿ]")),
    "custom_decoder": has("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") | all_of("function", "fromCharCode", "split(") | (has("parseInt") & any_of(", 16", ",16")),
    "function_introspection": any_of("arguments.callee", "Function.toString()", ".toString.call(", "constructor.toString()"),
    "excessive_string_allocation": (LOOP & hits("new Array(", ".substring(", ".concat(", "while(", "for(").at_least(3)) | count_of('"').at_least(10),
    "infinite_loop_risk": ENDLESS | any_of("for(;;)", "for (;;)"),
    "memory_bomb": all_of("new Array(", "999999", exact=True) | (has(".push(") & LOOP) | all_of("obj[", "for(", "new Array("),
    "computational_bomb": (count_of("for(") + count_of("for (") + count_of("while(") + count_of("while (")).at_least(3) | all_of("for", "10000", exact=True),
    "recursive_bomb": count_of("function").above(3),
    "redos_pattern": any_of("(a+)+", "(a*)*", "(a|a)*", "(.*)*", "(.+)+"),
    "dom_xss_sink": any_of("document.write(", "document.writeln(", ".innerHTML =", ".outerHTML =", "insertAdjacentHTML("),
    "innerHTML_injection": has(".innerHTML") & any_of("<script", "<iframe", "onerror"),
    "prototype_pollution_gadget": any_of("__proto__", "constructor.prototype", "Object.prototype", "Array.prototype") & any_of(" = ", "]="),
    "prototype_chain_manipulation": has("getPrototypeOf") & any_of("constructor = null", "constructor=null", "constructor = undefined", "constructor=undefined"),
    "script_injection": SCRIPT_TAG & has(".appendChild("),
    "eval_sink": unquoted("eval(") | unquoted("Function(") | unquoted("setTimeout(") | unquoted("setInterval("),
    "angler_ek": ANGLER,
    "magnitude_ek": MAGNITUDE,
    "rig_ek": RIG,
    "exploit_kit_pattern": hits("exploit", "shellcode", "payload", "CVE-").at_least(2) | ANGLER | MAGNITUDE | RIG,
    "file_enumeration": any_of("readdir", "opendir", "listFiles", "getFiles") & any_of("forEach", "for("),
    "bulk_encryption": any_of("encrypt(", "crypto.encrypt", "subtle.encrypt", "AES", "RSA") & any_of("forEach", "for(", "while(") & has("file"),
    "ransom_note": hits("encrypted", "ransom", "bitcoin", "btc", "payment", "decrypt", "locked", "restore").at_least(3),
    "bitcoin_address": matches(r"(?:^|\s)(?:[13]|bc1)[1-9A-HJ-NP-Za-km-z]{23,89}(?:\s|$)") & Rule(
        lambda t: F.exists(F.split(t["text"], r"\s+"), lambda w: w.rlike("^(?:[13]|bc1)[1-9A-HJ-NP-Za-km-z]+$") & F.length(w).between(26, 90)),
        r"len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: regexp_matches(w, '^(?:[13]|bc1)[1-9A-HJ-NP-Za-km-z]+$') AND length(w) BETWEEN 26 AND 90)) > 0",
    )
    | only_if(marked("4"), words_where(lambda w: F.startswith(w, F.lit("4")) & (F.octet_length(w) == 95), "starts_with(w, '4') AND strlen(w) = 95").at_least(1)),
    "jit_spray": count_of("0x").at_least(10) | (any_of("eval(", "Function(") & has("for(")),
    "unicode_shellcode": count_of("\\u").at_least(20) & has("unescape"),
    "constant_spray": only_if(marked("0x"), words_where(lambda w: F.startswith(w, F.lit("0x")) & (F.octet_length(w) > 6), "starts_with(w, '0x') AND strlen(w) > 6").at_least(15)),
    "fingerprint_check": hits("navigator.userAgent", "navigator.language", "navigator.platform", "screen.width", "screen.height", "navigator.plugins").at_least(2) & has("if("),
    "timing_evasion": any_of("performance.now()", "Date.now()", "getTime()") & has("if(") & any_of(" < ", " > "),
    "interaction_required": any_of("onclick", "onmousemove", "onkeypress", "addEventListener"),
    "targeted_execution": any_of("getTimezoneOffset()", "navigator.language", "toLocaleDateString()") & all_of("if(", "=="),
    "localStorage_write": any_of("localStorage.setItem", "localStorage["),
    "cookie_manipulation": all_of("document.cookie", " = "),
    "global_pollution": any_of("window.", "globalThis.", "global.") & has(" = "),
    "history_manipulation": any_of("history.pushState", "history.replaceState", "window.location =", "location.replace("),
    "dynamic_import": any_of("import(", "require(", "importScripts("),
    "remote_script_load": SCRIPT_TAG & has(".src = ") & any_of("http://", "https://"),
    "suspicious_package": any_of("999.999", "9999.", "@internal", "@private", "@company", exact=True),
    "port_scan": LOOP & any_of("new Image()", "fetch(", "XMLHttpRequest", "WebSocket") & any_of(":8", "port"),
    "internal_probe": any_of("192.168.", "10.", "172.16.", "localhost", "127.0.0.1"),
    "dns_rebinding": any_of("fetch(", "XMLHttpRequest") & all_of("setTimeout", "if(", ".then("),
    "comment_payload": Rule(
        lambda t: (F.octet_length(F.regexp_extract(t["text"], r"(?s)(/\*.*?)\*/", 1)) > 100) & (F.length(F.regexp_replace(F.regexp_extract(t["text"], r"(?s)(/\*.*?)\*/", 1), r"[^\p{L}\p{N}]+", "")) > 80),
        r"(strlen(regexp_extract(text, '(?s)(/\*.*?)\*/', 1)) > 100 AND length(regexp_replace(regexp_extract(text, '(?s)(/\*.*?)\*/', 1), '[^\p{L}\p{N}]+', '', 'g')) > 80)",
    )
    | all_of(".toString()", "/*", "*/"),
    "zero_width_chars": any_of("​", "‌", "‍", "﻿", exact=True),
    "canvas_decode": DRAWING & all_of("getImageData(", ".data["),
    "polyglot_pdf": hits("%PDF-", "endobj", "stream", "endstream").at_least(2),
    "polyglot_html": hits("<!--", "-->", "<script", "<html", "<body").at_least(2),
    "canvas_fingerprint": DRAWING & any_of("fillText(", "strokeText(") & has("toDataURL()"),
    "webgl_fingerprint": any_of("getContext('webgl')", 'getContext("webgl")', "getContext('experimental-webgl')") & has("getParameter("),
    "font_enumeration": any_of("offsetWidth", "offsetHeight") & all_of("Arial", "Verdana") & any_of("for(", "forEach"),
    "obfuscation_suspected": BASE64 | (has("eval") & any_of("fromCharCode", "unescape")) | any_of("\\x", "\\u"),
}
DENSITIES: dict[str, Number] = {"string_concat_density": count_of("+"), "escape_density": count_of("\\")}


def _prepared(df: DataFrame, text_col: str, keys: list[str]) -> tuple[DataFrame, dict]:
    cols = inputs(F.col(text_col))
    names = {name: f"__in{i}" for i, name in enumerate(cols)}
    return spread(df.select(*keys, text_col)).select(*keys, *[c.alias(names[n]) for n, c in cols.items()]), {n: F.col(x) for n, x in names.items()}


def _densities(t: dict[str, Column]) -> list[Column]:
    size = F.octet_length(t["text"])
    return [F.when(size > 0, n.column(t) / size).otherwise(0.0).alias(name) for name, n in DENSITIES.items()]


def signal_flags(df: DataFrame, text_col: str, *keys: str) -> DataFrame:
    """One boolean column a signal, and the two densities."""
    ready, t = _prepared(df, text_col, list(keys))
    return ready.select(*keys, *[r.column(t).alias(name) for name, r in SIGNALS.items()], *_densities(t))


def text_densities(df: DataFrame, text_col: str, *keys: str) -> DataFrame:
    """keys and the densities alone: marks in question for each byte of text, 0 for an empty one."""
    ready, t = _prepared(df, text_col, list(keys))
    return ready.select(*keys, *_densities(t))


def text_signals(df: DataFrame, text_col: str, *keys: str) -> DataFrame:
    """keys, signal: the signals that each text shows, one row each."""
    flags = signal_flags(df, text_col, *keys)
    shown = F.array(*[F.when(F.col(name), F.lit(name)) for name in SIGNALS])
    return flags.select(*keys, F.explode(F.array_compact(shown)).alias("signal"))


def deleted_globals(df: DataFrame, text_col: str, *keys: str) -> DataFrame:
    """Names of the globals a text deletes."""
    ready, t = _prepared(df, text_col, list(keys))
    names = ["window", "document", "confirm", "alert", "Function", "eval"]
    return ready.select(*keys, F.array_compact(F.array(*[F.when(has(f"delete {n}").column(t), F.lit(n)) for n in names])).alias("deleted"))


def signals_sql(table: str, text: str, keys: str) -> str:
    """The same rows in SQL."""
    cells = ", ".join(f"CASE WHEN {r.sql} THEN '{name}' END" for name, r in SIGNALS.items())
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""WITH t AS (SELECT {keys}, coalesce({text}, '') AS text FROM {table}), l AS (SELECT *, {low} AS low FROM t),
s AS (SELECT {keys}, unnest([{cells}]) AS signal FROM l) SELECT {keys}, signal FROM s WHERE signal IS NOT NULL"""
