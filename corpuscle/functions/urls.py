"""URL parts, flags and risk as struct columns. Built-in functions only; no strict URL parser, malformed input keeps its pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.operators.ranks import numbered

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed values.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "fbclid", "gclid", "mc_cid", "mc_eid", "_ga", "ref", "referer"]
EXFIL_NAMES = ["data", "payload", "info", "d", "p", "content"]
SUSPICIOUS_TLDS = ["tk", "ml", "ga", "cf", "gq", "zip", "mov"]
KEYWORDS = ["login", "signin", "verify", "update", "secure", "account", "billing", "password"]
CREDENTIALS = ["email", "user", "username", "password"]
SHORTENERS = [
    "bit.ly", "t.co", "tinyurl.com", "goo.gl", "ow.ly", "is.gd", "buff.ly", "adf.ly", "bit.do", "cutt.ly",
    "rebrand.ly", "shorturl.at", "tiny.cc", "t.ly", "rb.gy", "lnkd.in", "linktr.ee", "short.io", "tiny.one",
]
EXTENSIONS = ["exe", "scr", "js", "vbs", "vbe", "bat", "cmd", "ps1", "psm1", "msi", "jar", "dll", "com", "chm", "lnk", "url", "hta", "reg", "zip", "rar", "7z", "iso", "img"]
SCHEMES = [
    "ms-word", "ms-excel", "ms-powerpoint", "ms-msdt", "itms-services", "intent", "ms-settings", "ms-officeapp", "ms-outlook",
    "ms-access", "ms-publisher", "ms-visio", "ms-people", "ms-contacts", "ms-cxh", "ms-windows-store",
]
BYTE = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|0*[1-9]?[0-9])"


def low(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def blank_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def canonical_uri(u: Column) -> Column:
    """Only the scheme (text before the first colon) is lower-cased."""
    at = F.instr(u, ":")
    return F.when(at > 0, F.concat(low(F.substring(u, F.lit(1), at - 1)), F.substring(u, at, F.length(u)))).otherwise(u)


def deobfuscate(u: Column) -> Column:
    """hxxp, bracketed colons and dots undone."""
    out = F.regexp_replace(u, "(?i)^hxxp", "http")
    for old, new in (("[:]//", "://"), ("[.]", "."), ("(.)", ".")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def extract_domain(u: Column) -> Column:
    """What follows an optional http(s) up to ``/`` or ``:``; not validated."""
    return blank_null(F.regexp_extract(F.trim(u), "^(?:https?://)?([^/:]*)", 1))


def is_valid_domain(d: Column) -> Column:
    """Labels of letters, digits and inner hyphens, a top level of two letters or more, at most 253 characters."""
    return F.coalesce((F.length(d) <= 253) & d.rlike(r"^(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,63}$"), F.lit(False))


def query_params(query: Column) -> Column:
    """Pairs in order, split on ``&`` and the first ``=``; duplicates stay."""
    pairs = F.when(query == "", F.array().cast("array<string>")).otherwise(F.split(query, "&"))
    cut = lambda p: F.instr(p, "=")
    return F.transform(
        pairs,
        lambda p: F.struct(
            F.when(cut(p) > 0, F.substring(p, F.lit(1), cut(p) - 1)).otherwise(p).alias("key"), F.when(cut(p) > 0, F.substring(p, cut(p) + 1, F.length(p))).otherwise("").alias("value")
        ),
    )


def with_url_parts(df: DataFrame, url_col: str, out: str = "u") -> DataFrame:
    """Adds a struct: scheme, host, port, userinfo, path, query. A fragment stays in path or query."""
    u = F.col(url_col)
    at = F.instr(u, ":")
    scheme = F.when(at > 0, F.substring(u, F.lit(1), at - 1)).otherwise("http")
    rest = F.when(at > 0, F.substring(u, at + 1, F.length(u))).otherwise(u)
    step = df.withColumns({"__s": low(scheme), "__r": rest})
    opaque = F.col("__s").isin("javascript", "data")
    body = F.when(opaque, F.col("__r")).when(F.col("__s") == "mailto", F.regexp_extract("__r", r"^([^?]*)", 1)).otherwise(F.regexp_extract("__r", r"^/*([^?]*)", 1))
    query = F.when(opaque, "").otherwise(F.regexp_extract("__r", r"(?s)^[^?]*\?(.*)$", 1))
    step = step.withColumns({"__b": body, "__q": query})
    web = ~F.col("__s").isin("javascript", "data", "mailto", "file")
    authority = F.when(web, F.regexp_extract("__b", "^([^/]*)", 1))
    path = F.when(web, blank_null(F.regexp_extract("__b", r"(?s)^[^/]*(/.*)$", 1))).when(F.col("__s") == "file", F.concat(F.lit("/"), F.col("__b"))).otherwise(F.col("__b"))
    step = step.withColumns({"__a": authority, "__p": path})
    host_port = F.trim(F.regexp_replace("__a", "(?s)^.*@", ""))
    step = step.withColumn("__h", host_port)
    bracket = F.regexp_extract("__h", r"^\[([^\]]*)\]", 1)
    with_port = F.col("__h").rlike(r"^.+:[0-9]+$")
    host = F.when(F.startswith("__h", F.lit("[")), bracket).when(with_port, F.regexp_extract("__h", r"^(.+):[0-9]+$", 1)).otherwise(F.col("__h"))
    port = F.when(F.startswith("__h", F.lit("[")), F.regexp_extract("__h", r"\]:([0-9]+)$", 1)).otherwise(F.regexp_extract("__h", r"^.+:([0-9]+)$", 1)).try_cast("int")
    made = F.struct(
        F.col("__s").alias("scheme"),
        blank_null(F.regexp_replace(host, r"\.+$", "")).alias("host"),
        F.when(port <= 65535, port).alias("port"),
        F.coalesce(F.contains("__a", F.lit("@")), F.lit(False)).alias("userinfo"),
        F.col("__p").alias("path"),
        F.col("__q").alias("query"),
    )
    return step.withColumn(out, made).drop("__s", "__r", "__b", "__q", "__a", "__p", "__h")


def _base64_like(v: Column) -> Column:
    size = F.octet_length(v)
    return (size > 30) & (F.length(F.regexp_replace(v, r"[^\p{L}\p{N}+/=]", "")) > size * 0.9)


def with_url_flags(df: DataFrame, url_col: str, parts: str = "u", out: str = "f") -> DataFrame:
    """Adds a struct of content flags to a row that has its parts."""
    u, p = F.col(url_col), F.col(parts)
    host, path = F.coalesce(p["host"], F.lit("")), F.coalesce(p["path"], F.lit(""))
    step = df.withColumns({"__params": query_params(p["query"]), "__host": low(host), "__path": low(path)})
    params, host_low, path_low = F.col("__params"), F.col("__host"), F.col("__path")
    octets = F.octet_length(u)
    percent = F.when(octets > 0, (octets - F.octet_length(F.replace(u, F.lit("%"), F.lit("")))) / octets).otherwise(0.0)
    encoded = F.exists(params, lambda x: _base64_like(x["value"]))
    escapes = F.contains(u, F.lit("\\u")) | F.contains(u, F.lit("%u"))
    obfuscation = F.when(escapes | (encoded & (percent > 0.2)), "heavy").when((percent > 0.3) | encoded, "medium").when(percent > 0.1, "light").otherwise("none")
    ip = host.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$") | (~host.rlike(r"^[^.]*\.[^.]*\.[^.]*\.[^.]*$") & F.contains(host, F.lit(":")))
    embedded = F.exists(F.split(host, r"\."), lambda x: x.rlike(rf"^{BYTE}(?:-{BYTE}){{3}}$"))
    idn = (F.octet_length(host) > F.length(host)) & host.rlike("[A-Za-z]")
    tld = F.lower(host).rlike(r"\.(?:" + "|".join(SUSPICIOUS_TLDS) + ")$")
    web_port = F.coalesce(p["port"].isNotNull() & ~p["port"].isin(80, 443), F.lit(False))
    long_values = F.size(F.filter(params, lambda x: F.octet_length(x["value"]) > 50))
    exfil = (F.size(params) >= 3) & ((long_values > 3) | ((F.size(params) > 5) & (long_values > 1)))
    step = step.withColumn(
        "__patterns",
        F.array_compact(F.array(
            F.when(octets > 500, F.lit("extremely_long_url")),
            F.when(F.size(params) > 10, F.lit("many_parameters")),
            F.when(F.exists(params, lambda x: low(x["key"]).isin(EXFIL_NAMES)), F.lit("suspicious_param_names")),
            F.when(F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) > 2, F.lit("many_subdomains")),
            F.when(F.contains(host_low, F.lit("xn--")), F.lit("punycode_domain")),
            F.when(embedded, F.lit("embedded_ip")),
            F.when(idn, F.lit("idn_lookalike")),
        )),
    )
    patterns = F.col("__patterns")
    words = "|".join(KEYWORDS)
    phishing = F.array_sort(F.array_compact(F.array(
        F.when(p["userinfo"], F.lit("userinfo_in_url")),
        F.when(ip, F.lit("ip_address")),
        F.when(tld, F.lit("suspicious_tld")),
        F.when(web_port, F.lit("non_standard_port")),
        F.when(host_low.rlike(words) | path_low.rlike(words), F.lit("credential_keyword")),
        F.when(F.exists(params, lambda x: low(x["key"]).isin(CREDENTIALS)), F.lit("credential_param")),
        *[F.when(F.array_contains(patterns, n), F.lit(n)) for n in ("punycode_domain", "many_subdomains", "embedded_ip", "idn_lookalike")],
        F.when(F.contains(u, F.lit("@")), F.lit("at_symbol")),
    )))
    data = p["scheme"] == "data"
    flags = F.struct(
        F.size(params).alias("params"),
        F.transform(F.filter(params, lambda x: low(x["key"]).isin(TRACKING)), lambda x: x["key"]).alias("tracking"),
        obfuscation.alias("obfuscation"),
        ip.alias("ip_host"),
        tld.alias("suspicious_tld"),
        web_port.alias("odd_port"),
        exfil.alias("exfil_pattern"),
        host_low.rlike(r"(?:^|\.)(?:" + "|".join(s.replace(".", r"\.") for s in SHORTENERS) + ")$").alias("shortener"),
        path_low.rlike(r"\.(?:" + "|".join(EXTENSIONS) + ")$").alias("suspicious_extension"),
        p["scheme"].isin(SCHEMES).alias("suspicious_scheme"),
        embedded.alias("embedded_ip"),
        idn.alias("idn_lookalike"),
        patterns.alias("patterns"),
        phishing.alias("phishing"),
        F.when(data, blank_null(F.regexp_extract(path, "^([^;,]*)", 1))).alias("data_mime"),
        F.coalesce(data & F.contains(low(F.regexp_extract(path, "^([^,]*)", 1)), F.lit("base64")), F.lit(False)).alias("data_base64"),
        F.when(data, F.octet_length(F.regexp_extract(path, r"(?s)^[^,]*,(.*)$", 1))).alias("data_length"),
    )
    return step.withColumn(out, flags).drop("__params", "__host", "__path", "__patterns")


def url_risk(parts: Column, flags: Column, extra: Column | None = None) -> Column:
    """Additive score of the content flags; ``extra`` carries visibility and trigger terms where a table has them."""
    yes = lambda c, n: F.when(c, n).otherwise(0)
    level = F.when(flags["obfuscation"] == "heavy", 50).when(flags["obfuscation"] == "medium", 30).when(flags["obfuscation"] == "light", 10).otherwise(0)
    data = parts["scheme"] == "data"
    terms = [
        level, yes(parts["scheme"] == "javascript", 70), yes(parts["scheme"] == "file", 40), yes(data, 50), yes(flags["data_base64"], 20),
        yes(F.coalesce(flags["data_length"], F.lit(0)) > 512, 15), yes(flags["ip_host"], 20), yes(flags["suspicious_tld"], 30), yes(flags["exfil_pattern"], 60),
        yes(flags["odd_port"], 15), yes(flags["suspicious_extension"], 20), yes(flags["shortener"], 15), yes(flags["suspicious_scheme"], 35),
        yes(flags["embedded_ip"], 20), yes(flags["idn_lookalike"], 15), yes(F.size(flags["phishing"]) > 0, 25), yes(F.size(flags["patterns"]) > 0, 20),
    ]
    total = F.lit(0) if extra is None else extra
    for t in terms:
        total = total + t
    return total


def risk_severity(score: Column) -> Column:
    return F.when(score <= 20, "info").when(score <= 50, "low").when(score <= 80, "medium").otherwise("high")


def risk_confidence(score: Column) -> Column:
    return F.when(score <= 20, "weak").when(score <= 50, "tentative").when(score <= 80, "probable").otherwise("strong")


def scored_urls(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Rows with parts ``u``, flags ``f``, ``score``, ``severity`` and ``confidence``."""
    flagged = with_url_flags(with_url_parts(df, url_col), url_col)
    scored = flagged.withColumn("score", url_risk(F.col("u"), F.col("f")))
    return scored.withColumns({"severity": risk_severity(F.col("score")), "confidence": risk_confidence(F.col("score"))})


#: Bands of a document's URL and domain counts.
URL_BANDS, DOMAIN_BANDS = (50, 25, 10), (20, 10, 5)


def url_presence(df: DataFrame, url_col: str = "url") -> DataFrame:
    """For each document: URLs, domains, suspicious ones and the worse of the volume band and the worst URL."""
    scored = scored_urls(df, url_col)
    rank = F.when(F.col("severity") == "high", 3).when(F.col("severity") == "medium", 2).when(F.col("severity") == "low", 1).otherwise(0)
    out = scored.groupBy("doc").agg(
        F.count("*").alias("urls"),
        F.count_distinct("u.host").alias("domains"),
        F.count_if(F.col("severity") != "info").alias("suspicious"),
        F.count_if(F.col("u.scheme") == "https").alias("https"),
        F.max(rank).alias("worst"),
    )
    band = F.lit(0)
    for i, (a, b) in enumerate(zip(reversed(URL_BANDS), reversed(DOMAIN_BANDS), strict=True), 1):
        band = F.when((F.col("urls") >= a) | (F.col("domains") >= b), i).otherwise(band)
    return out.withColumn("severity", F.element_at(F.array(*map(F.lit, ["info", "low", "medium", "high"])), F.greatest("worst", band) + 1))


def top_urls(df: DataFrame, n: int = 50, url_col: str = "url") -> DataFrame:
    """The n worst URLs of each document, ties by canonical form."""
    scored = scored_urls(df, url_col).withColumn("canonical", canonical_uri(F.col(url_col)))
    order = Window.partitionBy("doc").orderBy(F.desc("score"), "canonical")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def extract_intents(findings: DataFrame, bare_domains: bool = False, undo: bool = True) -> DataFrame:
    """doc, url, domain from action and script metadata; the first finding of a URL names it."""
    wanted = F.map_filter("meta", lambda k, _: k.isin("action.target", "supply_chain.action_targets") | k.startswith("js."))
    values = findings.select("doc", "seq", F.explode(F.map_values(wanted)).alias("v"))
    words = values.select("doc", "seq", F.explode(F.split("v", r"[\s,;]+")).alias("w"))
    token = F.regexp_replace("w", r"""^["'<>()\[\]{}.;:]+|["'<>()\[\]{}.;:]+$""", "")
    urls = words.select("doc", "seq", (deobfuscate(token) if undo else token).alias("url"))
    good = F.col("url").rlike("(?i)^https?://")
    if bare_domains:
        good = good | is_valid_domain(F.col("url"))
    return urls.filter(good).groupBy("doc", "url").agg(F.min("seq").alias("seq")).select("doc", "url", extract_domain(F.col("url")).alias("domain"))


def campaigns(intents: DataFrame, least: int = 2, size: int = 1000) -> DataFrame:
    """Domains that occur in ``least`` documents or more, with their sorted documents in pages of ``size``: id, domain, page (from 0), docs.

    Documents are numbered block by block, so no row or task holds all documents of a domain.
    """
    pairs = intents.filter("domain is not null and doc is not null").select("domain", "doc").distinct()
    often = pairs.groupBy("domain").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("domain")
    placed = numbered(pairs.join(often, "domain", "left_semi"), ("domain",), ("doc",), "place")
    paged = placed.groupBy("domain", F.floor(F.col("place") / size).cast("int").alias("page")).agg(F.array_sort(F.collect_list("doc")).alias("docs"))
    return paged.select(F.concat(F.lit("campaign:"), F.col("domain")).alias("id"), "domain", "page", "docs")


def c2_domains(intents: DataFrame, distinct: bool = True) -> DataFrame:
    found = intents.filter(F.contains("domain", F.lit(".onion")) | F.contains("domain", F.lit("pastebin"))).select("domain")
    return found.distinct() if distinct else found
