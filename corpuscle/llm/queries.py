"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm import clusters, decontam, langid, licenses, minhash, mixing, pii, quality, repair, sharding, suffix, topk, urlfilter
from corpuscle.session import read_table

URL_PREFIXES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
#: Names of link farms and trackers, tokens of addresses that lead to no text, and endings of files that hold none.
FARMS = ["spam-farm", "cheap-pills", "adult-x", "casino-win", "free-bets", "ads-track", "doubleclick", "adservice", "clickbank", "popads", "payday-loans", "replica-watches", "xxx-cams", "torrent-hub", "crypto-giveaway", "seo-boost", "link-exchange", "free-ringtones", "miracle-diet", "warez"]
ACTIONS = ["login", "signin", "signup", "register", "logout", "cart", "checkout", "wishlist", "captcha", "unsubscribe", "password-reset", "print-view", "share", "feed", "trackback", "xmlrpc", "wp-admin", "cgi-bin", "admin", "calendar"]
ENDINGS = ["jpg", "jpeg", "png", "gif", "svg", "webp", "ico", "bmp", "tiff", "mp3", "mp4", "avi", "mov", "mkv", "wav", "flac", "ogg", "webm", "zip", "gz", "bz2", "xz", "rar", "7z", "tar", "iso", "exe", "msi", "dmg", "apk", "deb", "rpm", "jar", "css", "js", "woff", "woff2", "ttf", "eot", "swf"]
PARAMETERS = ["sessionid", "phpsessid", "jsessionid", "sid", "replytocom", "utm_source", "gclid", "fbclid", "affid", "add-to-cart"]
URL_PATTERNS = [
    *[(f"^{name}^", "block") for name in FARMS],
    *[(f"/{name}^", "block") for name in ACTIONS],
    *[(f".{name}^", "block") for name in ENDINGS],
    *[(f"^{name}=", "block") for name in PARAMETERS],
    ("://blog.*/fr/*^page=2^", "block"),
    ("^casino-win.*/de/*.html^", "allow"),
    ("/robots.txt^", "allow"),
    ("/login^*^next=", "allow"),
    ("^calendar^*^event=", "allow"),
]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [urlfilter.prefix_rule(*r) for r in URL_PREFIXES] + [urlfilter.pattern_rule(*r) for r in URL_PATTERNS]
    return urlfilter.filter_urls(read_table(spark, sf_dir, "pages"), rules)


def op1_sql() -> str:
    """Every rule tried on every URL, without an index."""
    low = f"translate(url, '{urlfilter.UPPER}', '{urlfilter.LOWER}')"
    prefixes = sorted((urlfilter.prefix_rule(*r) for r in URL_PREFIXES), key=lambda r: -len(r.name))
    patterns = [urlfilter.pattern_rule(*r) for r in URL_PATTERNS]
    fits = lambda r: f"(host <> '' AND regexp_matches(host || path, '{r.regex}'))"
    named = lambda act: "".join(f" WHEN regexp_matches({low}, '{r.regex}') THEN '{r.name}'" for r in patterns if r.action == act)
    rule = "".join(f" WHEN {fits(r)} THEN '{r.name}'" for r in prefixes)
    action = "".join(f" WHEN '{r.name}' THEN '{r.action}'" for r in prefixes)
    return f"""
WITH cut AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{urlfilter.UPPER}', '{urlfilter.LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
ruled AS (SELECT page_id, host, path, CASE{rule} END AS rule, CASE{named('allow')} END AS allowed, CASE{named('block')} END AS blocked FROM parts)
SELECT page_id, host, path, rule, CASE rule{action} ELSE CASE WHEN blocked IS NOT NULL AND allowed IS NULL THEN 'block' ELSE 'allow' END END AS verdict,
  coalesce(allowed, blocked) AS pattern FROM ruled"""


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_table(read_table(spark, sf_dir, "documents"), mixing.MixSpec(repetition=1.25))


def _drawn(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 15) AS BIGINT)"


OP2_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce('s:' || source, 'null') AS k, {_drawn("'7'", "coalesce(CAST(doc_id AS VARCHAR), '-')", "coalesce(md5(text), '-')")} AS u,
  CAST(greatest(1, ceil(strlen(coalesce(text, '')) / 4.0)) AS BIGINT) AS tokens FROM documents),
s AS (SELECT k, CAST(sum(tokens) AS BIGINT) AS t FROM d GROUP BY k),
p AS (SELECT k, t, t / (SELECT CAST(sum(t) AS DOUBLE) FROM s) AS share, (SELECT CAST(sum(t) AS DOUBLE) FROM s) AS budget FROM s),
l AS (SELECT list(share ORDER BY t, k) AS shares FROM p),
bis AS (SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, shares FROM l
  UNION ALL SELECT i + 1, CASE WHEN good THEN lo ELSE mid END, CASE WHEN good THEN mid ELSE hi END, shares
  FROM (SELECT *, list_max(list_transform(shares, lambda x: power(x, mid - 1))) / list_sum(list_transform(shares, lambda x: power(x, mid))) <= 1.25 AS good
        FROM (SELECT *, (lo + hi) / 2 AS mid FROM bis WHERE i < 50))),
w AS (SELECT k, t, budget, round(power(share, hi) / list_sum(list_transform(shares, lambda x: power(x, hi))), 12) AS weight FROM p, bis WHERE i = 50),
o AS (SELECT k, weight, CAST(greatest(64, ceil(t / 16000000.0)) AS BIGINT) AS blocks, CAST(floor(weight * budget + 0.5) AS BIGINT) AS own, t FROM w),
b AS (SELECT d.*, weight, own, t, CAST(u % blocks AS INTEGER) AS block FROM d JOIN o USING (k)),
passes AS (SELECT k, own, t, unnest(range(1, CAST(ceil(own / t) AS BIGINT) + 1)) AS pass FROM o),
blocks AS (SELECT k, block, CAST(sum(tokens) AS BIGINT) AS bt FROM b GROUP BY ALL),
ranked AS (SELECT k, block, pass, bt, own - (pass - 1) * t AS have, row_number() OVER x AS rank, sum(bt) OVER x AS upto
  FROM (SELECT *, {_drawn("'7'", "k", "CAST(block AS VARCHAR)", "CAST(pass AS VARCHAR)")} AS draw FROM passes JOIN blocks USING (k)) WINDOW x AS (PARTITION BY k, pass ORDER BY draw, block)),
rows AS (SELECT doc_id, source, tokens, weight, pass, b.block, rank, upto - bt + sum(tokens) OVER (PARTITION BY b.k, b.block, pass ORDER BY u, doc_id, tokens ROWS UNBOUNDED PRECEDING) AS spent, have
  FROM b JOIN ranked ON b.k = ranked.k AND b.block = ranked.block WHERE upto - bt < have)
SELECT doc_id, source, tokens, weight, CAST(pass AS INTEGER) AS pass, block, CAST(rank AS INTEGER) AS block_rank FROM rows WHERE spent <= have"""


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_table(read_table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP5_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

def op6_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), words=2)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix.cut_repeats(read_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = F.crc32(F.col("doc_id").cast("string")) % 3
    scored = quality.score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), rest != 1)
    return scored.select("doc_id", (rest == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    found = langid.predict_language(read_table(spark, sf_dir, "documents"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster_vectors(read_table(spark, sf_dir, "embeddings"))


def op11_sql(k: int = 16, rounds: int = 3) -> str:
    """Every vector against every centroid in every round, without bounds."""
    steps = [f"""WITH v AS (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY h, q) - 1 AS c, q FROM (SELECT sha256('1:' || vec_id) AS h, q FROM v WHERE vec_id IS NOT NULL ORDER BY h, q LIMIT {k}))"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS (SELECT i, min(struct_pack(d := d, c := c)) AS best FROM (
    SELECT i, c, CAST(list_sum(list_transform(list_zip(v.q, c{r}.q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, c{r}) GROUP BY i)""")
        if r < rounds:
            steps.append(f"""s{r} AS (SELECT c, pos, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT best.c AS c, unnest(range(1, 65)) AS pos, unnest(q) AS x FROM a{r} JOIN v USING (i)) GROUP BY c, pos),
c{r + 1} AS (SELECT c, coalesce(f.q, c{r}.q) AS q FROM c{r} LEFT JOIN (SELECT c, list((s - ((s % n + n) % n)) // n ORDER BY pos) AS q FROM s{r} GROUP BY c) f USING (c))""")
    last = f"""SELECT vec_id, CAST(best.c AS INTEGER) AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{rounds}.q, ',')) AS centroid_sha256 FROM a{rounds} JOIN v USING (i) JOIN c{rounds} ON c{rounds}.c = best.c"""
    return ",\n".join(steps) + "\n" + last


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.damage_and_repair(read_table(spark, sf_dir, "conversations"))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return pii.find_pii(docs, pii.learnt(docs))


#: Every path of every conversation turn by turn, cheapest first, with its audit and its text; crc32 bit by bit.
OP12_SQL = """
WITH RECURSIVE named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
bits AS (SELECT *, list_reduce(list_transform(range(8 * length(name)), lambda k: (ascii(substr(name, k // 8 + 1, 1)) >> (k % 8)) & 1),
  lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1)), CAST(4294967295 AS BIGINT)) AS state FROM named),
drawn AS (SELECT conv_id, turn, role, text, xor(state, 4294967295) % 20 AS draw FROM bits),
damaged AS (SELECT conv_id, turn, CASE draw WHEN 4 THEN 'user' ELSE role END AS role, CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE draw WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM drawn WHERE draw <> 0),
placed AS (SELECT conv_id, turn, role, text, left(role, 1) AS initial, row_number() OVER w AS i, left(lag(role) OVER w, 1) AS before FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
judged AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
  WHEN regexp_matches(text, '[^.!?\\x20\\x09-\\x0D][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault FROM placed),
follows(place, initial, after) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
grown AS (SELECT 0 AS n, p AS place, p AS there, '' AS more, '' AS audit FROM unnest([0, 1, 2, 3]) t(p)
  UNION ALL SELECT n + 1, grown.place, after, more || chr(10) || CASE initial WHEN 'u' THEN 'user:' ELSE 'assistant:' END, audit || 'I' FROM grown JOIN follows ON follows.place = there AND initial <> 's' WHERE n < 2),
paths AS (SELECT conv_id, 0 AS i, 0 AS place, struct_pack(cost := 0, audit := '', said := '') AS best FROM judged WHERE i = 1
  UNION ALL SELECT conv_id, i, place, min(best) FROM (
    SELECT j.conv_id, j.i, CASE e.edit WHEN 'D' THEN there ELSE after END AS place, struct_pack(
        cost := best.cost + 5 * n + CASE e.edit WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN fault = 'truncated' AND e.edit <> 'D' THEN 5 ELSE 0 END, audit := best.audit || g.audit || e.edit,
        said := best.said || more || CASE e.edit WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || role || ':' || text ELSE chr(10) || CASE f.initial WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text END) AS best
    FROM paths p JOIN judged j ON j.conv_id IS NOT DISTINCT FROM p.conv_id AND j.i = p.i + 1 JOIN grown g ON g.place = p.place CROSS JOIN (VALUES ('K'), ('R'), ('D')) e(edit)
    LEFT JOIN follows f ON f.place = there AND e.edit <> 'D' AND CASE e.edit WHEN 'K' THEN f.initial = j.initial ELSE f.initial <> 's' END
    WHERE e.edit = 'D' OR (f.after IS NOT NULL AND fault NOT IN ('blank', 'duplicate'))) GROUP BY ALL),
ends AS (SELECT p.conv_id, min(struct_pack(cost := best.cost + 5 * n, audit := best.audit || g.audit, said := best.said || more)) AS best
  FROM paths p JOIN (SELECT conv_id, max(i) AS i FROM judged GROUP BY conv_id) l ON l.conv_id IS NOT DISTINCT FROM p.conv_id AND l.i = p.i JOIN grown g ON g.place = p.place WHERE there IN (0, 3) GROUP BY p.conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(e.best.cost, 0) AS BIGINT) AS cost, coalesce(e.best.audit, '') AS audit, sha256(coalesce(substr(e.best.said, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM o.conv_id"""


QUERIES = {"op1_url_filters": op1_url_filters, "op2_source_mixing": op2_source_mixing, "op3_sharding": op3_sharding, "op4_license_scan": op4_license_scan, "op5_exact_topk": op5_exact_topk, "op6_minhash_neardup": op6_minhash_neardup, "op7_suffix_dedup": op7_suffix_dedup, "op8_quality": op8_quality, "op9_decontamination": op9_decontamination, "op10_language_id": op10_language_id, "op11_centroids": op11_centroids, "op12_conversation_repair": op12_conversation_repair, "op13_pii": op13_pii}
SQL = {"op1_url_filters": op1_sql(), "op2_source_mixing": OP2_SQL, "op5_exact_topk": OP5_SQL, "op11_centroids": op11_sql(), "op12_conversation_repair": OP12_SQL}
