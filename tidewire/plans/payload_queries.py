"""Queries of payload features, rules, score fusion and tokens over the texts of documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import payload as pay
from ..functions import rules as ops
from ..operators import detect
from .adapters import L, P, packets, payloads, table, with_sql
from .registry import query

# The bytes of a text as numbers, and one row for each.
_B = """b AS (SELECT origin, id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS INTEGER)) AS y FROM l),
e AS (SELECT origin, id, unnest(y) AS v FROM b)"""


def rounded(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("f1_byte_entropy", with_sql(L, _B) + ", n AS (SELECT origin, id, v, count(*)::DOUBLE AS c FROM e GROUP BY ALL), t AS (SELECT origin, id, -sum(c / s * log2(c / s)) AS h FROM (SELECT *, sum(c) OVER (PARTITION BY origin, id) AS s FROM n) GROUP BY 1, 2) SELECT l.origin, l.id, round(coalesce(h, 0), 6) AS entropy FROM l LEFT JOIN t USING (origin, id)")
def f1(spark, sf_dir):
    return payloads(spark, sf_dir).select("origin", "id", F.round(pay.byte_entropy(F.col("text")), 6).alias("entropy"))


@query("f3_byte_statistics", with_sql(L, _B) + """ SELECT origin, id, len(y)::DOUBLE AS length, round(ln(len(y) + 1), 6) AS log_length, round(coalesce(list_avg(y), 0), 6) AS mean, round(coalesce(list_stddev_pop(y), 0), 6) AS std, coalesce(list_min(y), 0)::DOUBLE AS min, coalesce(list_max(y), 0)::DOUBLE AS max, coalesce(list_median(y), 0)::DOUBLE AS median, len(list_distinct(y))::DOUBLE AS unique,
  round(coalesce(len(list_filter(y, lambda v: v = 0)) / nullif(len(y), 0), 0), 6) AS null_ratio, round(coalesce(len(list_filter(y, lambda v: v BETWEEN 32 AND 126)) / nullif(len(y), 0), 0), 6) AS printable_ratio, round(coalesce(len(list_filter(y, lambda v: v < 128)) / nullif(len(y), 0), 0), 6) AS ascii_ratio FROM b""")
def f3(spark, sf_dir):
    own = payloads(spark, sf_dir)
    return rounded(own.select("origin", "id", *[v.alias(k) for k, v in pay.byte_statistics(F.col("text")).items()]))


@query("f4_text_statistics", with_sql(L) + """ SELECT origin, id, length(text)::DOUBLE AS length, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))::DOUBLE AS words, round(coalesce(len(regexp_extract_all(text, '[A-Z]')) / nullif(length(text), 0), 0), 6) AS upper_ratio, round(coalesce(len(regexp_extract_all(text, '[a-z]')) / nullif(length(text), 0), 0), 6) AS lower_ratio, round(coalesce(len(regexp_extract_all(text, '[0-9]')) / nullif(length(text), 0), 0), 6) AS digit_ratio,
  CAST(contains(lower(text), 'script') AS INTEGER) AS has_script, CAST(contains(lower(text), 'select') AS INTEGER) AS has_select, len(list_distinct(list_transform(range(1, greatest(length(text) - 1, 1)), lambda i: substr(text, i, 3))))::DOUBLE AS distinct_ngrams FROM l""".replace("\\\\", "\\"))
def f4(spark, sf_dir):
    stats = pay.text_statistics(F.col("text"))
    return rounded(payloads(spark, sf_dir).select("origin", "id", *[stats[k].alias(k) for k in ("length", "words", "upper_ratio", "lower_ratio", "digit_ratio", "has_script", "has_select", "distinct_ngrams")]))


@query("f5_frequency_moments", with_sql(L, _B) + """, c AS (SELECT origin, id, v, count(*)::DOUBLE AS n FROM e GROUP BY ALL), f AS (SELECT origin, id, r.v, coalesce(n, 0) AS n FROM (SELECT origin, id, g.v FROM l, range(256) g(v)) r LEFT JOIN c USING (origin, id, v)), q AS (SELECT origin, id, n / greatest(sum(n) OVER (PARTITION BY origin, id), 1) AS x FROM f), m AS (SELECT origin, id, avg(x) AS a FROM q GROUP BY 1, 2)
SELECT origin, id, round(sqrt(avg((x - a) ** 2)), 9) AS frequency_std, round(coalesce(avg((x - a) ** 3) / nullif(pow(sqrt(avg((x - a) ** 2)), 3), 0), 0), 6) AS frequency_skew FROM q JOIN m USING (origin, id) GROUP BY 1, 2""")
def f5(spark, sf_dir):
    m = pay.frequency_moments(F.col("text"))
    return payloads(spark, sf_dir).select("origin", "id", F.round(m["frequency_std"], 9).alias("frequency_std"), F.round(m["frequency_skew"], 6).alias("frequency_skew"))


@query("w17_longest_byte_run", with_sql(L, _B) + ", i AS (SELECT origin, id, unnest(y) AS v, generate_subscripts(y, 1) AS p FROM b), g AS (SELECT origin, id, v, p - row_number() OVER (PARTITION BY origin, id, v ORDER BY p) AS d FROM i), n AS (SELECT origin, id, max(c)::INTEGER AS most FROM (SELECT origin, id, v, d, count(*) AS c FROM g GROUP BY ALL) GROUP BY 1, 2) SELECT l.origin, l.id, coalesce(most, 0) AS most FROM l LEFT JOIN n USING (origin, id)")
def w17(spark, sf_dir):
    return payloads(spark, sf_dir).select("origin", "id", pay.longest_run(F.col("text")).alias("most"))


@query("f2_hex_head", with_sql(L) + " SELECT origin, id, substr(lower(hex(encode(text))), 1, 40) AS head FROM l")
def f2(spark, sf_dir):
    return payloads(spark, sf_dir).select("origin", "id", pay.hex_head(F.col("text")).alias("head"))


@query("f17_hex_chunks", with_sql(L) + " SELECT origin, id, regexp_extract_all(lower(hex(encode(text))), '.{1,8}') AS chunks FROM l")
def f17(spark, sf_dir):
    return payloads(spark, sf_dir).select("origin", "id", pay.hex_chunks(F.col("text")).alias("chunks"))


@query("f32_hex_pairs", with_sql(L) + " SELECT origin, id, array_to_string(regexp_extract_all(rpad(substr(lower(hex(encode(text))), 1, 128), 128, '0'), '..'), ' ') AS pairs FROM l")
def f32(spark, sf_dir):
    return payloads(spark, sf_dir).select("origin", "id", pay.hex_pairs(F.col("text"), 64).alias("pairs"))


@query("f33_byte_tokens", with_sql(L, _B) + " SELECT origin, id, list_resize(list_concat([4], list_transform(y[1:62], lambda v: least(v + 6, 255)), [5]), 64, 0) AS ids, list_sum(list_transform(list_resize(list_concat([4], y[1:62], [5]), 64, NULL), lambda v: CASE WHEN v IS NULL THEN 0 ELSE 1 END))::BIGINT AS used FROM b")
def f33(spark, sf_dir):
    t = pay.byte_tokens(F.col("text"), 64)
    return payloads(spark, sf_dir).select("origin", "id", t["ids"].alias("ids"), F.aggregate(t["mask"], F.lit(0).cast("long"), lambda a, x: a + x).alias("used"))


# --- rules and fusion ------------------------------------------------------------------------------------------------
# Each origin's protocol; conditions on fields that texts lack never hold.
_PROTOCOLS = {"document": "udp", "page": "http", "turn": "mqtt"}
_PROTOCOL_SQL = "CASE origin WHEN 'document' THEN 'udp' WHEN 'page' THEN 'http' ELSE 'mqtt' END"


def _rule_sql() -> str:
    rows = []
    for i, r in enumerate(ops.RULES):
        pattern = r.pattern.replace("'", "''")
        hit = "true" if r.pattern == ".*" else f"regexp_matches(text, '(?is){pattern}')"
        holds = {"": "true", "len(payload) > 100": "length(text) > 100", "len(payload) > 268435455": "length(text) > 268435455", "protocol == 'udp' and len(payload) > 1000": "origin = 'document' AND length(text) > 1000"}.get(r.condition, "false")
        count = "least(len(regexp_extract_all(text, '[^\n]+')) + length(text) - length(replace(text, chr(10), '')) + 1, 5)" if r.pattern == ".*" else f"least(len(regexp_extract_all(text, '(?i){pattern}')), 5)"
        named = f"CASE WHEN contains('{r.description.lower()}', {_PROTOCOL_SQL}) THEN 0.1 ELSE 0 END"
        rows.append(f"SELECT origin, id, {i} AS i, '{r.id}' AS rule_id, '{r.severity}' AS severity, {ops.SEVERITIES[r.severity]} AS level, round(least(1.0, 0.5 + 0.2 * {count} / 5 + {0.3 if r.condition else 0.0} + {named}), 6)::DOUBLE AS confidence FROM l WHERE {hit} AND {holds}")
    return "h AS (" + "\nUNION ALL ".join(rows) + ")"


_R = _rule_sql()
_D = """d AS (SELECT l.origin, l.id, length(text) AS n, coalesce(max(CASE severity WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.8 WHEN 'medium' THEN 0.5 WHEN 'low' THEN 0.2 END), 0.0)::DOUBLE AS rule, count(rule_id) AS hits FROM l LEFT JOIN h USING (origin, id) GROUP BY l.origin, l.id, text),
f AS (SELECT *, n % 100 / 100.0::DOUBLE AS c, n % 37 / 37.0::DOUBLE AS q, n % 11 / 11.0::DOUBLE AS a FROM d),
g AS (SELECT *, rule * 0.25 + c * 0.30 + q * 0.30 + a * 0.15 AS score, (rule + c + q + a) / 4 AS m FROM f),
s AS (SELECT *, CASE WHEN score >= 0.8 THEN 'CRITICAL' WHEN score >= 0.6 THEN 'HIGH' WHEN score >= 0.4 THEN 'MEDIUM' WHEN score >= 0.2 THEN 'LOW' ELSE 'SAFE' END AS threat_level, 0.6 / (1 + ((rule - m) ** 2 + (c - m) ** 2 + (q - m) ** 2 + (a - m) ** 2) / 4) + 0.4 * least(hits / 3, 1) AS confidence FROM g)"""


def matched(spark, sf_dir, rules=ops.RULES):
    protocol = F.coalesce(*[F.when(F.col("origin") == k, F.lit(v)) for k, v in _PROTOCOLS.items()])
    return ops.match_rules(payloads(spark, sf_dir).withColumn("protocol", protocol), "text", rules, "protocol")


def detected(spark, sf_dir):
    """Rules, and three stand-in model scores that follow the text's length, fused."""
    n = F.length("text")
    return ops.fuse_scores(matched(spark, sf_dir), n % 100 / 100.0, n % 37 / 37.0, n % 11 / 11.0)


@query("f18_rule_matches", with_sql(L, _R) + " SELECT l.origin, l.id, coalesce(list(rule_id ORDER BY level DESC, i) FILTER (rule_id IS NOT NULL), []) AS rules FROM l LEFT JOIN h USING (origin, id) GROUP BY 1, 2")
def f18(spark, sf_dir):
    return matched(spark, sf_dir).select("origin", "id", F.col("matches.rule_id").alias("rules"))


@query("f19_match_confidence", with_sql(L, _R) + " SELECT origin, id, rule_id, confidence FROM h")
def f19(spark, sf_dir):
    return matched(spark, sf_dir).select("origin", "id", F.explode("matches").alias("m")).select("origin", "id", "m.rule_id", "m.confidence")


@query("f21_score_fusion", with_sql(L, _R, _D) + " SELECT origin, id, round(score, 6) AS final_score, threat_level, round(confidence, 6) AS confidence FROM s")
def f21(spark, sf_dir):
    return detected(spark, sf_dir).select("origin", "id", F.round("final_score", 6).alias("final_score"), "threat_level", F.round("fused_confidence", 6).alias("confidence"))


@query("f22_three_threshold_decision", with_sql(L, _R, _D) + " SELECT origin, id, CASE WHEN rule >= 0.8 OR c >= 0.7 OR 0.4 * rule + 0.3 * c + 0.3 * q >= 0.75 THEN 'MALICIOUS' WHEN 0.4 * rule + 0.3 * c + 0.3 * q >= 0.375 THEN 'SUSPICIOUS' ELSE 'NORMAL' END AS decision FROM s")
def f22(spark, sf_dir):
    n = F.length("text")
    return detected(spark, sf_dir).select("origin", "id", ops.three_threshold_decision(F.col("rule_score"), n % 100 / 100.0, n % 37 / 37.0).alias("decision"))


@query("a34_detection_summary", with_sql(L, _R, _D) + " SELECT count(*) AS packets, round(avg(score), 6) AS mean_score, round(avg(CAST(threat_level <> 'SAFE' AS DOUBLE)), 6) AS unsafe_ratio, round(avg(CAST(threat_level IN ('HIGH', 'CRITICAL') AS DOUBLE)), 6) AS high_ratio, sum(hits)::BIGINT AS rule_hits, arg_min(id, (-score, id)) AS max_key, round(max(score), 6) AS max_score FROM s")
def a34(spark, sf_dir):
    return ops.detection_summary(detected(spark, sf_dir), "id")


@query("a34_threat_levels", with_sql(L, _R, _D) + " SELECT origin, threat_level, count(*) AS n FROM s GROUP BY ALL")
def a34b(spark, sf_dir):
    return detected(spark, sf_dir).groupBy("origin", "threat_level").agg(F.count(F.lit(1)).alias("n"))


@query("a34_top_rules", with_sql(L, _R) + " SELECT rule_id, count(*) AS hits FROM h GROUP BY 1 ORDER BY hits DESC, rule_id LIMIT 10")
def a34c(spark, sf_dir):
    return ops.top_rules(matched(spark, sf_dir))


@query("x16_batch_detection")
def x16(spark, sf_dir):
    """Rules, feature rows, a classifier fitted on the documents labelled toxic or not, an isolation forest, and their fusion, over all payloads."""
    own = matched(spark, sf_dir).withColumn("key", F.concat_ws(":", "origin", "id"))
    labels = table(spark, sf_dir, "labels").select(F.concat(F.lit("document:"), F.col("doc_id").cast("string")).alias("key"), (F.col("toxic") > 0).cast("double").alias("label"))
    headers = F.create_map(F.lit("User-Agent"), F.col("origin"))
    row = pay.feature_row(F.col("text"), F.col("text"), F.col("protocol"), {"src_port": F.octet_length("text") % 65536, "dst_port": F.lit(80), "request_line": F.substring_index("text", "\n", 1), "headers": headers, "body": F.col("text"), "mqtt_remaining_len": F.octet_length("text")})
    found = detect.detect(own, "key", lambda df: df.withColumns({f"f_{k}": v for k, v in row.items()}), [f"f_{k}" for k in row], labels)
    return found.select("origin", "id", F.size("matches").cast("long").alias("hits"), F.round("proba", 6).alias("proba"), "anomaly", F.round("final_score", 6).alias("final_score"), "threat_level")


@query("f43_feature_row", with_sql(L, _B) + """ SELECT l.origin, l.id, strlen(text)::DOUBLE AS byte_length, round(coalesce(list_avg(y), 0), 6) AS byte_mean, len(list_distinct(y))::DOUBLE AS byte_unique, CASE WHEN l.origin = 'document' THEN (strlen(text) % 1000)::DOUBLE ELSE 0 END AS udp_sport, CASE WHEN l.origin = 'page' AND starts_with(text, 'GET') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS http_method_get, CASE WHEN l.origin = 'page' THEN length(text)::DOUBLE ELSE 0 END AS http_body_len,
CASE WHEN l.origin = 'page' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS http_has_user_agent, CASE WHEN l.origin = 'turn' THEN strlen(text)::DOUBLE ELSE 0 END AS mqtt_remaining_len, 0.0::DOUBLE AS protocol_unknown, length(text)::DOUBLE AS text_length, CAST(contains(lower(text), 'system') AS DOUBLE) AS text_has_system, greatest(length(text) - 1, 0)::DOUBLE AS text_ngrams FROM l JOIN b USING (origin, id) WHERE text IS NOT NULL""")
def f43(spark, sf_dir):
    own = matched(spark, sf_dir).where("text IS NOT NULL")
    raw, text = pay.coerced(F.col("text"), "string")
    row = pay.feature_row(raw, text, F.col("protocol"), {"src_port": F.octet_length("text") % 1000, "request_line": F.col("text"), "headers": F.create_map(F.lit("User-Agent"), F.col("origin")), "body": F.col("text"), "mqtt_remaining_len": F.octet_length("text")})
    kept = ["byte_length", "byte_mean", "byte_unique", "udp_sport", "http_method_get", "http_body_len", "http_has_user_agent", "mqtt_remaining_len", "protocol_unknown", "text_length", "text_has_system", "text_ngrams"]
    return rounded(own.select("origin", "id", *[row[k].alias(k) for k in kept]))


@query("f6_tcp_flags", with_sql(P) + " SELECT idx, " + ", ".join(f"CASE WHEN proto = 6 AND contains(['S', 'SA', 'A', 'PA', 'FA', 'R', 'UP'][k % 7 + 1], '{f}') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS tcp_flag_{f.lower()}" for f in pay.TCP_FLAGS) + ", CASE WHEN proto = 6 THEN dst_port::DOUBLE ELSE 0 END AS tcp_dport, CASE WHEN proto = 17 THEN dst_port::DOUBLE ELSE 0 END AS udp_dport FROM p")
def f6(spark, sf_dir):
    flags = F.element_at(F.array(*map(F.lit, ["S", "SA", "A", "PA", "FA", "R", "UP"])), F.col("k") % 7 + 1)
    row = pay.protocol_features(F.when(F.col("proto") == 6, "tcp").otherwise("udp"), {"src_port": F.col("src_port"), "dst_port": F.col("dst_port"), "flags": flags})
    return packets(spark, sf_dir).select("idx", *[row[k].alias(k) for k in (*(f"tcp_flag_{f.lower()}" for f in pay.TCP_FLAGS), "tcp_dport", "udp_dport")])


@query("f42_level_names", with_sql(L, _R, _D) + " SELECT origin, id, CASE threat_level WHEN 'SAFE' THEN '正常' WHEN 'LOW' THEN '低风险异常' WHEN 'MEDIUM' THEN '可疑载荷' WHEN 'HIGH' THEN '高危载荷' WHEN 'CRITICAL' THEN '严重载荷' END AS name, round(confidence * 100, 4) AS confidence FROM s")
def f42(spark, sf_dir):
    return detected(spark, sf_dir).select("origin", "id", pay.level_name(F.lower("threat_level")).alias("name"), F.round(pay.percent(F.col("fused_confidence")), 4).alias("confidence"))


@query("x24_verdict_codes", with_sql(L, _R, _D) + ", v AS (SELECT CASE WHEN rule >= 0.8 OR c >= 0.7 OR 0.4 * rule + 0.3 * c + 0.3 * q >= 0.75 THEN 2 WHEN 0.4 * rule + 0.3 * c + 0.3 * q >= 0.375 THEN 1 ELSE 0 END AS code, CASE origin WHEN 'page' THEN 2 ELSE 0 END AS truth FROM s) SELECT code, truth, count(*) AS n FROM v GROUP BY ALL")
def x24(spark, sf_dir):
    n = F.length("text")
    decision = ops.three_threshold_decision(F.col("rule_score"), n % 100 / 100.0, n % 37 / 37.0)
    codes = F.coalesce(*[F.when(decision == k, F.lit(v)) for k, v in (("NORMAL", 0), ("SUSPICIOUS", 1), ("MALICIOUS", 2))], F.lit(3))
    return detected(spark, sf_dir).select(codes.alias("code"), F.when(F.col("origin") == "page", 2).otherwise(0).alias("truth")).groupBy("code", "truth").agg(F.count(F.lit(1)).alias("n"))


@query("j1_signature_lookup", with_sql(P) + ", g AS (SELECT payload, min(kind) AS action FROM p WHERE direction = 'up' GROUP BY payload) SELECT idx, action FROM p JOIN g USING (payload)")
def j1(spark, sf_dir):
    own = packets(spark, sf_dir)
    signatures = own.where("direction = 'up'").groupBy("payload").agg(F.min("kind").alias("action"))
    return own.join(signatures, "payload").select("idx", "action")


@query("a21_signature_mining", with_sql(P) + """, f AS (SELECT kind AS label, capture_id AS file, payload, count(*) AS n FROM p GROUP BY ALL), g AS (SELECT label, payload, count(*) AS files, quantile_cont(n, 0.5)::DOUBLE AS median FROM f GROUP BY 1, 2), t AS (SELECT kind AS label, count(DISTINCT capture_id) AS total FROM p GROUP BY 1)
SELECT label, payload, files, median FROM (SELECT g.*, row_number() OVER (PARTITION BY label ORDER BY files DESC, median, payload) AS r FROM g JOIN t USING (label) WHERE files >= 0.6 * total AND median <= 4) WHERE r = 1""")
def a21(spark, sf_dir):
    own = packets(spark, sf_dir)
    per = own.groupBy(F.col("kind").alias("label"), "capture_id", "payload").agg(F.count(F.lit(1)).alias("n"))
    found = per.groupBy("label", "payload").agg(F.count(F.lit(1)).alias("files"), F.percentile("n", F.lit(0.5)).alias("median"))
    total = own.groupBy(F.col("kind").alias("label")).agg(F.countDistinct("capture_id").alias("total"))
    best = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("files"), "median", "payload"))
    return found.join(F.broadcast(total), "label").where("files >= 0.6 * total AND median <= 4").withColumn("r", best).where("r = 1").select("label", "payload", "files", "median")


@query("f20_rule_selection", with_sql(L) + """ SELECT rule_id, count(*) AS hits FROM (SELECT 'xss_onload' AS rule_id FROM l WHERE regexp_matches(text, '(?is)on(load|error)') UNION ALL SELECT 'sql_injection' FROM l WHERE regexp_matches(text, '(?is)(select|union|insert|update|delete|drop|create|alter).*from.*where') UNION ALL SELECT 'xss_script' FROM l WHERE regexp_matches(text, '(?is)<script[^>]*>.*</script>')
UNION ALL SELECT 'path_traversal' FROM l WHERE regexp_matches(text, '(?is)(\\.\\./|\\.\\.|%2e%2e/|%2e%2e%5c)') UNION ALL SELECT 'mail_address' FROM l WHERE regexp_matches(text, '(?is)[a-z0-9.]+@[a-z0-9]+')) GROUP BY 1""".replace("\\\\", "\\"))
def f20(spark, sf_dir):
    """The web rules of high severity, one changed, one added and one removed, applied to all payloads."""
    changes = [ops.Rule("xss_onload", r"on(load|error)", "high", "web"), ops.Rule("mail_address", r"[a-z0-9.]+@[a-z0-9]+", "high", "web")]
    own = ops.selected(ops.RULES, changes, removed=("file_inclusion",), category="web", severity="high")
    return matched(spark, sf_dir, own).select(F.explode("matches.rule_id").alias("rule_id")).groupBy("rule_id").agg(F.count(F.lit(1)).alias("hits"))


@query("f37_unified_status", with_sql(P) + """, r AS (SELECT capture_id, avg(CAST(size > 1400 AS DOUBLE)) AS side, avg(CAST(k > 90 AS DOUBLE)) * 100 AS pay FROM p GROUP BY 1), s AS (SELECT capture_id, CASE WHEN side >= 0.15 THEN 'ANOMALY' WHEN side >= 0.05 THEN 'UNKNOWN' WHEN side > 0 THEN 'TOLERATED' ELSE 'NORMAL' END AS a, CASE WHEN pay > 20 THEN 'ANOMALY' WHEN pay > 5 THEN 'UNKNOWN' WHEN pay > 0 THEN 'TOLERATED' ELSE 'NORMAL' END AS b FROM r)
SELECT capture_id, a AS side, b AS payload, CASE WHEN 'ANOMALY' IN (a, b) THEN 'ANOMALY' WHEN 'UNKNOWN' IN (a, b) THEN 'UNKNOWN' WHEN 'TOLERATED' IN (a, b) THEN 'TOLERATED' ELSE 'NORMAL' END AS overall FROM s""")
def f37(spark, sf_dir):
    own = packets(spark, sf_dir).groupBy("capture_id").agg(F.avg((F.col("size") > 1400).cast("double")).alias("s"), (F.avg((F.col("k") > 90).cast("double")) * 100).alias("p"))
    band = lambda c, high, mid, strict: F.when(c > high if strict else c >= high, "ANOMALY").when(c > mid if strict else c >= mid, "UNKNOWN").when(c > 0, "TOLERATED").otherwise("NORMAL")
    side, pay_ = band(F.col("s"), 0.15, 0.05, False), band(F.col("p"), 20, 5, True)
    either = lambda v: F.array_contains(F.array("side", "payload"), v)
    out = own.select("capture_id", side.alias("side"), pay_.alias("payload"))
    return out.withColumn("overall", F.when(either("ANOMALY"), "ANOMALY").when(either("ERROR"), "UNKNOWN").when(either("UNKNOWN"), "UNKNOWN").when(either("TOLERATED"), "TOLERATED").otherwise("NORMAL"))


_F41 = """b AS (SELECT idx, CASE WHEN k > 66 THEN kind END AS payload, CASE WHEN size > 700 THEN direction END AS traffic, dst AS motion, CASE WHEN k % 2 = 0 THEN 'ANOMALY' ELSE 'NORMAL' END AS status, CASE WHEN idx % 3 > 0 THEN src END AS signal, value / 500 AS sure FROM p),
f AS (SELECT *, coalesce(payload, traffic, motion) AS label0, CASE WHEN payload IS NOT NULL OR traffic IS NOT NULL THEN 'NORMAL' ELSE status END AS status0, CASE WHEN payload IS NOT NULL THEN 'amnar_payload_primary' WHEN traffic IS NOT NULL THEN 'traffic_profile_fallback' ELSE 'motion_only' END AS reason0 FROM b)"""


@query("f41_branch_fusion", with_sql(P, _F41) + """ SELECT idx, CASE WHEN signal IS NOT NULL AND sure >= 0.5 THEN signal ELSE label0 END AS primary_label, CASE WHEN signal IS NOT NULL AND sure >= 0.5 THEN 'NORMAL' ELSE status0 END AS primary_status, CASE WHEN signal IS NOT NULL AND sure >= 0.5 THEN 'signal_primary' ELSE reason0 END AS primary_reason,
label0 AS disagree_label, CASE WHEN signal IS NOT NULL AND sure >= 0.5 AND signal <> motion THEN 'ANOMALY' ELSE status0 END AS disagree_status, CASE WHEN signal IS NOT NULL AND sure >= 0.5 AND signal <> motion THEN 'signal_disagrees_with_motion' ELSE reason0 END AS disagree_reason, CASE WHEN signal IS NOT NULL THEN 'reported_side_by_side' ELSE reason0 END AS report_reason FROM f""")
def f41(spark, sf_dir):
    own = packets(spark, sf_dir).select("idx", F.when(F.col("k") > 66, F.col("kind")).alias("payload"), F.when(F.col("size") > 700, F.col("direction")).alias("traffic"), F.col("dst").alias("motion"), F.when(F.col("k") % 2 == 0, "ANOMALY").otherwise("NORMAL").alias("status"), F.when(F.col("idx") % 3 > 0, F.col("src")).alias("signal"), (F.col("value") / 500).alias("sure"))
    out = {}
    for mode, name in (("signal_primary", "primary"), ("disagree", "disagree"), ("report", "report")):
        found = ops.fuse_branches(F.col("payload"), F.col("traffic"), F.col("motion"), F.col("status"), F.col("signal"), F.col("sure"), mode, 0.5)
        out |= {f"{name}_{k}": v for k, v in found.items() if name != "report" or k == "reason"}
    return own.select("idx", *[v.alias(k) for k, v in out.items()])
