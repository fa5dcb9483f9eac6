"""Queries over packet views: selection, profiles, connection groups and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import net
from ..functions import payload as pay
from ..operators import profiles as ops
from ..operators import windows
from .adapters import P, packets, table, with_sql
from .registry import query


def ip_sql(c: str) -> str:
    return f"(CAST(split_part({c}, '.', 1) AS BIGINT) * 16777216 + CAST(split_part({c}, '.', 2) AS BIGINT) * 65536 + CAST(split_part({c}, '.', 3) AS BIGINT) * 256 + CAST(split_part({c}, '.', 4) AS BIGINT))"


def scope_sql(c: str) -> str:
    spans = " OR ".join(f"{ip_sql(c)} BETWEEN {a} AND {b}" for a, b in map(net._span, net.PRIVATE))
    return f"CASE WHEN {spans} THEN 'private' WHEN {ip_sql(c)} BETWEEN 3758096384 AND 4026531839 THEN 'multicast' ELSE 'public' END"


def service_sql(c: str) -> str:
    return f"CASE {c} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in net.SERVICES.items()) + " ELSE 'unknown' END"


def entropy_sql(c: str) -> str:
    """Entropy of a text's bytes, for texts of ASCII only."""
    return f"round(coalesce((SELECT -sum(n / t * log2(n / t)) FROM (SELECT count(*)::DOUBLE AS n, length({c})::DOUBLE AS t FROM (SELECT unnest(string_split({c}, '')) AS ch) WHERE ch <> '' GROUP BY ch)), 0), 9)"


# Payloads of the packet view repeat, so their entropy is worked out once for each.
C = f"""u AS (SELECT payload, {entropy_sql("payload")} AS entropy FROM (SELECT DISTINCT payload FROM p)),
c AS (SELECT p.*, u.entropy, coalesce(ts_us - lag(ts_us) OVER (PARTITION BY capture_id, src ORDER BY idx), 0) / 1000000.0::DOUBLE AS interval FROM p JOIN u USING (payload))"""


def candidates(spark, sf_dir):
    """The packet table with interval, entropy, address buckets and the payload's head."""
    return windows.intervals(packets(spark, sf_dir), ["capture_id", "src"], ["idx"]).withColumns({
        "entropy": F.round(pay.byte_entropy(F.col("payload")), 9),
        "src_bucket": net.ip_bucket(F.col("src")), "dst_bucket": net.ip_bucket(F.col("dst")), "head": pay.hex_head(F.col("payload")),
    })


@query("s4_packet_table", with_sql(P, C) + """ SELECT capture_id, idx, ts_us, src, dst, port, size, interval, entropy,
  CAST(CAST('0x' || substr(md5(src), 1, 8) AS BIGINT) % 10000 AS INTEGER) AS src_bucket, CAST(CAST('0x' || substr(md5(dst), 1, 8) AS BIGINT) % 10000 AS INTEGER) AS dst_bucket, substr(lower(hex(payload)), 1, 40) AS head FROM c""")
def s4(spark, sf_dir):
    return candidates(spark, sf_dir).select("capture_id", "idx", "ts_us", "src", "dst", "port", "size", "interval", "entropy", "src_bucket", "dst_bucket", "head")


@query("w1_interval", with_sql(P, C) + " SELECT idx, interval FROM c")
def w1(spark, sf_dir):
    return candidates(spark, sf_dir).select("idx", "interval")


@query("p2_port_filter", with_sql(P) + " SELECT idx FROM p WHERE (src_port IN (443, 80, 502) OR dst_port IN (443, 80, 502)) AND NOT (src_port = 80 OR dst_port = 80)")
def p2(spark, sf_dir):
    return ops.filter_ports(packets(spark, sf_dir), include=(443, 80, 502), exclude=(80,)).select("idx")


@query("p3_protocol_filter", with_sql(P) + " SELECT idx, port FROM p WHERE proto = 17")
def p3(spark, sf_dir):
    return ops.filter_protocol(packets(spark, sf_dir), "udp").select("idx", "port")


@query("p5_control_flow_filter", with_sql(P) + """, f AS (SELECT src_port, dst_port, count(*) AS n FROM p GROUP BY ALL HAVING count(*) >= 12 AND dst_port = 502), m AS (SELECT p.*, f.n FROM p LEFT JOIN f USING (src_port, dst_port)), k AS (SELECT capture_id, count(n) AS hits FROM m GROUP BY 1)
SELECT idx FROM m JOIN k USING (capture_id) WHERE n IS NOT NULL OR hits = 0""")
def p5(spark, sf_dir):
    own = packets(spark, sf_dir)
    flows = own.groupBy("src_port", "dst_port").count().where("count >= 12 AND dst_port = 502")
    return ops.control_packets(own, flows).select("idx")


@query("p6_direction", with_sql(P) + f" SELECT idx, CASE WHEN src IN ('10.0.0.7', '10.0.0.8') THEN 'up' WHEN dst IN ('10.0.0.7', '10.0.0.8') THEN 'down' WHEN {ip_sql('src')} < {ip_sql('dst')} THEN 'up' ELSE 'down' END AS way FROM p")
def p6(spark, sf_dir):
    return packets(spark, sf_dir).select("idx", ops.direction(F.col("src"), F.col("dst"), ["10.0.0.7", "10.0.0.8"]).alias("way"))


@query("p7_signed_direction", with_sql(P) + " SELECT idx, CASE WHEN src = (SELECT arg_min(src, idx) FROM p q WHERE q.capture_id = p.capture_id) THEN 1 ELSE -1 END AS sign FROM p")
def p7(spark, sf_dir):
    return ops.signed_direction(packets(spark, sf_dir)).select("idx", "sign")


@query("p8_length_mode", with_sql(P) + " SELECT idx, size AS packet, size - 14 AS ip, size - 34 AS transport, greatest(size - 34 - CASE WHEN proto = 6 THEN 20 ELSE 8 END, 0) AS payload FROM p")
def p8(spark, sf_dir):
    size = F.col("size")
    return packets(spark, sf_dir).select("idx", size.alias("packet"), (size - 14).alias("ip"), (size - 34).alias("transport"), F.greatest(size - 34 - F.when(F.col("proto") == 6, 20).otherwise(8), F.lit(0)).alias("payload"))


@query("p10_keep_columns", with_sql(P) + " SELECT idx, size, 0.0::DOUBLE AS iat_mean, port FROM p")
def p10(spark, sf_dir):
    return ops.keep_columns(packets(spark, sf_dir), ["idx", "size", "iat_mean", "port"])


@query("p1_feature_selection", with_sql(P, C) + " SELECT idx, size, interval, entropy FROM c")
def p1(spark, sf_dir):
    return ops.choose_features(candidates(spark, sf_dir), " ", ("size", "interval", "entropy", "port"), ("size", "interval", "entropy"), keep=("idx",))


@query("p13_public_addresses", with_sql(P) + f" SELECT dst, count(*) AS n FROM p WHERE {scope_sql('dst')} = 'public' GROUP BY dst")
def p13(spark, sf_dir):
    return packets(spark, sf_dir).where(net.ip_scope(F.col("dst")) == "public").groupBy("dst").agg(F.count(F.lit(1)).alias("n"))


@query("f7_ip_number", with_sql(P) + f" SELECT DISTINCT src, {ip_sql('src')} AS n, src AS again, upper(lpad(to_hex({ip_sql('src')}), 8, '0')) AS hex8 FROM p")
def f7(spark, sf_dir):
    n = net.ip_to_long(F.col("src"))
    return packets(spark, sf_dir).select("src").distinct().select("src", n.alias("n"), net.long_to_ip(n).alias("again"), F.lpad(F.hex(n), 8, "0").alias("hex8"))


@query("f8_scope", with_sql(P) + f" SELECT DISTINCT dst, {scope_sql('dst')} AS scope FROM p")
def f8(spark, sf_dir):
    return packets(spark, sf_dir).select("dst", net.ip_scope(F.col("dst")).alias("scope")).distinct()


@query("f9_location", """SELECT c_custkey, concat_ws(' ', trim(c_mktsegment), trim(n_name), nullif(trim(r_name), 'ASIA')) AS place FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def f9(spark, sf_dir):
    own = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return own.select("c_custkey", net.location(F.col("c_mktsegment"), F.col("n_name"), F.when(F.col("r_name") == "ASIA", "-").otherwise(F.col("r_name"))).alias("place"))


@query("f10_lenient_numbers", """SELECT event_id, coalesce(TRY_CAST(trim(t) AS DOUBLE), 0) AS d, CAST(trunc(coalesce(TRY_CAST(trim(t) AS DOUBLE), 0)) AS BIGINT) AS i FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN ' ' || value WHEN 1 THEN '' WHEN 2 THEN event_type ELSE CAST(-user_id AS VARCHAR) END AS t FROM events)""")
def f10(spark, sf_dir):
    m = F.col("event_id") % 4
    own = table(spark, sf_dir, "events").select("event_id", F.when(m == 0, F.concat(F.lit(" "), F.col("value").cast("string"))).when(m == 1, "").when(m == 2, F.col("event_type")).otherwise((-F.col("user_id")).cast("string")).alias("t"))
    return own.select("event_id", net.lenient_double(F.col("t")).alias("d"), net.lenient_int(F.col("t")).alias("i"))


@query("j2_service_lookup", with_sql(P) + f" SELECT port, {service_sql('port')} AS service, count(*) AS n FROM p GROUP BY ALL")
def j2(spark, sf_dir):
    return packets(spark, sf_dir).groupBy("port").agg(F.count(F.lit(1)).alias("n")).withColumn("service", net.service_name(F.col("port")))


@query("a1_capture_health", with_sql(P) + f""" SELECT capture_id, count(*) AS packets, sum(size)::BIGINT AS bytes, min(ts_us) AS first_us, max(ts_us) AS last_us, (max(ts_us) - min(ts_us)) / 1000000.0::DOUBLE AS duration_s, count(*) FILTER (proto = 6) AS tcp, count(*) FILTER (proto = 17) AS udp,
  count(*) FILTER ({scope_sql('dst')} = 'multicast') AS multicast, count(*) FILTER (dst LIKE '%.255') AS broadcast, sum(strlen(payload))::BIGINT AS payload_bytes, count(*) FILTER (strlen(payload) = 0) AS empty, count(DISTINCT src) AS sources, count(DISTINCT dst) AS destinations,
  {", ".join(f"count(*) FILTER (src_port = {q} OR dst_port = {q}) AS port_{q}" for q in (53, 123, 443, 1900))} FROM p GROUP BY capture_id""")
def a1(spark, sf_dir):
    return ops.capture_health(packets(spark, sf_dir))


@query("a2_size_distribution", with_sql(P) + """ SELECT capture_id, l[1] AS min, m AS mean, median, l[least(CAST(floor(len(l) * 0.9) AS BIGINT), len(l) - 1) + 1] AS p90, l[least(CAST(floor(len(l) * 0.99) AS BIGINT), len(l) - 1) + 1] AS p99, l[-1] AS max
FROM (SELECT capture_id, list(size ORDER BY size) AS l, avg(size) AS m, quantile_cont(size, 0.5)::DOUBLE AS median FROM p GROUP BY 1)""")
def a2(spark, sf_dir):
    return ops.size_distribution(packets(spark, sf_dir), "capture_id")


@query("a3_top_talkers", with_sql(P) + " SELECT src, dst, sum(size)::BIGINT AS bytes, count(*) AS packets FROM p GROUP BY ALL ORDER BY bytes DESC, src, dst LIMIT 20")
def a3(spark, sf_dir):
    return ops.top_talkers(packets(spark, sf_dir), ["src", "dst"], 20)


_PROFILE = f"""SELECT ip, {scope_sql('ip')} AS scope, count(*) AS count, count(*) FILTER (role = 's') AS observed_as_src, count(*) FILTER (role = 'd') AS observed_as_dst,
  coalesce(array_to_string(list_sort(list(DISTINCT port) FILTER (role = 'd')), ', '), '-') AS ports FROM (SELECT src AS ip, 's' AS role, port FROM p UNION ALL SELECT dst, 'd', port FROM p) GROUP BY ip"""


@query("a4_address_profile", with_sql(P) + " " + _PROFILE)
def a4(spark, sf_dir):
    return ops.address_profile(packets(spark, sf_dir))


@query("a5_port_profile", with_sql(P) + f" SELECT port, {service_sql('port')} AS service, count(*) AS count, array_to_string(list_sort(list(DISTINCT src))[:10], ', ') AS src_ips, array_to_string(list_sort(list(DISTINCT dst))[:10], ', ') AS dst_ips FROM p GROUP BY port")
def a5(spark, sf_dir):
    return ops.port_profile(packets(spark, sf_dir))


G = f"""g AS (SELECT src, dst, count(*) AS count, list_sort(list(DISTINCT port)) AS ports, min(size) AS size_min, max(size) AS size_max, max(entropy) AS entropy_max, max(interval) AS interval_max,
  count(DISTINCT port)::INTEGER AS port_count, list_sort(list_distinct(list({service_sql('port')}) FILTER ({service_sql('port')} <> 'unknown'))) AS services, {scope_sql('dst')} AS scope, dst = '10.0.0.5' AS is_target FROM c GROUP BY src, dst),
v AS (SELECT *, CASE WHEN dst = '239.255.255.250' OR list_contains(ports, 1900) THEN 'ssdp' WHEN dst = '224.0.0.251' OR list_contains(ports, 5353) THEN 'mdns' WHEN scope = 'multicast' THEN 'multicast' WHEN dst LIKE '%.255' THEN 'broadcast' WHEN port_count >= 10 THEN 'port scan' END AS reason FROM g),
j AS (SELECT *, coalesce(reason = 'port scan', false) AS is_risk, CASE reason WHEN 'ssdp' THEN 0.97 WHEN 'mdns' THEN 0.97 WHEN 'multicast' THEN 0.9 WHEN 'broadcast' THEN 0.82 WHEN 'port scan' THEN 0.85 ELSE 0.5 END::DOUBLE AS confidence, CASE WHEN reason IS NULL THEN 'default' ELSE 'rule' END AS verdict_source FROM v)"""


def groups(spark, sf_dir):
    return ops.connection_groups(candidates(spark, sf_dir), "10.0.0.5")


@query("a6_connection_groups", with_sql(P, C, G) + " SELECT * FROM g")
def a6(spark, sf_dir):
    return groups(spark, sf_dir)


@query("a7_group_hints", with_sql(P, C, G) + """ SELECT src, dst, list_filter([CASE WHEN is_target THEN 'target' END, CASE WHEN port_count >= 5 THEN 'many_ports' END, CASE WHEN scope = 'public' THEN 'public' END, CASE WHEN entropy_max >= 7 THEN 'high_entropy' END, CASE WHEN size_max <= 80 THEN 'small_packets' END, CASE WHEN list_contains(ports, 53) THEN 'dns' END], lambda x: x IS NOT NULL) AS hints FROM g""")
def a7(spark, sf_dir):
    return ops.group_hints(groups(spark, sf_dir)).select("src", "dst", "hints")


@query("a8_rule_verdict", with_sql(P, C, G) + " SELECT src, dst, is_risk, confidence, verdict_source, reason FROM j")
def a8(spark, sf_dir):
    return ops.final_verdict(ops.rule_verdict(groups(spark, sf_dir))).select("src", "dst", "is_risk", "confidence", "verdict_source", "reason")


@query("a9_judge_summary", with_sql(P, C, G) + """ SELECT count(*) AS total_groups, sum(count)::BIGINT AS total_candidates, count(*) FILTER (is_risk) AS risk_groups, count(*) FILTER (NOT is_risk) AS benign_groups, coalesce(sum(count) FILTER (is_risk), 0)::BIGINT AS risk_packets, coalesce(sum(count) FILTER (NOT is_risk), 0)::BIGINT AS benign_packets,
  count(*) FILTER (verdict_source = 'rule') AS rule_decided, count(*) FILTER (verdict_source = 'external') AS external_decided, bool_or(is_risk) AS overall_risk FROM j""")
def a9(spark, sf_dir):
    return ops.judge_summary(ops.final_verdict(ops.rule_verdict(groups(spark, sf_dir))))


@query("j15_external_verdicts", with_sql(P, C, G) + """, x AS (SELECT src, dst, count % 2 = 0 AS is_risk, 0.6::DOUBLE AS confidence FROM g WHERE count % 3 = 0)
SELECT v.src, v.dst, CASE WHEN v.reason IS NOT NULL THEN v.reason = 'port scan' ELSE coalesce(x.is_risk, false) END AS is_risk, CASE WHEN v.reason IS NOT NULL THEN 'rule' WHEN x.is_risk IS NOT NULL THEN 'external' ELSE 'default' END AS verdict_source FROM v LEFT JOIN x USING (src, dst)""")
def j15(spark, sf_dir):
    own = groups(spark, sf_dir)
    external = own.where("count % 3 = 0").select("src", "dst", (F.col("count") % 2 == 0).alias("is_risk"), F.lit(0.6).alias("confidence"))
    return ops.final_verdict(ops.rule_verdict(own), external).select("src", "dst", "is_risk", "verdict_source")


@query("t2_group_order", with_sql(P, C, G) + " SELECT src, dst, port_count, count FROM g ORDER BY port_count DESC, is_target DESC, count DESC, src, dst LIMIT 40")
def t2(spark, sf_dir):
    return ops.order_groups(groups(spark, sf_dir)).select("src", "dst", "port_count", "count")


@query("a11_histogram", """WITH b AS (SELECT min(value) AS lo, (max(value) - min(value)) / 28 AS w FROM events), n AS (SELECT least(CAST(floor((value - lo) / w) AS INTEGER), 27) AS bin, count(*) AS n FROM events, b GROUP BY 1)
SELECT CAST(i AS INTEGER) AS bin, lo + w * (i + 0.5) AS center, coalesce(n, 0) AS n FROM b, range(28) r(i) LEFT JOIN n ON n.bin = i""")
def a11(spark, sf_dir):
    return ops.histogram(table(spark, sf_dir, "events"), "value")


@query("a12_edge_histogram", "SELECT CASE WHEN v < 50 THEN 0 WHEN v < 60 THEN 1 WHEN v < 70 THEN 2 WHEN v < 80 THEN 3 WHEN v < 90 THEN 4 WHEN v < 95 THEN 5 ELSE 6 END AS bin, count(*) AS n FROM (SELECT floor(value / 4) AS v FROM events) WHERE v >= 0 AND v < 100 GROUP BY 1")
def a12(spark, sf_dir):
    own = table(spark, sf_dir, "events").select(F.floor(F.col("value") / 4).alias("v"))
    return ops.edge_histogram(own, "v", [0, 50, 60, 70, 80, 90, 95, 100])


@query("p9_anomaly_filter", with_sql(P) + " SELECT idx, size FROM p WHERE size > 1400 AND dst = '8.8.8.8'")
def p9(spark, sf_dir):
    own = packets(spark, sf_dir).withColumn("label", F.when(F.col("size") > 1400, -1).otherwise(1))
    return own.where((F.col("label") == -1) & (F.col("dst") == "8.8.8.8")).select("idx", "size")


@query("a10_anomaly_summary", with_sql(P) + " SELECT count(*) AS total, count(*) FILTER (size > 1400) AS abnormal, avg(CAST(size > 1400 AS DOUBLE)) AS ratio, avg(size) AS mean_score FROM p")
def a10(spark, sf_dir):
    return ops.anomaly_summary(packets(spark, sf_dir).withColumn("label", F.when(F.col("size") > 1400, -1).otherwise(1)), score="size")


@query("t1_lowest_scores", with_sql(P) + " SELECT idx, -size AS score FROM p WHERE size > 1000 ORDER BY score, idx LIMIT 100")
def t1(spark, sf_dir):
    return packets(spark, sf_dir).where("size > 1000").select("idx", (-F.col("size")).alias("score")).orderBy("score", "idx").limit(100)


@query("t5_input_cap", with_sql(P) + " SELECT idx, src FROM p WHERE idx <= 500")
def t5(spark, sf_dir):
    return packets(spark, sf_dir).where("idx <= 500").select("idx", "src")


@query("a17_local_addresses", with_sql(P) + " SELECT ip, count(*) AS n FROM (SELECT src AS ip FROM p WHERE idx <= 5000 UNION ALL SELECT dst FROM p WHERE idx <= 5000) WHERE ip LIKE '10.%' OR ip LIKE '192.168.%' OR ip LIKE '172.%' GROUP BY ip ORDER BY n DESC, ip LIMIT 3")
def a17(spark, sf_dir):
    return ops.local_addresses(packets(spark, sf_dir))


@query("a18_control_flows", with_sql(P) + " SELECT src_port, dst_port, count(*) AS packets, count(*) FILTER (size > 200) AS valid FROM p GROUP BY ALL HAVING count(*) FILTER (size > 200) >= 5 AND count(*) FILTER (size > 200) >= 0.9 * count(*)")
def a18(spark, sf_dir):
    return ops.control_flows(packets(spark, sf_dir), F.col("size") > 200, least=5, share=0.9)


@query("s20_merge_captures", with_sql(P) + " SELECT idx, ts_us FROM p WHERE capture_id = 1 UNION ALL SELECT idx, ts_us + 5000000 FROM p WHERE capture_id = 2")
def s20(spark, sf_dir):
    own = packets(spark, sf_dir)
    return ops.merge_captures(own.where("capture_id = 1"), own.where("capture_id = 2"), 5_000_000).select("idx", "ts_us")


@query("u3_port_overlap", with_sql(P) + " SELECT idx FROM p WHERE list_has_any([src_port, dst_port], [53, 443, 1883])")
def u3(spark, sf_dir):
    return packets(spark, sf_dir).where(F.arrays_overlap(F.array("src_port", "dst_port"), F.array(F.lit(53), F.lit(443), F.lit(1883)))).select("idx")


@query("j14_enrichment", """WITH c AS (SELECT c_custkey, c_nationkey, c_acctbal FROM customer), o AS (SELECT o_custkey, count(*) AS seen FROM orders GROUP BY 1)
SELECT c_custkey, coalesce(seen, 0) AS seen, n_name AS country, concat_ws(',', CASE WHEN c_acctbal < 0 THEN 'debt' END, CASE WHEN coalesce(seen, 0) = 0 THEN 'silent' END) AS tags, CASE WHEN n_name IS NULL THEN 'unknown' ELSE 'ok' END AS status FROM c LEFT JOIN o ON o_custkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey""")
def j14(spark, sf_dir):
    seen = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("seen"))
    own = table(spark, sf_dir, "customer").join(seen, F.col("c_custkey") == F.col("o_custkey"), "left").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    n = F.coalesce("seen", F.lit(0))
    return own.select("c_custkey", n.alias("seen"), F.col("n_name").alias("country"), F.concat_ws(",", F.when(F.col("c_acctbal") < 0, "debt"), F.when(n == 0, "silent")).alias("tags"), F.when(F.col("n_name").isNull(), "unknown").otherwise("ok").alias("status"))
