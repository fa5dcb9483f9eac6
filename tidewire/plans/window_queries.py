"""Queries of the time series operators over the packet view; gaps there are minutes, so times are parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profiles, windows as ops
from ..sources.capture import control_status, control_type
from .adapters import P, packets, table, with_sql
from .registry import query
from .source_queries import _CTL, control_packets

MINUTE = 60_000_000
FLOW = "least(src, dst) || '|' || greatest(src, dst)"
FEATURES = ["iat_mean", "iat_std", "iat_cv", "direction_balance", "burst_intensity", "periodicity_score", "size_cv"]

# Each packet's last 20 of its flow as a list, so that the statement follows the definition and not the frames.
_TRAIL = f"""q AS (SELECT idx, list(ts_us) OVER w AS t, list(size) OVER w AS z, list(direction) OVER w AS d FROM (SELECT *, {FLOW} AS flow FROM p) WINDOW w AS (PARTITION BY capture_id, flow ORDER BY ts_us, idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
r AS (SELECT *, len(t) AS n, [(t[i + 1] - t[i]) / 1000.0::DOUBLE for i in range(1, len(t))] AS g FROM q),
s AS (SELECT *, list_avg(g) AS gm, sqrt(list_avg([(x - list_avg(g)) ** 2 for x in g])) AS gs, [abs(g[i + 1] - g[i]) for i in range(1, len(g))] AS j, list_avg(z) AS zm, sqrt(list_avg([(x - list_avg(z)) ** 2 for x in z])) AS zs,
  len([x for x in d if x = 'up']) AS u, len([x for x in d if x = 'down']) AS o FROM r)"""


def rounded(df, columns, digits=6):
    return df.select(*[F.round(F.col(c).cast("double"), digits).alias(c) if c in columns else F.col(c) for c in df.columns])


@query("w2_trailing_flow_features", with_sql(P, _TRAIL) + """ SELECT idx, round(CASE WHEN n > 1 THEN gm ELSE 0 END / 60000, 5) AS iat_minutes, round(CASE WHEN n > 1 THEN gs ELSE 0 END / 60000, 5) AS iat_std_minutes, round(CASE WHEN n > 1 THEN gs / greatest(gm, 0.001) ELSE 0 END, 6) AS iat_cv, round((u - o) / greatest(u + o, 1), 6) AS direction_balance,
  round(CASE WHEN n > 2 THEN 1 / (1 + list_avg(j)) ELSE 0 END, 12) AS periodicity_score, round(CASE WHEN n > 1 THEN zs / greatest(zm, 1) ELSE 0 END, 6) AS size_cv FROM s""")
def w2(spark, sf_dir):
    out = ops.trailing_flow_features(packets(spark, sf_dir))
    return out.select("idx", F.round(F.col("iat_mean") / 60000, 5).alias("iat_minutes"), F.round(F.col("iat_std") / 60000, 5).alias("iat_std_minutes"), F.round("iat_cv", 6).alias("iat_cv"), F.round("direction_balance", 6).alias("direction_balance"), F.round("periodicity_score", 12).alias("periodicity_score"), F.round("size_cv", 6).alias("size_cv"))


@query("w2_bursts", with_sql(P, f"""i AS (SELECT *, sum(CASE WHEN gap < {120 * MINUTE} THEN 0 ELSE 1 END) OVER (PARTITION BY capture_id, flow ORDER BY ts_us, idx) AS island FROM (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY capture_id, flow ORDER BY ts_us, idx) AS gap FROM (SELECT *, {FLOW} AS flow FROM p)))""") + """
SELECT idx, CASE WHEN c = 1 THEN 0.0 ELSE (SELECT max(m)::DOUBLE FROM (SELECT count(*) AS m FROM unnest(l) t(x) GROUP BY x)) END AS burst_intensity FROM (SELECT idx, list(island) OVER w AS l, count(*) OVER w AS c FROM i WINDOW w AS (PARTITION BY capture_id, flow ORDER BY ts_us, idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))""")
def w2b(spark, sf_dir):
    return ops.trailing_flow_features(packets(spark, sf_dir), burst_us=120 * MINUTE).select("idx", "burst_intensity")


@query("w3_whole_flow_features", with_sql(P, f"""f AS (SELECT *, ts_us - lag(ts_us) OVER w AS gap FROM (SELECT *, {FLOW} AS flow FROM p) WINDOW w AS (PARTITION BY capture_id, flow ORDER BY ts_us, idx)),
g AS (SELECT *, abs(gap - lag(gap) OVER w) AS jump FROM f WINDOW w AS (PARTITION BY capture_id, flow ORDER BY ts_us, idx))""") + """
SELECT capture_id, flow, round(coalesce(avg(gap) / 1000, 0) / 60000, 5) AS iat_minutes, round(coalesce(stddev_pop(gap / 1000), 0) / 60000, 4) AS iat_std_minutes, round((count(*) FILTER (direction = 'up') - count(*) FILTER (direction = 'down')) / count(*), 6) AS direction_balance, round(CASE WHEN count(gap) > 3 THEN 1 / (1 + avg(jump) / 1000) ELSE 0 END, 12) AS periodicity_score,
  round(CASE WHEN count(*) > 1 THEN stddev_pop(size) / greatest(avg(size), 1) ELSE 0 END, 6) AS size_cv FROM g GROUP BY capture_id, flow""")
def w3(spark, sf_dir):
    out = ops.whole_flow_features(packets(spark, sf_dir))
    return out.select("capture_id", "flow", F.round(F.col("iat_mean") / 60000, 5).alias("iat_minutes"), F.round(F.col("iat_std") / 60000, 4).alias("iat_std_minutes"), F.round("direction_balance", 6).alias("direction_balance"), F.round("periodicity_score", 12).alias("periodicity_score"), F.round("size_cv", 6).alias("size_cv"))


@query("j3_features_to_packets", with_sql(P) + f""", f AS (SELECT capture_id, {FLOW} AS flow, round(CASE WHEN count(*) > 1 THEN stddev_pop(size) / greatest(avg(size), 1) ELSE 0 END, 6) AS size_cv FROM p GROUP BY ALL) SELECT idx, coalesce(size_cv, 0) AS size_cv FROM p LEFT JOIN f ON f.capture_id = p.capture_id AND f.flow = {FLOW}""")
def j3(spark, sf_dir):
    own = packets(spark, sf_dir).withColumn("flow", ops.flow_id())
    return own.join(ops.whole_flow_features(own.drop("flow")).select("capture_id", "flow", "size_cv"), ["capture_id", "flow"], "left").select("idx", F.round(F.coalesce("size_cv", F.lit(0.0)), 6).alias("size_cv"))


_W = f"""t AS (SELECT p.*, CAST(floor((ts_us - t0) / {60 * MINUTE}.0) AS BIGINT) AS window_idx FROM p JOIN (SELECT capture_id, arg_min(ts_us, idx) AS t0 FROM p GROUP BY 1) USING (capture_id)),
x AS (SELECT *, (ts_us - lag(ts_us) OVER (PARTITION BY capture_id, window_idx ORDER BY idx)) / 1000.0::DOUBLE AS gap FROM t),
w AS (SELECT capture_id, window_idx, count(*) AS pkt_count, sum(size)::BIGINT AS byte_count, count(*) FILTER (direction = 'up') AS up_pkt_count, count(*) FILTER (direction = 'down') AS down_pkt_count, coalesce(sum(size) FILTER (direction = 'up'), 0)::BIGINT AS up_bytes, coalesce(sum(size) FILTER (direction = 'down'), 0)::BIGINT AS down_bytes, count(*) FILTER (proto = 6) AS tcp_count, count(*) FILTER (proto = 17) AS udp_count,
  count(*) FILTER (size <= 128) AS small_count, count(*) FILTER (size >= 1000) AS large_count, avg(size) AS mean_len, stddev_pop(size) AS std_len, coalesce(avg(gap), 0) AS mean_iat_ms, coalesce(stddev_pop(gap), 0) AS std_iat_ms, count(*) FILTER (k % 3 = 0) AS valid_payload_count, coalesce(sum(strlen(payload)) FILTER (k % 3 = 0), 0)::BIGINT AS payload_byte_count FROM x GROUP BY 1, 2),
d AS (SELECT capture_id, unnest(range(0, max(window_idx) + 1)) AS window_idx FROM w GROUP BY 1)"""


def hourly(spark, sf_dir):
    return ops.window_features(packets(spark, sf_dir), 60 * MINUTE, F.col("k") % 3 == 0)


@query("a13_window_features", with_sql(P, _W) + """ SELECT capture_id, window_idx, coalesce(pkt_count, 0) AS pkt_count, coalesce(byte_count, 0) AS byte_count, coalesce(up_pkt_count, 0) AS up_pkt_count, coalesce(up_bytes, 0) AS up_bytes, coalesce(down_bytes, 0) AS down_bytes, coalesce(tcp_count, 0) AS tcp_count, coalesce(udp_count, 0) AS udp_count, coalesce(small_count, 0) AS small_count, coalesce(large_count, 0) AS large_count,
  round(coalesce(mean_len, 0), 6) AS mean_len, round(coalesce(std_len, 0), 6) AS std_len, round(coalesce(mean_iat_ms, 0) / 60000 + 0.000000005, 5) AS iat_minutes, round(coalesce(std_iat_ms, 0) / 60000 + 0.000000005, 5) AS iat_std_minutes, round((coalesce(up_pkt_count, 0) - coalesce(down_pkt_count, 0)) / greatest(coalesce(pkt_count, 0), 1), 6) AS direction_balance, round(coalesce(small_count, 0) / greatest(coalesce(pkt_count, 0), 1), 6) AS small_ratio, round(coalesce(std_len, 0) / greatest(coalesce(mean_len, 0), 1), 6) AS len_cv FROM d LEFT JOIN w USING (capture_id, window_idx)""")
def a13(spark, sf_dir):
    out = hourly(spark, sf_dir).select("capture_id", "window_idx", "pkt_count", "byte_count", "up_pkt_count", "up_bytes", "down_bytes", "tcp_count", "udp_count", "small_count", "large_count", "mean_len", "std_len", F.round(F.col("mean_iat_ms") / 60000 + 5e-9, 5).alias("iat_minutes"), F.round(F.col("std_iat_ms") / 60000 + 5e-9, 5).alias("iat_std_minutes"), "direction_balance", "small_ratio", "len_cv")
    return rounded(out, ["mean_len", "std_len", "direction_balance", "small_ratio", "len_cv"])


_KINDS = (1, 2, 3, 4, 5, 6)
_A14 = ", ".join(f"count(*) FILTER (status = 'ok' AND c.t = {k}) AS n{k}" for k in _KINDS)


@query("a14_payload_window_counts", with_sql(P, _W, _CTL) + f""", y AS (SELECT x.capture_id, window_idx, count(*) AS n, count(*) FILTER (status = 'ok') AS ok, coalesce(sum(c.n) FILTER (status = 'ok'), 0)::BIGINT AS bytes, {_A14} FROM x JOIN v AS c USING (idx) GROUP BY 1, 2)
SELECT capture_id, window_idx, coalesce(ok, 0) AS valid_payload_count, coalesce(bytes, 0) AS payload_byte_count, round(coalesce(ok, 0) / greatest(coalesce(n, 0), 1), 6) AS valid_payload_ratio, """ + ", ".join(f"coalesce(n{k}, 0) AS msg_type_0{k}_count, round(coalesce(n{k}, 0) / greatest(coalesce(n, 0), 1), 6) AS msg_type_0{k}_ratio" for k in _KINDS) + " FROM d LEFT JOIN y USING (capture_id, window_idx)")
def a14(spark, sf_dir):
    own = control_packets(spark, sf_dir).drop("payload").withColumnRenamed("control", "payload")
    out = ops.window_features(own, 60 * MINUTE, control_status(F.col("payload")) == "ok", control_type(F.col("payload")), _KINDS)
    types = [f"msg_type_0{k}_{c}" for k in _KINDS for c in ("count", "ratio")]
    return rounded(out.select("capture_id", "window_idx", "valid_payload_count", "payload_byte_count", "valid_payload_ratio", *types), ["valid_payload_ratio", *[c for c in types if c.endswith("ratio")]])


@query("a19_payload_profile", with_sql(P, _CTL) + """, g AS (SELECT capture_id, count(*) AS n, max(ts_us) - min(ts_us) AS t, avg(CASE WHEN b = 0 THEN c.t / 255.0::DOUBLE WHEN b = 1 THEN 9 / 255.0::DOUBLE END) AS x, """ + ", ".join(f"count(*) FILTER (c.t = {k} AND b = 0) AS n{k}" for k in range(1, 7)) + """
  FROM v AS c JOIN p USING (capture_id, idx), range(0, 2) AS r(b) WHERE status = 'ok' GROUP BY capture_id),
f AS (SELECT capture_id, avg(t / 255.0::DOUBLE) AS first, stddev_pop(t / 255.0::DOUBLE) AS spread, avg(d) AS jump FROM (SELECT capture_id, c.t, abs(c.t - lag(c.t) OVER (PARTITION BY capture_id ORDER BY idx)) / 255.0::DOUBLE AS d FROM v AS c WHERE status = 'ok') GROUP BY 1)
SELECT capture_id, 1536 AS size, round(first, 9) AS first, round(9 / 255.0::DOUBLE, 9) AS second, round(spread, 9) AS spread, round(jump, 9) AS jump, round(n / 2 / 1000, 9) AS count, round(t / 1000000.0::DOUBLE, 6) AS seconds, """ + ", ".join(f"round(n{k} / (n / 2), 9) AS r{k}" for k in range(1, 7)) + " FROM g JOIN f USING (capture_id)")
def a19(spark, sf_dir):
    """Parts of the payload profile that SQL can tell without the bytes: first two bytes, number, seconds, shares of the types."""
    own = control_packets(spark, sf_dir).where(control_status(F.col("control")) == "ok").select("capture_id", "idx", "ts_us", F.col("control").alias("payload"), control_type(F.col("control")).alias("kind"))
    at = lambda i: F.get("profile", F.lit(i))
    shares = {f"r{k}": F.round(at(1526 + k - 1), 9) for k in range(1, 7)}
    return ops.payload_profile(own).select("capture_id", F.size("profile").alias("size"), F.round(at(0), 9).alias("first"), F.round(at(1), 9).alias("second"), F.round(at(380), 9).alias("spread"), F.round(at(760), 9).alias("jump"), F.round(at(1532), 9).alias("count"), F.round(at(1533), 6).alias("seconds"), *[v.alias(k) for k, v in shares.items()])


@query("w4_gap_in_window", with_sql(P, _W) + " SELECT idx, coalesce(gap, 0) AS gap FROM x")
def w4(spark, sf_dir):
    from pyspark.sql import Window

    own = packets(spark, sf_dir)
    first = own.groupBy("capture_id").agg(F.min_by("ts_us", "idx").alias("t0"))
    rows = own.join(first, "capture_id").withColumn("w", F.floor((F.col("ts_us") - F.col("t0")) / (60 * MINUTE)))
    return rows.select("idx", F.coalesce((F.col("ts_us") - F.lag("ts_us").over(Window.partitionBy("capture_id", "w").orderBy("idx"))) / 1000.0, F.lit(0.0)).alias("gap"))


_SIGN = "g AS (SELECT *, CASE WHEN src = (SELECT arg_min(src, idx) FROM p q WHERE q.capture_id = p.capture_id) THEN 1 ELSE -1 END AS sign FROM p)"
_BIN = f"""b AS (SELECT capture_id, min(ts_us) AS t0, (max(ts_us) - min(ts_us)) // {30 * MINUTE} + 1 AS n FROM p GROUP BY 1), y AS (SELECT g.capture_id, least(n - 1, (ts_us - t0) // {30 * MINUTE}) AS bin, sum(sign * size)::BIGINT AS value FROM g JOIN b USING (capture_id) GROUP BY 1, 2),
z AS (SELECT r.capture_id, r.bin, coalesce(value, 0) AS value FROM (SELECT capture_id, unnest(range(0, n)) AS bin FROM b) r LEFT JOIN y USING (capture_id, bin))"""


def signal(spark, sf_dir):
    return ops.signal_bins(profiles.signed_direction(packets(spark, sf_dir)), 30 * MINUTE)


@query("a15_signal_bins", with_sql(P, _SIGN, _BIN) + " SELECT * FROM z")
def a15(spark, sf_dir):
    return signal(spark, sf_dir)


@query("a16_signal_summary", with_sql(P, _SIGN) + " SELECT capture_id, count(*) AS packets, (max(ts_us) - min(ts_us)) / 1000000.0::DOUBLE AS duration_s, count(*) FILTER (sign > 0) AS positive, count(*) FILTER (sign < 0) AS negative, round(avg(size), 6) AS mean_length, round(stddev_pop(size), 6) AS std_length FROM g GROUP BY 1")
def a16(spark, sf_dir):
    return rounded(ops.signal_summary(profiles.signed_direction(packets(spark, sf_dir))), ["mean_length", "std_length"])


@query("w20_trim_silence", with_sql(P, _SIGN, _BIN) + ", e AS (SELECT capture_id, min(bin) AS lo, max(bin) AS hi FROM z WHERE abs(value) > 2000 GROUP BY 1) SELECT z.* FROM z JOIN e USING (capture_id) WHERE bin BETWEEN lo AND hi")
def w20(spark, sf_dir):
    return ops.trim_silence(signal(spark, sf_dir), 2000)


_SESSION = f"""k AS (SELECT *, sum(CASE WHEN ts_us - prev > {90 * MINUTE} THEN 1 ELSE 0 END) OVER (PARTITION BY src ORDER BY ts_us, idx) AS session FROM (SELECT *, lag(ts_us) OVER (PARTITION BY src ORDER BY ts_us, idx) AS prev FROM p))"""


@query("w7_gap_sessions", with_sql(P, _SESSION) + f" SELECT src, session::BIGINT AS session, count(*) AS n, min(ts_us) AS start, max(ts_us) AS end FROM k GROUP BY src, session HAVING count(*) >= 2 AND max(ts_us) - min(ts_us) >= {5 * MINUTE}")
def w7(spark, sf_dir):
    return ops.session_summary(packets(spark, sf_dir), ["src"], "ts_us", "idx", 90 * MINUTE, 2, 5 * MINUTE)


@query("w9_flow_segments", with_sql(P, _SESSION) + " SELECT idx, session::BIGINT AS session FROM k QUALIFY count(*) OVER (PARTITION BY src, session) >= 3")
def w9(spark, sf_dir):
    from pyspark.sql import Window

    own = ops.sessions(packets(spark, sf_dir), ["src"], "ts_us", "idx", 90 * MINUTE)
    return own.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("src", "session"))).where("n >= 3").select("idx", "session")


@query("w10_count_windows", with_sql(P) + ", r AS (SELECT capture_id, idx, row_number() OVER (PARTITION BY capture_id ORDER BY idx) - 1 AS rn, count(*) OVER (PARTITION BY capture_id) AS n FROM p), v AS (SELECT capture_id, idx, rn, unnest(range(0, (n - 32) // 8 + 1)) AS w FROM r WHERE n >= 32) SELECT capture_id, w AS window, min(idx) AS first, max(idx) AS last, count(*) AS n FROM v WHERE rn BETWEEN w * 8 AND w * 8 + 31 GROUP BY 1, 2")
def w10(spark, sf_dir):
    return ops.count_windows(packets(spark, sf_dir), ["capture_id"], "idx").groupBy("capture_id", "window").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.count(F.lit(1)).alias("n"))


@query("j9_window_scores_to_packets", with_sql(P) + ", r AS (SELECT capture_id, idx, size, row_number() OVER (PARTITION BY capture_id ORDER BY idx) - 1 AS rn, count(*) OVER (PARTITION BY capture_id) AS n FROM p WHERE proto = 17), v AS (SELECT capture_id, idx, size, rn, unnest(range(0, (n - 32) // 8 + 1)) AS w FROM r WHERE n >= 32), s AS (SELECT capture_id, w, avg(size) AS score FROM v WHERE rn BETWEEN w * 8 AND w * 8 + 31 GROUP BY 1, 2), m AS (SELECT v.idx, max(score) AS score FROM v JOIN s USING (capture_id, w) WHERE rn BETWEEN w * 8 AND w * 8 + 31 GROUP BY 1) SELECT p.idx, round(score, 6) AS score FROM p LEFT JOIN m USING (idx)")
def j9(spark, sf_dir):
    own = packets(spark, sf_dir)
    rows = ops.count_windows(own.where("proto = 17").select("capture_id", "idx", "size"), ["capture_id"], "idx")
    scores = rows.groupBy("capture_id", "window").agg(F.avg("size").alias("score"))
    best = rows.join(scores, ["capture_id", "window"]).groupBy("idx").agg(F.max("score").alias("score"))
    return own.select("idx").join(best, "idx", "left").select("idx", F.round("score", 6).alias("score"))


@query("j8_time_windows", with_sql(P) + f", f AS (SELECT capture_id, min(ts_us) AS t0 FROM p GROUP BY 1), v AS (SELECT p.capture_id, ts_us - t0 AS t, unnest(range(0, (ts_us - t0) // {60 * MINUTE} + 1)) * {60 * MINUTE} AS start FROM p JOIN f USING (capture_id)) SELECT capture_id, start, count(*) AS n FROM v WHERE t < start + {150 * MINUTE} GROUP BY 1, 2 HAVING count(*) >= 3")
def j8(spark, sf_dir):
    return ops.time_windows(packets(spark, sf_dir), ["capture_id"], "ts_us", 150 * MINUTE, 60 * MINUTE, 3)


_RUN = "n AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY idx) - row_number() OVER (PARTITION BY capture_id, kind ORDER BY idx) AS island FROM p), r AS (SELECT capture_id, kind, island, min(idx) AS first, max(idx) AS last, count(*) AS n, avg(value) AS mean_score FROM n GROUP BY ALL)"


@query("w13_merge_runs", with_sql(P, _RUN) + " SELECT capture_id, kind, first, last, n, round(mean_score, 6) AS mean_score FROM r")
def w13(spark, sf_dir):
    return rounded(ops.merge_runs(packets(spark, sf_dir), ["capture_id"], "idx", "kind", "value").drop("run"), ["mean_score"])


@query("w6_compress_runs", with_sql(P, _RUN) + " SELECT capture_id, string_agg(repeat(upper(kind[1:1]), least(n, 3)::BIGINT), '' ORDER BY first) AS text FROM r GROUP BY 1")
def w6(spark, sf_dir):
    return ops.compress_runs(packets(spark, sf_dir).withColumn("symbol", F.upper(F.substring("kind", 1, 1))), ["capture_id"], "idx", "symbol")


@query("w6_repeat_violations", with_sql(P, _RUN) + " SELECT capture_id, kind, first, n FROM r WHERE n > 2")
def w6v(spark, sf_dir):
    return ops.merge_runs(packets(spark, sf_dir), ["capture_id"], "idx", "kind").where("n > 2").select("capture_id", "kind", "first", "n")


@query("w16_changed_only", with_sql(P, _RUN) + " SELECT capture_id, list(kind ORDER BY first)[-100:] AS history FROM r GROUP BY 1")
def w16(spark, sf_dir):
    return ops.changed_only(packets(spark, sf_dir), ["capture_id"], "idx", "kind")


@query("w12_smooth_labels", with_sql(P) + """, a AS (SELECT idx, lag(kind) OVER w AS x, kind AS y, lead(kind) OVER w AS z FROM p WINDOW w AS (PARTITION BY capture_id ORDER BY idx))
SELECT idx, CASE WHEN x IS NULL THEN y WHEN y = z THEN y ELSE x END AS smoothed FROM a""")
def w12(spark, sf_dir):
    return ops.smooth_labels(packets(spark, sf_dir), ["capture_id"], "idx", "kind").select("idx", "smoothed")


@query("w18_true_clusters", with_sql(P) + """, n AS (SELECT capture_id, rn, island FROM (SELECT *, rn - row_number() OVER (PARTITION BY capture_id, big ORDER BY rn) AS island FROM (SELECT capture_id, size > 700 AS big, row_number() OVER (PARTITION BY capture_id ORDER BY idx) AS rn FROM p)) WHERE big), r AS (SELECT capture_id, island, min(rn) AS first, max(rn) AS last, count(*) AS n FROM n GROUP BY 1, 2)
SELECT capture_id, count(*) AS clusters, round(avg(n), 6) AS mean_length, max(n) AS longest, round(coalesce(avg(pause), 0), 6) AS mean_pause, max(last) - min(first) + 1 AS span FROM (SELECT *, first - lag(last) OVER (PARTITION BY capture_id ORDER BY first) - 1 AS pause FROM r) GROUP BY 1""")
def w18(spark, sf_dir):
    from pyspark.sql import Window

    own = packets(spark, sf_dir).select("capture_id", (F.col("size") > 700).alias("big"), F.row_number().over(Window.partitionBy("capture_id").orderBy("idx")).cast("long").alias("rn"))
    return rounded(ops.true_clusters(own, ["capture_id"], "rn", "big"), ["mean_length", "mean_pause"])


@query("w11_activity_segments", with_sql(P, _W) + """, e AS (SELECT d.capture_id, d.window_idx, (coalesce(byte_count, 0) + coalesce(pkt_count, 0))::DOUBLE AS a FROM d LEFT JOIN w USING (capture_id, window_idx)), l AS (SELECT capture_id, greatest(1, coalesce(quantile_cont(a, 0.25) FILTER (a > 0), 1)) AS level, min(window_idx) AS lo, max(window_idx) AS hi FROM e GROUP BY 1),
o AS (SELECT capture_id, window_idx, sum(CASE WHEN window_idx - prev > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY capture_id ORDER BY window_idx) AS s FROM (SELECT e.*, lag(window_idx) OVER (PARTITION BY e.capture_id ORDER BY window_idx) AS prev FROM e JOIN l USING (capture_id) WHERE a >= level)),
g AS (SELECT capture_id, min(window_idx) AS first, max(window_idx) AS last FROM o GROUP BY capture_id, s HAVING max(window_idx) - min(window_idx) + 1 >= 3) SELECT * FROM g UNION ALL SELECT capture_id, lo, hi FROM l WHERE capture_id NOT IN (SELECT capture_id FROM g)""")
def w11(spark, sf_dir):
    return ops.activity_segments(hourly(spark, sf_dir), gap=1, least=3)


@query("w15_merge_canonical", with_sql(P) + """, c AS (SELECT *, CASE WHEN kind IN ('view', 'click') THEN 'move' ELSE kind END AS label FROM p), n AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY idx) - row_number() OVER (PARTITION BY capture_id, label ORDER BY idx) AS island FROM c)
SELECT capture_id, label, min(idx) AS first, max(idx) AS last, list_sort(list(DISTINCT kind)) AS raw FROM n GROUP BY capture_id, label, island""")
def w15(spark, sf_dir):
    own = packets(spark, sf_dir).withColumn("label", F.when(F.col("kind").isin("view", "click"), "move").otherwise(F.col("kind")))
    return ops.runs(own, ["capture_id"], "idx", "label").groupBy("capture_id", "label", "run").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.array_sort(F.collect_set("kind")).alias("raw")).drop("run")


# Each kept event and the first one that comes long enough after it, round by round.
@query("w8_suppress_repeats", "WITH RECURSIVE " + P + f", r AS (SELECT src, kind, min(ts_us) AS t FROM p GROUP BY 1, 2 UNION ALL SELECT r.src, r.kind, min(p.ts_us) FROM r JOIN p ON p.src = r.src AND p.kind = r.kind WHERE p.ts_us >= r.t + {600 * MINUTE} GROUP BY 1, 2) SELECT src, kind, list_sort(list(t)) AS kept FROM r GROUP BY 1, 2")
def w8(spark, sf_dir):
    return ops.suppress_repeats(packets(spark, sf_dir), ["src"], "ts_us", "kind", 600 * MINUTE)


@query("w14_merge_short_runs")
def w14(spark, sf_dir):
    own = ops.runs(packets(spark, sf_dir), ["src"], "idx", "kind").groupBy("src", "run", F.col("kind").alias("label")).agg((F.min("ts_us") / 1e6).alias("first"), (F.max("ts_us") / 1e6).alias("last"), F.avg("value").alias("confidence"), F.count(F.lit(1)).alias("windows"))
    return ops.merge_short_runs(own, ["src"], 3600 * 3)


@query("w19_top_per_group", with_sql(P) + " SELECT src, dst, n FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS r FROM (SELECT src, dst, count(*) AS n FROM p GROUP BY src, dst)) WHERE r <= 2")
def w19(spark, sf_dir):
    from pyspark.sql import Window

    own = packets(spark, sf_dir).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    return own.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("n"), "dst"))).where("r <= 2").drop("r")


_A20 = ["pkt_count", "byte_count", "tcp_count", "large_count", "mean_len"]


@query("a20_traffic_profile", with_sql(P, _W) + " SELECT capture_id, " + ", ".join(f"round(avg(coalesce({c}, 0)), 4) AS {c}_mean, round(stddev_pop(coalesce({c}, 0)), 4) AS {c}_std, round(max(coalesce({c}, 0))::DOUBLE, 4) AS {c}_max, round(sum(coalesce({c}, 0))::DOUBLE, 4) AS {c}_sum" for c in _A20) + " FROM d LEFT JOIN w USING (capture_id, window_idx) GROUP BY 1")
def a20(spark, sf_dir):
    own = ops.traffic_profile(hourly(spark, sf_dir), ["capture_id"], _A20)
    return rounded(own, own.columns[1:], 4)


@query("a48_standardise", "WITH s AS (SELECT avg(value) AS m, stddev_pop(value) AS s, min(value) AS l, max(value) AS h FROM events) SELECT event_id, round((value - m) / s, 6) AS z, round((value - l) / (h - l + 1e-8), 6) AS unit FROM events, s")
def a48(spark, sf_dir):
    own = table(spark, sf_dir, "events").select("event_id", F.col("value").alias("z"), F.col("value").alias("unit"))
    return rounded(ops.min_max(ops.zscore(own, ["z"]), ["unit"]), ["z", "unit"])
