"""Queries of metrics, training sets, tasks and tables over labels, documents, conversations and orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import corpora as ops
from ..operators import metrics, profiles
from .adapters import P, packets, table, with_sql
from .registry import query

# Labelled documents with a prediction that follows the text: long ones are good.
_Y = "y AS (SELECT d.doc_id, quality AS truth, CAST(n_chars > 600 AS INTEGER) AS pred, n_chars AS score, source FROM documents d JOIN labels l USING (doc_id))"


def labelled(spark, sf_dir):
    own = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return own.select("doc_id", F.col("quality").alias("truth"), (F.col("n_chars") > 600).cast("int").alias("pred"), F.col("n_chars").alias("score"), "source", "toxic", "lang")


def rounded(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_K = """k AS (SELECT label, sum(hit) AS hit, sum(t) AS t, sum(p) AS p FROM (SELECT truth AS label, CAST(truth = pred AS INTEGER) AS hit, 1 AS t, 0 AS p FROM y UNION ALL SELECT pred, 0, 0, 1 FROM y) GROUP BY 1),
q AS (SELECT label, t, hit / (p + 1e-9) AS precision, hit / (t + 1e-9) AS recall FROM k), c AS (SELECT *, 2 * precision * recall / (precision + recall + 1e-9) AS f1 FROM q)"""


@query("a37_confusion_matrix", with_sql(_Y) + " SELECT truth, pred, count(*) AS n FROM y GROUP BY ALL")
def a37(spark, sf_dir):
    return metrics.confusion(labelled(spark, sf_dir))


@query("a37_class_scores", with_sql(_Y, _K) + " SELECT label, t::BIGINT AS support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM c")
def a37b(spark, sf_dir):
    return rounded(metrics.class_scores(labelled(spark, sf_dir)))


@query("a38_overall_scores", with_sql(_Y, _K) + """ SELECT round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1, round(sum(precision * t) / sum(t), 6) AS weighted_precision, round(sum(recall * t) / sum(t), 6) AS weighted_recall, round(sum(f1 * t) / sum(t), 6) AS weighted_f1,
  round(2 * avg(precision) * avg(recall) / (avg(precision) + avg(recall) + 1e-9), 6) AS f1_of_macros, (SELECT round(avg(CAST(truth = pred AS DOUBLE)), 6) FROM y) AS accuracy FROM c""")
def a38(spark, sf_dir):
    return rounded(metrics.overall_scores(labelled(spark, sf_dir)))


@query("a38_auc", with_sql(_Y) + ", r AS (SELECT truth, (rank() OVER (ORDER BY score) + rank() OVER (ORDER BY score) + count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM y) SELECT round((sum(r) FILTER (truth = 1) - count(*) FILTER (truth = 1) * (count(*) FILTER (truth = 1) + 1) / 2) / (count(*) FILTER (truth = 1) * count(*) FILTER (truth = 0)), 6)::DOUBLE AS auc FROM r")
def a38b(spark, sf_dir):
    return rounded(metrics.auc(labelled(spark, sf_dir)))


@query("a38_binary_by_source", with_sql(_Y) + """, n AS (SELECT source, count(*) FILTER (truth = 1 AND pred = 1) AS tp, count(*) FILTER (truth <> 1 AND pred = 1) AS fp, count(*) FILTER (truth = 1 AND pred <> 1) AS fn, count(*) FILTER (truth <> 1 AND pred <> 1) AS tn FROM y GROUP BY 1)
SELECT *, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM n""")
def a38c(spark, sf_dir):
    return rounded(metrics.binary_scores(labelled(spark, sf_dir), "truth", "pred", "source"))


@query("a39_best_threshold", with_sql(_Y) + ", c AS (SELECT score, count(*) AS n, count(*) FILTER (truth = 1) AS pos FROM y GROUP BY 1), d AS (SELECT score, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS a, (SELECT sum(pos) FROM c) AS p FROM c) SELECT score AS threshold, round(tp / a, 6) AS precision, round(tp / p, 6) AS recall, round(2 * tp / (a + p), 6) AS f1 FROM d ORDER BY 2 * tp / (a + p) DESC, score DESC LIMIT 1")
def a39(spark, sf_dir):
    return rounded(metrics.best_threshold(labelled(spark, sf_dir)))


@query("a40_detection_rates", with_sql(_Y) + " SELECT source, count(*) AS n, round(avg(CAST(pred = 1 AS DOUBLE)), 6) AS rate, round(avg(score), 6) AS mean_confidence FROM y GROUP BY 1")
def a40(spark, sf_dir):
    return rounded(metrics.detection_by_class(labelled(spark, sf_dir), "source", F.col("pred") == 1, "score"))


@query("a41_attack_benchmark", with_sql(P) + " SELECT kind AS attack_type, count(*) AS n, round(avg(CAST(size > 700 AS DOUBLE)), 6) AS rate, round(avg(value), 6) AS mean_confidence FROM p GROUP BY 1")
def a41(spark, sf_dir):
    return rounded(metrics.detection_by_class(packets(spark, sf_dir).withColumnRenamed("kind", "attack_type"), "attack_type", F.col("size") > 700, "value"))


@query("a42_fold_scores", with_sql(_Y) + """, f AS (SELECT *, least((row_number() OVER (ORDER BY doc_id) - 1) // greatest(count(*) OVER () // 5, 1), 4) AS fold FROM y), n AS (SELECT fold, count(*) FILTER (truth = 1 AND pred = 1) AS tp, count(*) FILTER (truth <> 1 AND pred = 1) AS fp, count(*) FILTER (truth = 1 AND pred <> 1) AS fn, count(*) AS n, count(*) FILTER (truth = pred) AS ok FROM f GROUP BY 1)
SELECT round(avg(ok / n), 6) AS accuracy_mean, round(stddev_pop(ok / n), 6) AS accuracy_std, round(avg(tp / (tp + fp)), 6) AS precision_mean, round(stddev_pop(tp / (tp + fp)), 6) AS precision_std, round(avg(tp / (tp + fn)), 6) AS recall_mean, round(stddev_pop(tp / (tp + fn)), 6) AS recall_std, round(avg(2 * tp / (2 * tp + fp + fn)), 6) AS f1_mean, round(stddev_pop(2 * tp / (2 * tp + fp + fn)), 6) AS f1_std FROM n""")
def a42(spark, sf_dir):
    return rounded(metrics.fold_scores(labelled(spark, sf_dir), "doc_id", 5))


@query("a43_branch_accuracies", with_sql(P) + " SELECT round(avg(CAST(a = kind AS DOUBLE)), 6) AS a, round(avg(CAST(b = kind AS DOUBLE)), 6) AS b FROM (SELECT kind, CASE WHEN k % 2 = 0 THEN 'view' END AS a, CASE WHEN size > 500 THEN kind WHEN size > 300 THEN 'click' END AS b FROM p)")
def a43(spark, sf_dir):
    own = packets(spark, sf_dir).withColumns({"a": F.when(F.col("k") % 2 == 0, "view"), "b": F.when(F.col("size") > 500, F.col("kind")).when(F.col("size") > 300, "click")})
    return rounded(metrics.branch_accuracies(own, "kind", ["a", "b"]))


@query("a49_majority_vote", with_sql(P) + " SELECT idx, CASE WHEN x + y + z >= 2 THEN 1 ELSE 0 END AS vote FROM (SELECT idx, CAST(size > 400 AS INTEGER) AS x, CAST(k > 50 AS INTEGER) AS y, CAST(value > 30 AS INTEGER) AS z FROM p)")
def a49(spark, sf_dir):
    own = packets(spark, sf_dir).select("idx", (F.col("size") > 400).cast("int").alias("x"), (F.col("k") > 50).cast("int").alias("y"), (F.col("value") > 30).cast("int").alias("z"))
    return metrics.majority_vote(own, ["idx"], ["x", "y", "z"]).select("idx", "vote")


@query("a22_label_thresholds", with_sql(P) + " SELECT kind, round(least(greatest(quantile_cont(value / 500, 0.95) + 0.05, 0.1), 0.85), 6) AS threshold FROM p GROUP BY 1")
def a22(spark, sf_dir):
    return rounded(metrics.label_thresholds(packets(spark, sf_dir).withColumn("value", F.col("value") / 500), "kind", "value", floor=0.1))


@query("a23_label_summary", with_sql(P) + " SELECT kind, count(*) AS n, round(avg(value), 6) AS mean_score, max(value) AS max_score, round(avg(CAST(value > 100 AS DOUBLE)), 6) AS anomaly_rate FROM p GROUP BY 1")
def a23(spark, sf_dir):
    return packets(spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_score"), F.max("value").alias("max_score"), F.round(F.avg((F.col("value") > 100).cast("double")), 6).alias("anomaly_rate"))


@query("a25_median_duration", with_sql(P) + " SELECT kind, round(quantile_cont(d, 0.5), 6) AS median_s, round(min(d), 6) AS least_s, round(max(d), 6) AS most_s FROM (SELECT kind, (ts_us - lag(ts_us) OVER (PARTITION BY src ORDER BY idx)) / 1000000.0::DOUBLE AS d FROM p) WHERE d IS NOT NULL GROUP BY 1")
def a25(spark, sf_dir):
    own = packets(spark, sf_dir).select("kind", ((F.col("ts_us") - F.lag("ts_us").over(Window.partitionBy("src").orderBy("idx"))) / 1e6).alias("d")).where("d IS NOT NULL")
    return rounded(own.groupBy("kind").agg(F.percentile("d", F.lit(0.5)).alias("median_s"), F.min("d").alias("least_s"), F.max("d").alias("most_s")))


@query("a35_capture_statistics", with_sql(P) + """, q AS (SELECT *, CASE WHEN k % 9 = 0 THEN 1 ELSE proto END AS pr, CASE WHEN k % 7 = 0 THEN 0 ELSE size % 500 END AS n FROM p), t AS (SELECT capture_id, list(port ORDER BY c DESC, port)[:5] AS top_ports FROM (SELECT capture_id, port, count(*) AS c FROM q WHERE pr IN (6, 17) GROUP BY 1, 2) GROUP BY 1)
SELECT capture_id, count(*) AS total_read, count(*) FILTER (pr = 17) AS udp, count(*) FILTER (pr = 6) AS tcp, count(*) FILTER (pr NOT IN (6, 17)) AS other, count(*) FILTER (pr = 17 AND n > 0) AS udp_with_payload, count(*) FILTER (pr <> 17) AS skipped_non_udp, count(*) FILTER (pr = 17 AND n = 0) AS skipped_empty,
count(*) FILTER (pr = 17 AND n BETWEEN 1 AND 49) AS below_50, count(*) FILTER (pr = 17 AND n BETWEEN 50 AND 199) AS below_200, count(*) FILTER (pr = 17 AND n BETWEEN 200 AND 379) AS below_380, count(*) FILTER (pr = 17 AND n = 380) AS equal_380, count(*) FILTER (pr = 17 AND n > 380) AS over_380, any_value(top_ports) AS top_ports FROM q JOIN t USING (capture_id) GROUP BY 1""")
def a35b(spark, sf_dir):
    own = packets(spark, sf_dir).select("capture_id", F.when(F.col("k") % 9 == 0, 1).otherwise(F.col("proto")).alias("proto"), "port", F.when(F.col("k") % 7 == 0, 0).otherwise(F.col("size") % 500).alias("payload_size"))
    return profiles.capture_statistics(own)


@query("a35_size_buckets", with_sql(P) + " SELECT capture_id, count(*) FILTER (size < 64) AS tiny, count(*) FILTER (size >= 64 AND size < 128) AS small, count(*) FILTER (size >= 128 AND size < 512) AS medium, count(*) FILTER (size >= 512 AND size < 1024) AS large, count(*) FILTER (size >= 1024) AS huge FROM p GROUP BY 1")
def a35(spark, sf_dir):
    s = F.col("size")
    bands = {"tiny": s < 64, "small": (s >= 64) & (s < 128), "medium": (s >= 128) & (s < 512), "large": (s >= 512) & (s < 1024), "huge": s >= 1024}
    return packets(spark, sf_dir).groupBy("capture_id").agg(*[F.count_if(v).alias(k) for k, v in bands.items()])


@query("a36_class_distribution", with_sql(P) + ", c AS (SELECT kind, count(*) AS n FROM p GROUP BY 1) SELECT kind, n, round(n / (SELECT sum(n) FROM c), 6) AS share, kind = (SELECT arg_min(kind, (-n, kind)) FROM c) AS is_majority FROM c")
def a36(spark, sf_dir):
    c = packets(spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    top = c.agg(F.sum("n").alias("t"), F.min_by("kind", F.struct(-F.col("n"), F.col("kind"))).alias("m"))
    return c.crossJoin(F.broadcast(top)).select("kind", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"), (F.col("kind") == F.col("m")).alias("is_majority"))


@query("a44_sequence_scores", """WITH r AS (SELECT conv_id, string_agg(role[1:1], '' ORDER BY turn) AS seq FROM conversations GROUP BY 1), j AS (SELECT a.seq AS x, b.seq AS y FROM r a LEFT JOIN r b ON b.conv_id = a.conv_id + 1)
SELECT count(*) AS n, count(*) FILTER (y IS NULL) AS missing, round(avg(CAST(coalesce(x = y, false) AS DOUBLE)), 6) AS exact, round(avg(1 - levenshtein(x, y) / greatest(length(x), length(y))), 6) AS similarity FROM j""")
def a44(spark, sf_dir):
    own = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.substring("role", 1, 1).alias("r")))), lambda x: x["r"]), "").alias("expected"))
    j = metrics.prediction_join(own, own.select((F.col("conv_id") - 1).alias("conv_id"), F.col("expected").alias("predicted")), "conv_id")
    return j.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "MISSING").alias("missing"), F.round(F.avg((F.col("status") == "EXACT").cast("double")), 6).alias("exact"), F.round(F.avg(metrics.edit_similarity(F.col("expected"), F.col("predicted"))), 6).alias("similarity"))


@query("j13_prediction_status", """WITH r AS (SELECT conv_id, string_agg(role[1:1], '' ORDER BY turn) AS seq FROM conversations GROUP BY 1) SELECT a.conv_id, CASE WHEN b.seq IS NULL THEN 'MISSING' WHEN a.seq = b.seq THEN 'EXACT' ELSE 'DIFFERENT' END AS status FROM r a LEFT JOIN r b ON b.conv_id = a.conv_id + 1""")
def j13(spark, sf_dir):
    own = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.substring("role", 1, 1).alias("r")))), lambda x: x["r"]), "").alias("expected"))
    return metrics.prediction_join(own, own.select((F.col("conv_id") - 1).alias("conv_id"), F.col("expected").alias("predicted")), "conv_id").select("conv_id", "status")


@query("j12_ground_truth_by_position", "SELECT d.doc_id, quality FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i FROM labels) d JOIN (SELECT quality, row_number() OVER (ORDER BY doc_id) AS i FROM labels) l USING (i)")
def j12(spark, sf_dir):
    own = table(spark, sf_dir, "labels")
    left, right = ops.global_positions(own.select("doc_id"), "doc_id"), ops.global_positions(own.select("doc_id", "quality"), "doc_id").drop("doc_id")
    return left.join(right, "position").select("doc_id", "quality")


# --- training sets ---------------------------------------------------------------------------------------------------
_T = "t AS (SELECT doc_id AS id, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents))"


def unit(*parts: str, seed: int = 0) -> str:
    text = " || ':' || ".join([f"'{seed}'", *[f"CAST({p} AS VARCHAR)" for p in parts]])
    return f"(CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496.0)"


def tokens(spark, sf_dir):
    return ops.tokens_table(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("a47_vocabulary", with_sql(_T) + " SELECT token, n, CAST(id AS INTEGER) AS id FROM (SELECT token, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, token) + 4 AS id FROM t GROUP BY 1 HAVING count(*) >= 3) UNION ALL SELECT * FROM (VALUES ('[PAD]', 0, 0), ('[UNK]', 0, 1), ('[CLS]', 0, 2), ('[SEP]', 0, 3), ('[MASK]', 0, 4))")
def a47(spark, sf_dir):
    return ops.vocabulary(tokens(spark, sf_dir), 3)


@query("f36_token_ids", with_sql(_T) + ", v AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) + 4 AS vid FROM t GROUP BY 1 HAVING count(*) >= 3) SELECT id, list_resize(list(coalesce(vid, 1)::INTEGER ORDER BY pos), 32, 0) AS ids, list_resize(list(1 ORDER BY pos), 32, 0) AS mask FROM t LEFT JOIN v USING (token) WHERE pos < 32 GROUP BY id")
def f36(spark, sf_dir):
    own = tokens(spark, sf_dir)
    return ops.token_ids(own, ops.vocabulary(own, 3), 32)


@query("b1_pack_documents", with_sql(_T) + " SELECT block, list(token ORDER BY i) AS tokens FROM (SELECT token, i, i // 128 AS block FROM (SELECT token, row_number() OVER (ORDER BY id, pos) - 1 AS i FROM t)) GROUP BY 1")
def b1(spark, sf_dir):
    return ops.pack_documents(tokens(spark, sf_dir), 128)


@query("b2_mask_tokens", with_sql(_T) + f", r AS (SELECT id, pos, token, row_number() OVER w AS r, count(*) OVER (PARTITION BY id) AS n, lead(token) OVER w AS other FROM t WINDOW w AS (PARTITION BY id ORDER BY {unit('id', 'pos')}, pos)), m AS (SELECT *, r <= greatest(1, floor(0.15 * n + 0.5)) AS masked FROM r) SELECT id, pos::INTEGER AS pos, token, masked, CASE WHEN NOT masked THEN token WHEN {unit('id', 'pos', seed=1)} < 0.8 THEN '[MASK]' WHEN {unit('id', 'pos', seed=1)} < 0.9 THEN coalesce(other, token) ELSE token END AS shown FROM m")
def b2(spark, sf_dir):
    return ops.mask_tokens(tokens(spark, sf_dir))


@query("b7_causal_pairs", with_sql(_T) + " SELECT id, pos::INTEGER AS pos, token, coalesce(lead(token) OVER (PARTITION BY id ORDER BY pos), '[SEP]') AS next FROM t")
def b7(spark, sf_dir):
    return ops.causal_pairs(tokens(spark, sf_dir))


@query("b7_both_way_targets", with_sql(_T) + " SELECT id, pos::INTEGER AS pos, token, coalesce(lag(token) OVER w, '[CLS]') AS previous, coalesce(lead(token) OVER w, '[SEP]') AS next FROM t WINDOW w AS (PARTITION BY id ORDER BY pos)")
def b7b(spark, sf_dir):
    return ops.both_way_targets(tokens(spark, sf_dir))


@query("b8_source_target_pairs", """SELECT conv_id, turn, text AS source, target FROM (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS target, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE role = 'user' AND r = 'assistant' AND len(string_split(text, ' ')) < 512""")
def b8(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    own = table(spark, sf_dir, "conversations").withColumns({"target": F.lead("text").over(w), "r": F.lead("role").over(w)})
    return own.where((F.col("role") == "user") & (F.col("r") == "assistant") & (F.size(F.split("text", " ")) < 512)).select("conv_id", "turn", F.col("text").alias("source"), "target")


@query("b9_span_targets", with_sql(_T) + f", m AS (SELECT id, pos, token, {unit('id', 'pos')} < 0.3 AS masked FROM t), g AS (SELECT id, pos, token, pos - row_number() OVER (PARTITION BY id ORDER BY pos) AS g FROM m WHERE masked) SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY min(pos)) - 1 AS BIGINT) AS sentinel, CAST(min(pos) AS INTEGER) AS first, list(token ORDER BY pos) AS tokens FROM g GROUP BY id, g")
def b9(spark, sf_dir):
    return ops.span_targets(tokens(spark, sf_dir).withColumn("masked", ops.unit_hash("id", "pos") < 0.3))


@query("b10_classification_instances", with_sql(_T) + " SELECT id, quality AS label, list(token ORDER BY pos)[:16] AS tokens FROM t JOIN labels ON doc_id = id GROUP BY id, quality")
def b10(spark, sf_dir):
    own = tokens(spark, sf_dir).where("pos < 16").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]).alias("tokens"))
    return own.join(table(spark, sf_dir, "labels"), F.col("id") == F.col("doc_id")).select("id", F.col("quality").alias("label"), "tokens")


@query("b11_repeat_corpus", "SELECT doc_id, CAST(c AS INTEGER) AS copy FROM documents, range(3) r(c)")
def b11(spark, sf_dir):
    return ops.repeat_corpus(table(spark, sf_dir, "documents").select("doc_id"), 3)


_S = r"s AS (SELECT doc_id AS id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS text FROM (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '') AS l FROM documents))"


def sentences(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.posexplode(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != "")).alias("pos", "text"))
    return own


@query("b4_sentence_pairs", with_sql(_S) + f", h AS (SELECT id, text, row_number() OVER (ORDER BY {unit('id', seed=1)}) AS r, count(*) OVER () AS n FROM s WHERE pos = 0), o AS (SELECT a.id, b.text AS other FROM h a JOIN h b ON b.r = a.r % a.n + 1) SELECT id, pos::INTEGER AS pos, a, CASE WHEN u < 0.5 THEN nxt ELSE other END AS b, u < 0.5 AS is_next FROM (SELECT id, pos, text AS a, lead(text) OVER (PARTITION BY id ORDER BY pos) AS nxt, {unit('id', 'pos')} AS u FROM s) JOIN o USING (id) WHERE nxt IS NOT NULL")
def b4(spark, sf_dir):
    return ops.sentence_pairs(sentences(spark, sf_dir))


@query("b6_order_pairs", with_sql(_S) + f" SELECT id, pos::INTEGER AS pos, CASE WHEN u < 0.5 THEN nxt ELSE a END AS a, CASE WHEN u < 0.5 THEN a ELSE nxt END AS b, u < 0.5 AS swapped FROM (SELECT id, pos, text AS a, lead(text) OVER (PARTITION BY id ORDER BY pos) AS nxt, {unit('id', 'pos')} AS u FROM s) WHERE nxt IS NOT NULL")
def b6(spark, sf_dir):
    return ops.order_pairs(sentences(spark, sf_dir))


@query("b12_byte_pair_merges")
def b12(spark, sf_dir):
    own = tokens(spark, sf_dir)
    merges = ops.learn_merges(own, 8)
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(merges)], "step int, a string, b string")


@query("b13_labelled_text_set", "SELECT quality AS label, array_to_string(regexp_extract_all(rpad(substr(lower(hex(encode(text))), 1, 128), 128, '0'), '..'), ' ') AS text_a, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'valid' ELSE 'test' END AS split FROM (SELECT *, " + unit("doc_id", seed=3) + " AS u FROM documents JOIN labels USING (doc_id)) WHERE text IS NOT NULL")
def b13(spark, sf_dir):
    from ..functions.payload import hex_pairs

    own = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").where("text IS NOT NULL")
    return ops.hash_split(own, "doc_id", {"train": 0.8, "valid": 0.1, "test": 0.1}, 3).select(F.col("quality").alias("label"), hex_pairs(F.col("text"), 64).alias("text_a"), "split")


@query("t6_hash_sample", f"SELECT doc_id FROM documents ORDER BY {unit('doc_id', seed=4)}, doc_id LIMIT 100")
def t6(spark, sf_dir):
    return ops.hash_sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 100, 4)


@query("t7_hash_split", f"SELECT doc_id, CASE WHEN {unit('doc_id')} < 0.8 THEN 'train' WHEN {unit('doc_id')} < 0.9 THEN 'valid' ELSE 'test' END AS split FROM documents")
def t7(spark, sf_dir):
    return ops.hash_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", {"train": 0.8, "valid": 0.1, "test": 0.1})


@query("t8_stratified_split", f"SELECT doc_id, quality, CASE WHEN r < 0.64 THEN 'train' WHEN r < 0.8 THEN 'valid' ELSE 'test' END AS split FROM (SELECT doc_id, quality, (row_number() OVER (PARTITION BY quality ORDER BY {unit('doc_id')}, doc_id) - 1) / count(*) OVER (PARTITION BY quality) AS r FROM labels)")
def t8(spark, sf_dir):
    return ops.stratified_split(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "quality", {"train": 0.64, "valid": 0.16, "test": 0.2})


@query("t9_ratio_split", f"SELECT doc_id, CASE WHEN {unit('doc_id', seed=9)} < 0.7 THEN 'train' WHEN {unit('doc_id', seed=9)} < 0.85 THEN 'valid' ELSE 'test' END AS split FROM labels")
def t9(spark, sf_dir):
    return ops.hash_split(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", {"train": 0.7, "valid": 0.15, "test": 0.15}, 9)


@query("s6_mean_imputation", "SELECT event_id, coalesce(v, (SELECT avg(CASE WHEN event_id % 7 <> 0 THEN value END) FROM events)) AS v FROM (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS v FROM events)")
def s6(spark, sf_dir):
    own = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"))
    return ops.impute_mean(own, ["v"])


@query("s7_finite_or_zero", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 0 ELSE value END::DOUBLE AS v, CAST(event_type <> 'view' AS INTEGER) AS label FROM events")
def s7(spark, sf_dir):
    m = F.col("event_id") % 5
    own = table(spark, sf_dir, "events").select("event_id", F.when(m == 0, float("inf")).when(m == 1, None).otherwise(F.col("value")).alias("v"), (F.col("event_type") != "view").cast("int").alias("label"))
    return ops.finite_or_zero(own, ["v"])


@query("s10_category_codes", "SELECT event_id, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS code FROM events")
def s10(spark, sf_dir):
    return ops.encode_categories(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type").select("event_id", "code")


@query("s14_blank_line_documents", r"SELECT doc_id AS file, count(*) AS paragraphs FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '\n\s*\n'), lambda x: trim(x, E' \n\t') <> '')) AS p FROM documents) GROUP BY 1")
def s14(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("n", "text"))
    return ops.lines_to_documents(lines, "file", "n", "text").groupBy("file").agg(F.count(F.lit(1)).alias("paragraphs"))


@query("b3_span_masks")
def b3(spark, sf_dir):
    return ops.mask_spans(tokens(spark, sf_dir))


@query("b5_three_way_pairs")
def b5(spark, sf_dir):
    return ops.three_way_pairs(sentences(spark, sf_dir))


_WORD = "1300 + CAST('0x' || substr(md5({0}), 1, 8) AS BIGINT) % 500"


@query("f34_structured_tokens", f"SELECT event_id, list_concat([{_WORD.format('event_type')}], list_transform(regexp_extract_all(lower(props), '[0-9]+|[a-z]+'), lambda x: CASE WHEN regexp_full_match(x, '[0-9]+') THEN 1200 + CAST(x AS BIGINT) % 1000 ELSE {_WORD.format('x')} END)) AS ids FROM events")
def f34(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", ops.structured_tokens(F.col("event_type"), F.col("props")).alias("ids"))


_CODES = "MAP {" + ", ".join(f"'{w}': {256 + i}" for i, w in enumerate(ops.HYBRID)) + "}"


@query("f34_hybrid_tokens", f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s\\x1c-\\x1f\\x85\\p{{Z}}]')[1:1024] AS w FROM documents)
SELECT doc_id, flatten(list_transform(w, lambda x: CASE WHEN {_CODES}[x] IS NOT NULL THEN [{_CODES}[x]] ELSE list_transform(regexp_extract_all(hex(encode(x)), '..'), lambda h: CAST(CAST('0x' || h AS BIGINT) + 4 AS INTEGER)) END))[1:1024] AS ids FROM w""")
def f34b(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", ops.hybrid_tokens(F.col("text"))["ids"].alias("ids"))


@query("f35_basic_tokens", r"SELECT event_id, [event_type, '=', k, '中', '%', 'cafe'] AS tokens FROM (SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS VARCHAR) AS k FROM events)")
def f35b(spark, sf_dir):
    text = F.concat(F.upper("event_type"), F.lit("="), F.get_json_object("props", "$.k"), F.lit("中%\u0000 \t Cafe\u0301"))
    return table(spark, sf_dir, "events").select("event_id", ops.basic_tokens(text).alias("tokens"))


@query("f35_word_pieces")
def f35(spark, sf_dir):
    letters = [chr(i) for i in range(97, 123)] + [str(i) for i in range(10)]
    return ops.split_words(tokens(spark, sf_dir), [*letters, *[f"##{c}" for c in letters], "th", "##th", "##ing", "the", "and", "##tion"])
