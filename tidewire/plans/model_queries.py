"""Queries of outlier scores, models, signals and symbol texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.payload import text_statistics
from ..operators import conformance, forests, metrics, motion, outliers, profiles, signals, windows
from ..sources.shared import checkpointed
from ..sources.tables import flat_features
from .adapters import P, packets, table, with_sql
from .profile_queries import candidates
from .registry import query
from .window_queries import _BIN, _SIGN, MINUTE, hourly, signal

VALUES = ["size", "interval", "entropy"]


def rounded(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("x1_isolation_forest")
def x1(spark, sf_dir):
    own = candidates(spark, sf_dir).select("idx", *VALUES)
    return outliers.isolation_forest(own, "idx", VALUES)


@query("x2_scored_pipeline")
def x2(spark, sf_dir):
    names = ["iat_mean", "iat_std", "iat_cv", "direction_balance", "burst_intensity", "periodicity_score", "size_cv"]
    own = windows.trailing_flow_features(packets(spark, sf_dir)).select("idx", (F.col("size") > 1400).cast("int").alias("truth"), *names)
    scored = outliers.isolation_forest(windows.zscore(own, names), "idx", names, trees=50)
    return metrics.binary_scores(scored.withColumn("pred", (F.col("label") == -1).cast("int")))


@query("x3_cluster_symbols")
def x3(spark, sf_dir):
    own = hourly(spark, sf_dir).select("capture_id", "window_idx", "pkt_count", "byte_count", "mean_len")
    return outliers.cluster_symbols(own, ["pkt_count", "byte_count", "mean_len"], 6).select("capture_id", "window_idx", "symbol")


@query("x12_diagonal_mahalanobis", with_sql(P) + " SELECT idx, round(sqrt((size - (SELECT avg(size) FROM p)) ** 2 / ((SELECT var_samp(size) FROM p) + 1e-6) + (value - (SELECT avg(value) FROM p)) ** 2 / ((SELECT var_samp(value) FROM p) + 1e-6)), 6) AS distance FROM p")
def x12(spark, sf_dir):
    return rounded(outliers.mahalanobis(packets(spark, sf_dir).select("idx", "size", "value"), ["size", "value"], diagonal=True).select("idx", "distance"))


@query("x12_mahalanobis")
def x12b(spark, sf_dir):
    return outliers.mahalanobis(packets(spark, sf_dir).select("idx", "size", "value", "k"), ["size", "value", "k"]).select("idx", "distance")


@query("x13_blended_scores", with_sql(P) + ", b AS (SELECT min(size) AS l1, max(size) AS h1, min(value) AS l2, max(value) AS h2 FROM p) SELECT idx, round((size - l1) / (h1 - l1 + 1e-8) * (exp(0.5) / (exp(0.5) + exp(0.2))) + (value - l2) / (h2 - l2 + 1e-8) * (exp(0.2) / (exp(0.5) + exp(0.2))), 6) AS blend FROM p, b")
def x13(spark, sf_dir):
    return rounded(outliers.blend_scores(packets(spark, sf_dir).select("idx", "size", "value"), ["size", "value"], [0.5, 0.2]).select("idx", "blend"))


def text_table(spark, sf_dir):
    """Labelled documents with numeric text features, label and key."""
    own = table(spark, sf_dir, "documents").where("text IS NOT NULL").join(table(spark, sf_dir, "labels"), "doc_id")
    stats = {k: v for k, v in text_statistics(F.col("text")).items() if not k.startswith("has_") and "ngrams" not in k}
    # Models read the table many times over; the texts are read once.
    return checkpointed(own.select("doc_id", F.col("quality").cast("double").alias("label"), *[v.alias(k) for k, v in stats.items()])), list(stats)


@query("x9_model_ensemble")
def x9(spark, sf_dir):
    own, names = text_table(spark, sf_dir)
    ready = outliers.prepared(own, names, "label", 4)
    train, test = ready.where("doc_id % 5 != 0"), ready.where("doc_id % 5 = 0")
    return outliers.ensemble_scores(train, test.select("doc_id", "features"), outliers.classifiers(4), "doc_id")


@query("x7_action_classifier")
def x7(spark, sf_dir):
    """A balanced forest of 300 trees and boosted trees, fitted on four fifths of the documents."""
    own, names = text_table(spark, sf_dir)
    ready = outliers.balanced(outliers.prepared(own, names, "label", 4), "label")
    train, test = ready.where("doc_id % 5 != 0"), ready.where("doc_id % 5 = 0")
    out = test.select("doc_id", "label", "features")
    for name, model in outliers.action_classifiers().items():
        out = model.fit(train).transform(out).withColumnRenamed("prediction", name).drop("rawPrediction", "probability")
    return out.drop("features")


@query("x23_feature_importance")
def x23(spark, sf_dir):
    from pyspark.ml.feature import VectorAssembler

    own, names = text_table(spark, sf_dir)
    ready = VectorAssembler(inputCols=names, outputCol="features").transform(own)
    model = outliers.classifiers(len(names))["forest"].fit(ready)
    return spark.createDataFrame(outliers.importances(model, names), "feature string, importance double")


@query("x11_outliers_on_scaled_table")
def x11(spark, sf_dir):
    own, names = text_table(spark, sf_dir)
    return outliers.isolation_forest(windows.zscore(own.drop("label"), names), "doc_id", names, contamination=0.1, trees=40).select("doc_id", "score", "label")


@query("x17_feature_vector", "SELECT vec_id, label::DOUBLE AS first, len(embedding)::DOUBLE AS last, 4 AS n, round(list_avg(embedding::DOUBLE[]), 6) AS mean FROM embeddings")
def x17(spark, sf_dir):
    features = {"label": F.col("label"), "embedding": F.col("embedding"), "missing": F.lit(None).cast("double"), "size": F.size("embedding")}
    own = table(spark, sf_dir, "embeddings").select("vec_id", flat_features(features, ("embedding",)).alias("v"))
    return own.select("vec_id", F.get("v", F.lit(0)).alias("first"), F.get("v", F.lit(3)).alias("last"), F.size("v").alias("n"), F.round(F.get("v", F.lit(1)), 6).alias("mean"))


_V = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), c AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v) GROUP BY 1, 2) GROUP BY 1)"


@query("f25_distances_to_center", with_sql(_V) + " SELECT vec_id, round(list_distance(e, c), 6) AS euclidean, round(least(1, greatest(0, list_cosine_similarity(e, c))), 6) AS cosine FROM v JOIN c USING (label)")
def f25(spark, sf_dir):
    own = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    c = conformance.embedding_centers(own, ["label"], "v").select("label", "center")
    return rounded(own.join(c, "label").select("vec_id", conformance.euclidean(F.col("v"), F.col("center")).alias("euclidean"), conformance.cosine(F.col("v"), F.col("center")).alias("cosine")))


@query("a19_position_profile", "WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings), d AS (SELECT *, abs(x - lag(x) OVER (PARTITION BY label, pos ORDER BY vec_id)) AS d FROM e) SELECT label, CAST(pos AS INTEGER) AS pos, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(coalesce(avg(d), 0), 6) AS jump_mean, round(coalesce(stddev_pop(d), 0), 6) AS jump_std FROM d GROUP BY 1, 2")
def a19(spark, sf_dir):
    own = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "x"))
    own = own.withColumn("d", F.abs(F.col("x") - F.lag("x").over(Window.partitionBy("label", "pos").orderBy("vec_id"))))
    return rounded(own.groupBy("label", "pos").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.coalesce(F.avg("d"), F.lit(0.0)).alias("jump_mean"), F.coalesce(F.stddev_pop("d"), F.lit(0.0)).alias("jump_std")))


@query("w5_vector_differences", "SELECT vec_id, round(list_sum(list_transform(list_zip(e, p), lambda z: abs(z[1] - z[2]))), 5) AS total FROM (SELECT vec_id, embedding::DOUBLE[] AS e, lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings) WHERE p IS NOT NULL")
def w5(spark, sf_dir):
    own = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    own = own.withColumn("p", F.lag("e").over(Window.partitionBy("label").orderBy("vec_id"))).where("p IS NOT NULL")
    return own.select("vec_id", F.round(F.aggregate(F.zip_with("e", "p", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


# --- signals ---------------------------------------------------------------------------------------------------------
@query("f27_signal_statistics", with_sql(P, _SIGN, _BIN) + """, m AS (SELECT capture_id, avg(value) AS m FROM z GROUP BY 1), s AS (SELECT z.capture_id, count(*) AS n, max(m) AS mean, sqrt(avg((value - m) ** 2)) + 1e-9 AS std, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, sum(value::DOUBLE * value) AS energy, count(*) FILTER (value > 0) AS positive, avg((value - m) ** 3) AS m3, avg((value - m) ** 4) AS m4 FROM z JOIN m USING (capture_id) GROUP BY 1)
SELECT capture_id, n, round(mean, 6) AS mean, round(std, 6) AS std, round(q1, 6) AS q1, round(q3, 6) AS q3, round(energy, 1) AS energy, positive, round(m3 / std ** 3, 6) AS skew, round(m4 / std ** 4 - 3, 6) AS kurtosis FROM s""")
def f27(spark, sf_dir):
    out = signals.signal_statistics(signal(spark, sf_dir)).select("capture_id", "n", "mean", "std", "q1", "q3", F.round("energy", 1).alias("energy"), "positive", "skew", "kurtosis")
    return rounded(out)


@query("f26_standardised_signal", with_sql(P, _SIGN, _BIN) + " SELECT capture_id, bin, round((value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-9), 6) AS z FROM z WINDOW w AS (PARTITION BY capture_id)")
def f26(spark, sf_dir):
    return rounded(windows.zscore(signal(spark, sf_dir).withColumnRenamed("value", "z"), ["z"], "capture_id"))


_TPL = "lb AS (SELECT DISTINCT capture_id, CASE WHEN capture_id % 2 = 0 THEN 'even' ELSE 'odd' END AS label FROM p), tp AS (SELECT label, bin, (v - avg(v) OVER w) / (stddev_pop(v) OVER w + 1e-9) AS t FROM (SELECT label, bin, sum(value) / (SELECT count(*) FROM lb x WHERE x.label = lb.label) AS v FROM z JOIN lb USING (capture_id) GROUP BY label, bin) WINDOW w AS (PARTITION BY label))"


def signal_templates(spark, sf_dir):
    own = signal(spark, sf_dir)
    labels = own.select("capture_id").distinct().withColumn("label", F.when(F.col("capture_id") % 2 == 0, "even").otherwise("odd"))
    return own, labels, signals.average_templates(own, labels)


@query("x5_average_templates", with_sql(P, _SIGN, _BIN, _TPL) + " SELECT label, bin, round(t, 6) AS value FROM tp")
def x5(spark, sf_dir):
    return rounded(signal_templates(spark, sf_dir)[2])


@query("f29_template_distances", with_sql(P, _SIGN, _BIN, _TPL) + """, n AS (SELECT capture_id, bin, (value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-9) AS v FROM z WINDOW w AS (PARTITION BY capture_id)), gr AS (SELECT c.capture_id, tp.label, tp.t, coalesce(n.v, 0) AS v FROM (SELECT DISTINCT capture_id FROM z) c CROSS JOIN tp LEFT JOIN n ON n.capture_id = c.capture_id AND n.bin = tp.bin)
SELECT capture_id, label, round(sqrt(sum((v - t) ** 2)) / count(*), 6) AS distance, round(sum(v * t) / (sqrt(sum(v * v)) * sqrt(sum(t * t)) + 1e-9), 6) AS cosine FROM gr GROUP BY 1, 2""")
def f29(spark, sf_dir):
    own, _, templates = signal_templates(spark, sf_dir)
    return rounded(signals.template_distances(own, templates))


@query("f28_cross_correlation", with_sql(P, _SIGN, _BIN, _TPL) + """, k AS (SELECT * FROM tp), c AS (SELECT z.capture_id, label, z.bin - k.bin AS lag, sum(value * t) AS s FROM z, k GROUP BY 1, 2, 3), r AS (SELECT c.capture_id, c.label, lag, s / (sn * tn + 1e-9) AS r FROM c JOIN (SELECT capture_id, sqrt(sum(value::DOUBLE * value)) AS sn FROM z GROUP BY 1) a USING (capture_id) JOIN (SELECT label, sqrt(sum(t * t)) AS tn FROM k GROUP BY 1) b USING (label))
SELECT capture_id, label, count(*) AS lags, round(max(r), 6) AS best FROM r GROUP BY 1, 2""")
def f28(spark, sf_dir):
    own, _, templates = signal_templates(spark, sf_dir)
    out = signals.cross_correlation(own, templates)
    return rounded(out.groupBy("capture_id", "label").agg(F.count(F.lit(1)).alias("lags"), F.max("correlation").alias("best")))


@query("x6_signal_feature_table")
def x6(spark, sf_dir):
    own, _, templates = signal_templates(spark, sf_dir)
    return signals.signal_features(own, templates, ["even", "odd"])


# --- symbol texts: each user's events as letters, the label is the user modulo 4 ----------------------------------------
_TX = "tx AS (SELECT CAST(user_id AS VARCHAR) AS sample, 'l' || (user_id % 4) AS label, string_agg(event_type[1:1], '' ORDER BY ts, event_id) AS text FROM events GROUP BY user_id)"
_SIM = "1 - levenshtein(a.text, b.text) / greatest(length(a.text), length(b.text), 1)"
_PAIR = f"pr AS (SELECT a.sample AS sample_a, b.sample AS sample_b, a.label AS label_a, b.label AS label_b, {_SIM} AS similarity FROM tx a JOIN tx b ON a.sample < b.sample)"


def texts(spark, sf_dir):
    own = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", F.substring("event_type", 1, 1).alias("c")))), lambda x: x["c"]), "").alias("t"))
    return own.select(F.col("user_id").cast("string").alias("sample"), F.concat(F.lit("l"), (F.col("user_id") % 4).cast("string")).alias("label"), F.col("t").alias("text"))


@query("j5_pairs_within_label", with_sql(_TX, _PAIR) + " SELECT sample_a, sample_b, round(similarity, 6) AS similarity FROM pr WHERE label_a = label_b")
def j5(spark, sf_dir):
    return rounded(signals.text_pairs(texts(spark, sf_dir)).select("sample_a", "sample_b", "similarity"))


@query("j5_similar_pairs_banded", with_sql(_TX, _PAIR) + " SELECT sample_a, sample_b, round(similarity, 6) AS similarity FROM pr WHERE label_a = label_b AND similarity >= 0.4")
def j5b(spark, sf_dir):
    return rounded(signals.text_pairs(texts(spark, sf_dir), True, 0.4).select("sample_a", "sample_b", "similarity"))


@query("j5_near_pairs", with_sql(_TX, "tz AS (SELECT sample, label, text || substr(text, 1, CAST(sample AS INTEGER) % 3) AS text FROM (SELECT sample, label, substr(text, 1, 30) AS text FROM tx) UNION ALL SELECT sample || 'b', label, reverse(substr(text, 3, 30)) || substr(text, 1, 2) FROM tx UNION ALL SELECT sample || 'c', label, reverse(substr(text, 3, 29)) || substr(text, 2, 3) FROM tx)",
  _PAIR.replace("tx a JOIN tx b", "tz a JOIN tz b")) + " SELECT sample_a, sample_b, round(similarity, 6) AS similarity FROM pr WHERE label_a = label_b AND similarity >= 0.85")
def j5c(spark, sf_dir):
    """Near pairs by shared pieces: the event texts' beginnings, and two variants of each that lie close together."""
    own = texts(spark, sf_dir)
    cut = lambda a, n: F.substring("text", a, n)
    rows = own.withColumn("text", F.expr("concat(substring(text, 1, 30), substring(substring(text, 1, 30), 1, cast(sample as int) % 3))"))
    for mark, text in (("b", F.concat(F.reverse(cut(3, 30)), cut(1, 2))), ("c", F.concat(F.reverse(cut(3, 29)), cut(2, 3)))):
        rows = rows.unionByName(own.select(F.concat("sample", F.lit(mark)).alias("sample"), "label", text.alias("text")))
    return rounded(signals.text_pairs(rows, True, 0.85).select("sample_a", "sample_b", "similarity"))


@query("a24_separability", with_sql(_TX, _PAIR) + " SELECT round(avg(similarity) FILTER (label_a = label_b), 6) AS within, round(avg(similarity) FILTER (label_a <> label_b), 6) AS between, round(avg(similarity) FILTER (label_a = label_b) - avg(similarity) FILTER (label_a <> label_b), 6) AS separability FROM pr")
def a24(spark, sf_dir):
    return rounded(signals.separability(texts(spark, sf_dir)))


_MED = """bo AS (SELECT label_a AS label, sample_a AS sample, similarity FROM pr WHERE label_a = label_b UNION ALL SELECT label_a, sample_b, similarity FROM pr WHERE label_a = label_b UNION ALL SELECT label, sample, 1.0 FROM tx),
me AS (SELECT * FROM (SELECT label, sample, avg(similarity) AS mean_similarity, count(*) FILTER (similarity >= 0.7) AS support, row_number() OVER (PARTITION BY label ORDER BY round(avg(similarity), 9) DESC, sample) AS r FROM bo GROUP BY 1, 2) WHERE r = 1)"""


@query("x4_medoid_templates", with_sql(_TX, _PAIR, _MED) + " SELECT label, sample, round(mean_similarity, 6) AS mean_similarity, support, text FROM me JOIN tx USING (sample, label)")
def x4(spark, sf_dir):
    return rounded(signals.medoid_templates(texts(spark, sf_dir)).select("label", "sample", "mean_similarity", "support", "text"))


@query("x4_diverse_templates", with_sql(_TX, _PAIR) + """, bd AS (SELECT label_a AS label, sample_a AS sample, sample_b AS other, similarity FROM pr WHERE label_a = label_b UNION ALL SELECT label_a, sample_b, sample_a, similarity FROM pr WHERE label_a = label_b),
cd AS (SELECT tx.label, tx.sample, coalesce(avg(similarity), 1) AS m, 1 + count(*) FILTER (similarity >= 0.45) AS n FROM tx LEFT JOIN bd USING (label, sample) GROUP BY 1, 2),
t1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(m, 9) DESC, n DESC, sample) AS r FROM cd) WHERE r = 1),
t2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(m, 9) DESC, n DESC, sample) AS r FROM cd WHERE n >= 2 AND NOT EXISTS (SELECT 1 FROM t1 WHERE t1.label = cd.label AND t1.sample = cd.sample) AND NOT EXISTS (SELECT 1 FROM t1 JOIN bd ON bd.label = t1.label AND bd.other = t1.sample WHERE bd.label = cd.label AND bd.sample = cd.sample AND similarity >= 0.45)) WHERE r = 1)
SELECT label, CAST(1 AS INTEGER) AS rank, sample, round(m, 6) AS mean_similarity, n AS support FROM t1 UNION ALL SELECT label, 2, sample, round(m, 6), n FROM t2""")
def x4d(spark, sf_dir):
    return rounded(signals.diverse_templates(texts(spark, sf_dir), diversity=0.45).withColumn("support", F.col("support").cast("long")))


@query("j6_best_template", with_sql(_TX, _PAIR, _MED) + """, sc AS (SELECT a.sample, a.label, me.label AS best, 1 - levenshtein(a.text, t.text) / greatest(length(a.text), length(t.text), 1) AS s FROM tx a, me JOIN tx t ON t.sample = me.sample), rk AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY s DESC, best) AS r, lead(s) OVER (PARTITION BY sample ORDER BY s DESC, best) AS nxt FROM sc) SELECT sample, label, best, round(s, 6) AS similarity, round(s - coalesce(nxt, 0), 6) AS margin FROM rk WHERE r = 1""")
def j6(spark, sf_dir):
    own = texts(spark, sf_dir)
    return rounded(signals.match_templates(own, signals.medoid_templates(own)))


@query("x14_leave_one_out", with_sql(_TX, _PAIR) + ", bo AS (SELECT sample_a AS sample, label_b AS best, similarity FROM pr UNION ALL SELECT sample_b, label_a, similarity FROM pr) SELECT tx.sample, tx.label, (SELECT arg_min(best, (-similarity, best)) FROM bo WHERE bo.sample = tx.sample) AS best FROM tx")
def x14(spark, sf_dir):
    return signals.leave_one_out(texts(spark, sf_dir))


@query("f23_nearest_center_symbol", with_sql(P) + """, m AS (SELECT avg(l) AS a, stddev_pop(l) AS s FROM (SELECT ln(size + 1) AS l FROM p)), z AS (SELECT idx, capture_id, (ln(size + 1) - a) / s AS z FROM p, m), c AS (SELECT c, chr(64 + CAST(row_number() OVER (ORDER BY c) AS INTEGER)) AS s FROM (SELECT avg(z) AS c FROM z GROUP BY floor(greatest(-2, least(z, 1.9))))) SELECT idx, (SELECT arg_min(s, ((z - c) ** 2, s)) FROM c) AS symbol FROM z""")
def f23(spark, sf_dir):
    """Centers are fitted: the means of the standardised values between whole numbers."""
    own = windows.zscore(packets(spark, sf_dir).select("idx", outliers.softsign_log(F.col("size").cast("double")).alias("z")), ["z"])
    centers = own.groupBy(F.floor(F.greatest(F.lit(-2.0), F.least("z", F.lit(1.9))))).agg(F.avg("z").alias("c")).select("c").collect()
    return outliers.nearest_center(own, ["z"], [[r.c] for r in centers]).select("idx", "symbol")


@query("x20_capture_decision")
def x20(spark, sf_dir):
    """Symbols of windows, runs cut to three, nearest template, and a decision by the label's threshold."""
    own = outliers.cluster_symbols(hourly(spark, sf_dir).select("capture_id", "window_idx", "pkt_count", "byte_count"), ["pkt_count", "byte_count"], 5)
    text = windows.compress_runs(own, ["capture_id"], "window_idx", "symbol")
    samples = text.select(F.col("capture_id").cast("string").alias("sample"), F.concat(F.lit("l"), (F.col("capture_id") % 2).cast("string")).alias("label"), "text")
    scored = signals.match_templates(samples, signals.medoid_templates(samples)).withColumn("anomaly", 1 - F.col("similarity"))
    limits = metrics.label_thresholds(scored, "best", "anomaly").select("best", "threshold")
    return scored.join(F.broadcast(limits), "best").select("sample", "best", "similarity", "anomaly", "threshold", (F.col("anomaly") <= F.col("threshold")).alias("passed"))


@query("x22_signal_pipeline")
def x22(spark, sf_dir):
    own = windows.signal_bins(profiles.signed_direction(packets(spark, sf_dir)), 60 * MINUTE)
    labels = own.select("capture_id").distinct().withColumn("label", F.when(F.col("capture_id") % 2 == 0, "even").otherwise("odd"))
    near = signals.template_distances(own, signals.average_templates(own, labels))
    best = near.groupBy("capture_id").agg(F.max_by("label", "cosine").alias("predicted"), F.max("cosine").alias("confidence"))
    return labels.join(best, "capture_id")


@query("c11_task_step_scores")
def c11(spark, sf_dir):
    """Users' letters as samples, labelled by the user's most frequent event type; even users' sequences give the graph."""
    from .adapters import actions

    kinds = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    label = kinds.groupBy(F.col("user_id").cast("string").alias("sample")).agg(F.min_by("event_type", F.struct(-F.col("n"), F.col("event_type"))).alias("label"))
    samples = texts(spark, sf_dir).drop("label").join(label, "sample")
    steps = actions(spark, sf_dir)
    graph = conformance.adjacency(conformance.as_sequences(steps.where(F.split("seq_id", "-")[0].cast("long") % 2 == 0)))
    templates = signals.medoid_templates(samples)
    scored = signals.match_templates(samples, templates).withColumn("anomaly", 1 - F.col("similarity"))
    return signals.score_task_steps(steps, samples, templates, graph, metrics.label_thresholds(scored, "best", "anomaly"))


# --- the motion model: captures of users by kind of day, hourly windows ----------------------------------------------
MOTION = ["pkt_count", "byte_count", "mean_len", "small_count", "large_count", "up_bytes"]


def motion_windows(spark, sf_dir):
    """Windows of twelve hours of each user's packets; the label is the user modulo 3, the sample the user."""
    own = packets(spark, sf_dir).withColumn("capture_id", F.col("src_port") - 1024)
    out = windows.window_features(own, 720 * MINUTE)
    return out.withColumns({"sample": F.col("capture_id").cast("string"), "label": F.concat(F.lit("m"), (F.col("capture_id") % 3).cast("string"))})


@query("x21_motion_training")
def x21(spark, sf_dir):
    _, found = motion.train_motion(motion_windows(spark, sf_dir), MOTION)
    return found["scores"].select("sample", "label", "best", F.round("similarity", 6).alias("similarity"), F.round("anomaly", 6).alias("anomaly"), "threshold", "is_anomaly")


def motion_texts(found):
    """Three captures of each label in a row as one long capture."""
    own = found["sequences"].withColumn("n", F.floor((F.row_number().over(Window.partitionBy("label").orderBy("sample")) - 1) / 3))
    return own.groupBy(F.concat_ws("-", "label", F.col("n").cast("string")).alias("capture_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sample", "text"))), lambda x: x["text"]), "").alias("text"))


@query("x18_best_path_segments")
def x18(spark, sf_dir):
    _, found = motion.train_motion(motion_windows(spark, sf_dir), MOTION)
    return motion.segment_captures("dp", motion_texts(found), found)


@query("x19_method_dispatch")
def x19(spark, sf_dir):
    """Segments of long captures by scan and by transcript, and runs of commands."""
    _, found = motion.train_motion(motion_windows(spark, sf_dir), MOTION)
    texts_, commands = motion_texts(found), packets(spark, sf_dir).select("capture_id", "idx", F.col("kind").alias("label"))
    parts = {"scan": motion.segment_captures("scan", texts_, found, least=4), "scripted": motion.segment_captures("scripted", texts_.where("capture_id LIKE 'm1%'"), found, ["m1", "m1", "m1"]), "command": motion.segment_captures("command", texts_, found, commands=commands)}
    out = None
    for name, part in parts.items():
        own = part.withColumn("method", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out


def profiles_of_samples(spark, sf_dir):
    """One vector for each sample: mean, deviation, maximum and sum of each window column."""
    own = windows.traffic_profile(motion_windows(spark, sf_dir), ["label", "sample"], MOTION)
    return own, [c for c in own.columns if c not in ("label", "sample")]


@query("x8_profile_classifier")
def x8(spark, sf_dir):
    """Extra-trees on the profiles of even users, applied to all."""
    own, names = profiles_of_samples(spark, sf_dir)
    model, labels = forests.fit_extra_trees(own.where(F.col("sample").cast("long") % 2 == 0), "sample", names, "label", trees=200)
    return forests.predict_extra_trees(own, model, labels, names).select("sample", "label", "predicted", F.round("confidence", 6).alias("confidence"))


@query("x15_leave_one_out_report")
def x15(spark, sf_dir):
    """Captures by user modulo 40, each predicted by trees grown from the others."""
    rows = motion_windows(spark, sf_dir).withColumns({"sample": (F.col("capture_id") % 40).cast("string"), "label": F.concat(F.lit("m"), (F.col("capture_id") % 2).cast("string"))})
    own = windows.traffic_profile(rows, ["label", "sample"], MOTION)
    return forests.leave_one_out_report(own, "sample", [c for c in own.columns if c not in ("label", "sample")], "label")
