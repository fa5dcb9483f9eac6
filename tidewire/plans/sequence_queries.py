"""Queries of the conformance operators; users with an even id train the model, all sequences are checked."""

from __future__ import annotations

import functools

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import conformance as ops
from ..operators.scans import ranked
from ..sources.shared import checkpointed, own_folder, remove
from ..sources.tables import evidence_rows
from .adapters import A, actions, with_sql
from .registry import query

# Training steps: the sequences of users whose number is even.
T = "t AS (SELECT * FROM a WHERE CAST(split_part(seq_id, '-', 1) AS BIGINT) % 2 = 0), ts AS (SELECT seq_id, list(action ORDER BY pos) AS seq FROM t GROUP BY seq_id)"
M = "m AS (SELECT src, dst, n, round(n / sum(n) OVER (PARTITION BY src), 6) AS p, (sum(n) OVER (PARTITION BY src))::BIGINT AS support FROM (SELECT src, dst, count(*) AS n FROM (SELECT action AS src, coalesce(lead(action) OVER (PARTITION BY seq_id ORDER BY pos), '__END__') AS dst FROM t) GROUP BY src, dst))"
X = """x AS (SELECT context, dst, n, round(n / sum(n) OVER (PARTITION BY context), 6) AS p, (sum(n) OVER (PARTITION BY context))::BIGINT AS support FROM (SELECT array_to_string(seq[i - k + 1:i], '|') AS context, coalesce(seq[i + 1], '__END__') AS dst, count(*) AS n
  FROM (SELECT seq, i, unnest(range(1, least(i, 3) + 1)) AS k FROM (SELECT seq, unnest(range(1, len(seq) + 1)) AS i FROM ts)) GROUP BY 1, 2))"""
# Each history's longest known context, and the contexts' tables of the likeliest actions.
H = """h AS (SELECT seq_id, pos, previous, actual, history, (SELECT arg_max(c, k) FROM (SELECT k, array_to_string(history[len(history) - k + 1:], '|') AS c FROM (SELECT unnest(range(1, least(len(history), 3) + 1)) AS k)) WHERE c IN (SELECT context FROM x)) AS context
  FROM (SELECT seq_id, pos, lag(action) OVER w AS previous, action AS actual, list(action) OVER (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS history FROM a WINDOW w AS (PARTITION BY seq_id ORDER BY pos)) WHERE previous IS NOT NULL),
y AS (SELECT *, max(p) OVER (PARTITION BY context) AS allmax, max(CASE WHEN dst <> '__END__' THEN p END) OVER (PARTITION BY context) AS actmax, row_number() OVER (PARTITION BY context ORDER BY p DESC, dst) AS rank FROM x)"""


def train(spark, sf_dir):
    return actions(spark, sf_dir).where(F.split("seq_id", "-")[0].cast("long") % 2 == 0)


@query("a26_transition_matrix", with_sql(A, T, M) + " SELECT * FROM m")
def a26(spark, sf_dir):
    return ops.transition_matrix(train(spark, sf_dir))


@query("a27_context_transitions", with_sql(A, T, X) + " SELECT * FROM x")
def a27(spark, sf_dir):
    return ops.context_transitions(train(spark, sf_dir))


@query("a28_prefix_graph", with_sql(A, T) + " SELECT array_to_string(seq[1:i], '|') AS prefix, seq[i + 1] AS next, count(*) AS n FROM (SELECT seq, unnest(range(1, len(seq))) AS i FROM ts) GROUP BY 1, 2")
def a28(spark, sf_dir):
    return ops.prefix_graph(ops.as_sequences(train(spark, sf_dir)))


@query("a28_adjacency", with_sql(A, T) + " SELECT action, list_sort(list(DISTINCT nxt) FILTER (nxt IS NOT NULL)) AS successors, bool_or(pos = 0) AS starts, bool_or(nxt IS NULL) AS ends FROM (SELECT action, pos, lead(action) OVER (PARTITION BY seq_id ORDER BY pos) AS nxt FROM t) GROUP BY action")
def a28b(spark, sf_dir):
    return ops.adjacency(ops.as_sequences(train(spark, sf_dir)))


@query("a29_distinct_templates", with_sql(A, T) + " SELECT seq, count(*) AS n FROM ts GROUP BY seq")
def a29(spark, sf_dir):
    return ops.distinct_templates(ops.as_sequences(train(spark, sf_dir)))


_ISLANDS = "r AS (SELECT seq_id, action, min(pos) AS first, count(*) AS n FROM (SELECT *, pos - row_number() OVER (PARTITION BY seq_id, action ORDER BY pos) AS g FROM {0}) GROUP BY seq_id, action, g)"


@query("a30_max_repeats", with_sql(A, T, _ISLANDS.format("t")) + " SELECT action, max(n) + 1 AS most FROM r GROUP BY action")
def a30(spark, sf_dir):
    return ops.max_repeats(train(spark, sf_dir), 1)


@query("w6_conformance_repeats", with_sql(A, T, _ISLANDS.format("a")) + " SELECT seq_id, first + 2 AS at, action, n, 2::BIGINT AS most FROM r WHERE n > 2")
def w6c(spark, sf_dir):
    own = actions(spark, sf_dir)
    return ops.repeat_violations(own, own.select("action").distinct().withColumn("most", F.lit(2).cast("long"))).select("seq_id", F.col("at").cast("long").alias("at"), "action", "n", "most")


@query("a31_critical_actions", with_sql(A, T) + " SELECT action, count(DISTINCT seq_id) / (SELECT count(*) FROM ts) AS share FROM t GROUP BY action HAVING count(DISTINCT seq_id) / (SELECT count(*) FROM ts) >= 0.7 AND action <> 'view'")
def a31(spark, sf_dir):
    return ops.critical_actions(ops.as_sequences(train(spark, sf_dir)), 0.7, ("view",))


@query("u2_noncritical_removed", with_sql(A, T) + " SELECT DISTINCT action FROM t EXCEPT SELECT 'view'")
def u2(spark, sf_dir):
    own = train(spark, sf_dir).select("action").distinct()
    return own.join(spark.createDataFrame([("view",)], "action string"), "action", "left_anti")


@query("a32_context_embeddings", with_sql(A, T, M) + """, k AS (SELECT DISTINCT action FROM t), i AS (SELECT dst AS action, src AS other, n / sum(n) OVER (PARTITION BY dst) AS q FROM m WHERE dst <> '__END__')
SELECT k.action, list_concat(list(round(coalesce(q, 0), 6) ORDER BY o.action), list(coalesce(m.p, 0) ORDER BY o.action)) AS embedding FROM k, k o LEFT JOIN i ON i.action = k.action AND i.other = o.action LEFT JOIN m ON m.src = k.action AND m.dst = o.action GROUP BY k.action""")
def a32(spark, sf_dir):
    return ops.context_embeddings(train(spark, sf_dir))


@query("a33_embedding_centers", """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(v) AS m FROM e GROUP BY 1, 2), d AS (SELECT label, vec_id, sqrt(sum((v - m) ** 2)) AS d FROM e JOIN c USING (label, i) GROUP BY 1, 2)
SELECT label, round(greatest(0.1, avg(d) + 3 * stddev_pop(d)), 6) AS threshold FROM d GROUP BY label""")
def a33(spark, sf_dir):
    from .adapters import table

    own = table(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v"))
    return ops.embedding_centers(own, ["label"], "v", 0.1).select("label", F.round("threshold", 6).alias("threshold"))


@query("c9_embedding_match", """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(v) AS m FROM e GROUP BY 1, 2), d AS (SELECT label, vec_id, sqrt(sum((v - m) ** 2)) AS d FROM e JOIN c USING (label, i) GROUP BY 1, 2), t AS (SELECT label, avg(d) + stddev_pop(d) AS t FROM d GROUP BY 1)
SELECT vec_id, round(d, 6) AS distance, d <= t AS matches FROM d JOIN t USING (label)""")
def c9(spark, sf_dir):
    from .adapters import table

    own = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    d = own.join(ops.embedding_centers(own, ["label"], "v"), "label").withColumn("distance", ops.euclidean(F.col("v"), F.col("center")))
    limits = d.groupBy("label").agg((F.avg("distance") + F.stddev_pop("distance")).alias("t"))
    return d.join(limits, "label").select("vec_id", F.round("distance", 6).alias("distance"), (F.col("distance") <= F.col("t")).alias("matches"))


# Histories of all steps, the first ones' empty; every fifth user's hold a label that no training sequence has before the step.
_H1 = """g AS (SELECT seq_id || '#' || pos AS id, 's' || (CAST(split_part(seq_id, '-', 1) AS BIGINT) % 3) AS scenario, list_concat(CASE WHEN CAST(split_part(seq_id, '-', 1) AS BIGINT) % 5 = 0 AND pos = 1 THEN ['idle'] ELSE [] END, coalesce(list(action) OVER (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), [])) AS history FROM a),
gc AS (SELECT *, (SELECT arg_max(c, k) FROM (SELECT k, array_to_string(history[len(history) - k + 1:], '|') AS c FROM (SELECT unnest(range(1, least(len(history), 3) + 1)) AS k)) WHERE c IN (SELECT context FROM x)) AS context FROM g),
b AS (SELECT '<START>' AS context, action AS dst, n, n / sum(n) OVER () AS p, (sum(n) OVER ())::BIGINT AS support FROM (SELECT seq[1] AS action, count(*) AS n FROM (SELECT DISTINCT seq FROM ts) GROUP BY 1)),
xb AS (SELECT context, dst, n, p, support FROM x UNION ALL SELECT * FROM b),
yb AS (SELECT *, max(p) OVER (PARTITION BY context) AS allmax, max(CASE WHEN dst <> '__END__' THEN p END) OVER (PARTITION BY context) AS actmax, row_number() OVER (PARTITION BY context ORDER BY p DESC, dst) AS rank FROM xb),
nx AS (SELECT id, scenario, rank, dst AS action, round(p, 4) AS probability, round(1 - p / CASE WHEN dst = '__END__' THEN allmax ELSE coalesce(actmax, allmax) END, 4) AS risk, support FROM gc JOIN yb ON yb.context = CASE WHEN len(history) = 0 THEN '<START>' ELSE gc.context END
  WHERE NOT (scenario = 's0' AND dst = 'error') AND NOT (scenario = 's1' AND dst NOT IN ('view', 'click', 'purchase')))"""


def scenario_rules(spark):
    return spark.createDataFrame([("s0", [], ["error"]), ("s1", ["view", "click", "purchase"], [])], "scenario string, allowed array<string>, forbidden array<string>")


def with_scenario(steps):
    return steps.withColumn("scenario", F.concat(F.lit("s"), (F.split("seq_id", "-")[0].cast("long") % 3).cast("string")))


def histories(spark, sf_dir):
    w = Window.partitionBy("seq_id").orderBy("pos")
    own = with_scenario(actions(spark, sf_dir)).withColumn("history", F.collect_list("action").over(w.rowsBetween(-3, -1)))
    odd = (F.split("seq_id", "-")[0].cast("long") % 5 == 0) & (F.col("pos") == 1)
    return own.select(F.concat_ws("#", "seq_id", "pos").alias("id"), "scenario", F.when(odd, F.concat(F.array(F.lit("idle")), "history")).otherwise(F.col("history")).alias("history"))


def predicted(spark, sf_dir, top):
    m = ops.fit_model(train(spark, sf_dir), parts=("contexts", "matrix", "starts"))
    return ops.predict_next(histories(spark, sf_dir), m["contexts"], m["matrix"], m["starts"], scenario_rules(spark), top=top)


@query("c1_next_actions", with_sql(A, T, X, _H1) + " SELECT id, rank, action, probability, risk, support FROM nx WHERE rank <= 3")
def c1(spark, sf_dir):
    return predicted(spark, sf_dir, 3)


@query("t3_likeliest_action", with_sql(A, T, X, _H1) + " SELECT id, action FROM nx WHERE rank = 1")
def t3(spark, sf_dir):
    return predicted(spark, sf_dir, 1).select("id", "action")


@query("c1_start_distribution", with_sql(A, T) + " SELECT action, count(*) AS n, count(*) / sum(count(*)) OVER () AS p FROM t WHERE pos = 0 GROUP BY action")
def c1s(spark, sf_dir):
    return ops.start_distribution(ops.as_sequences(train(spark, sf_dir)))


_FORBIDDEN = [("purchase", "signup", "no signup after purchase"), ("error", "purchase", "no purchase after error")]
_ANALYSIS = """f AS (SELECT 'purchase' AS previous, 'signup' AS actual UNION ALL SELECT 'error', 'purchase'),
z AS (SELECT h.seq_id, h.pos, h.previous, h.actual, h.context, coalesce(m.p, 0) AS mp, coalesce(y.p, 0) AS cp, f.actual IS NOT NULL AS forbidden, t.top, (CAST(split_part(h.seq_id, '-', 1) AS BIGINT) % 3 = 0 AND h.actual = 'error') OR (CAST(split_part(h.seq_id, '-', 1) AS BIGINT) % 3 = 1 AND h.actual NOT IN ('view', 'click', 'purchase')) AS against FROM h LEFT JOIN m ON m.src = h.previous AND m.dst = h.actual LEFT JOIN y ON y.context = h.context AND y.dst = h.actual LEFT JOIN f ON f.previous = h.previous AND f.actual = h.actual LEFT JOIN (SELECT DISTINCT context, coalesce(actmax, allmax) AS top FROM y) t ON t.context = h.context),
n AS (SELECT seq_id, pos, previous, actual, context, round(mp, 4) AS probability, round(cp, 4) AS context_probability, CASE WHEN forbidden OR against THEN 'ANOMALY' WHEN cp >= 0.15 THEN 'NORMAL' ELSE 'DEVIATION' END AS decision, round(1 - cp / top, 4) AS risk, CASE WHEN forbidden THEN 'forbidden' WHEN against THEN 'unseen' WHEN cp < 0.15 THEN 'low' WHEN mp >= 0.25 THEN 'high' WHEN mp >= 0.1 THEN 'medium' ELSE 'low' END AS level FROM z)"""


def analysis(spark, sf_dir):
    m = ops.fit_model(train(spark, sf_dir), parts=("contexts", "matrix", "embeddings"))
    forbidden = spark.createDataFrame(_FORBIDDEN, "previous string, actual string, rule string")
    return ops.transition_analysis(with_scenario(actions(spark, sf_dir)), m["matrix"], m["contexts"], forbidden, m["embeddings"], threshold=0.15, rules=scenario_rules(spark))


@query("c2_transition_decisions", with_sql(A, T, M, X, H, _ANALYSIS) + " SELECT seq_id, pos, previous, actual, context, probability, context_probability, decision, risk, level FROM n")
def c2(spark, sf_dir):
    return analysis(spark, sf_dir).drop("reason", "scored")


@query("c3_transition_summary", with_sql(A, T, M, X, H, _ANALYSIS) + " SELECT seq_id, count(*) AS transitions, floor(sum(round(risk * 10000)) / count(*) + 0.5) / 10000 AS mean_risk, round(max(risk), 4) AS max_risk, count(*) FILTER (level = 'forbidden') AS forbidden_count, count(*) FILTER (decision = 'DEVIATION') AS deviation_count, count(*) FILTER (decision = 'ANOMALY' AND level <> 'forbidden') AS unseen_count FROM n GROUP BY seq_id")
def c3(spark, sf_dir):
    return ops.transition_summary(analysis(spark, sf_dir))


@query("p14_anomalous_transitions", with_sql(A, T, M, X, H, _ANALYSIS) + " SELECT count(*) FILTER (decision = 'ANOMALY') AS anomalous, count(*) FILTER (decision <> 'NORMAL') AS not_normal, count(*) AS n FROM n")
def p14(spark, sf_dir):
    return analysis(spark, sf_dir).agg(F.count_if(F.col("decision") == "ANOMALY").alias("anomalous"), F.count_if(F.col("decision") != "NORMAL").alias("not_normal"), F.count(F.lit(1)).alias("n"))


@query("j10_scenario_violations", with_sql(A) + " SELECT seq_id, pos, action, CASE WHEN CAST(split_part(seq_id, '-', 1) AS BIGINT) % 3 = 0 THEN 'forbidden in scenario' ELSE 'outside scenario' END AS reason FROM a WHERE (CAST(split_part(seq_id, '-', 1) AS BIGINT) % 3 = 0 AND action = 'error') OR (CAST(split_part(seq_id, '-', 1) AS BIGINT) % 3 = 1 AND action NOT IN ('view', 'click', 'purchase'))")
def j10(spark, sf_dir):
    own = with_scenario(actions(spark, sf_dir))
    return ops.scenario_violations(own, own.select("action").distinct(), scenario_rules(spark))


# Templates of the checks: all different training sequences, numbered by their letters.
_TEMPLATES = "tp AS (SELECT row_number() OVER (ORDER BY txt) AS template_id, seq, txt FROM (SELECT seq, array_to_string(list_transform(seq, lambda v: v[1:1]), '') AS txt FROM ts GROUP BY seq)), sx AS (SELECT seq_id, seq, array_to_string(list_transform(seq, lambda v: v[1:1]), '') AS txt FROM s)"
_RANKED = "k AS (SELECT seq_id, template_id, levenshtein(sx.txt, tp.txt) AS distance, levenshtein(sx.txt, tp.txt) / greatest(length(sx.txt), length(tp.txt), 1) AS ratio, row_number() OVER (PARTITION BY seq_id ORDER BY levenshtein(sx.txt, tp.txt), levenshtein(sx.txt, tp.txt) / greatest(length(sx.txt), length(tp.txt), 1), template_id) AS rank FROM sx, tp)"


def templates(spark, sf_dir):
    """Sequences with text, templates with text: the first letters of the five labels differ, so they serve as codes."""
    letter = F.array_join(F.transform("seq", lambda x: F.substring(x, 1, 1)), "")
    sequences = ops.as_sequences(actions(spark, sf_dir)).withColumn("text", letter)
    own = ops.as_sequences(train(spark, sf_dir)).select("seq").distinct().withColumn("text", letter)
    return sequences, ops.held(ranked(own, [F.col("text")]).withColumn("template_id", F.col("position") + 1).drop("position"))


@query("j7_rank_templates", with_sql(A, T, _TEMPLATES, _RANKED) + " SELECT seq_id, rank, template_id, distance, ratio FROM k WHERE rank <= 3")
def j7(spark, sf_dir):
    sequences, own = templates(spark, sf_dir)
    return ops.rank_templates(sequences, own)


@query("c6_candidate_matches", with_sql(A, T, _TEMPLATES, _RANKED) + " SELECT seq_id, list(template_id ORDER BY rank) AS candidates, min(distance) AS best FROM k WHERE rank <= 3 GROUP BY seq_id")
def c6(spark, sf_dir):
    sequences, own = templates(spark, sf_dir)
    ranked = ops.rank_templates(sequences, own)
    return ranked.groupBy("seq_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "template_id"))), lambda x: x["template_id"]).alias("candidates"), F.min("distance").alias("best"))


@query("f24_label_edit_distance", with_sql(A) + " SELECT a.seq_id, levenshtein(array_to_string(list_transform(a.seq, lambda v: v[1:1]), ''), array_to_string(list_transform(b.seq, lambda v: v[1:1]), '')) AS distance FROM s a JOIN s b ON split_part(a.seq_id, '-', 1) = split_part(b.seq_id, '-', 1) AND split_part(b.seq_id, '-', 2) = '0'")
def f24(spark, sf_dir):
    own = ops.as_sequences(actions(spark, sf_dir))
    own = ops.coded(own, ops.label_codes(actions(spark, sf_dir))).withColumns({"u": F.split("seq_id", "-")[0], "k": F.split("seq_id", "-")[1]})
    first = own.where("k = '0'").select("u", F.col("text").alias("other"))
    return own.join(first, "u").select("seq_id", F.levenshtein("text", "other").alias("distance"))


@query("c4_best_alignment")
def c4(spark, sf_dir):
    sequences, own = templates(spark, sf_dir)
    return ops.align_best(sequences, own, ops.rank_templates(sequences, own, 1))


@query("c4_operation_counts", with_sql(A, T, _TEMPLATES, _RANKED) + " SELECT seq_id, template_id, distance AS edits FROM k WHERE rank = 1")
def c4b(spark, sf_dir):
    """As many operations other than matches as the edit distance says."""
    return c4(spark, sf_dir).select("seq_id", "template_id", F.size(F.filter("operations", lambda o: o["op"] != "match")).cast("long").alias("edits"))


def checked(spark, sf_dir):
    sequences, own = templates(spark, sf_dir)
    aligned = ops.align_best(sequences, own, ops.rank_templates(sequences, own, 1))
    hard = analysis(spark, sf_dir).where("level = 'forbidden'").select("seq_id")
    repeats = ops.repeat_violations(actions(spark, sf_dir), ops.max_repeats(train(spark, sf_dir)))
    return ops.sequence_status(aligned, sequences, own, ["purchase"], ["view"], hard, repeats)


@query("c5_sequence_status")
def c5(spark, sf_dir):
    return checked(spark, sf_dir)


@query("c14_explanations")
def c14(spark, sf_dir):
    repeats = ops.repeat_violations(actions(spark, sf_dir), ops.max_repeats(train(spark, sf_dir)))
    why = repeats.select("seq_id", "at", F.concat_ws(" ", F.col("action"), F.lit("repeated"), F.col("n").cast("string"), F.lit("times")).alias("reason"))
    return ops.explain(checked(spark, sf_dir), why).select("seq_id", "text", "decision.*")


@query("c12_review_queue")
def c12(spark, sf_dir):
    sequences = ops.as_sequences(actions(spark, sf_dir))
    pending = sequences.where("seq_id LIKE '1%'").select("seq").distinct()
    return ops.enqueue_reviews(pending, checked(spark, sf_dir), sequences)


@query("c7_graph_plausibility", with_sql(A, "t AS (SELECT * FROM a WHERE CAST(split_part(seq_id, '-', 1) AS BIGINT) % 2 = 0 AND action <> 'signup')") + """, w AS (SELECT seq_id, pos, lag(action) OVER (PARTITION BY seq_id ORDER BY pos) AS previous, action AS actual FROM a), e AS (SELECT DISTINCT lag(action) OVER (PARTITION BY seq_id ORDER BY pos) AS previous, action AS actual FROM t)
SELECT w.* FROM w WHERE (previous IS NULL AND actual NOT IN (SELECT action FROM t WHERE pos = 0)) OR (previous IS NOT NULL AND NOT EXISTS (SELECT 1 FROM e WHERE e.previous = w.previous AND e.actual = w.actual))""")
def c7(spark, sf_dir):
    own = actions(spark, sf_dir)
    graph = ops.adjacency(ops.as_sequences(train(spark, sf_dir).where("action <> 'signup'")))
    return ops.graph_plausibility(own, graph).withColumn("pos", F.col("pos").cast("int"))


# The longest subsequence along the edges from a start: all paths that end at each step, the later step of equal lengths.
_C8 = """eg(a, b) AS (VALUES ('view', 'click'), ('view', 'view'), ('click', 'signup'), ('click', 'purchase'), ('signup', 'purchase')),
pt AS (SELECT seq_id, pos, action, 1 AS n FROM a WHERE action IN ('view', 'click') UNION ALL SELECT a.seq_id, a.pos, a.action, pt.n + 1 FROM pt JOIN a ON a.seq_id = pt.seq_id AND a.pos > pt.pos JOIN eg ON eg.a = pt.action AND eg.b = a.action),
bt AS (SELECT seq_id, arg_max(action, (n, pos)) AS last, max(n) AS n FROM pt GROUP BY 1)"""


@query("c8_longest_valid_chain", "WITH RECURSIVE " + A + ", " + _C8 + """ SELECT s.seq_id, CAST(coalesce(n, 0) AS INTEGER) AS matched, last, CASE last WHEN 'view' THEN ['click', 'view'] WHEN 'click' THEN ['purchase', 'signup'] WHEN 'signup' THEN ['purchase'] WHEN 'purchase' THEN [] ELSE ['click', 'view'] END AS next,
CASE WHEN last IS NULL THEN 'NO_MATCH' WHEN last = 'purchase' THEN 'DEAD_END' ELSE 'IN_PROGRESS' END AS state FROM s LEFT JOIN bt USING (seq_id)""")
def c8(spark, sf_dir):
    graph = {"view": ["click", "view"], "click": ["signup", "purchase"], "signup": ["purchase"], "purchase": []}
    return ops.longest_valid_chain(ops.as_sequences(actions(spark, sf_dir)), graph, ["view", "click"], ["signup"])


@query("c10_fitted_model", with_sql(A, T, M, X) + """ SELECT 'templates' AS part, count(DISTINCT seq) AS n FROM ts UNION ALL SELECT 'contexts', count(*) FROM x UNION ALL SELECT 'matrix', count(*) FROM m UNION ALL SELECT 'starts', count(DISTINCT seq[1]) FROM ts
UNION ALL SELECT 'repeats', count(DISTINCT action) FROM t UNION ALL SELECT 'graph', count(DISTINCT action) FROM t UNION ALL SELECT 'embeddings', count(DISTINCT action) FROM t UNION ALL SELECT 'critical', count(*) FROM (SELECT v FROM (SELECT seq, unnest(list_distinct(seq)) AS v FROM (SELECT DISTINCT seq FROM ts)) GROUP BY v HAVING count(*) >= 0.5 * (SELECT count(DISTINCT seq) FROM ts))""")
def c10(spark, sf_dir):
    """How many rows each part of the fitted model has, after it was saved and read again."""
    folder = own_folder(spark, "conformance")
    ops.save_model(ops.fit_model(train(spark, sf_dir), least=0.5), folder)
    parts = [part.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n") for name, part in ops.load_model(spark, folder).items()]
    out = checkpointed(functools.reduce(lambda a, b: a.unionByName(b), parts))
    remove(spark, folder)
    return out


@query("c13_clean_sequences", with_sql(A) + " SELECT seq_id, list_filter(list_transform(seq, lambda v: CASE WHEN v = 'error' THEN '' ELSE v END), lambda v: v <> '') AS seq FROM s")
def c13(spark, sf_dir):
    own = ops.as_sequences(actions(spark, sf_dir))
    return own.select("seq_id", ops.clean_sequence(F.transform("seq", lambda x: F.when(x == "error", "  ").otherwise(F.concat(F.lit(" "), x)))).alias("seq"))


@query("c15_known_actions", with_sql(A, T) + " SELECT DISTINCT action FROM t")
def c15(spark, sf_dir):
    return ops.known_actions(ops.fit_model(train(spark, sf_dir), parts=("templates", "matrix")))


@query("c15_status_summary")
def c15b(spark, sf_dir):
    return ops.status_summary(checked(spark, sf_dir))


@query("c13_clean_items", with_sql(A) + " SELECT seq_id, list_filter(list_transform(seq, lambda v: CASE WHEN v = 'error' THEN '' ELSE v END), lambda v: v <> '') AS labels, len(list_filter(seq, lambda v: v = 'view'))::INTEGER AS embedded FROM s")
def c13b(spark, sf_dir):
    item = lambda x: F.struct(F.when(x == "error", "  ").otherwise(F.concat(F.lit(" "), x)).alias("label"), F.when(x == "view", F.array(F.lit(1.0))).otherwise(F.array().cast("array<double>")).alias("embedding"))
    own = ops.as_sequences(actions(spark, sf_dir)).select("seq_id", ops.clean_items(F.transform("seq", item)).alias("i"))
    return own.select("seq_id", F.transform("i", lambda x: x["label"]).alias("labels"), F.size(F.filter("i", lambda x: x["embedding"].isNotNull())).alias("embedded"))


@query("u4_new_templates_only", with_sql(A, T) + " SELECT DISTINCT seq FROM s WHERE seq NOT IN (SELECT seq FROM ts)")
def u4(spark, sf_dir):
    own = ops.as_sequences(actions(spark, sf_dir)).select("seq").distinct()
    return own.join(ops.as_sequences(train(spark, sf_dir)).select("seq").distinct(), "seq", "left_anti")


@query("a46_model_inventory", with_sql(A, T, M, X) + " SELECT (SELECT count(DISTINCT seq) FROM ts) AS templates, (SELECT count(DISTINCT context) FROM x) AS contexts, (SELECT count(DISTINCT src) FROM m) AS rows_in_matrix, (SELECT count(DISTINCT action) FROM t) AS actions")
def a46(spark, sf_dir):
    own = train(spark, sf_dir)
    parts = [ops.as_sequences(own).agg(F.countDistinct("seq").alias("templates")), ops.context_transitions(own).agg(F.countDistinct("context").alias("contexts")), ops.transition_matrix(own).agg(F.countDistinct("src").alias("rows_in_matrix")), own.agg(F.countDistinct("action").alias("actions"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))
    return out


@query("f39_evidence_rows", with_sql(A, T, M, X, H, _ANALYSIS) + """, tr AS (SELECT a.action, max(n) AS most FROM (SELECT seq_id, action, g, count(*) AS n FROM (SELECT *, pos - row_number() OVER (PARTITION BY seq_id, action ORDER BY pos) AS g FROM t) GROUP BY ALL) a GROUP BY 1), ru AS (SELECT seq_id, action, g, count(*) AS n, min(pos) AS first FROM (SELECT *, pos - row_number() OVER (PARTITION BY seq_id, action ORDER BY pos) AS g FROM a) GROUP BY ALL)
SELECT seq_id, CAST(first + most AS INTEGER) AS at, 'violation' AS kind, action || ' repeated ' || n || ' times' AS detail FROM ru JOIN tr USING (action) WHERE n > most UNION ALL SELECT seq_id, pos, CASE WHEN level = 'forbidden' THEN 'forbidden' ELSE 'transition' END, previous || ' -> ' || actual FROM n WHERE decision IN ('ANOMALY', 'DEVIATION')""")
def f39(spark, sf_dir):
    repeats = ops.repeat_violations(actions(spark, sf_dir), ops.max_repeats(train(spark, sf_dir)))
    violations = repeats.select("seq_id", "at", F.concat(F.col("action"), F.lit(" repeated "), F.col("n").cast("string"), F.lit(" times")).alias("reason"))
    return evidence_rows(violations, analysis(spark, sf_dir))
