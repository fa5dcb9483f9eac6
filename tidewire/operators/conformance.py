"""Procedure conformance: transition models learned from action sequences, and checks of sequences against them.

Sequences are step tables (seq_id, pos from 0, action). A fitted model is a set of small tables; per-sequence work stays inside
rows of that sequence, whose length is the unit.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import models
from .edits import nearest_templates
from .metrics import sql_round
from .scans import ranked

END = "__END__"
START = "<START>"
#: Label codes begin in the private planes of Unicode: over 100,000 of them, and none is the mark of an unknown label.
_FIRST_CODE = 0xF0000
_SEQ = ("seq_id",)


def _own() -> Window:
    return Window.partitionBy("seq_id").orderBy("pos")


#: Rows up to which a model table is held by the driver and broadcast.
HELD = 100_000


def held(table: DataFrame) -> DataFrame:
    """A model table as rows in the plan if it has at most HELD of them, so that it is computed once and broadcast; else the table itself."""
    few = table.limit(HELD + 1).toArrow()
    return table.sparkSession.createDataFrame(few, table.schema) if few.num_rows <= HELD else table


def small(table: DataFrame) -> DataFrame:
    """A model table, broadcast if it has at most HELD rows; a larger one is left to the join's own plan."""
    return F.broadcast(table) if table.limit(HELD + 1).count() <= HELD else table


# --- learning --------------------------------------------------------------------------------------------------------
def as_sequences(steps: DataFrame) -> DataFrame:
    """seq_id, seq: the actions in order."""
    return steps.groupBy("seq_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "action"))), lambda x: x["action"]).alias("seq"))


def clean_sequence(seq: Column) -> Column:
    """Trimmed labels without blank ones."""
    return F.filter(F.transform(seq, lambda x: F.trim(x)), lambda x: x != "")


def _normalised(counts: DataFrame, key: str) -> DataFrame:
    return counts.withColumns({"p": sql_round(F.col("n") / F.sum("n").over(Window.partitionBy(key)), 6), "support": F.sum("n").over(Window.partitionBy(key))})


def transition_matrix(steps: DataFrame, end: str = END) -> DataFrame:
    """src, dst, n, p, support: how often dst follows src; the last action of a sequence is followed by the end marker."""
    pairs = steps.select(F.col("action").alias("src"), F.coalesce(F.lead("action").over(_own()), F.lit(end)).alias("dst"))
    return _normalised(pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")), "src")


def _context_counts(steps: DataFrame, most: int, end: str) -> DataFrame:
    """order, context (up to `most` actions, joined by |), dst, n."""
    back = F.collect_list("action").over(_own().rowsBetween(1 - most, 0))
    rows = steps.select(F.coalesce(F.lead("action").over(_own()), F.lit(end)).alias("dst"), back.alias("back"))
    found = rows.select("dst", F.explode(F.transform(F.sequence(F.lit(1), F.size("back")), lambda k: F.struct(k.alias("order"), F.array_join(F.slice("back", -k, k), "|").alias("context")))).alias("c"))
    return found.groupBy("c.order", "c.context", "dst").agg(F.count(F.lit(1)).alias("n"))


def context_transitions(steps: DataFrame, most: int = 3, end: str = END) -> DataFrame:
    """context (up to `most` actions, joined by |), dst, n, p, support."""
    return _normalised(_context_counts(steps, most, end).groupBy("context", "dst").agg(F.sum("n").alias("n")), "context")


def start_distribution(templates: DataFrame) -> DataFrame:
    """action, n, p of the first actions of the templates (a column seq)."""
    first = templates.groupBy(F.get("seq", F.lit(0)).alias("action")).agg(F.count(F.lit(1)).alias("n"))
    return first.crossJoin(F.broadcast(first.agg(F.sum("n").alias("_t")))).select("action", "n", (F.col("n") / F.col("_t")).alias("p"))


def distinct_templates(sequences: DataFrame) -> DataFrame:
    """seq, n: the different sequences and how often they came."""
    return sequences.groupBy("seq").agg(F.count(F.lit(1)).alias("n"))


def prefix_graph(sequences: DataFrame) -> DataFrame:
    """prefix (joined by |), next, n: what follows each prefix."""
    rows = sequences.select("seq", F.explode(F.sequence(F.lit(1), F.size("seq"))).alias("k"))
    return rows.where(F.col("k") < F.size("seq")).groupBy(F.array_join(F.slice("seq", F.lit(1), F.col("k")), "|").alias("prefix"), F.get("seq", F.col("k")).alias("next")).agg(F.count(F.lit(1)).alias("n"))


def adjacency(sequences: DataFrame) -> DataFrame:
    """action, successors (sorted), starts, ends: where it may lead and whether sequences start or end with it."""
    rows = sequences.select("seq", F.posexplode("seq").alias("i", "action"))
    out = rows.groupBy("action").agg(F.array_sort(F.collect_set(F.get("seq", F.col("i") + 1))).alias("successors"), F.bool_or(F.col("i") == 0).alias("starts"), F.bool_or(F.col("i") == F.size("seq") - 1).alias("ends"))
    return out


def max_repeats(steps: DataFrame, margin: int = 0) -> DataFrame:
    """action, most: the longest run of each action, plus the margin."""
    new = F.when(F.col("action").eqNullSafe(F.lag("action").over(_own())), 0).otherwise(1)
    islands = steps.withColumn("_n", new).withColumn("_run", F.sum("_n").over(_own().rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("seq_id", "_run", "action").agg(F.count(F.lit(1)).alias("n")).groupBy("action").agg((F.max("n") + margin).alias("most"))


def critical_actions(templates: DataFrame, least: float, noncritical: tuple[str, ...] = ()) -> DataFrame:
    """action, share of the templates that hold it: those of at least the given share, without the noncritical ones."""
    counts = templates.select(F.explode(F.array_distinct("seq")).alias("action")).groupBy("action").agg(F.count(F.lit(1)).alias("n"))
    out = counts.crossJoin(F.broadcast(templates.agg(F.count(F.lit(1)).alias("_t")))).select("action", (F.col("n") / F.col("_t")).alias("share"))
    return out.where((F.col("share") >= least) & ~F.col("action").isin(list(noncritical)))


def context_embeddings(steps: DataFrame, end: str = END) -> DataFrame:
    """action, embedding: shares of what comes before it, then of what comes after, over all actions in order."""
    return role_embeddings(held(transition_matrix(steps, end)), end)


def role_embeddings(matrix: DataFrame, end: str = END) -> DataFrame:
    """The embeddings of a transition matrix; every action has a row there."""
    seen = matrix.where(F.col("dst") != end)
    into = seen.withColumn("q", F.col("n") / F.sum("n").over(Window.partitionBy("dst"))).select(F.col("dst").alias("action"), F.col("src").alias("other"), "q")
    actions = F.broadcast(matrix.select(F.col("src").alias("action")).distinct())
    # The grid holds the square of the number of action kinds, a small vocabulary.
    grid = actions.crossJoin(actions.withColumnRenamed("action", "other"))
    full = grid.join(into, ["action", "other"], "left").join(seen.select(F.col("src").alias("action"), F.col("dst").alias("other"), "p"), ["action", "other"], "left")
    lists = full.groupBy("action").agg(F.array_sort(F.collect_list(F.struct("other", F.round(F.coalesce("q", F.lit(0.0)), 6).alias("q"), F.coalesce("p", F.lit(0.0)).alias("p")))).alias("_l"))
    return lists.select("action", F.concat(F.transform("_l", lambda x: x["q"]), F.transform("_l", lambda x: x["p"])).alias("embedding"))


def embedding_centers(rows: DataFrame, keys: list[str], vector: str, floor: float = 0.0) -> DataFrame:
    """keys, center, threshold: the mean vector, and the mean plus three population deviations of the distances to it."""
    mean = rows.select(*keys, F.posexplode(vector).alias("_i", "_v")).groupBy(*keys, "_i").agg(F.avg("_v").alias("_v"))
    center = mean.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_v"))), lambda x: x["_v"]).alias("center"))
    d = rows.join(center, keys).withColumn("_d", euclidean(F.col(vector), F.col("center")))
    return center.join(d.groupBy(*keys).agg(F.greatest(F.lit(floor), F.avg("_d") + 3 * F.stddev_pop("_d")).alias("threshold")), keys)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine within 0 and 1; 0 for different lengths or a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 1e-12), F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(a, b) / norm))).otherwise(0.0)


PARTS = ("templates", "contexts", "matrix", "starts", "repeats", "critical", "graph", "embeddings")


def fit_model(steps: DataFrame, most: int = 3, margin: int = 0, least: float = 0.8, noncritical: tuple[str, ...] = (), end: str = END, parts: tuple[str, ...] = PARTS) -> dict[str, DataFrame]:
    """The model of training steps (blank labels left out), as named tables; of all parts, or only of those asked for.

    templates (template_id by falling frequency, then labels; seq, n), contexts, matrix, starts, repeats, critical, graph and
    embeddings (a role from what comes before and after). Tables of at most HELD rows are computed once.
    """
    own, out = steps.select("seq_id", "pos", F.trim("action").alias("action")).where("action <> ''"), {}
    if {"contexts", "matrix", "embeddings"} & set(parts):
        counts = held(_context_counts(own, most, end))
        out["contexts"] = held(_normalised(counts.groupBy("context", "dst").agg(F.sum("n").alias("n")), "context"))
        out["matrix"] = held(_normalised(counts.where("order = 1").select(F.col("context").alias("src"), "dst", "n"), "src"))
    if {"templates", "starts", "critical", "graph"} & set(parts):
        templates = distinct_templates(as_sequences(own))
        numbered = ranked(templates, [-F.col("n"), F.array_join("seq", "|")])
        templates = held(numbered.select((F.col("position") + 1).alias("template_id"), "seq", "n"))
        out["templates"] = templates
    late = {"starts": lambda: start_distribution(templates), "repeats": lambda: max_repeats(own, margin), "critical": lambda: critical_actions(templates, least, noncritical), "graph": lambda: adjacency(templates), "embeddings": lambda: role_embeddings(out["matrix"], end)}
    return {name: out[name] if name in out else held(late[name]()) for name in parts}


def save_model(model: dict[str, DataFrame], folder: str) -> int:
    """Publish the parts as one version of the model, see `models.publish`; readers see the one before it or all of it. Returns its number."""
    return models.publish(model, folder)


def load_model(spark: SparkSession, folder: str, parts: tuple[str, ...] = PARTS, number: int | None = None) -> dict[str, DataFrame]:
    """Parts of the current version, or of a number, checked against what was published."""
    return models.load(spark, folder, parts, number)[0]


# --- next actions ----------------------------------------------------------------------------------------------------
def longest_context(histories: DataFrame, contexts: DataFrame, most: int = 3) -> DataFrame:
    """histories (id, history) with context: the longest suffix of up to `most` actions that the contexts hold; null if none."""
    keys = contexts.select("context").distinct()
    orders = F.when(F.size("history") > 0, F.sequence(F.lit(1), F.least(F.size("history"), F.lit(most))))
    tries = histories.select("id", F.explode(F.transform(orders, lambda k: F.struct(k.alias("k"), F.array_join(F.slice("history", -k, k), "|").alias("context")))).alias("t"))
    found = tries.select("id", "t.k", "t.context").join(small(keys), "context").groupBy("id").agg(F.max_by("context", "k").alias("context"))
    return histories.join(found, "id", "left")


def _scaled(table: DataFrame, end: str) -> DataFrame:
    """A transition table with the risk of each action: 1 less its probability over the greatest of its kind (the end counts apart)."""
    scale = Window.partitionBy("context")
    most = F.when(F.col("dst") == end, F.max("p").over(scale)).otherwise(F.coalesce(F.max(F.when(F.col("dst") != end, F.col("p"))).over(scale), F.max("p").over(scale)))
    return table.withColumn("risk", sql_round(1 - F.col("p") / most, 4)).withColumn("rank", F.row_number().over(scale.orderBy(F.desc("p"), "dst")))


def _within(rules: DataFrame | None, rows: DataFrame, action: str) -> DataFrame:
    """rows (with scenario) that their scenario allows: its allowed list is empty or holds the action, its forbidden list doesn't."""
    if rules is None:
        return rows
    no = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    out = rows.join(small(rules.select("scenario", "allowed", "forbidden")), "scenario", "left")
    return out.where(~F.array_contains(no("forbidden"), F.col(action)) & ((F.size(no("allowed")) == 0) | F.array_contains(no("allowed"), F.col(action)))).drop("allowed", "forbidden")


def predict_next(histories: DataFrame, contexts: DataFrame, matrix: DataFrame | None = None, starts: DataFrame | None = None, rules: DataFrame | None = None, top: int = 5, most: int = 3, end: str = END) -> DataFrame:
    """id, rank, action, probability, risk, support: the likeliest next actions of each history (id, history, and scenario with rules).

    The table is that of the longest known context; without one that of the last action in the matrix, and for an empty history
    the distribution of starts. A scenario's rules take actions out of the top ones; ranks stay as they were.
    """
    own = ["id", "scenario"] if rules is not None else ["id"]
    found = longest_context(histories, contexts, most).withColumn("context", F.coalesce("context", F.when(F.size("history") == 0, F.lit(START)).otherwise(F.concat(F.lit("\0"), F.element_at("history", -1)))))
    table = contexts.select("context", "dst", "p", "support")
    if matrix is not None:
        # A context of one action and a row of the matrix are told apart by their keys.
        table = table.unionByName(matrix.select(F.concat(F.lit("\0"), "src").alias("context"), "dst", "p", "support"))
    if starts is not None:
        total = starts.agg(F.sum("n").alias("support"))
        table = table.unionByName(starts.crossJoin(F.broadcast(total)).select(F.lit(START).alias("context"), F.col("action").alias("dst"), "p", "support"))
    ranked = _scaled(table, end).where(F.col("rank") <= top)
    out = found.select(*own, "context").join(small(ranked), "context").withColumnRenamed("dst", "action")
    return _within(rules, out, "action").select("id", "rank", "action", sql_round(F.col("p"), 4).alias("probability"), "risk", "support")


def transition_analysis(steps: DataFrame, matrix: DataFrame, contexts: DataFrame, forbidden: DataFrame | None = None, embeddings: DataFrame | None = None, threshold: float = 0.08, most: int = 3, end: str = END, rules: DataFrame | None = None) -> DataFrame:
    """Every transition with probability, context probability, decision, risk and level.

    Decisions in order: an unknown action, one that its scenario (a column of steps, with rules) forbids or lacks, and a forbidden
    pair are an ANOMALY; context probability at the threshold NORMAL; else DEVIATION, whose
    reason tells a rare transition, a similar role, or an unseen one. All lookups are joins with the small model tables.
    """
    w = _own()
    scenario = ["scenario"] if rules is not None else []
    out = steps.select("seq_id", "pos", *scenario, F.lag("action").over(w).alias("previous"), F.col("action").alias("actual"), F.collect_list("action").over(w.rowsBetween(-most, -1)).alias("history")).where("previous IS NOT NULL")
    scale = Window.partitionBy("context")
    table = contexts.withColumns({"_all": F.max("p").over(scale), "_acts": F.max(F.when(F.col("dst") != end, F.col("p"))).over(scale), "rank": F.row_number().over(scale.orderBy(F.desc("p"), "dst"))})
    # One row a context: its probabilities and the greatest. Held tables have a known size, so that Spark broadcasts small ones itself.
    folded = table.groupBy("context").agg(F.map_from_entries(F.collect_list(F.struct("dst", "p"))).alias("probs"), F.max(F.coalesce("_acts", "_all")).alias("top"))
    folded = held(folded)
    for k in range(most, 0, -1):
        key = F.when(F.size("history") >= k, F.array_join(F.slice("history", -k, k), "|"))
        out = out.join(folded.select(F.col("context").alias(f"_k{k}"), F.struct("context", "probs", "top").alias(f"_m{k}")), key == F.col(f"_k{k}"), "left")
    out = out.withColumn("_m", F.coalesce(*[f"_m{k}" for k in range(most, 0, -1)]))
    out = out.withColumns({"context": F.col("_m.context"), "cp": F.try_element_at("_m.probs", F.col("actual")), "_top": F.col("_m.top")}).drop("_m", *[f"_{c}{k}" for k in range(1, most + 1) for c in "km"])
    rows = held(matrix.groupBy("src").agg(F.map_from_entries(F.collect_list(F.struct("dst", "p"))).alias("_row")))
    out = out.join(rows.withColumnRenamed("src", "previous"), "previous", "left").withColumn("mp", F.try_element_at("_row", F.col("actual")))
    out = out.join(rows.select(F.col("src").alias("actual"), F.lit(True).alias("_known")), "actual", "left")
    out = out.join(small(forbidden.select("previous", "actual", "rule")), ["previous", "actual"], "left") if forbidden is not None else out.withColumn("rule", F.lit(None).cast("string"))
    against = F.lit(None).cast("string")
    if rules is not None:
        out = out.join(small(rules.select("scenario", "allowed", F.col("forbidden").alias("_not"))), "scenario", "left")
        no = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
        against = F.when(F.array_contains(no("_not"), F.col("actual")), "forbidden in scenario").when((F.size(no("allowed")) > 0) & ~F.array_contains(no("allowed"), F.col("actual")), "outside scenario")
    out = out.withColumn("_against", against)
    if embeddings is not None:
        # Only transitions that the context hasn't seen look at roles: the others have no key for these joins.
        unseen = F.col("cp").isNull() & F.col("_known").isNotNull() & F.col("rule").isNull() & F.col("_against").isNull()
        roles = held(embeddings)
        likely = table.where("rank <= 5").select("context", F.col("dst").alias("action")).join(roles, "action").groupBy(F.col("context").alias("_c")).agg(F.collect_list("embedding").alias("_likely"))
        out = out.join(held(likely), F.when(unseen, F.col("context")) == F.col("_c"), "left").join(roles.select(F.col("action").alias("_a"), "embedding"), F.when(unseen, F.col("actual")) == F.col("_a"), "left")
        out = out.withColumn("similarity", F.coalesce(F.array_max(F.transform("_likely", lambda e: cosine(F.col("embedding"), e))), F.lit(0.0)))
    else:
        out = out.withColumn("similarity", F.lit(0.0))
    cp, mp = F.coalesce("cp", F.lit(0.0)), F.coalesce("mp", F.lit(0.0))
    decision = F.when(F.col("_known").isNull() | F.col("_against").isNotNull() | F.col("rule").isNotNull(), "ANOMALY").when(cp >= threshold, "NORMAL").otherwise("DEVIATION")
    reason = F.when(F.col("_known").isNull(), "unknown action").when(F.col("_against").isNotNull(), F.col("_against")).when(F.col("rule").isNotNull(), "forbidden").when(cp >= threshold, "matches context").when(cp > 0, "rare").when(F.coalesce("similarity", F.lit(0.0)) >= 0.82, "similar role").otherwise("unseen")
    level = F.when(F.col("rule").isNotNull(), "forbidden").when(decision == "ANOMALY", "unseen").when(decision == "DEVIATION", "low").when(F.col("_row").isNull(), "unknown").when(F.col("mp").isNull(), "unseen").when(mp >= 0.25, "high").when(mp >= 0.10, "medium").otherwise("low")
    risk = sql_round(F.when(F.col("_top") > 0, 1 - cp / F.col("_top")).otherwise(1.0), 4)
    return out.select("seq_id", "pos", "previous", "actual", "context", sql_round(mp, 4).alias("probability"), sql_round(cp, 4).alias("context_probability"), decision.alias("decision"), reason.alias("reason"), risk.alias("risk"), level.alias("level"), (F.col("_row").isNotNull() | F.col("rule").isNotNull()).alias("scored"))


def transition_summary(analysis: DataFrame) -> DataFrame:
    risk = F.when(F.col("scored"), F.col("risk"))
    return analysis.groupBy("seq_id").agg(
        F.count(F.lit(1)).alias("transitions"), F.coalesce(F.floor(F.sum(F.round(risk * 10000)) / F.count(risk) + 0.5) / 10000, F.lit(0.0)).alias("mean_risk"), F.round(F.coalesce(F.max(risk), F.lit(0.0)), 4).alias("max_risk"), F.count_if(F.col("level") == "forbidden").alias("forbidden_count"),
        F.count_if(F.col("decision") == "DEVIATION").alias("deviation_count"), F.count_if((F.col("decision") == "ANOMALY") & (F.col("level") != "forbidden")).alias("unseen_count"),
    )


# --- whole sequences -------------------------------------------------------------------------------------------------
def repeat_violations(steps: DataFrame, limits: DataFrame) -> DataFrame:
    """seq_id, at, action, n, most: runs longer than their action's limit; at is where the run passes it."""
    new = F.when(F.col("action").eqNullSafe(F.lag("action").over(_own())), 0).otherwise(1)
    islands = steps.withColumn("_n", new).withColumn("_run", F.sum("_n").over(_own().rowsBetween(Window.unboundedPreceding, 0)))
    runs = islands.groupBy("seq_id", "_run", "action").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("_first"))
    return runs.join(small(limits), "action").where("n > most").select("seq_id", (F.col("_first") + F.col("most")).alias("at"), "action", "n", "most")


def scenario_violations(steps: DataFrame, known: DataFrame, rules: DataFrame) -> DataFrame:
    """seq_id, pos, action, reason for steps (with a column scenario) of unknown, forbidden or not allowed actions.

    rules: scenario, allowed (array, empty for all), forbidden (array).
    """
    out = steps.join(small(known.select("action", F.lit(True).alias("_k"))), "action", "left").join(small(rules), "scenario", "left")
    no = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    reason = F.when(F.col("_k").isNull(), "unknown action").when(F.array_contains(no("forbidden"), F.col("action")), "forbidden in scenario").when((F.size(no("allowed")) > 0) & ~F.array_contains(no("allowed"), F.col("action")), "outside scenario")
    return out.withColumn("reason", reason).where("reason IS NOT NULL").select("seq_id", "pos", "action", "reason")


def graph_plausibility(steps: DataFrame, graph: DataFrame) -> DataFrame:
    """seq_id, pos, previous, actual: starts that no template starts with, and pairs that no template holds."""
    w = _own()
    rows = steps.select("seq_id", "pos", F.lag("action").over(w).alias("previous"), F.col("action").alias("actual"))
    starts = rows.where("previous IS NULL").join(small(graph.where("starts").select(F.col("action").alias("actual"))), "actual", "left_anti")
    edges = graph.select(F.col("action").alias("previous"), F.explode("successors").alias("actual"))
    pairs = rows.where("previous IS NOT NULL").join(small(edges), ["previous", "actual"], "left_anti")
    return starts.select("seq_id", "pos", "previous", "actual").unionByName(pairs.select("seq_id", "pos", "previous", "actual"))


def label_codes(labels: DataFrame) -> DataFrame:
    """action, code: one code point for each label, in order, so that string functions see a label as one character.

    The code points end at U+10FFFF: more labels than there are up to it are an error.
    """
    own = ranked(labels.select("action").distinct(), [F.col("action")])
    point = F.col("position") + 1 + _FIRST_CODE
    point = F.when(point <= 0x10FFFF, point).otherwise(F.raise_error(F.lit("more labels than code points")).cast("long"))
    return own.select("action", F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32").alias("code"))


def coded(sequences: DataFrame, codes: DataFrame) -> DataFrame:
    """Adds text: the sequence as one code point per label, '?' for unknown ones."""
    rows = sequences.select("seq_id", F.posexplode("seq").alias("pos", "action")).join(small(codes), "action", "left")
    text = rows.groupBy("seq_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("code", F.lit("?")).alias("c")))), lambda x: x["c"]), "").alias("text"))
    return sequences.join(text, "seq_id")


def rank_templates(sequences: DataFrame, templates: DataFrame, top: int = 3) -> DataFrame:
    """seq_id, rank, template_id, distance, ratio: the nearest templates by edit distance, then its share of the length, then the number.

    Both sides have text (see coded). Different texts walk a trie of the templates (see `edits.Trie`); of a model with more than HELD
    templates, parts of at most that many by number, one after the other, and the best of all parts count. For the single
    best one, texts that are templates themselves are found by a join.
    """
    own = templates.select("template_id", "text")
    texts = sequences.select("text").distinct()
    equal = None
    if top == 1:
        equal = texts.join(own.groupBy("text").agg(F.min("template_id").alias("template_id")), "text").select("text", "template_id", F.lit(0).alias("distance"), F.lit(0.0).alias("ratio"))
        texts = texts.join(own.select("text"), "text", "left_anti")
    found, after = equal, None
    while True:
        part = own.where(F.col("template_id") > after) if after is not None else own
        rows = part.orderBy("template_id").limit(HELD).collect()
        if not rows and after is not None:
            break
        near = nearest_templates(texts, [(r.template_id, r.text) for r in rows], top)
        found = near if found is None else found.unionByName(near)
        if len(rows) < HELD:
            break
        after = rows[-1].template_id
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("text").orderBy("distance", "ratio", "template_id"))).where(F.col("rank") <= top)
    return sequences.select("seq_id", "text").join(best, "text").select("seq_id", "rank", "template_id", "distance", "ratio")


def _align(actions: list[str], template: list[str]) -> list[dict]:
    """Edit operations of the cheapest alignment; a match comes before a substitution, then an extra, then a missing action."""
    n, m = len(actions), len(template)
    cost = [[i + j if not i or not j else 0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            cost[i][j] = min(cost[i - 1][j - 1] + (actions[i - 1] != template[j - 1]), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
    out, i, j = [], n, m
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + (actions[i - 1] != template[j - 1]):
            i, j = i - 1, j - 1
            out.append({"op": "match" if actions[i] == template[j] else "substitute", "at": i, "actual": actions[i], "expected": template[j]})
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            i -= 1
            out.append({"op": "extra", "at": i, "actual": actions[i], "expected": None})
        else:
            j -= 1
            out.append({"op": "missing", "at": i, "actual": None, "expected": template[j]})
    return out[::-1]


ALIGNED = "array<struct<op:string,at:int,actual:string,expected:string>>"


def align_best(sequences: DataFrame, templates: DataFrame, ranked: DataFrame) -> DataFrame:
    """seq_id, template_id, distance, operations against the nearest template; only the winner is traced back, in batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["seq_id", "template_id", "distance"]].assign(operations=[_align(list(x), list(y)) for x, y in zip(b["seq"], b["template"], strict=True)])

    best = ranked.where("rank = 1").join(small(templates.select("template_id", F.col("seq").alias("template"))), "template_id").join(sequences.select("seq_id", "seq"), "seq_id")
    return best.select("seq_id", "seq", "template", "template_id", "distance").mapInPandas(run, f"seq_id string, template_id long, distance int, operations {ALIGNED}")


def sequence_status(aligned: DataFrame, sequences: DataFrame, templates: DataFrame, critical: list[str], noncritical: list[str], hard: DataFrame, repeats: DataFrame, most_distance: int = 1, most_ratio: float = 0.25, end: str = END) -> DataFrame:
    """seq_id, status: NORMAL, NORMAL_WITH_TOLERANCE, UNKNOWN_VALIDITY or ANOMALY, with distance and allowed.

    hard: seq_id of sequences with scenario, forbidden-transition or embedding violations; repeats: those with too long runs.
    """
    out = aligned.join(sequences.select("seq_id", F.size("seq").alias("_n")), "seq_id").join(small(templates.select("template_id", F.size("seq").alias("_m"))), "template_id")
    out = out.join(hard.select("seq_id", F.lit(True).alias("_hard")).distinct(), "seq_id", "left").join(repeats.select("seq_id", F.lit(True).alias("_repeat")).distinct(), "seq_id", "left")
    wrong = F.filter("operations", lambda o: o["op"] != "match")
    expects = lambda o: F.coalesce(o["expected"], F.lit(end))
    within = lambda names: F.array(*map(F.lit, names)).cast("array<string>")
    past = lambda o: (o["op"] == "extra") & (o["at"] >= F.col("_m"))
    out = out.withColumns({"_wrong": wrong, "allowed": F.greatest(F.lit(most_distance), F.floor(most_ratio * F.greatest("_n", "_m")).cast("int"))})
    is_hard = F.exists("_wrong", lambda o: F.array_contains(within(critical), expects(o)) | past(o)) | F.coalesce("_hard", F.lit(False))
    tolerated = F.size(F.filter("_wrong", lambda o: F.array_contains(within(noncritical), expects(o))))
    exact, repeat = F.col("distance") == 0, F.coalesce("_repeat", F.lit(False))
    valid = ((exact & ~is_hard) | ((F.col("distance") <= F.col("allowed")) & (tolerated > 0) & (tolerated == F.size("_wrong")) & ~is_hard)) & ~repeat
    status = F.when(valid & exact, "NORMAL").when(valid, "NORMAL_WITH_TOLERANCE").when(~is_hard & ~repeat, "UNKNOWN_VALIDITY").otherwise("ANOMALY")
    return out.select("seq_id", "template_id", "distance", "allowed", status.alias("status"))


def longest_valid_chain(sequences: DataFrame, graph: dict[str, list[str]], starts: list[str], terminals: list[str] | None = None) -> DataFrame:
    """seq_id, matched (length of the longest subsequence that follows the graph from a start), last action, next (where it may go on), state.

    States: START (no actions), NO_MATCH, TERMINAL (nothing may follow and the action may end a sequence; without terminals any may),
    DEAD_END (nothing may follow, but it may not end), IN_PROGRESS. The recurrence is quadratic in a sequence's length and is
    run as higher-order functions on each row.
    """
    edges = F.create_map(*[x for k, v in graph.items() for x in (F.lit(k), F.array(*map(F.lit, sorted(v))).cast("array<string>"))]) if graph else F.lit(None).cast("map<string,array<string>>")
    follows = lambda a, b: F.coalesce(F.array_contains(F.try_element_at(edges, a), b), F.lit(False))
    start = F.array().cast("array<struct<action:string,n:int>>")
    names = lambda values: F.array(*map(F.lit, sorted(values))).cast("array<string>")
    first = names(starts)

    def step(acc: Column, action: Column) -> Column:
        before = F.coalesce(F.array_max(F.transform(F.filter(acc, lambda p: (p["n"] > 0) & follows(p["action"], action)), lambda p: p["n"])), F.lit(0))
        own = F.greatest(F.when(F.array_contains(first, action), 1).otherwise(0), F.when(before > 0, before + 1).otherwise(0))
        return F.concat(acc, F.array(F.struct(action.alias("action"), own.cast("int").alias("n"))))

    chain = F.aggregate("seq", start, step)
    best = F.array_max(F.transform(chain, lambda p, i: F.struct(p["n"].alias("n"), i.alias("at"), p["action"].alias("action"))))
    n, last = F.coalesce(F.col("_b.n"), F.lit(0)), F.when(F.col("_b.n") > 0, F.col("_b.action"))
    out = sequences.select("seq_id", "seq", best.alias("_b")).withColumn("next", F.when(n == 0, first).otherwise(F.coalesce(F.try_element_at(edges, F.col("_b.action")), F.array().cast("array<string>"))))
    ends = F.lit(True) if terminals is None else F.array_contains(names(terminals), last)
    state = F.when(F.size("seq") == 0, "START").when(n == 0, "NO_MATCH").when(F.size("next") > 0, "IN_PROGRESS").when(ends, "TERMINAL").otherwise("DEAD_END")
    return out.select("seq_id", n.alias("matched"), last.alias("last"), "next", state.alias("state"))


def explain(checked: DataFrame, violations: DataFrame | None = None) -> DataFrame:
    """Adds text, sentences on the status and on each violation (seq_id, at, reason) in order, and decision, the record of it."""
    head = F.concat_ws(" ", F.concat(F.lit("sequence "), "seq_id", F.lit(":")), "status", F.concat(F.lit("(distance "), F.col("distance").cast("string"), F.lit(" of "), F.col("allowed").cast("string"), F.lit(" allowed to template "), F.col("template_id").cast("string"), F.lit(")")))
    out = checked
    if violations is not None:
        lists = violations.groupBy("seq_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "reason"))), lambda v: F.concat(F.lit("at "), v["at"].cast("string"), F.lit(": "), v["reason"])).alias("_why"))
        out = out.join(lists, "seq_id", "left")
    why = F.coalesce("_why", F.array().cast("array<string>")) if violations is not None else F.array().cast("array<string>")
    valid = F.col("status").isin("NORMAL", "NORMAL_WITH_TOLERANCE")
    record = F.struct(valid.alias("valid"), "status", F.when(valid, "accept").when(F.col("status") == "UNKNOWN_VALIDITY", "review").otherwise("reject").alias("action"), F.size(why).alias("violations"))
    return out.withColumns({"text": F.concat_ws("; ", head, why), "decision": record}).drop("_why")


def status_summary(checked: DataFrame) -> DataFrame:
    """One row: how many sequences there are, how many of each status, and how many of them are valid."""
    names = ("NORMAL", "NORMAL_WITH_TOLERANCE", "UNKNOWN_VALIDITY", "ANOMALY")
    counts = [F.count_if(F.col("status") == s).alias(s.lower()) for s in names]
    return checked.agg(F.count(F.lit(1)).alias("sequences"), *counts, F.count_if(F.col("status").isin(*names[:2])).alias("valid"))


def known_actions(model: dict[str, DataFrame]) -> DataFrame:
    """The different actions of a fitted model's templates and transitions."""
    own = model["templates"].select(F.explode("seq").alias("action")).unionByName(model["matrix"].select(F.col("src").alias("action")))
    return own.distinct()


def clean_items(items: Column) -> Column:
    """Items {label, embedding} with trimmed labels; those without a label go, and so does an empty embedding (it becomes null)."""
    own = F.transform(items, lambda x: F.struct(F.trim(x["label"]).alias("label"), F.when(F.size(x["embedding"]) > 0, x["embedding"]).alias("embedding")))
    return F.filter(own, lambda x: x["label"].isNotNull() & (x["label"] != ""))


def enqueue_reviews(pending: DataFrame, checked: DataFrame, sequences: DataFrame) -> DataFrame:
    """New reviews (seq): sequences of unknown validity that aren't pending yet, each once."""
    unknown = checked.where("status = 'UNKNOWN_VALIDITY'").join(sequences, "seq_id").select("seq").distinct()
    return unknown.join(pending.select("seq"), "seq", "left_anti")


def accept_reviews(training: DataFrame, reviews: DataFrame) -> DataFrame:
    """Training sequences with the accepted reviews that they lack."""
    return training.select("seq").unionByName(reviews.where("accepted").select("seq").distinct().join(training.select("seq").distinct(), "seq", "left_anti"))


def refit_accepted(spark: SparkSession, folder: str, steps: DataFrame, reviews: DataFrame, **settings) -> int:
    """Fit the model anew on the training steps and the accepted reviews (seq, accepted), and publish it with what is left of the queue.

    The queue (part reviews: seq, status) keeps each review once, as accepted or pending; sequences that were accepted before stay
    in training through it. Returns the version's number.
    """
    try:
        before = models.load(spark, folder, ("reviews",))[0]["reviews"].select("seq", F.col("status") == "accepted")
    except (FileNotFoundError, KeyError):
        before = spark.createDataFrame([], "seq array<string>, accepted boolean")
    queue = reviews.select("seq", "accepted").unionByName(before.toDF("seq", "accepted")).groupBy("seq").agg(F.max(F.coalesce("accepted", F.lit(False))).alias("accepted"))
    training = accept_reviews(as_sequences(steps), queue)
    numbered = ranked(training, [F.array_join("seq", "\x00")]).select(F.col("position").cast("string").alias("seq_id"), F.posexplode("seq").alias("pos", "action"))
    model = fit_model(numbered, **settings)
    model["reviews"] = queue.select("seq", F.when(F.col("accepted"), "accepted").otherwise("pending").alias("status"))
    return save_model(model, folder)
