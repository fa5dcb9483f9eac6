"""Evaluation: confusion, class and binary scores, ranking, folds, sequences, votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import ranked

_EPS = 1e-9


def confusion(df: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def class_scores(df: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """label, support, precision, recall, f1 of each class that is a truth or a prediction."""
    c = confusion(df, truth, pred)
    sides = c.select(F.col("truth").alias("label"), F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0).alias("hit"), F.col("n").alias("t"), F.lit(0).alias("p")).unionByName(c.select(F.col("pred").alias("label"), F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p")))
    s = sides.groupBy("label").agg(*[F.sum(x).alias(x) for x in ("hit", "t", "p")])
    precision, recall = F.col("hit") / (F.col("p") + _EPS), F.col("hit") / (F.col("t") + _EPS)
    return s.select("label", F.col("t").alias("support"), precision.alias("precision"), recall.alias("recall"), (2 * precision * recall / (precision + recall + _EPS)).alias("f1"))


def overall_scores(df: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """accuracy; macro and weighted precision, recall, F1; F1 of the macro means."""
    s = class_scores(df, truth, pred)
    w = F.col("support") / F.sum("support").over(Window.partitionBy())
    s = s.withColumn("_w", w)
    means = s.agg(*[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")], *[F.sum(F.col(c) * F.col("_w")).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")])
    means = means.withColumn("f1_of_macros", 2 * F.col("macro_precision") * F.col("macro_recall") / (F.col("macro_precision") + F.col("macro_recall") + _EPS))
    return means.crossJoin(df.agg(F.avg((F.col(truth) == F.col(pred)).cast("double")).alias("accuracy")))


def binary_scores(df: DataFrame, truth: str = "truth", pred: str = "pred", *by: str) -> DataFrame:
    t, p = F.col(truth) == 1, F.col(pred) == 1
    c = df.groupBy(*by).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return c.withColumns({"accuracy": ratio(F.col("tp") + F.col("tn"), n), "precision": precision, "recall": recall, "f1": ratio(2 * precision * recall, precision + recall)})


def auc(df: DataFrame, truth: str = "truth", score: str = "score") -> DataFrame:
    """Area under the ROC curve by average ranks; rows are counted by score first."""
    t = F.col(truth) == 1
    counts = df.groupBy(score).agg(F.count(F.lit(1)).alias("n"), F.count_if(t).alias("pos"))
    placed = ranked(counts, [F.col(score)], {"below": F.col("n")}).withColumn("rank", F.col("below") + (F.col("n") + 1) / 2)
    s = placed.agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").cast("double").alias("p"), F.sum(F.col("n") - F.col("pos")).cast("double").alias("m"))
    return s.select(F.when((F.col("p") > 0) & (F.col("m") > 0), (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("m"))).alias("auc"))


def best_threshold(df: DataFrame, truth: str = "truth", score: str = "score") -> DataFrame:
    """threshold, precision, recall, f1 of the cut (score at least the threshold) of the highest F1, ties to the highest cut."""
    counts = df.groupBy(score).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(truth) == 1).alias("pos"))
    total = counts.agg(F.sum("pos").alias("_p"))
    above = ranked(counts, [-F.col(score)], {"_above_pos": F.col("pos"), "_above_n": F.col("n")})
    c = above.withColumns({"tp": F.col("_above_pos") + F.col("pos"), "all": F.col("_above_n") + F.col("n")}).crossJoin(F.broadcast(total))
    c = c.withColumns({"precision": F.col("tp") / F.col("all"), "recall": F.col("tp") / F.col("_p")}).withColumn("f1", F.when(F.col("tp") > 0, 2 * F.col("tp") / (F.col("all") + F.col("_p"))).otherwise(0.0))
    return c.orderBy(F.desc("f1"), F.desc(score)).limit(1).select(F.col(score).alias("threshold"), "precision", "recall", "f1")


def fold_scores(df: DataFrame, order: str, folds: int, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """Binary scores of `folds` contiguous parts in the given order (the last takes the rest), as mean and population deviation.

    Places come from counts of order ranges, not from one sort of all rows.
    """
    from .corpora import global_positions

    n = df.count()
    size = max(n // folds, 1)
    parts = global_positions(df, order).withColumn("fold", F.least(F.floor(F.col("position") / size), F.lit(folds - 1)))
    s = binary_scores(parts, truth, pred, "fold")
    return s.agg(*[x for c in ("accuracy", "precision", "recall", "f1") for x in (F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"))])


def detection_by_class(df: DataFrame, kind: str, flagged: Column, confidence: str | None = None) -> DataFrame:
    extra = [F.avg(confidence).alias("mean_confidence")] if confidence else []
    return df.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), F.avg(flagged.cast("double")).alias("rate"), *extra)


def branch_accuracies(df: DataFrame, truth: str, branches: list[str]) -> DataFrame:
    """Share of right answers of each branch, its nulls left out."""
    return df.agg(*[F.avg((F.col(b) == F.col(truth)).cast("double")).alias(b) for b in branches])


def majority_vote(df: DataFrame, keys: list[str], votes: list[str]) -> DataFrame:
    """Adds vote: the most frequent value of the columns, the lowest of equal ones."""
    own = F.array_sort(F.array_compact(F.array(*votes)))
    counted = F.transform(F.array_distinct(own), lambda x: F.struct((-F.size(F.filter(own, lambda y: y == x))).alias("n"), x.alias("v")))
    return df.withColumn("vote", F.array_min(counted)["v"])


def label_thresholds(df: DataFrame, label: str, score: str, q: float = 0.95, pad: float = 0.05, floor: float = 0.3, cap: float = 0.85) -> DataFrame:
    """label, threshold: the padded quantile of its scores within floor and cap."""
    return df.groupBy(label).agg(F.least(F.greatest(F.percentile(score, F.lit(q)) + pad, F.lit(floor)), F.lit(cap)).alias("threshold"))


def exact_quantile(df: DataFrame, column: str, q: float, most: int = 1_000_000, rows: int | None = None) -> float | None:
    """The q-quantile (linear between neighbours) of a column's values, None without any; no task gathers more than about `most` of them.

    While more values are left, an approximate quantile bounds the two order statistics that are asked for, and only the values between
    the bounds go on; each pass leaves a few hundredths. rows, where the caller knows that there are no more, saves a count.
    """
    if rows is not None and rows <= most:
        own = F.col(column).cast("double")
        return df.agg(F.percentile(F.when(~F.isnan(own), own), F.lit(q))).first()[0]
    own = df.select(F.col(column).cast("double").alias("x")).where("x IS NOT NULL AND NOT isnan(x)")
    n = own.count()
    if not n:
        return None
    at = (n - 1) * q
    below, low, high = 0, int(at), min(int(at) + 1, n - 1)  # places of the two values among all
    while n > most:
        share = lambda k: min(max((k - below) / n, 0.0), 1.0)  # noqa: B023, E731
        a, b = own.approxQuantile("x", [max(share(low) - 0.005, 0.0), min(share(high) + 0.005, 1.0)], 0.002)
        less, kept = own.agg(F.count_if(F.col("x") < a), F.count_if(F.col("x").between(a, b))).first()
        if kept == n or not (below + less <= low and high < below + less + kept):
            break  # many equal values: of what is left few differ, and percentile counts different ones
        own, below, n = own.where(F.col("x").between(a, b)), below + less, kept
    return own.agg(F.percentile("x", F.lit((at - below) / max(n - 1, 1)))).first()[0]


def prediction_join(truth: DataFrame, pred: DataFrame, key: str) -> DataFrame:
    """Truth rows with their predictions (column predicted) and status: MISSING, EXACT or DIFFERENT."""
    return truth.join(pred, key, "left").withColumn("status", F.when(F.col("predicted").isNull(), "MISSING").when(F.col("predicted") == F.col("expected"), "EXACT").otherwise("DIFFERENT"))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, 1 - F.levenshtein(a, b) / longest).otherwise(1.0)


def sql_round(c: Column, digits: int) -> Column:
    """Rounded as DuckDB's round() does it on doubles: the product with the power of ten to a whole number, halves away from 0. Spark's
    own takes the shortest decimal, so that 0.16115 becomes 0.1612 there and 0.1611 here."""
    return F.round(c.cast("double") * float(10**digits), 0) / float(10**digits)
