"""Extra-trees: each tree is grown in its own group from a bounded sample of the labelled rows, and the model is a table of nodes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .corpora import unit_hash

_NODES = "tree int, node int, feature int, cut double, left int, right int, votes array<double>"


def grow_tree(x: np.ndarray, y: np.ndarray, classes: int, rng: np.random.Generator, depth: int = 12) -> list[tuple]:
    """Nodes (node, feature, cut, left, right, votes) of one tree: at each split the best, by Gini, of random cuts of about sqrt(features) features.

    Rows weigh so that all classes of the sample count alike.
    """
    weight = (1 / np.maximum(np.bincount(y, minlength=classes), 1))[y]
    nodes: list[list] = []
    tries = max(1, int(np.sqrt(x.shape[1])))

    def gini(at: np.ndarray) -> float:
        v = np.bincount(y[at], weights=weight[at], minlength=classes)
        return v.sum() - (v * v).sum() / v.sum() if len(at) else 0.0

    def split(at: np.ndarray, level: int) -> int:
        me = len(nodes)
        votes = np.bincount(y[at], weights=weight[at], minlength=classes)
        nodes.append([me, -1, 0.0, -1, -1, (votes / votes.sum()).tolist()])
        if level < depth and (votes > 0).sum() > 1:
            lo, hi = x[at].min(axis=0), x[at].max(axis=0)
            open_ = np.flatnonzero(hi > lo)
            best = None
            for f in rng.permutation(open_)[:tries].tolist():
                cut = float(rng.uniform(lo[f], hi[f]))
                less = x[at, f] <= cut
                score = gini(at[less]) + gini(at[~less])
                if best is None or score < best[0]:
                    best = (score, f, cut, less)
            if best is not None and 0 < best[3].sum() < len(at):
                nodes[me][1:3] = best[1], best[2]
                nodes[me][3] = split(at[best[3]], level + 1)
                nodes[me][4] = split(at[~best[3]], level + 1)
        return me

    split(np.arange(len(x)), 0)
    return [tuple(n) for n in nodes]


def vote(nodes: list[tuple], x: np.ndarray) -> np.ndarray:
    """rows x classes: the votes of one tree's leaves."""
    feature, cut, left, right = (np.array([n[i] for n in nodes]) for i in (1, 2, 3, 4))
    at, moving = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
    while len(moving):
        moving = moving[feature[at[moving]] >= 0]
        own = at[moving]
        at[moving] = np.where(x[moving, feature[own]] <= cut[own], left[own], right[own])
    return np.array([n[5] for n in nodes])[at]


def fit_extra_trees(rows: DataFrame, key: str, columns: list[str], label: str, trees: int = 800, sample: int = 4000, depth: int = 12, seed: int = 0) -> tuple[DataFrame, list[str]]:
    """The node table of `trees` trees and the labels in order; each tree sees about `sample` rows chosen by hash (a bounded, stated sample)."""
    known = rows.where(F.col(label).isNotNull())
    labels = sorted(r[0] for r in known.select(F.col(label).cast("string")).distinct().limit(1001).collect())
    if len(labels) > 1000:
        raise ValueError("more than 1000 labels")
    share = min(1.0, 1.5 * sample / max(known.count(), 1))
    dealt = known.select(key, F.col(label).cast("string").alias("_y"), *columns).withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("_u", unit_hash("tree", key, seed=seed)).where(F.col("_u") < share)
    few = dealt.withColumn("_r", F.row_number().over(Window.partitionBy("tree").orderBy("_u", key))).where(F.col("_r") <= sample)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree, own = int(pdf["tree"].iloc[0]), pdf.sort_values("_r")
        nodes = grow_tree(np.nan_to_num(own[columns].to_numpy(dtype=np.float64)), np.searchsorted(labels, own["_y"].to_numpy(dtype=str)), len(labels), np.random.default_rng([seed, tree]), depth)
        return pd.DataFrame([(tree, *n) for n in nodes], columns=["tree", "node", "feature", "cut", "left", "right", "votes"])

    return few.groupBy("tree").applyInPandas(grow, _NODES), labels


def predict_extra_trees(rows: DataFrame, model: DataFrame, labels: list[str], columns: list[str]) -> DataFrame:
    """rows with predicted (ties to the first label) and confidence, the mean vote; the model is a bounded table that goes to the tasks."""
    trees = [list(t.sort_values("node")[["node", "feature", "cut", "left", "right", "votes"]].itertuples(index=False, name=None)) for _, t in model.toPandas().groupby("tree")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.nan_to_num(b[columns].to_numpy(dtype=np.float64))
            mean = sum(vote(t, x) for t in trees) / max(len(trees), 1) if len(x) else np.zeros((0, len(labels)))
            yield b.assign(predicted=[labels[i] for i in mean.argmax(axis=1)] if len(x) else [], confidence=mean.max(axis=1, initial=0.0))

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), "predicted string, confidence double"])
    return rows.mapInPandas(run, schema)


def leave_one_out_report(rows: DataFrame, key: str, columns: list[str], label: str, trees: int = 50, most: int = 500) -> DataFrame:
    """key, label, predicted, confidence of each sample by trees that were grown from all the others; samples are captures, `most` at most."""
    own = rows.where(F.col(label).isNotNull()).select(F.col(key).cast("string").alias("sample"), F.col(label).cast("string").alias("label"), *columns)
    if own.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} samples: hold out folds instead")
    held = own.select(F.col("sample").alias("_held"))
    pairs = held.join(F.broadcast(own))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sample")
        out, rest = pdf[pdf["sample"] == pdf["_held"]], pdf[pdf["sample"] != pdf["_held"]]
        names = sorted(rest["label"].unique())
        if not names:
            return out[["sample", "label"]].assign(predicted=None, confidence=0.0)
        x, y = np.nan_to_num(rest[columns].to_numpy(dtype=np.float64)), np.searchsorted(names, rest["label"].to_numpy(dtype=str))
        mean = sum(vote(grow_tree(x, y, len(names), np.random.default_rng(t)), np.nan_to_num(out[columns].to_numpy(dtype=np.float64))) for t in range(trees)) / trees
        return out[["sample", "label"]].assign(predicted=[names[i] for i in mean.argmax(axis=1)], confidence=mean.max(axis=1))

    return pairs.groupBy("_held").applyInPandas(run, "sample string, label string, predicted string, confidence double")
