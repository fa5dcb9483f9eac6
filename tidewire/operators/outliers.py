"""Outlier scores: a distributed isolation forest, Mahalanobis distance, blends, and MLlib models with fixed settings."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LinearSVC, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import RobustScaler, UnivariateFeatureSelector, VarianceThresholdSelector, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import checkpointed
from .metrics import exact_quantile

_EULER = 0.5772156649015329


def _expected_depth(n: int) -> float:
    """Mean path length of an unsuccessful search in a tree of n rows."""
    return 2 * (math.log(n - 1) + _EULER) - 2 * (n - 1) / n if n > 2 else float(n == 2)


def fit_forest(df: DataFrame, key: str, columns: list[str], trees: int = 100, rows: int = 256, seed: int = 0) -> DataFrame:
    """node table (tree, node, feature, cut, left, right, size): each tree grown from about `rows` rows of the whole table, chosen by hash.

    A row is copied for the trees that draw it and no others: one number of the row's hash says which tree is the first, the way the
    first of many equal draws that succeed is spread, and the trees after that one draw on their own. A tree's sample is bounded, so a tree
    is one group; the whole model is at most trees * 2 * rows nodes.
    """
    share = min(1.0, 1.5 * rows / max(df.count(), 1))
    draw = lambda *parts: (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts, key), 11) + 0.5) / float(1 << 53)
    first = F.floor(F.log(draw(F.lit(-1))) / (math.log1p(-share) if share < 1 else -math.inf))
    drawn = df.select(key, *columns).withColumn("_first", first).where(F.col("_first") < trees)
    later = F.filter(F.sequence(F.col("_first").cast("int") + 1, F.lit(trees)), lambda t: (t < trees) & (draw(t) < share))
    sampled = drawn.withColumn("tree", F.explode(F.concat(F.array(F.col("_first").cast("int")), later))).withColumn("_u", draw(F.col("tree"), F.lit(7)))
    few = sampled.withColumn("_r", F.row_number().over(Window.partitionBy("tree").orderBy("_u", key))).where(F.col("_r") <= rows)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng([seed, tree])
        x = pdf.sort_values("_r")[columns].to_numpy(dtype=np.float64)
        depth = max(1, math.ceil(math.log2(max(len(x), 2))))
        nodes: list[list[float]] = []

        def split(at: np.ndarray, level: int) -> int:
            me = len(nodes)
            nodes.append([tree, me, -1, 0.0, -1, -1, len(at)])
            lo, hi = x[at].min(axis=0), x[at].max(axis=0)
            open_ = np.flatnonzero(hi > lo)
            if level < depth and len(at) > 1 and len(open_):
                f = int(rng.choice(open_))
                cut = float(rng.uniform(lo[f], hi[f]))
                less = x[at, f] <= cut
                if not less.all():  # a cut between values next to each other can be the greater one
                    nodes[me][2:4] = f, cut
                    nodes[me][4] = split(at[less], level + 1)
                    nodes[me][5] = split(at[~less], level + 1)
            return me

        split(np.arange(len(x)), 0)
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "cut", "left", "right", "size"])

    return few.groupBy("tree").applyInPandas(grow, "tree int, node int, feature int, cut double, left int, right int, size int")


def score_forest(df: DataFrame, forest: DataFrame, columns: list[str], rows: int = 256) -> DataFrame:
    """Adds score: 0.5 - 2 ** (-mean depth / expected depth), low for outliers. The model is a bounded table that goes to the tasks; of
    the rows only the columns that the trees look at leave the JVM."""
    nodes = forest.orderBy("tree", "node").toPandas()
    trees = [t.sort_values("node").to_numpy(dtype=np.float64) for _, t in nodes.groupby("tree")]
    scale = _expected_depth(int(min(rows, max((t[0, 6] for t in trees), default=1)))) or 1.0
    deep = np.array([_expected_depth(i) for i in range(rows + 1)])

    @F.pandas_udf("double")
    def score(*values: pd.Series) -> pd.Series:
        x = np.nan_to_num(np.column_stack([v.to_numpy(dtype=np.float64, na_value=np.nan) for v in values]))
        total = np.zeros(len(x))
        for t in trees:
            at, level, moving = np.zeros(len(x), dtype=np.int64), np.zeros(len(x)), np.arange(len(x))
            while len(moving):
                node = at[moving]
                feature = t[node, 2].astype(np.int64)
                moving, node, feature = moving[feature >= 0], node[feature >= 0], feature[feature >= 0]
                at[moving] = np.where(x[moving, feature] <= t[node, 3], t[node, 4], t[node, 5]).astype(np.int64)
                level[moving] += 1
            total += level + deep[t[at, 6].astype(np.int64)]
        return pd.Series(0.5 - 2.0 ** (-(total / max(len(trees), 1)) / scale))

    return df.withColumn("score", score(*[F.col(c).cast("double") for c in columns]))


def isolation_forest(df: DataFrame, key: str, columns: list[str], contamination: float = 0.06, trees: int = 100, rows: int = 256, seed: int = 0) -> DataFrame:
    """df with score, and label -1 for the share `contamination` of the lowest scores, 1 for others. An empty table stays empty."""
    scored = checkpointed(score_forest(df, fit_forest(df, key, columns, trees, rows, seed), columns, rows))  # read for the cut, and again for the labels
    cut = exact_quantile(scored, "score", contamination)
    return scored.withColumn("label", F.when(F.col("score") < F.lit(cut), -1).otherwise(1))


def mahalanobis(df: DataFrame, columns: list[str], ridge: float = 1e-6, diagonal: bool = False) -> DataFrame:
    """Adds distance to the mean under the sample covariance (plus ridge); its inverse of columns x columns is taken on the driver."""
    d = len(columns)
    pairs = [(i, j) for i in range(d) for j in range(i, d) if i == j or not diagonal]
    stats = df.agg(*[F.avg(c) for c in columns], *[F.covar_samp(columns[i], columns[j]) for i, j in pairs]).first()
    mean, cov = np.array([v or 0.0 for v in stats[:d]]), np.eye(d) * ridge
    for (i, j), v in zip(pairs, stats[d:], strict=True):
        cov[i, j] += v or 0.0
        if i != j:
            cov[j, i] += v or 0.0
    inverse = np.linalg.pinv(cov)
    x = [F.col(c) - float(mean[i]) for i, c in enumerate(columns)]
    total = F.lit(0.0)
    for i in range(d):
        for j in range(d):
            if inverse[i, j] and (i == j or not diagonal):
                total = total + x[i] * x[j] * float(inverse[i, j])
    return df.withColumn("distance", F.sqrt(F.greatest(total, F.lit(0.0))))


def blend_scores(df: DataFrame, columns: list[str], weights: list[float]) -> DataFrame:
    """Adds blend: the min-max normalised columns weighed by the softmax of the weights."""
    top = max(weights)
    share = [math.exp(w - top) for w in weights]
    total = sum(share)
    bounds = df.agg(*[F.min(c).alias(f"_l{i}") for i, c in enumerate(columns)], *[F.max(c).alias(f"_h{i}") for i, c in enumerate(columns)])
    blend = sum(((F.col(c) - F.col(f"_l{i}")) / (F.col(f"_h{i}") - F.col(f"_l{i}") + 1e-8) * (share[i] / total) for i, c in enumerate(columns)), F.lit(0.0))
    return df.crossJoin(F.broadcast(bounds)).withColumn("blend", blend).select(*df.columns, "blend")


def softsign_log(c: Column) -> Column:
    return F.signum(c) * F.log1p(F.abs(c))


def cluster_symbols(df: DataFrame, columns: list[str], k: int, seed: int = 7) -> DataFrame:
    """Adds symbol: the letter of the nearest of k centers after sign * log1p and scaling; letters follow the sorted centers."""
    from .windows import zscore

    ready = zscore(df.select(*df.columns, *[softsign_log(F.col(c).cast("double")).alias(f"_z_{c}") for c in columns]), [f"_z_{c}" for c in columns])
    ready = VectorAssembler(inputCols=[f"_z_{c}" for c in columns], outputCol="_v").transform(ready)
    k = max(2, min(k, ready.count()))
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="_c").fit(ready)
    order = sorted(range(len(model.clusterCenters())), key=lambda i: tuple(model.clusterCenters()[i]))
    names = F.create_map(*[x for rank, i in enumerate(order) for x in (F.lit(i), F.lit(chr(65 + rank)))])
    return model.transform(ready).withColumn("symbol", names[F.col("_c")]).select(*df.columns, "symbol")


def nearest_center(df: DataFrame, columns: list[str], centers: list[list[float]]) -> DataFrame:
    """Adds symbol: the letter of the nearest of fitted centers, which are lettered in their order; ties to the first."""
    far = [sum(((F.col(c) - float(v)) ** 2 for c, v in zip(columns, center, strict=True)), F.lit(0.0)) for center in sorted(centers)]
    return df.withColumn("symbol", F.array_min(F.array(*[F.struct(d.alias("d"), F.lit(chr(65 + i)).alias("s")) for i, d in enumerate(far)]))["s"])


def prepared(df: DataFrame, columns: list[str], label: str, best: int, least_variance: float = 0.01) -> DataFrame:
    """Adds features: robustly scaled columns of enough variance, the `best` of them by F-test."""
    steps = [VectorAssembler(inputCols=columns, outputCol="_raw", handleInvalid="skip"), RobustScaler(inputCol="_raw", outputCol="_scaled", withCentering=True), VarianceThresholdSelector(varianceThreshold=least_variance, featuresCol="_scaled", outputCol="_varied"), UnivariateFeatureSelector(featuresCol="_varied", labelCol=label, outputCol="features", selectionMode="numTopFeatures").setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(best)]
    return Pipeline(stages=steps).fit(df).transform(df).drop("_raw", "_scaled", "_varied")


def classifiers(inputs: int, classes: int = 2, seed: int = 7) -> dict:
    """Forest, boosted trees, perceptron and linear machine with the settings of the detection ensemble; `many` is for several classes."""
    base = GBTClassifier(maxIter=10, maxDepth=4, seed=seed)
    return {"forest": RandomForestClassifier(numTrees=60, maxDepth=8, seed=seed), "boosted": base if classes == 2 else OneVsRest(classifier=base), "perceptron": MultilayerPerceptronClassifier(layers=[inputs, 16, classes], maxIter=60, seed=seed), "linear": LinearSVC(maxIter=50)}


def balanced(df: DataFrame, label: str) -> DataFrame:
    """Adds weight: rows over classes times the rows of its class, so that all classes weigh alike."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_t"), F.count(F.lit(1)).alias("_k"))
    return df.join(F.broadcast(counts.crossJoin(F.broadcast(total))), label).withColumn("weight", F.col("_t") / (F.col("_k") * F.col("_n"))).drop("_n", "_t", "_k")


def action_classifiers(trees: int = 300, classes: int = 2, seed: int = 7) -> dict:
    """The balanced forest and the boosted trees of action recognition; rows carry weight."""
    base = GBTClassifier(maxIter=20, maxDepth=4, seed=seed, weightCol="weight")
    return {"forest": RandomForestClassifier(numTrees=trees, maxDepth=8, seed=seed, weightCol="weight"), "boosted": base if classes == 2 else OneVsRest(classifier=base, weightCol="weight")}


def ensemble_scores(train: DataFrame, test: DataFrame, models: dict, key: str) -> DataFrame:
    """key and proba: the mean over the models of the probability of class 1 (a model without probabilities gives its 0 or 1)."""
    out = test
    names = []
    for name, m in models.items():
        fitted = m.fit(train.select("features", "label"))
        scored = fitted.transform(out.drop("rawPrediction", "probability", "prediction"))
        own = vector_to_array("probability")[1] if "probability" in scored.columns else F.col("prediction")
        out = scored.withColumn(f"_p_{name}", own).drop("rawPrediction", "probability", "prediction")
        names.append(f"_p_{name}")
    return out.select(key, *names, (sum((F.col(n) for n in names), F.lit(0.0)) / len(names)).alias("proba"))


def importances(model, names: list[str]) -> list[tuple[str, float]]:
    return sorted(((n, float(v)) for n, v in zip(names, model.featureImportances.toArray(), strict=True)), key=lambda x: (-x[1], x[0]))
