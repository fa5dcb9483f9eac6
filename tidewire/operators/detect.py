"""Batch detection: rules, a fitted classifier and an outlier forest over feature rows, fused to one score a payload."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import fuse_scores
from ..sources.shared import checkpointed
from .corpora import unit_hash
from .metrics import exact_quantile
from .outliers import fit_forest, score_forest


def detect(payloads: DataFrame, key: str, featurize: Callable[[DataFrame], DataFrame], features: list[str], labels: DataFrame, fitted: int = 20_000, trees: int = 40, outliers: float = 0.06) -> DataFrame:
    """payloads (with matches) and their features, with proba, anomaly (0 or 1), final_score, threat_level and fused_confidence.

    featurize adds the feature columns, once for all rows: what models and scores need of them is written to the shared folder. labels
    (key, label 0 or 1) name the rows for the classifier, at most `fitted` of them by hash of the key (a bounded, stated sample); without
    both labels proba is 0.5. The forest draws from all rows, and its cut is the quantile of all scores, so `outliers` is the share of
    rows under it but for ties. The sequence model of the original is a neural network: its score is 0, as where it isn't installed.
    """
    assembler = VectorAssembler(inputCols=features, outputCol="_v", handleInvalid="keep")
    made = featurize(payloads)
    rows = checkpointed(made.select(*dict.fromkeys([*payloads.columns, *features])))
    keys = labels.select(key, "label", unit_hash(key, seed=3).alias("_u")).join(rows.select(key).distinct(), key).orderBy("_u", key).limit(fitted).drop("_u")
    known = assembler.transform(rows.join(F.broadcast(keys), key).select("label", *features)).select("label", "_v").persist()
    try:
        model = RandomForestClassifier(featuresCol="_v", numTrees=trees, maxDepth=8, seed=7).fit(known) if known.select("label").distinct().count() == 2 else None
    finally:
        known.unpersist()
    scored = checkpointed(score_forest(rows, fit_forest(rows, key, features, trees), features))
    cut = exact_quantile(scored, "score", outliers)
    out = scored.withColumn("anomaly", F.when(F.col("score") < F.lit(cut), 1.0).otherwise(0.0)).drop("score")
    if model is None:
        out = out.withColumn("proba", F.lit(0.5))
    else:
        out = model.transform(assembler.transform(out)).withColumn("proba", vector_to_array("probability")[1]).drop("_v", "rawPrediction", "probability", "prediction")
    return fuse_scores(out, F.col("proba"), F.lit(0.0), F.col("anomaly"))
