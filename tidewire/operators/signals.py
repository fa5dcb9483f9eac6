"""Signals in bins, templates of signals and of symbol texts, similarity and matching.

A signal is (capture_id, bin, value) with all bins; symbol texts are one row per sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import checkpointed
from .edits import alike, by_blocks, near_pairs
from .metrics import edit_similarity


def to_arrays(signal: DataFrame) -> DataFrame:
    """capture_id, values in bin order."""
    return signal.groupBy("capture_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "value"))), lambda x: x["value"].cast("double")).alias("values"))


def pad_or_trim(values: Column, n: int) -> Column:
    return F.slice(F.concat(values, F.array_repeat(F.lit(0.0), n)), 1, n)


def signal_statistics(signal: DataFrame, active: float = 0.0) -> DataFrame:
    """Per capture: moments, quartiles, energy, sums, shares and counts of active and signed bins, skew and excess kurtosis.

    Deviations carry 1e-9, skew needs 3 bins and kurtosis 4.
    """
    means = signal.groupBy("capture_id").agg(F.avg("value").alias("_m"))
    d = F.col("value") - F.col("_m")
    s = signal.join(means, "capture_id").groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("_m").alias("mean"), (F.sqrt(F.avg(d * d)) + 1e-9).alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), F.percentile("value", F.lit(0.25)).alias("q1"), F.percentile("value", F.lit(0.5)).alias("median"), F.percentile("value", F.lit(0.75)).alias("q3"),
        F.sum(F.col("value").cast("double") * F.col("value")).alias("energy"), F.sum(F.abs("value")).alias("abs_sum"), F.avg((F.abs("value") > active).cast("double")).alias("active_ratio"), F.count_if(F.col("value") > 0).alias("positive"), F.count_if(F.col("value") < 0).alias("negative"), F.avg(d * d * d).alias("_3"), F.avg(d * d * d * d).alias("_4"),
    )
    return s.withColumns({"skew": F.when(F.col("n") >= 3, F.col("_3") / F.pow("std", F.lit(3.0))).otherwise(0.0), "kurtosis": F.when(F.col("n") >= 4, F.col("_4") / F.pow("std", F.lit(4.0)) - 3).otherwise(0.0)}).drop("_3", "_4")


def average_templates(signal: DataFrame, labels: DataFrame) -> DataFrame:
    """label, bin, value: the mean over a label's captures, shorter ones taken as 0 at their end, then standardised."""
    rows = signal.join(labels, "capture_id")
    counts = labels.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    mean = rows.groupBy("label", "bin").agg(F.sum("value").alias("_s")).join(F.broadcast(counts), "label").select("label", "bin", (F.col("_s") / F.col("_n")).alias("value"))
    w = Window.partitionBy("label")
    return mean.select("label", "bin", ((F.col("value") - F.avg("value").over(w)) / (F.stddev_pop("value").over(w) + 1e-9)).alias("value"))


#: Values of all templates up to which they go to the tasks whole.
TEMPLATE_VALUES = 4_000_000


#: Lags that one transform gives.
LAGS = 1 << 16


def cross_correlation(signal: DataFrame, templates: DataFrame, flip: bool = False, lags: int = LAGS) -> DataFrame:
    """capture_id, label, lag, correlation: sums of products of signal and shifted template over both norms, at all lags where they overlap.

    With flip the template is turned round, which gives the convolution. Each block of `lags` lags is a row of the bins that it needs, those
    of the block and of a template more, so blocks of one capture are made on all cores, each by fast Fourier transforms; bins that are
    missing count as 0. The templates, a model table of at most TEMPLATE_VALUES numbers, go to the tasks.
    """
    rows = templates.limit(TEMPLATE_VALUES + 1).select("label", "bin", F.col("value").cast("double").alias("value")).toPandas()
    if len(rows) > TEMPLATE_VALUES:
        raise ValueError("the templates are too large to be matched whole")
    known = [(label, own.sort_values("bin")["value"].to_numpy()[:: -1 if flip else 1]) for label, own in rows.groupby("label")]
    longest = max((len(t) for _, t in known), default=1)
    size = 1 << (lags + 2 * longest).bit_length()
    own = signal.select("capture_id", F.col("bin").cast("long").alias("bin"), F.col("value").cast("double").alias("value"))
    # Block b has the lags from b * lags - (longest - 1) on; a bin is looked at from the lags up to longest - 1 before it.
    blocks = own.withColumn("block", F.explode(F.sequence(F.floor(F.col("bin") / lags), F.floor((F.col("bin") + longest - 1) / lags))))
    blocks = blocks.groupBy("capture_id", "block").agg(F.collect_list("bin").alias("bins"), F.collect_list("value").alias("values"))
    norms = own.groupBy(F.col("capture_id").alias("_capture")).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"), (F.max("bin") + 1).alias("n"))
    blocks = blocks.join(norms, F.col("capture_id") == F.col("_capture")).drop("_capture")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turned = [(label, len(t), np.sqrt((t * t).sum()), np.conj(np.fft.rfft(t, size))) for label, t in known]
        for b in batches:
            for capture, block, bins, values, norm, n in zip(*(b[c] for c in ("capture_id", "block", "bins", "values", "norm", "n")), strict=True):
                first = int(block) * lags - (longest - 1)
                x = np.zeros(size)
                x[np.asarray(bins) - first] = values
                spectrum = np.fft.rfft(x)
                for label, m, own_norm, t in turned:
                    low, high = max(first, 1 - m), min(first + lags, int(n))
                    if low < high:
                        out = np.fft.irfft(spectrum * t, size)[low - first : high - first] / (norm * own_norm + 1e-9)
                        out[np.abs(out) < 1e-13] = 0.0
                        yield pd.DataFrame({"capture_id": capture, "label": label, "lag": np.arange(low, high), "correlation": out})

    kind = signal.schema["capture_id"].dataType.simpleString()
    return blocks.mapInPandas(run, f"capture_id {kind}, label string, lag long, correlation double")


def signal_features(signal: DataFrame, templates: DataFrame, labels: list[str]) -> DataFrame:
    """One row a capture: its statistics, and for each label those of its correlation and of its convolution with the label's template, and both distances."""
    own = signal_statistics(signal)
    names = [c for c in own.columns if c != "capture_id"]
    out = own
    for kind, flip in (("corr", False), ("conv", True)):
        found = cross_correlation(signal, templates, flip).select(F.struct("capture_id", "label").alias("capture_id"), F.col("lag").alias("bin"), F.col("correlation").alias("value"))
        stats = signal_statistics(found).select("capture_id.*", *names).groupBy("capture_id").pivot("label", labels).agg(*[F.first(c).alias(f"{kind}_{c}") for c in names])
        out = out.join(stats, "capture_id", "left")
    near = template_distances(signal, templates).groupBy("capture_id").pivot("label", labels).agg(F.first("distance").alias("distance"), F.first("cosine").alias("cosine"))
    return out.join(near, "capture_id", "left")


def template_distances(signal: DataFrame, templates: DataFrame) -> DataFrame:
    """capture_id, label, distance (over the number of bins), cosine of the standardised signal and the template on the template's bins."""
    w = Window.partitionBy("capture_id")
    z = signal.withColumn("value", (F.col("value") - F.avg("value").over(w)) / (F.stddev_pop("value").over(w) + 1e-9))
    grid = signal.select("capture_id").distinct().crossJoin(F.broadcast(templates.withColumnRenamed("value", "_t")))
    rows = grid.join(z, ["capture_id", "bin"], "left").withColumn("_v", F.coalesce("value", F.lit(0.0)))
    dot = lambda a, b: F.sum(F.col(a) * F.col(b))
    out = rows.groupBy("capture_id", "label").agg((F.sqrt(F.sum((F.col("_v") - F.col("_t")) ** 2)) / F.count(F.lit(1))).alias("distance"), (dot("_v", "_t") / (F.sqrt(dot("_v", "_v")) * F.sqrt(dot("_t", "_t")) + 1e-9)).alias("cosine"))
    return out


# --- symbol texts ----------------------------------------------------------------------------------------------------
#: Similarity from which pieces of texts are long enough (three letters or so) to keep most pairs apart.
PIECES = 0.65


#: Samples of a block whose pairs are all told.
PAIRED = 512


def _kind(samples: DataFrame, column: str) -> str:
    return samples.schema[column].dataType.simpleString()


def _coded(*columns: pa.ChunkedArray) -> tuple[pa.Array, list[np.ndarray]]:
    """The different values of some columns in order, and the number of each column's values among them."""
    values = [v for c in columns for v in c.to_pylist()]
    known = sorted(set(values))
    number = {v: i for i, v in enumerate(known)}
    codes, ends = np.array([number[v] for v in values], dtype=np.int64), np.cumsum([len(c) for c in columns])
    return pa.array(known, type=columns[0].type), np.split(codes, ends[:-1])


def text_pairs(samples: DataFrame, within: bool = True, least: float | None = None) -> DataFrame:
    """sample_a, sample_b, label_a, label_b, similarity of pairs of samples (sample, label, text), within a label or across.

    With `least` from PIECES on only texts that share a piece meet, see `edits.near_pairs`; below it pieces of one or two letters would
    bring all together anyway, so all texts are compared, by blocks of samples: different texts of two blocks once.
    """
    if least is None or least < PIECES:

        def fold(a: pa.Table, b: pa.Table, similarity: np.ndarray, same: bool) -> pa.Table:
            names, (i, j) = _coded(a["sample"], b["sample"])
            labels, (x, y) = _coded(a["label"], b["label"])
            kept = np.ones(similarity.shape, dtype=bool) if least is None else similarity >= least
            kept &= ~((similarity == 1) & (i[:, None] == j[None, :])) if within else x[:, None] != y[None, :]
            p, q = np.nonzero(np.triu(kept, 1) if same else kept)
            swap = i[p] > j[q] if within else x[p] > y[q]
            out = {}
            for name, known, left, right in (("sample", names, i[p], j[q]), ("label", labels, x[p], y[q])):
                out[f"{name}_a"], out[f"{name}_b"] = known.take(pa.array(np.where(swap, right, left))), known.take(pa.array(np.where(swap, left, right)))
            return pa.table({c: out[c] for c in ("sample_a", "sample_b", "label_a", "label_b")} | {"similarity": similarity[p, q]})

        schema = ", ".join(f"{c}_{k} {_kind(samples, c)}" for c in ("sample", "label") for k in "ab") + ", similarity double"
        return by_blocks(samples.select("sample", "label", "text"), fold, schema, within, most=PAIRED)
    texts = samples.select("label", "text").distinct()
    pairs = near_pairs(texts, least, within)
    if within:
        pairs = pairs.unionByName(texts.select(F.col("label").alias("label_a"), F.col("text").alias("text_a"), F.col("label").alias("label_b"), F.col("text").alias("text_b"), F.lit(1.0).alias("similarity")))
    left = samples.select(F.col("sample").alias("_a"), F.col("label").alias("label_a"), F.col("text").alias("text_a"))
    right = samples.select(F.col("sample").alias("_b"), F.col("label").alias("label_b"), F.col("text").alias("text_b"))
    out = pairs.join(left, ["label_a", "text_a"]).join(right, ["label_b", "text_b"])
    if not within:
        return out.select(F.col("_a").alias("sample_a"), F.col("_b").alias("sample_b"), "label_a", "label_b", "similarity")
    out = out.where((F.col("text_a") != F.col("text_b")) | (F.col("_a") < F.col("_b")))
    return out.select(F.least("_a", "_b").alias("sample_a"), F.greatest("_a", "_b").alias("sample_b"), "label_a", "label_b", "similarity")


def different_texts(samples: DataFrame) -> DataFrame:
    """label, text, n, sample: the different texts of each label, their number of samples and the least of these."""
    return samples.groupBy("label", "text").agg(F.count(F.lit(1)).alias("n"), F.min("sample").alias("sample"))


def separability(samples: DataFrame) -> DataFrame:
    """Mean similarity within and between labels, and their difference; different texts are compared once and count with their samples."""
    texts = different_texts(samples)

    def fold(a: pa.Table, b: pa.Table, similarity: np.ndarray, same: bool) -> pa.Table:
        _, (x, y) = _coded(a["label"], b["label"])
        weight = a["n"].to_numpy()[:, None] * b["n"].to_numpy()[None, :]
        weight = np.triu(weight, 1) if same else weight
        own = np.where(x[:, None] == y[None, :], weight, 0)
        other = weight - own
        return pa.table({"w": [float((similarity * own).sum())], "wn": [int(own.sum())], "b": [float((similarity * other).sum())], "bn": [int(other.sum())]})

    found = by_blocks(texts.select("label", "text", "n"), fold, "w double, wn long, b double, bn long", False)
    copies = texts.where("label IS NOT NULL AND text IS NOT NULL").select((F.col("n") * (F.col("n") - 1) / 2).cast("double").alias("w"), (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("wn"), F.lit(0.0).alias("b"), F.lit(0).cast("long").alias("bn"))
    total = found.unionByName(copies).agg(*[F.sum(c).alias(c) for c in ("w", "wn", "b", "bn")])
    mean = lambda c: F.when(F.col(f"{c}n") > 0, F.col(c) / F.nullif(F.col(f"{c}n"), F.lit(0)))
    return total.select(mean("w").alias("within"), mean("b").alias("between")).withColumn("separability", F.col("within") - F.col("between"))


def _beside(samples: DataFrame, least: float) -> DataFrame:
    """label, text, n, sample of the different texts, total and hits: over the samples of the label's other texts the sum of the similarities,
    and how many are at least `least`; all: the label's samples. A null text has no others."""
    texts = different_texts(samples)

    def fold(a: pa.Table, b: pa.Table, similarity: np.ndarray, same: bool) -> pa.Table:
        hits = similarity >= least
        if same:
            np.fill_diagonal(similarity, 0)
            np.fill_diagonal(hits, False)
        sides = [(a, similarity @ b["n"].to_numpy().astype(float), hits @ b["n"].to_numpy())]
        if not same:
            sides.append((b, similarity.T @ a["n"].to_numpy().astype(float), hits.T @ a["n"].to_numpy()))
        return pa.concat_tables([t.select(["label", "sample"]).append_column("total", pa.array(x)).append_column("hits", pa.array(h)) for t, x, h in sides])

    own = texts.select("label", "text", "n", "sample")
    sums = by_blocks(own, fold, f"label {_kind(samples, 'label')}, sample {_kind(samples, 'sample')}, total double, hits long", True)
    sums = sums.groupBy("label", "sample").agg(F.sum("total").alias("total"), F.sum("hits").alias("hits"))
    sizes = own.where("text IS NOT NULL").groupBy("label").agg(F.sum("n").alias("all"))
    none = lambda c, v: F.coalesce(c, F.lit(v))
    out = own.join(sums.withColumn("_text", F.lit(True)), ["label", "sample"], "left").join(sizes, "label", "left")
    return out.select("label", "text", "n", "sample", none("total", 0.0).alias("total"), none("hits", 0).alias("hits"), none("all", 1).alias("all"))


def medoid_templates(samples: DataFrame, support: float = 0.7) -> DataFrame:
    """One template per label: the sample of the highest mean similarity to the label's samples (itself included), ties to the least sample."""
    known = F.col("text").isNotNull()
    copies = F.when(known, F.col("n")).otherwise(1)
    mean = F.when(known, (F.col("total") + F.col("n")) / F.col("all")).otherwise(1.0)
    scored = _beside(samples.where("label IS NOT NULL"), support).select("label", "sample", mean.alias("mean_similarity"), (F.col("hits") + (copies if support <= 1 else 0)).alias("support"), "text")
    # Texts of equal mean compare by their least samples, and a text's samples are equal, so the first text's is the first sample.
    best = scored.groupBy("label").agg(F.min_by(F.struct("sample", "mean_similarity", "support", "text"), F.struct(-F.round("mean_similarity", 9), F.col("sample"))).alias("_b"))
    return best.select("_b.sample", "label", "_b.mean_similarity", "_b.support", "_b.text")


def diverse_templates(samples: DataFrame, most: int = 2, support: int = 2, diversity: float = 0.85) -> DataFrame:
    """label, rank, sample, mean_similarity, support: up to `most` templates a label, its normal variants.

    Candidates are ordered by their mean similarity to the label's other samples (1 if there are none), then by how many
    samples, themselves included, are at least `diversity` (at most 1) alike, then by name. The first is taken; a later one needs the
    given support, and to be less alike than `diversity` to all taken before. One round for each template.
    """
    others = F.col("all") - 1
    mean = F.when(F.col("text").isNotNull() & (others > 0), (F.col("total") + F.col("n") - 1) / F.nullif(others, F.lit(0))).otherwise(1.0)
    copies = F.when(F.col("text").isNotNull(), F.col("n")).otherwise(1)
    candidates = checkpointed(_beside(samples, diversity).select("label", "sample", "text", mean.alias("mean_similarity"), (F.col("hits") + copies).alias("support")))
    order = F.struct(-F.round("mean_similarity", 9), -F.col("support"), F.col("sample"))

    def first(rest: DataFrame, rank: int) -> DataFrame:
        best = rest.groupBy("label").agg(F.min_by(F.struct("sample", "text", "mean_similarity", "support"), order).alias("_b"))
        return checkpointed(best.select("label", F.lit(rank).alias("rank"), "_b.*"))

    taken, last, rest = first(candidates, 1), None, candidates.where(F.col("support") >= support)
    for rank in range(2, most + 1):
        last = taken if last is None else last
        new = last.select(F.col("label").alias("_l"), F.col("sample").alias("_s"), F.col("text").alias("_t"))
        near = (F.col("sample") == F.col("_s")) | F.coalesce(alike(F.col("text"), F.col("_t")) >= diversity, F.lit(False))
        rest = rest.join(F.broadcast(new), F.col("label").eqNullSafe(F.col("_l")), "left").withColumn("_near", F.coalesce(near, F.lit(False))).where(~F.col("_near")).drop("_l", "_s", "_t", "_near")
        last = first(rest, rank)
        taken = taken.unionByName(last)
    return taken.select("label", "rank", "sample", "mean_similarity", "support")


def match_templates(samples: DataFrame, templates: DataFrame) -> DataFrame:
    """sample, label (its own), best label and similarity, runner-up and margin; different texts meet the small template table once."""
    texts = samples.select("text").distinct().crossJoin(F.broadcast(templates.select(F.col("label").alias("best"), F.col("text").alias("_t"))))
    per = texts.withColumn("_s", alike(F.col("text"), F.col("_t"))).groupBy("text", "best").agg(F.max("_s").alias("similarity"))
    w = Window.partitionBy("text").orderBy(F.desc("similarity"), "best")
    ranked = per.withColumns({"_r": F.row_number().over(w), "second": F.lead("similarity").over(w)}).where("_r = 1")
    return samples.join(ranked.select("text", "best", "similarity", (F.col("similarity") - F.coalesce("second", F.lit(0.0))).alias("margin")), "text").select("sample", "label", "best", "similarity", "margin")


def leave_one_out(samples: DataFrame) -> DataFrame:
    """sample, label, best: the label of the most similar other sample, ties to the least label. Each pair of blocks of different texts tells the
    best of its texts, not its pairs."""
    texts = different_texts(samples).where("label IS NOT NULL AND text IS NOT NULL")

    def fold(a: pa.Table, b: pa.Table, similarity: np.ndarray, same: bool) -> pa.Table:
        labels, (x, y) = _coded(a["label"], b["label"])
        if same:
            np.fill_diagonal(similarity, -1)
        out = []
        for rows, near, other in ((a, similarity, y),) if same else ((a, similarity, y), (b, similarity.T, x)):
            top = near.max(axis=1, initial=-1.0)
            best = np.where(near == top[:, None], other[None, :], len(labels)).min(axis=1, initial=len(labels))
            told = np.flatnonzero(top >= 0)
            out.append(rows.select(["label", "sample"]).take(told).append_column("similarity", pa.array(top[told])).append_column("best", labels.take(pa.array(best[told]))))
        return pa.concat_tables(out)

    label = _kind(samples, "label")
    found = by_blocks(texts.select("label", "text", "sample"), fold, f"label {label}, sample {_kind(samples, 'sample')}, similarity double, best {label}", False)
    copies = texts.where("n > 1").select("label", "sample", F.lit(1.0).alias("similarity"), F.col("label").alias("best"))
    top = found.unionByName(copies).groupBy("label", "sample").agg(F.min_by("best", F.struct(-F.col("similarity"), F.col("best"))).alias("best"))
    named = texts.join(top, ["label", "sample"], "left").select("label", "text", "best")
    return samples.select("sample", "label", "text").join(named, ["label", "text"], "left").select("sample", "label", "best")


def leave_one_out_templates(samples: DataFrame) -> DataFrame:
    """sample, label, best, template, similarity: the label whose template, rebuilt without the sample, is most similar; ties to the least label.

    A label's template is its medoid; the sample's own label has none without it if it is the only one.
    """
    half = text_pairs(samples, True)
    both = half.select(F.col("label_a").alias("label"), F.col("sample_a").alias("held"), F.col("sample_b").alias("template"), "similarity").unionByName(half.select(F.col("label_a").alias("label"), F.col("sample_b").alias("held"), F.col("sample_a").alias("template"), "similarity"))
    # A candidate's sum over its label, less its share for the held-out sample; its own 1 stays.
    total = both.groupBy("label", "template").agg((F.sum("similarity") + 1).alias("_sum"))
    without = both.join(total, ["label", "template"]).withColumn("_rest", F.round(F.col("_sum") - F.col("similarity"), 9))
    own = without.groupBy("label", "held").agg(F.min_by("template", F.struct(-F.col("_rest"), F.col("template"))).alias("template"))
    chosen = own.select(F.col("held").alias("sample"), F.col("label").alias("best"), "template")
    medoids = F.broadcast(medoid_templates(samples).select(F.col("label").alias("best"), F.col("sample").alias("template")))
    others = samples.join(medoids, F.col("label") != F.col("best")).select("sample", "best", "template")
    rows = others.unionByName(chosen).join(samples.select(F.col("sample").alias("template"), F.col("text").alias("_t")), "template").join(samples, "sample")
    scored = rows.withColumn("similarity", edit_similarity(F.col("text"), F.col("_t")))
    top = F.min_by(F.struct("best", "template", "similarity"), F.struct(-F.col("similarity"), F.col("best")))
    return scored.groupBy("sample", "label").agg(top.alias("_top")).select("sample", "label", "_top.*")


def score_task_steps(steps: DataFrame, samples: DataFrame, templates: DataFrame, graph: DataFrame, thresholds: DataFrame) -> DataFrame:
    """seq_id, pos, action, sample, best, similarity, valid, anomaly: each step's sample against the templates of the actions that may stand there.

    A step's sample is one of its action's samples, picked by a hash of the step; steps of actions without samples are left
    out. An action may stand where the one before leads to it, or at the start (graph: action, successors, starts). A step is an
    anomaly if it isn't valid or its best template is farther than that label's threshold.
    """
    from .corpora import unit_hash

    numbered = samples.withColumns({"_k": F.row_number().over(Window.partitionBy("label").orderBy("sample")) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy("label"))})
    sizes = numbered.groupBy(F.col("label").alias("action")).agg(F.max("_n").alias("_n"))
    rows = steps.withColumn("_previous", F.lag("action").over(Window.partitionBy("seq_id").orderBy("pos"))).join(F.broadcast(sizes), "action")
    rows = rows.withColumn("_k", F.floor(unit_hash("seq_id", "pos") * F.col("_n"))).join(numbered.select(F.col("label").alias("action"), "_k", "sample", "text"), ["action", "_k"])
    starts = graph.where("starts").agg(F.collect_set("action").alias("_starts"))
    rows = rows.join(F.broadcast(graph.select(F.col("action").alias("_previous"), "successors")), "_previous", "left").crossJoin(F.broadcast(starts))
    rows = rows.withColumn("_next", F.when(F.col("_previous").isNull(), F.col("_starts")).otherwise(F.coalesce("successors", F.array().cast("array<string>"))))
    # Different texts meet the small template table once; a step then picks among its valid actions.
    scored = samples.select("text").distinct().crossJoin(F.broadcast(templates.select(F.col("label").alias("best"), F.col("text").alias("_t")))).withColumn("_s", alike(F.col("text"), F.col("_t"))).groupBy("text", "best").agg(F.max("_s").alias("similarity"))
    lists = scored.groupBy("text").agg(F.collect_list(F.struct((-F.col("similarity")).alias("d"), "best")).alias("_all"))
    top = F.array_min(F.filter("_all", lambda x: F.array_contains(F.col("_next"), x["best"])))
    out = rows.join(lists, "text").withColumn("_top", top).withColumns({"best": F.col("_top.best"), "similarity": F.coalesce(-F.col("_top.d"), F.lit(0.0)), "valid": F.array_contains("_next", F.col("action"))})
    out = out.join(F.broadcast(thresholds.select("best", "threshold")), "best", "left")
    far = F.col("best").isNotNull() & (1 - F.col("similarity") > F.coalesce("threshold", F.lit(1.0)))
    return out.select("seq_id", "pos", "action", "sample", "best", "similarity", "valid", (~F.col("valid") | far).alias("anomaly"))
