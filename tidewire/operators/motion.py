"""The motion model as a whole: symbols of windows, templates, thresholds, and the segmentation of long captures by several methods."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import models
from ..sources.shared import checkpointed
from . import signals, windows
from .conformance import held
from .metrics import label_thresholds
from .outliers import nearest_center, softsign_log


class Symbols:
    """Fitted standardisation and centers: windows become letters."""

    def __init__(self, columns: list[str], means: list[float], deviations: list[float], centers: list[list[float]]):
        self.columns, self.means, self.deviations, self.centers = columns, means, deviations, centers

    def standardised(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({f"_z{i}": (softsign_log(F.col(c).cast("double")) - m) / s for i, (c, m, s) in enumerate(zip(self.columns, self.means, self.deviations, strict=True))})

    def apply(self, rows: DataFrame) -> DataFrame:
        """rows with symbol."""
        names = [f"_z{i}" for i in range(len(self.columns))]
        return nearest_center(self.standardised(rows), names, self.centers).drop(*names)


def fit_symbols(rows: DataFrame, columns: list[str], k: int = 8, seed: int = 7) -> Symbols:
    """Mean, deviation (1 for none) and k-means centers of sign * log1p of the columns."""
    own = [softsign_log(F.col(c).cast("double")) for c in columns]
    stats = rows.agg(*[F.avg(c) for c in own], *[F.stddev_pop(c) for c in own], F.count(F.lit(1))).first()
    d = len(columns)
    model = Symbols(columns, [float(v or 0.0) for v in stats[:d]], [float(v or 0.0) or 1.0 for v in stats[d : 2 * d]], [])
    ready = VectorAssembler(inputCols=[f"_z{i}" for i in range(d)], outputCol="_v").transform(model.standardised(rows))
    fitted = KMeans(k=max(2, min(k, stats[2 * d])), seed=seed, featuresCol="_v").fit(ready)
    model.centers = sorted([float(v) for v in c] for c in fitted.clusterCenters())
    return model


def train_motion(rows: DataFrame, columns: list[str], k: int = 8, most: int = 2, q: float = 0.85, floor: float = 0.2, pad: float = 0.12) -> tuple[Symbols, dict[str, DataFrame]]:
    """Fit on window features (label, sample, window_idx, columns). The symbols' model, and tables: windows, sequences, templates, scores, thresholds, manifest."""
    rows = checkpointed(rows)  # read for the statistics, the centers and the letters
    model = fit_symbols(rows, columns, k)
    lettered = model.apply(rows)
    texts = windows.compress_runs(lettered, ["label", "sample"], "window_idx", "symbol")
    samples = held(texts.select("label", "sample", "text"))
    templates = held(signals.diverse_templates(samples, most).join(samples, ["label", "sample"]).select("label", "rank", "sample", "text", "mean_similarity", "support"))
    lengths = samples.groupBy("label").agg(F.avg(F.length("text")).alias("mean_length"))
    templates = held(templates.join(lengths, "label"))
    scores = signals.match_templates(samples, templates).withColumn("anomaly", 1 - F.col("similarity"))
    thresholds = held(label_thresholds(scores, "best", "anomaly", q, pad, floor).select(F.col("best").alias("label"), "threshold"))
    scores = scores.join(F.broadcast(thresholds.withColumnRenamed("label", "best")), "best").withColumn("is_anomaly", F.col("anomaly") > F.col("threshold"))
    manifest = lettered.groupBy("label").agg(F.countDistinct("sample").alias("samples"), F.count(F.lit(1)).alias("windows"))
    return model, {"windows": lettered, "sequences": samples, "templates": templates, "scores": scores, "thresholds": thresholds, "manifest": manifest}


def write_training(tables: dict[str, DataFrame], folder: str) -> None:
    """The report tables of a training run, each a folder; windows and sequences are split by label."""
    for name, table in tables.items():
        writer = table.write.mode("overwrite")
        (writer.partitionBy("label") if name in ("windows", "sequences") else writer).parquet(f"{folder}/{name}")


def publish_motion(model: Symbols, tables: dict[str, DataFrame], folder: str) -> int:
    """Publish the symbols' model and the tables of a training run as one version, see `models.publish`."""
    value = {"columns": model.columns, "means": model.means, "deviations": model.deviations, "centers": model.centers}
    return models.publish(tables, folder, value, split=("windows", "sequences"))


def load_motion(spark: SparkSession, folder: str, number: int | None = None) -> tuple[Symbols, dict[str, DataFrame]]:
    """What publish_motion has published last, or under a number."""
    tables, value = models.load(spark, folder, number=number)
    return Symbols(value["columns"], value["means"], value["deviations"], value["centers"]), tables


def prefix_distances(codes: np.ndarray, starts: np.ndarray, template: np.ndarray, most: int) -> np.ndarray:
    """Edit distances (length, start) of a template to the text's pieces of 1 to `most` letters from each start, by bit vectors.

    A column of the edit table is kept as the bits where it goes up and down (Myers), in words of 64 letters of the template; one step
    takes a letter of the text at all starts at once. Pieces that reach over the end of the text are told to nobody.
    """
    m, one = len(template), np.uint64(1)
    blocks = -(-m // 64)
    up = [np.full(len(starts), np.uint64(2**64 - 1)) for _ in range(blocks)]
    down = [np.zeros(len(starts), dtype=np.uint64) for _ in range(blocks)]
    # For each letter, the places in the template that hold it; the last row is of letters that it lacks.
    letters, numbers = np.unique(template, return_inverse=True)
    where = np.zeros((len(letters) + 1, blocks), dtype=np.uint64)
    for i, letter in enumerate(numbers.tolist()):
        where[letter, i // 64] |= np.uint64(1 << (i % 64))
    at = np.searchsorted(letters, codes)
    row = np.where((at < len(letters)) & (letters[np.minimum(at, len(letters) - 1)] == codes), at, len(letters))
    row = np.concatenate([row, np.full(most, len(letters))])
    score = np.full(len(starts), m, dtype=np.int32)
    out = np.empty((most, len(starts)), dtype=np.int32)
    for j in range(most):
        own = where[row[starts + j]]
        rises, falls = np.ones(len(starts), dtype=np.uint64), np.zeros(len(starts), dtype=np.uint64)
        for b in range(blocks):
            top = np.uint64((m - 1) % 64 if b == blocks - 1 else 63)
            eq = own[:, b]
            xv = eq | down[b]
            eq = eq | falls
            xh = (((eq & up[b]) + up[b]) ^ up[b]) | eq
            ph, mh = down[b] | ~(xh | up[b]), up[b] & xh
            out_rises, out_falls = (ph >> top) & one, (mh >> top) & one
            ph, mh = (ph << one) | rises, (mh << one) | falls
            up[b], down[b] = mh | ~(xv | ph), ph & xv
            rises, falls = out_rises, out_falls
        score = score + rises.astype(np.int32) - falls.astype(np.int32)
        out[j] = score
    return out


#: Starts whose distances are held at once.
STARTS = 1 << 14


def best_path(text: str, templates: list[tuple[str, str, float]], transcript: list[str] | None = None) -> list[tuple[str, int, int, float]]:
    """Segments (label, first, end, similarity) of a symbol text: the path of the highest total of similarity less 0.12 |log length ratio| and 0.02 a segment.

    templates: (label, text, mean length of the label's samples), texts not empty. A segment's length over that mean is between 0.45
    and 1.85. The path may end within the longest segment of the end. With a transcript the labels must be those, in order, and all
    of them. A text without a path, or one that is short and has none of a total above 0, is one segment of the nearest template;
    an empty text has none.
    """
    n, templates = len(text), [t for t in templates if t[1]]
    if not n or not templates:
        return []
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    spelled = [np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32) for _, t, _ in templates]
    least = max(2, int(min(map(len, spelled)) * 0.45))
    most = max(3, int(max(map(len, spelled)) * 1.75))
    lengths = np.arange(1, most + 1)
    scripted = bool(transcript)
    wanted = transcript if scripted else [None]
    of = {w: [i for i, t in enumerate(templates) if w is None or t[0] == w] for w in dict.fromkeys(wanted)}

    def cost(mean: float) -> np.ndarray:
        """What a segment of each length loses, infinite where none may have it."""
        ratio = [k / max(mean, 1.0) for k in lengths.tolist()]
        return np.array([abs(math.log(r)) * 0.12 if k >= least and 0.45 <= r <= 1.85 else math.inf for k, r in zip(lengths.tolist(), ratio, strict=True)])

    costs = [cost(mean) for _, _, mean in templates]
    steps = len(wanted) if scripted else 0
    # best[s][i]: the highest total of a path to letter i with s segments of the transcript; came: (start, template, similarity) of its last one.
    best = np.full((steps + 1, n + 1), -np.inf)
    best[0, 0] = 0.0
    came = np.full((steps + 1, n + 1, 2), -1, dtype=np.int64)
    near = np.zeros((steps + 1, n + 1))
    for low in range(0, n, STARTS):
        starts = np.arange(low, min(n, low + STARTS))
        tables: dict = {}
        distances: dict[int, np.ndarray] = {}
        for w, own in of.items():
            total = np.full((most, len(starts)), -np.inf)
            which, alike = np.full(total.shape, -1, dtype=np.int32), np.zeros(total.shape)
            for i in own:
                if i not in distances:
                    distances[i] = prefix_distances(codes, starts, spelled[i], most)
                similarity = 1 - distances[i] / np.maximum(lengths, len(spelled[i]))[:, None]
                score = similarity - costs[i][:, None] - 0.02
                better = score > total
                total, which, alike = np.where(better, score, total), np.where(better, i, which), np.where(better, similarity, alike)
            tables[w] = total.T.copy(), which.T.copy(), alike.T.copy()
        for s, w in enumerate(wanted):
            to = s + 1 if scripted else 0
            total, which, alike = tables[w]
            for i, first in enumerate(starts.tolist()):
                room = min(most, n - first)
                if best[s, first] == -np.inf or room < least:
                    continue
                new, old = best[s, first] + total[i, :room], best[to, first + 1 : first + room + 1]
                at = np.flatnonzero(new > old)
                if len(at):
                    old[at] = new[at]
                    came[to, first + 1 + at, 0], came[to, first + 1 + at, 1], near[to, first + 1 + at] = first, which[i, at], alike[i, at]
    low = max(0, n - most)
    at = low + int(np.argmax(best[steps, low:]))
    if came[steps, at, 0] < 0:
        found = [1 - int(prefix_distances(codes, np.zeros(1, dtype=np.int64), t, n)[-1, 0]) / max(n, len(t)) for t in spelled]
        i = int(np.argmax(found))
        return [(templates[i][0], 0, n, found[i])]
    out, s = [], steps
    while came[s, at, 0] >= 0:
        first, i = came[s, at].tolist()
        out.append((templates[i][0], first, at, float(near[s, at])))
        at, s = first, s - 1 if scripted else 0
    return out[::-1]


#: Templates that a model may hold.
MODEL = 10_000
SEGMENTS = "capture_id string, label string, first int, last int, similarity double"


def segment_texts(texts: DataFrame, templates: DataFrame, transcript: list[str] | None = None) -> DataFrame:
    """capture_id, label, first, last (exclusive), similarity: the best path of each capture's symbol text; a text that has letters has a row.

    templates are a model table of a few texts a label, which goes to the tasks whole; more than MODEL of them are an error.
    """
    rows = templates.select("label", "text", "mean_length", "rank").orderBy("label", "rank").limit(MODEL + 1).collect()
    if len(rows) > MODEL:
        raise ValueError(f"more than {MODEL} templates")
    known = [(r.label, r.text, float(r.mean_length)) for r in rows]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(c, *s) for c, t in zip(b["capture_id"], b["text"], strict=True) for s in best_path(t or "", known, transcript)]
            yield pd.DataFrame(rows, columns=["capture_id", "label", "first", "last", "similarity"])

    # Texts are few bytes and much work, so they are dealt out by number, which the adaptive planner leaves alone.
    spark = texts.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return texts.select(F.col("capture_id").cast("string").alias("capture_id"), "text").repartition(tasks, "capture_id").mapInPandas(run, SEGMENTS)


def segment_captures(method: str, texts: DataFrame, tables: dict[str, DataFrame], transcript: list[str] | None = None, commands: DataFrame | None = None, activity: DataFrame | None = None, least: float = 0.0) -> DataFrame:
    """capture_id, label, first, last, similarity, status by a named method.

    dp: best path over the symbols; scripted: the same along a transcript; command: runs of recognised commands (capture_id, idx, label);
    scan: each symbol's best template by label, runs joined and short ones folded; activity: active segments (capture_id, first,
    last) of the symbols matched as wholes. status is ANOMALY where 1 - similarity is over the label's threshold (0.5 without one).
    """
    if method in ("dp", "scripted"):
        if method == "scripted" and not transcript:
            raise ValueError("a scripted segmentation needs a transcript")
        found = segment_texts(texts, tables["templates"], transcript if method == "scripted" else None)
    elif method == "command":
        runs = windows.runs(commands, ["capture_id"], "idx", "label").groupBy("capture_id", "run", "label").agg(F.min("idx").cast("int").alias("first"), (F.max("idx") + 1).cast("int").alias("last"))
        found = runs.select(F.col("capture_id").cast("string").alias("capture_id"), "label", "first", "last", F.lit(1.0).alias("similarity"))
    elif method in ("scan", "activity"):
        own = texts.select(F.col("capture_id").cast("string").alias("capture_id"), "text")
        if method == "scan":  # overlapping parts of the templates' mean length, a step of a quarter of it
            size = max(2, int(tables["templates"].agg(F.avg("mean_length")).first()[0] or 2))
            step = max(1, size // 4)
            parts = own.select("capture_id", "text", F.explode(F.sequence(F.lit(0), F.greatest(F.length("text") - size, F.lit(0)), F.lit(step))).alias("first")).withColumn("last", F.least(F.col("first") + step, F.length("text")))
            parts = parts.withColumn("part", F.substring("text", F.col("first") + 1, F.lit(size)))
        else:
            parts = own.join(activity.select(F.col("capture_id").cast("string").alias("capture_id"), F.col("first").cast("int").alias("first"), F.col("last").cast("int").alias("last")), "capture_id").withColumn("part", F.substring("text", F.col("first") + 1, F.col("last") - F.col("first")))
        samples = parts.select(F.concat_ws("#", "capture_id", F.col("first").cast("string")).alias("sample"), F.lit("?").alias("label"), F.col("part").alias("text"))
        matched = signals.match_templates(samples, tables["templates"]).select("sample", "best", "similarity")
        found = parts.withColumn("sample", F.concat_ws("#", "capture_id", F.col("first").cast("string"))).join(matched, "sample").select("capture_id", F.col("best").alias("label"), F.col("first").cast("double").alias("first"), F.col("last").cast("double").alias("last"), F.col("similarity").alias("confidence"), F.lit(1).cast("long").alias("windows"))
        if method == "scan":
            found = windows.merge_short_runs(found, ["capture_id"], least)
        found = found.select("capture_id", "label", F.col("first").cast("int").alias("first"), F.col("last").cast("int").alias("last"), F.col("confidence").alias("similarity"))
    else:
        raise ValueError(f"no such method: {method}")
    limits = tables["thresholds"].select("label", "threshold")
    out = found.join(F.broadcast(limits), "label", "left")
    status = F.when(1 - F.col("similarity") <= F.coalesce("threshold", F.lit(0.5)), "NORMAL").otherwise("ANOMALY")
    return out.select("capture_id", "label", "first", "last", "similarity", status.alias("status"))
