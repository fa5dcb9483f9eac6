"""Quality scores by co-training: a classifier of the text and one of the page's metadata teach each other.

The text view is hashed words and word shapes; the metadata view is source, language and layout (length, lines, shares of
capitals, digits and signs). Each view is a naive Bayes classifier, so that fitting is counting: its log-odds are the mean, over a
document's features, of the log ratio of their frequencies in good and bad documents. Platt scaling on labelled rows that
neither view saw turns them into chances. Each round scores all unlabelled documents and counts, for either view, those that the
other view is confident of; the calibrated views are then combined by a logistic regression on the rows held out.
Features are made where the texts are and only counts of fixed size leave the tasks; only the labelled rows for fitting are bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, buffers, cut, mix, span_hashes, steps, summed

#: Hashed features of each view (the last of the text's is kept for repeated words), and the counts that one row of a partition's sums holds.
TEXT_FEATURES, META_FEATURES, CHUNK = (1 << 15) - 1, 1 << 12, 1 << 13

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: The shape of a byte: one sign for all capitals, letters and digits, and other bytes as they are.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[48:58], _SHAPE[128:] = 65, 97, 48, 97
_STOPS, _LINE = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_STOPS[[44, 46]] = _LINE[10] = True


def text_features(text: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature) of each word, each word shape and each word that repeats the one before it; rows of the latter alone.

    Words end at white space; shapes hold no sign twice in a row.
    """
    on = ~_SPACE[text]
    edges = cuts[(cuts > 0) & (cuts < len(text))]
    first, last = on.copy(), on.copy()
    first[1:] &= ~on[:-1]
    last[:-1] &= ~on[1:]
    first[edges] |= on[edges]
    last[edges - 1] |= on[edges - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(cuts, start, side="right") - 1
    half = np.uint64(TEXT_FEATURES // 2)  # of words, and as many of shapes
    words = span_hashes(LOWER[text], start, end)
    again = row[1:][(words[1:] == words[:-1]) & (row[1:] == row[:-1])]
    shape = _SHAPE[text]
    kept = first | (on & np.r_[True, shape[1:] != shape[:-1]])
    at = np.r_[0, np.cumsum(kept)]
    shapes = (span_hashes(shape[kept], at[start], at[end]) % half + half).astype(np.int64)
    return np.r_[row, row, again], np.r_[(words % half).astype(np.int64), shapes, np.full(len(again), TEXT_FEATURES - 1)], again


def meta_features(text: np.ndarray, cuts: np.ndarray, words: np.ndarray, again: np.ndarray, source: list, lang: list) -> np.ndarray:
    """rows x facts: the hashed values of source, language and layout; words and again: a row's words, and those that repeat the one before."""
    size = np.diff(cuts)
    sums = lambda kind: np.diff(np.r_[0, np.cumsum(kind[text], dtype=np.int64)][cuts])
    lines, n = sums(_LINE) + 1, np.maximum(size, 1)
    log = lambda x: np.floor(np.log2(x + 1.0)).astype(np.int64)
    part = lambda x: (20 * x // n).astype(np.int64)
    other = np.ones(256, dtype=bool)
    other[(_SHAPE == 65) | (_SHAPE == 97) | (_SHAPE == 48) | _SPACE | _STOPS] = False
    facts = [log(size), log(lines), log(size / lines), *(part(sums(kind)) for kind in (_SHAPE == 65, _SHAPE == 97, _SHAPE == 48, _SPACE, _STOPS, other))]
    facts += [(20 * again // np.maximum(words, 1)).astype(np.int64), np.minimum(size // np.maximum(words, 1), 40)]
    facts += [pd.util.hash_array(np.array(["?" if v is None else f"={v}" for v in values], dtype=object), categorize=True).view(np.int64) if len(values) else np.zeros(0, dtype=np.int64) for values in (source, lang)]
    out = np.stack(facts, axis=1).view(np.uint64)
    return (mix(out + np.arange(1, out.shape[1] + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) % np.uint64(META_FEATURES)).astype(np.int64)


class Views:
    """The features of the rows of a batch, in steps of bounded memory."""

    def __init__(self, text: np.ndarray, cuts: np.ndarray, source: list, lang: list):
        self.rows = len(cuts) - 1
        self.row, self.feature, again = text_features(text, cuts)
        self.count, again = (np.bincount(x, minlength=self.rows) for x in (self.row, again))
        self.meta = meta_features(text, cuts, (self.count - again) // 2, again, source, lang)

    def add(self, view: int, counts: np.ndarray, label: np.ndarray) -> None:
        """Add the documents of label 0 and 1 to counts (2 x features); each weighs 1, however long."""
        if view:
            for kind in (0, 1):
                counts[kind] += np.bincount(self.meta[label == kind].ravel(), minlength=META_FEATURES) / self.meta.shape[1]
        else:
            each, own = 1 / np.maximum(self.count, 1), label[self.row]
            for kind in (0, 1):
                at = own == kind
                counts[kind] += np.bincount(self.feature[at], weights=each[self.row[at]], minlength=TEXT_FEATURES)

    def odds(self, ratios: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """2 x rows: the mean log ratio of each view."""
        text = np.bincount(self.row, weights=ratios[0][self.feature], minlength=self.rows) / np.maximum(self.count, 1)
        return np.stack([text, ratios[1][self.meta].mean(axis=1)])


def _views(text: pa.Array, source: pa.Array, lang: pa.Array) -> Iterator[tuple[int, int, Views]]:
    data, offsets = buffers(text)
    source, lang = source.to_pylist(), lang.to_pylist()
    for lo, hi in steps(offsets):
        yield lo, hi, Views(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], source[lo:hi], lang[lo:hi])


def log_ratios(counts: np.ndarray) -> np.ndarray:
    """Log of a feature's share in good documents over that in bad ones; counts are 2 x features, smoothed by a hundredth of a document's weight."""
    share = (counts + 0.01 / np.sqrt(counts.shape[1])) / (counts.sum(axis=1, keepdims=True) + 0.01 * np.sqrt(counts.shape[1]))
    return np.log(share[1] / share[0])


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights of the columns of x, then the intercept, of a logistic regression (Newton's method); targets are Platt's."""
    n1, n0 = float(y.sum()), float(len(y) - y.sum())
    goal = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    own = np.c_[x / scale, np.ones(len(x))]
    w = np.zeros(own.shape[1])
    loss = lambda w: np.logaddexp(0, own @ w).sum() - goal @ (own @ w) + ridge / 2 * (w[:-1] ** 2).sum()
    for _ in range(100):
        p = 1 / (1 + np.exp(-own @ w))
        slope = own.T @ (p - goal) + ridge * np.r_[w[:-1], 0]
        step = np.linalg.solve((own * (p * (1 - p))[:, None]).T @ own + (ridge + 1e-9) * np.eye(len(w)), slope)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return np.r_[w[:-1] / scale, w[-1]]


class CoTrained:
    """Log ratios of both views, the calibration of each, and what combines them."""

    def __init__(self, counts: list[np.ndarray], raw_of):
        """raw_of: gives, for log ratios, the views' mean log ratios (2 x rows) and the labels of the rows to calibrate on."""
        self.ratios = tuple(log_ratios(c) for c in counts)
        raw, label = raw_of(self.ratios)
        self.scale = [logistic_fit(raw[i][:, None], label) for i in (0, 1)]
        self.both = logistic_fit(self._calibrated(raw).T, label)

    def _calibrated(self, raw: np.ndarray) -> np.ndarray:
        return np.stack([a * x + b for x, (a, b) in zip(raw, self.scale, strict=True)])

    def odds(self, views: Views) -> np.ndarray:
        """2 x rows: calibrated log-odds of good quality of each view."""
        return self._calibrated(views.odds(self.ratios))

    def chances(self, views: Views) -> np.ndarray:
        """3 x rows: chances of good quality, combined and of each view."""
        odds = self.odds(views)
        return 1 / (1 + np.exp(-np.stack([self.both[:2] @ odds + self.both[2], *odds])))


def _counted(labels_of):
    """The counts of a partition for both views, as chunks for `summed`; labels_of gives each view's labels (-1: none) of a step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _no_counts()
        for batch in batches:
            for lo, hi, views in _views(*(batch.column(c) for c in ("_text", "_source", "_lang"))):
                for view, label in enumerate(labels_of(batch, lo, hi, views)):
                    views.add(view, counts[view], label)
        flat = np.concatenate([c.ravel() for c in counts])
        parts = np.pad(flat, (0, -len(flat) % CHUNK)).reshape(-1, CHUNK)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), type=pa.int32()), pa.array([x.tobytes() for x in parts], type=pa.binary())], names=["chunk", "counts"])

    return run


def _no_counts() -> list[np.ndarray]:
    return [np.zeros((2, TEXT_FEATURES)), np.zeros((2, META_FEATURES))]


def _counts(rows: DataFrame, labels_of) -> list[np.ndarray]:
    sums = summed(rows.mapInArrow(_counted(labels_of), "chunk int, counts binary"), np.float64)
    flat = np.concatenate([sums.get(i, np.zeros(CHUNK)) for i in range(-(-2 * (TEXT_FEATURES + META_FEATURES) // CHUNK))])
    return [flat[: 2 * TEXT_FEATURES].reshape(2, -1), flat[2 * TEXT_FEATURES : 2 * (TEXT_FEATURES + META_FEATURES)].reshape(2, -1)]


def _known(batch: pa.RecordBatch, lo: int, hi: int, views: Views) -> list[np.ndarray]:
    return [batch.column("_label").to_numpy()[lo:hi].astype(np.int64)] * 2


def _confident(model: CoTrained, confident: float):
    """Each view is taught what the other one is confident of."""
    edge = np.log(confident / (1 - confident))

    def labels_of(batch: pa.RecordBatch, lo: int, hi: int, views: Views) -> list[np.ndarray]:
        return [np.where(odds >= edge, 1, np.where(odds <= -edge, 0, -1)) for odds in model.odds(views)[::-1]]

    return labels_of


def _raw_odds(ratios: tuple[np.ndarray, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, views in _views(*(batch.column(c) for c in ("_text", "_source", "_lang"))):
                yield pa.RecordBatch.from_arrays([*map(pa.array, views.odds(ratios)), batch.column("_label").slice(lo, hi - lo)], names=["text", "meta", "label"])

    return run


def co_train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", labelled: int = 8000, rounds: int = 3, confident: float = 0.95) -> CoTrained | None:
    """Fit on at most `labelled` labelled rows and the pseudo-labels that all other documents earn; None without labels of both kinds.

    The labelled rows are those of the least hashes of id and text (repeated labels: the greatest counts; repeated rows are
    rows); a fifth of them, by hash, is held out for calibration. Labelled rows beyond the bound teach as unlabelled ones.
    The driver sees counts of features and the held-out rows' log ratios, no texts.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("_label"))
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"), F.col(source_col).cast("string").alias("_source"), F.col(lang_col).cast("string").alias("_lang"))
    own = own.withColumn("_hash", F.xxhash64("_id", "_text", F.lit(5)))
    # The sample is chosen by ids and hashes, so that no text is shuffled.
    chosen = cut(own.select("_id", "_hash").join(known, "_id").orderBy("_hash", "_id").limit(labelled))
    few = F.broadcast(chosen.distinct())
    sample = cut(own.join(few, ["_id", "_hash"]).orderBy("_hash", "_id").limit(labelled).withColumn("_held", F.pmod(F.xxhash64("_hash"), F.lit(5)) == 0))
    kinds = {(r[0], r[1]) for r in sample.select("_held", "_label").distinct().collect()}
    if not {(False, 0), (False, 1)} <= kinds:
        return None
    # Where too few are held out, the rows that the views saw must do.
    held = sample.where("_held") if {(True, 0), (True, 1)} <= kinds else sample

    def raw_of(ratios: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        rows = held.select("_text", "_source", "_lang", "_label").mapInArrow(_raw_odds(ratios), "text double, meta double, label int").toPandas().sort_values(["text", "meta", "label"])
        return rows[["text", "meta"]].to_numpy().T, rows["label"].to_numpy(dtype=np.float64)

    seen = _counts(sample.where("NOT _held").select("_text", "_source", "_lang", "_label"), _known)
    model = CoTrained(seen, raw_of)
    others = own.join(few.select("_id", "_hash"), ["_id", "_hash"], "left_anti").select("_text", "_source", "_lang")
    for _ in range(rounds):
        more = _counts(others, _confident(model, confident))
        model = CoTrained([a + b for a, b in zip(seen, more, strict=True)], raw_of)
    return model


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", **options) -> DataFrame:
    """All columns of docs with _q_score (0 to 1), _q_p_text, _q_p_meta: the chance of good quality, combined and of each view.

    Every row is scored, repeated ones one by one; null texts are empty, null sources and languages are values of their own.
    Without labels of both kinds nothing can be learned and all scores are 0.5. An empty table gives no rows. Columns of docs
    with the names of the results are replaced by them.
    """
    model = co_train(docs, labels, id_col, text_col=text_col, source_col=source_col, lang_col=lang_col, **options)
    names = ("_q_score", "_q_p_text", "_q_p_meta")
    if model is None:
        return docs.withColumns({c: F.lit(0.5) for c in names})

    @F.arrow_udf("struct<score double, p_text double, p_meta double>")
    def chances(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for columns in batches:
            parts = [model.chances(v) for _, _, v in _views(*columns)] or [np.zeros((3, 0))]
            yield pa.StructArray.from_arrays([pa.array(x) for x in np.concatenate(parts, axis=1)], names=["score", "p_text", "p_meta"])

    own = chances(F.col(text_col).cast("binary"), F.col(source_col).cast("string"), F.col(lang_col).cast("string"))
    return docs.withColumns({c: own[k] for c, k in zip(names, ("score", "p_text", "p_meta"), strict=True)})
