"""Language identification by compression: the language whose text, as a zstandard dictionary, shortens a document most."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A document is compressed in pieces of so many bytes, each from the dictionary anew, so that a long one doesn't teach the encoder its own language.
PIECE = 16 << 10
#: Levels from about 5 to 9 look for the short matches that tell languages apart; higher ones parse short pieces no better.
LEVEL = 6


def dictionaries(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", learn: Column | None = None, per_language: int = 64, dictionary_bytes: int = 96 << 10) -> dict[str, bytes]:
    """Raw content for a dictionary of each language, from a bounded sample of labelled rows.

    Texts are lower-cased, as for prediction. The sample: of each non-null language at most `per_language` rows with text, those of up to PIECE bytes first, then by a hash
    of the id, while they fit `dictionary_bytes`; the first row always counts, cut to that size.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & (F.length(F.trim(text_col)) > 0))
    rows = rows.where(learn) if learn is not None else rows
    size = F.octet_length(text_col)
    order = [size > PIECE, F.xxhash64(F.col(id_col), F.lit(11)), F.xxhash64(text_col)]
    ranked = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), size.alias("n"), *[c.alias(f"o{i}") for i, c in enumerate(order)])
    by = Window.partitionBy("lang").orderBy("o0", "o1", "o2")
    few = ranked.withColumn("r", F.row_number().over(by)).where(F.col("r") <= per_language)
    few = few.withColumn("end", F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, 0))).where((F.col("r") == 1) | (F.col("end") <= dictionary_bytes))
    out: dict[str, list[bytes]] = {}
    for r in few.select("lang", "r", F.substring(F.lower("text").cast("binary"), 1, dictionary_bytes).alias("text")).orderBy("lang", "r").collect():
        out.setdefault(r.lang, []).append(bytes(r.text))
    return {lang: b"\n".join(texts) for lang, texts in sorted(out.items())}


def _classify(content: dict[str, bytes], id_names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, encoders = list(content), []
        for lang in langs:
            data = zstandard.ZstdCompressionDict(content[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=LEVEL)
            encoders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False))
        for batch in batches:
            pred, score, margin = [], [], []
            for item in batch.column("_text"):
                if not item.is_valid or not langs:
                    pred.append("und")
                    score.append(0.0)
                    margin.append(0.0)
                    continue
                text = memoryview(item.as_buffer())
                sizes = np.zeros(len(langs))
                for a in range(0, len(text), PIECE):
                    sizes += [len(e.compress(text[a : a + PIECE])) for e in encoders]
                order = np.argsort(sizes, kind="stable")
                best, second = sizes[order[0]], sizes[order[1]] if len(langs) > 1 else float(len(text) + 32)
                pred.append(langs[order[0]])
                margin.append(max(0.0, (second - best) / second))
                score.append(float(second / (second + best)) if len(langs) > 1 else 1.0)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in id_names], pa.array(pred, type=pa.string()), pa.array(score, type=pa.float64()), pa.array(margin, type=pa.float64())], names=[*id_names, "lang_pred", "score", "margin"])

    return run


def identify_language(docs: DataFrame, content: dict[str, bytes], keep: list[str], text_col: str = "text", least_margin: float = 0.02) -> DataFrame:
    """The columns `keep` of docs with lang_pred, score, margin, rejected.

    The prediction is the language whose dictionary gives the fewest bytes over the whole text, the first by name of equal
    ones. margin is the share of the runner-up's bytes that the best saves; score is the runner-up's share of both (0.5: a
    tie); rejected tells that the margin is below `least_margin`, for callers that then leave the language open. A text that
    is null or has no letter is `und` with score 0, and so is every text if no language was learned; repeated rows are
    judged one by one; an empty table gives no rows. content is bounded by the languages times the dictionary size.
    """
    frame = docs.select(*keep, F.when(F.col(text_col).rlike(r"\p{L}"), F.lower(text_col)).cast("binary").alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields[:-1]), "lang_pred string, score double, margin double"])
    return frame.mapInArrow(_classify(content, keep), schema).withColumn("rejected", (F.col("margin") < least_margin) | (F.col("lang_pred") == "und"))
