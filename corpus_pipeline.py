"""The corpus pipeline: quality, repeated lines, near duplicates, benchmark passages, mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, and n_chars
follows the text. run() applies them to documents, each over the written result of the one before. Columns of docs may have any
names: a stage sees them under names of their own, so none can clash with those of an operator. Stages that run Python bound the
session's Arrow batches by bytes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.common import bounded_batches, discard, shared_folder, shielded, table
from tidewire.llm.decontaminate import decontaminate
from tidewire.llm.line_dedup import line_dedup
from tidewire.llm.mixing import mix_sources
from tidewire.llm.near_dedup import near_duplicates
from tidewire.llm.quality import score_quality
from tidewire.llm.queries import quality_weights


def _rewritten(frame: DataFrame, new: dict[str, str], changed) -> DataFrame:
    """The columns under their old names, n_chars anew where the text changed; documents of which nothing is left go."""
    text, n = F.col(new["text"]), new["n_chars"]
    kept = frame.where(~changed | (F.length(F.trim(text)) > 0))
    kept = kept.withColumn(n, F.when(changed, F.length(text).cast(frame.schema[n].dataType)).otherwise(F.col(n)))
    return kept.select(*new.values()).toDF(*new)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    bounded_batches(spark)
    own, new = shielded(docs)
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", new["doc_id"])
    scored = score_quality(own, labels, id_col=new["doc_id"], text_col=new["text"], source_col=new["source"], lang_col=new["lang"])
    return scored.where("_q_score >= 0.5").select(*new.values()).toDF(*new)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later occurrences of repeated three-line passages."""
    own, new = shielded(docs)
    return _rewritten(line_dedup(own, id_col=new["doc_id"], text_col=new["text"]), new, F.col("_n_removed") > 0)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: that of the least id; of rows with its id and text, the least by the other columns as JSON."""
    bounded_batches(spark)
    own, new = shielded(docs)
    stays = near_duplicates(docs).where("stays").select(F.col("_id").alias("own"), F.concat("_digest", F.lit(b"")).alias("digest"))
    digest = F.unhex(F.md5(F.coalesce(F.col(new["text"]), F.lit("")).cast("binary")))
    marked = own.withColumn("digest", digest).join(stays, "digest").where(F.col(new["doc_id"]).eqNullSafe(F.col("own")))
    rest = [F.col(c) for c in new.values() if c not in (new["doc_id"], new["text"])]
    one = marked.groupBy("digest", new["doc_id"]).agg(F.min_by(F.struct(*new.values()), F.to_json(F.struct(*rest))).alias("row"))
    return one.select("row.*").toDF(*new)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of benchmark windows; those that hold nothing else go."""
    bounded_batches(spark)
    own, new = shielded(docs)
    found = decontaminate(own, table(spark, sf_dir, "benchmark"), text_col=new["text"], cut_text=True)
    return _rewritten(found.where("_n_hit = 0 OR _n_hit < _n_words"), new, F.col("_n_hit") > 0)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with size, source_size, target and taken (words, repeats counted), then their other columns."""
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "size", "source_size", "target", "taken"))
    return mix_sources(docs, quality_weights(spark, sf_dir), keep=rest).where("taken > 0")


STAGES = [("quality", quality_stage), ("lines", line_stage), ("near duplicates", near_stage), ("benchmark", benchmark_stage), ("mix", mix_stage)]

#: The classifier and the sampled similarity can't be stated in SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents of sf_dir after the stages before it; each stage's table goes when the next one is written."""
    docs, folder, before = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for i, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            discard(spark, before)
        before = path
    return docs
