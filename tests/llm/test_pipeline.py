"""The pipeline's stages on odd rows, and the corpus queries against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewire.llm import decontaminate, near_dedup, quality, queries

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size int, _text string"


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in con.description]
    want = sorted(str([f"{v:.9g}" if isinstance(v, float) else v for v in r]) for r in con.fetchall())
    got = sorted(str([f"{v:.9g}" if isinstance(v, float) else v for v in r]) for r in queries.QUERIES[name](spark, sf_dir).select(*names).collect())
    assert got == want


def test_stages_keep_columns_and_bear_odd_rows(spark, sf_dir):
    rows = [(1, "a good line\nand more\nof it\nhere", "en", "s", 30, 1, "x"), (1, "a good line\nand more\nof it\nhere", "en", "s", 30, 1, "x"), (None, None, None, None, None, None, None), (3, "", "en", "s", 0, 2, None), (4, "é" * 5000, "fr", None, 5000, 3, "y")]
    docs = spark.createDataFrame(rows, COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        own = docs.drop("_text") if name == "lines" else docs
        for df in (own, own.limit(0)):
            out = stage(spark, df, sf_dir)
            assert name == "mix" or out.columns == df.columns
            assert out.count() <= df.count()


def test_near_stage_keeps_one_of_each_class(spark, sf_dir):
    text = " ".join(f"w{i}" for i in range(200))
    docs = spark.createDataFrame([(i, text + (f" x{i}" if i else ""), "en", "s", 1) for i in range(6)] + [(2, text, "en", "s", 1), (2, text, "en", "s", 1), (9, "other words here", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_stage(spark, docs, sf_dir).collect()) == [0, 9]


def test_benchmark_stage_cuts_passages(spark, sf_dir):
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    docs = spark.createDataFrame([(1, f"before it {item} after it", "en", "s", 1), (2, "clean text", "en", "s", 10), (3, item, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in corpus_pipeline.benchmark_stage(spark, docs, sf_dir).collect()}
    assert set(got) == {1, 2} and got[2].text == "clean text" and got[1].text.startswith("before it") and got[1].n_chars == len(got[1].text) < 40


def test_run_returns_the_mix(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.where("taken <= 0").count() == 0 and out.agg(F.countDistinct("doc_id")).first()[0] > 100


def test_stages_bound_the_batches_of_long_texts(spark, sf_dir, monkeypatch):
    def checked(make):
        def made(*args):
            run = make(*args)

            def each(batches):
                for batch in batches:
                    assert batch.nbytes < 3 << 20 or batch.num_rows == 1, f"a batch of {batch.nbytes} bytes"
                    yield batch

            return lambda batches: run(each(batches))

        return made

    for module, name in ((quality, "_counted"), (near_dedup, "_count_features"), (near_dedup, "_sign"), (decontaminate, "_scan")):
        monkeypatch.setattr(module, name, checked(getattr(module, name)))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    least = docs.agg(F.min("doc_id")).first()[0]
    long = docs.withColumn("text", F.expr(f"repeat(text, if(doc_id = {least}, 2000, 20))")).coalesce(1)
    for stage in (corpus_pipeline.quality_stage, corpus_pipeline.near_stage, corpus_pipeline.benchmark_stage):
        stage(spark, long, sf_dir).write.format("noop").mode("overwrite").save()
