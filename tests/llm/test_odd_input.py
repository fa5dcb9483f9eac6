"""Every operator and stage over nulls, empty tables, empty and very long texts, repeated rows and columns with clashing names."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewire.llm.decontaminate import decontaminate
from tidewire.llm.html_extract import extract_text
from tidewire.llm.language_id import dictionaries, identify_language
from tidewire.llm.license_scan import license_scan
from tidewire.llm.line_dedup import line_dedup
from tidewire.llm.mixing import mix_sources
from tidewire.llm.near_dedup import near_duplicates
from tidewire.llm.quality import score_quality
from tidewire.llm.suffix_dedup import suffix_dedup
from tidewire.llm.topk_search import top_k

#: Names that the operators use inside, or that users are likely to have.
CLASHES = "_id _text _digest _own _row _items _spans _n_hit _gone _starts _key _hash _source _lang _label _q_id _q_score _q_facts _range _before _weight node samples bucket component digest data places anchor starts lines hash id key first last size target html url page label quality".split()
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
GOOD = "a calm line of words\nthat goes on for a while\nand then comes to its end\nas lines do"
ROWS = [(1, GOOD, "en", "s", 80), (1, GOOD, "en", "s", 80), (1, GOOD, "en", "t", 80), (None, None, None, None, None), (None, GOOD, None, None, 80), (3, "", "en", "s", 0), (4, "\n\n \n", "fr", "s", 4), (5, "é" * 300, "fr", None, 300), (6, "BUY!! 99 $$ " * 9, "en", "t", 108)]


def labels(spark):
    return spark.createDataFrame([(1, 1), (4, 1), (6, 0), (None, 1), (5, None)], "doc_id long, quality int")


def items(spark):
    return spark.createDataFrame([(1, "then comes to"), (2, None), (None, "calm line"), (3, "")], "item_id long, text string")


OPERATORS = {
    "op1": lambda spark, docs: suffix_dedup(docs), "op2": lambda spark, docs: decontaminate(docs, items(spark)), "op3": lambda spark, docs: license_scan(docs), "op4": lambda spark, docs: extract_text(docs, "doc_id", "source", "text"), "op6": lambda spark, docs: line_dedup(docs),
    "op7": lambda spark, docs: mix_sources(docs, labels(spark).select("doc_id", F.lit(2.0).alias("w")).where("doc_id = 1")), "op8": lambda spark, docs: near_duplicates(docs), "op9": lambda spark, docs: score_quality(docs, labels(spark)), "op10": lambda spark, docs: identify_language(docs, dictionaries(docs), ["doc_id"]),
}


def clashing(docs):
    return docs.select("*", *[F.concat(F.lit(f"mine {c} "), F.col("doc_id").cast("string")).alias(c) for c in CLASHES])


def plain(rows):
    return sorted(str(sorted((k, v) for k, v in r.asDict().items() if k not in CLASHES)) for r in rows)


@pytest.mark.parametrize("name", list(OPERATORS))
def test_operators_bear_odd_rows_and_clashing_names(spark, name):
    run, docs = OPERATORS[name], spark.createDataFrame(ROWS, COLUMNS)
    got, again = run(spark, docs).collect(), run(spark, clashing(docs)).collect()
    results = [c for c in (got[0].asDict() if got else ()) if c in CLASHES]
    assert len(again) == len(got) and plain(got) == plain(again)
    assert sum(r["copies"] for r in got) == len(ROWS) if name == "op8" else len(got) == len(ROWS)
    if name in ("op2", "op6", "op9"):  # they keep all columns, but for those that are results
        assert all(r[c] == (None if r.doc_id is None else f"mine {c} {r.doc_id}") for r in again for c in CLASHES if c not in results)
    for empty in (docs.limit(0), clashing(docs).limit(0)):
        assert run(spark, empty).count() == 0


def test_search_bears_odd_rows_and_clashing_names(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (50, [0.5, 0.5]), (50, [0.5, 0.5]), (7, [1.0]), (None, [1.0]), (8, None), (9, [None]), (10, [])], "vec_id long, embedding array<double>")
    more = rows.select("*", *[F.lit("mine").alias(c) for c in ("id", "v", "key", "shard", "block", "score", "rank", "low")])
    got, again = (sorted(map(str, top_k(d, d.where("vec_id % 50 = 0")).collect())) for d in (rows, more))
    assert got == again and len(got) == 8
    assert top_k(rows, rows.limit(0)).count() == 0 and top_k(rows.limit(0), rows).count() == 0


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_bear_odd_rows_and_clashing_names(spark, sf_dir, name, stage):
    docs = spark.createDataFrame(ROWS, COLUMNS)
    got, again = stage(spark, docs, sf_dir).collect(), stage(spark, clashing(docs), sf_dir).collect()
    assert name == "mix" or plain(got) == plain(again)
    assert len(got) == len(again) <= len(ROWS)
    if name != "mix":
        assert stage(spark, clashing(docs), sf_dir).columns == clashing(docs).columns
        assert all(r[c] == (None if r.doc_id is None else f"mine {c} {r.doc_id}") for r in again for c in CLASHES)
    assert stage(spark, clashing(docs).limit(0), sf_dir).count() == 0


@pytest.fixture(scope="module")
def long_texts(spark):
    random.seed(1)
    words = ["".join(random.choice("abcdefghijklmnop") for _ in range(random.randrange(2, 9))) for _ in range(50_000)]
    line = lambda: " ".join(random.choices(words, k=12))
    text = "\n".join(line() for _ in range(330_000))
    tail = "\n".join(line() for _ in range(40))
    return spark.createDataFrame([(1, text + "\n" + tail, "en", "s", 1), (2, tail, "en", "s", 1), (3, "= " * 200_000, "en", "t", 1), (4, "x" * 300_000, "en", "t", 1)], COLUMNS).repartition(2)


@pytest.mark.parametrize("name", list(OPERATORS))
def test_operators_bear_very_long_texts(spark, long_texts, name):
    got = OPERATORS[name](spark, long_texts).drop("text").collect()
    assert len(got) == 4
    by = {r[0] if name != "op8" else r["_id"]: r for r in got}
    if name == "op1":
        tail = by[2].n_bytes
        assert by[2].n_removed == tail and by[1].n_removed == tail and by[1].n_bytes > 20_000_000 and by[4].n_removed == 300_000
    if name == "op6":
        assert by[2]._n_removed == 40 and by[1]._n_removed == 0 and by[1]._n_lines == 330_040
