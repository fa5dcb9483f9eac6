"""Cases of the fourth round's findings: queries against their SQL where rare values decide, and symbol texts in blocks."""

import datetime
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.operators import conformance, edits, metrics, motion, signals
from tidewire.plans import model_queries, sequence_queries, source_queries  # noqa: F401
from tidewire.plans.registry import QUERIES, SQL


def events(folder, rows):
    """An events table of (user, type) rows, a minute apart."""
    first = datetime.datetime(2024, 1, 1)
    own = duckdb.connect()
    own.execute("CREATE TABLE e (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    own.executemany("INSERT INTO e VALUES (?, ?, ?, ?, ?, ?)", [(i, first + datetime.timedelta(minutes=i), u, t, float(i), f'{{"k": {i % 100}}}') for i, (u, t) in enumerate(rows)])
    own.execute(f"COPY e TO '{folder}/events.parquet' (FORMAT parquet)")
    own.execute("ALTER TABLE e RENAME TO events")
    return own


def test_a_source_port_of_a_service_is_no_protocol(spark, tmp_path):
    """User 859 sends from port 1883, user 7056 from 8080."""
    con = events(tmp_path, [(u, "view") for u in (859, 7056, 3) for _ in range(8)])
    want = con.execute(SQL["f11_protocol"]).fetchall()
    assert sorted(map(tuple, QUERIES["f11_protocol"](spark, str(tmp_path)).collect())) == sorted(want)


def test_probabilities_round_like_sql(spark):
    """Halves of the fourth digit, which doubles hold a hair below or above: 0.16115 and the like."""
    halves = [(i, (2 * i + 1) / 20_000) for i in range(10_000)]
    con = duckdb.connect()
    con.execute("CREATE TABLE h AS SELECT range AS i, (2 * range + 1) / 20000 AS v FROM range(10000)")
    want = dict(con.execute("SELECT i, round(v, 4) FROM h").fetchall())
    rows = spark.createDataFrame(halves, "i long, v double")
    assert {r.i: r.r for r in rows.select("i", metrics.sql_round(F.col("v"), 4).alias("r")).collect()} == want
    histories = spark.createDataFrame([("x", ["a"])], "id string, history array<string>")
    contexts = spark.createDataFrame([("a", "b", 0.83885, 100), ("a", "c", 0.16115, 100)], "context string, dst string, p double, support long")
    got = {r.action: r.probability for r in conformance.predict_next(histories, contexts).collect()}
    assert got["c"] == 0.1611 == con.execute("SELECT round(0.16115::DOUBLE, 4)").fetchone()[0] and got["b"] == con.execute("SELECT round(0.83885::DOUBLE, 4)").fetchone()[0]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


@pytest.mark.parametrize(("letters", "size", "n"), [("ab", 5, 20), ("abcde", 70, 20), ("abc", 128, 8), ("a\U0001f600é", 130, 8), ("ab", 300, 2)])
def test_distances_by_bit_vectors(letters, size, n):
    rng = random.Random(size)
    left, right = (["".join(rng.choice(letters) for _ in range(rng.randrange(size + 1))) for _ in range(m)] + ["a" * size, "", "zz"] for m in (n, n + 5))
    want = np.array([[distance(a, b) for b in right] for a in left])
    assert (edits.distances(left, right) == want).all()
    assert all(edits._single(a, b) == want[i, j] for i, a in enumerate(left) for j, b in enumerate(right))


def symbol_texts(seed=5):
    """Samples of three labels with copies within and across labels, an empty text and a label of one sample."""
    rng = random.Random(seed)
    kinds = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(14)]
    return [(f"s{i}", rng.choice("xy"), rng.choice(kinds)) for i in range(60)] + [("e", "x", ""), ("one", "z", kinds[0])]


def similar(a, b):
    return 1 - distance(a, b) / max(len(a), len(b), 1)


@pytest.mark.parametrize("small", [True, False])
def test_symbol_texts_in_blocks_give_what_all_pairs_give(spark, monkeypatch, small):
    if small:  # many blocks of a few rows
        monkeypatch.setattr(edits, "LEAST", 1)
        monkeypatch.setattr(edits, "TEXTS", 3)
        monkeypatch.setattr(signals, "PAIRED", 4)
    rows = symbol_texts()
    df = spark.createDataFrame(rows, "sample string, label string, text string")
    pairs = [(a, b, similar(a[2], b[2])) for i, a in enumerate(rows) for b in rows[i + 1 :]]
    within, between = ([s for a, b, s in pairs if (a[1] == b[1]) == own] for own in (True, False))
    got = signals.separability(df).first()
    assert got.within == pytest.approx(sum(within) / len(within)) and got.between == pytest.approx(sum(between) / len(between))
    for least in (None, 0.5):
        want = sorted((*sorted((a[0], b[0])), round(s, 9)) for a, b, s in pairs if a[1] == b[1] and s >= (least or 0))
        assert sorted((r.sample_a, r.sample_b, round(r.similarity, 9)) for r in signals.text_pairs(df, True, least).collect()) == want
    best = {a[0]: min((-similar(a[2], b[2]), b[1]) for b in rows if b is not a)[1] for a in rows}
    assert {r.sample: r.best for r in signals.leave_one_out(df).collect()} == best
    for label in "xyz":
        own = [r for r in rows if r[1] == label]
        mean = {a[0]: sum(similar(a[2], b[2]) for b in own) / len(own) for a in own}
        medoid = min(own, key=lambda a: (-round(mean[a[0]], 9), a[0]))
        r = signals.medoid_templates(df).where(F.col("label") == label).first()
        assert (r.sample, r.text, r.support) == (medoid[0], medoid[2], sum(similar(medoid[2], b[2]) >= 0.7 for b in own)) and r.mean_similarity == pytest.approx(mean[medoid[0]])
        other = {a[0]: sum(similar(a[2], b[2]) for b in own if b is not a) / (len(own) - 1) if len(own) > 1 else 1.0 for a in own}
        support = {a[0]: sum(similar(a[2], b[2]) >= 0.6 for b in own) for a in own}
        left, taken = list(own), []
        while left and len(taken) < 3:
            now = min(left, key=lambda a: (-round(other[a[0]], 9), -support[a[0]], a[0]))
            taken.append((now[0], support[now[0]]))
            left = [a for a in left if support[a[0]] >= 2 and a is not now and similar(a[2], now[2]) < 0.6]
        assert [(r.sample, r.support) for r in signals.diverse_templates(df, 3, 2, 0.6).where(F.col("label") == label).orderBy("rank").collect()] == taken


def test_no_pair_of_texts_is_a_row(spark):
    """3,000 texts of one label have 4.5 million pairs; the plan's joins make a row for each text and block, or fewer."""
    rng = random.Random(2)
    rows = [(str(i), "x", "".join(rng.choice("abcde") for _ in range(60))) for i in range(3000)]
    df = spark.createDataFrame(rows, "sample string, label string, text string")
    for made in (signals.separability(df), signals.medoid_templates(df), signals.leave_one_out(df)):
        assert "levenshtein" not in made._jdf.queryExecution().executedPlan().toString()
        assert made.count() in (1, 3000)


def test_long_captures_are_segmented_on_all_cores(spark):
    """A few texts from one partition: each is much work, so they are dealt out."""
    texts = spark.createDataFrame([(str(i), "AB" * 20) for i in range(40)], "capture_id string, text string").coalesce(1)
    templates = spark.createDataFrame([("x", 1, "ABAB", 4.0), ("y", 1, "BBBB", 4.0)], "label string, rank int, text string, mean_length double")
    found = motion.segment_texts(texts, templates)
    used = found.withColumn("p", F.spark_partition_id()).groupBy("capture_id").agg(F.min("p").alias("p")).select("p").distinct().count()
    assert used >= 8 and found.groupBy("capture_id").count().count() == 40


def test_models_read_the_texts_once(spark, sf_dir):
    """The feature table that scalers and models pass over many times has no scan of documents in its plan."""
    own, names = model_queries.text_table(spark, sf_dir)
    assert "documents" not in own._jdf.queryExecution().executedPlan().toString() and own.count() > 0 and set(names) < set(own.columns)
