"""Windows and running sums over large groups against plain windows, and ranks of whole tables against sorted lists."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewire.operators import corpora, metrics, windows
from tidewire.operators.scans import Ordered, ranked

SCHEMA = "capture_id long, idx long, ts_us long, src string, dst string, size int, direction string, kind string"


@pytest.fixture(scope="module")
def packets(spark):
    rng = random.Random(1)
    rows, t = [], 0
    for i in range(900):
        t += rng.choice([0, 1_000, 9_000, 11_000, 700_000])
        capture = rng.choice([None, 1, 1, 1, 1, 1, 2, 3])
        a, b = rng.choice([("a", "b"), ("b", "a"), ("a", "b"), ("c", "d")])
        rows.append((capture, i, t, a, b, rng.randrange(40, 1500), rng.choice(["up", "down"]), rng.choice("xxy")))
    return spark.createDataFrame(rows, SCHEMA).repartition(5).persist()


def told(df):
    return sorted(str(sorted((k, round(v, 9) if isinstance(v, float) else v) for k, v in r.asDict().items())) for r in df.collect())


@pytest.mark.parametrize("most", [25])
@pytest.mark.parametrize("run", [
    lambda p, most: windows.trailing_flow_features(p, most=most), lambda p, most: windows.trailing_flow_features(p, 5, most=most), lambda p, most: windows.whole_flow_features(p, most=most), lambda p, most: windows.sessions(p, ["capture_id", "src"], "ts_us", "idx", 600_000, most),
    lambda p, most: windows.runs(p, ["capture_id"], "idx", "kind", most), lambda p, most: windows.intervals(p, ["capture_id", "src"], ["idx"], most), lambda p, most: windows.count_windows(p, ["src"], "idx", 32, 8, most), lambda p, most: corpora.stratified_split(p, "idx", "kind", {"a": 0.64, "b": 0.16, "c": 0.2}, 3, most),
], ids=["trailing", "trailing5", "flow", "sessions", "runs", "intervals", "count", "split"])
def test_large_groups_give_the_rows_of_plain_windows(packets, run, most):
    assert told(run(packets, most)) == told(run(packets, 1 << 60))


def test_copies_reach_over_ranges_of_few_rows(spark):
    rows = spark.range(40).select(F.lit("k").alias("k"), F.col("id").alias("o"))
    own = Ordered(rows, ["k"], ["o"], 2)
    assert own.ranged.select("_scan_range").distinct().count() > 10
    got = own.reach(lambda df, w: df.withColumn("s", F.sum("o").over(w.rowsBetween(-9, 0))).withColumn("back", F.lag("o", 9).over(w)), 9).running("all", F.col("o")).table().orderBy("o").collect()
    assert [(r.s, r.back, r["all"]) for r in got] == [(sum(range(max(0, i - 9), i + 1)), i - 9 if i >= 9 else None, sum(range(i + 1))) for i in range(40)]


def test_a_hot_flow_spreads_over_tasks(spark):
    n = 400_000
    p = spark.range(n).select(F.lit(1).cast("long").alias("capture_id"), F.col("id").alias("idx"), (F.col("id") * 7919 % 1000 + F.col("id") * 1000).alias("ts_us"), F.lit("a").alias("src"), F.lit("b").alias("dst"), (F.col("id") % 1400).cast("int").alias("size"), F.lit("up").alias("direction"))
    own = Ordered(p, ["capture_id"], ["ts_us", "idx"], 20_000)
    sizes = [r["count"] for r in own.ranged.groupBy("_scan_range").count().collect()]
    assert len(sizes) >= 20 and max(sizes) < n / 10
    wide = Window.partitionBy("capture_id").orderBy("ts_us", "idx")
    want = p.withColumn("gap", F.col("ts_us") - F.lag("ts_us").over(wide)).agg(F.sum(F.hash("idx", "gap").cast("long"))).first()[0]
    got = own.reach(lambda rows, w: rows.withColumn("gap", F.col("ts_us") - F.lag("ts_us").over(w)), 1).table().agg(F.sum(F.hash("idx", "gap").cast("long"))).first()[0]
    assert got == want


def test_ranks_of_a_whole_table(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, 5, 5, 5, 10**15, 7]), f"t{i}", rng.randrange(9)) for i in range(800)]
    frame = spark.createDataFrame(rows, "v long, k string, w int").repartition(6)
    got = {r.k: (r.position, r.s) for r in ranked(frame, [-F.col("v"), F.col("k")], {"position": F.lit(1).cast("long"), "s": F.col("w")}).collect()}
    seen, order = 0, sorted(rows, key=lambda r: (r[0] is not None, -(r[0] or 0), r[1]))
    for i, (_, k, w) in enumerate(order):
        assert got[k] == (i, seen)
        seen += w
    assert ranked(frame.limit(0), [F.col("k")]).count() == 0


def test_clustered_ids_spread_over_ranges(spark):
    rows = spark.range(50_000).select(F.when(F.col("id") == 0, 1 << 60).otherwise(F.col("id")).alias("id"))
    got = corpora.global_positions(rows, "id").orderBy("id").select("position").collect()
    assert [r.position for r in got] == list(range(50_000))


def test_area_and_threshold_by_ranks(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(2), rng.randrange(12) / 4) for _ in range(400)]
    df = spark.createDataFrame(rows, "truth int, score double").repartition(5)
    pos, neg = [s for t, s in rows if t], [s for t, s in rows if not t]
    assert metrics.auc(df).first().auc == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg))
    best = max((2 * tp / (n + len(pos)), cut) for cut in {s for _, s in rows} for tp, n in [(sum(s >= cut for s in pos), sum(s >= cut for _, s in rows))])
    got = metrics.best_threshold(df).first()
    assert (got.f1, got.threshold) == (pytest.approx(best[0]), best[1])
