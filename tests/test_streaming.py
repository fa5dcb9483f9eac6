"""Streams over landing folders: windows, sessions, late rows, history with checks, dedup, scoring, progress, captures."""

import datetime
import struct

import pytest
from pyspark.sql import functions as F

from tidewire.operators import conformance, outliers
from tidewire.streaming import live

SCHEMA = "capture_id long, ts timestamp, size int, direction string, kind string"
T0 = datetime.datetime(2024, 1, 1)


def at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


class Landing:
    """A folder in which batches of rows land one after the other."""

    def __init__(self, spark, path):
        self.spark, self.path, self.n = spark, str(path), 0

    def put(self, rows):
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{self.path}/{self.n}")
        self.n += 1

    def stream(self):
        return live.read_landing(self.spark, f"{self.path}/*", self.spark.createDataFrame([], SCHEMA).schema, 1)


@pytest.fixture
def landing(spark, tmp_path):
    return Landing(spark, tmp_path / "in")


def run(frame, name, landing, batches, mode="append"):
    landing.put(batches[0])
    query = frame().writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        query.processAllAvailable()
        for rows in batches[1:]:
            landing.put(rows)
            query.processAllAvailable()
        return landing.spark.table(name).collect(), live.progress(query)
    finally:
        query.stop()


def row(capture, seconds, kind="a", size=100):
    return (capture, at(seconds), size, "up", kind)


def test_late_rows_go(spark, landing):
    got, _ = run(lambda: live.tumbling_features(landing.stream(), "1 second", "2 seconds"), "late", landing, [[row(1, 0.1), row(1, 0.2)], [row(1, 5.0)], [row(1, 0.3), row(1, 4.5)], [row(1, 20.0)], [row(1, 21.0)]])
    counts = {(r.window.start - T0).total_seconds(): r.pkt_count for r in got}
    assert counts[0.0] == 2 and counts[4.0] == 1 and counts[5.0] == 1  # the row at 0.3 came behind the watermark


def test_sliding_and_session_windows(spark, landing, tmp_path):
    batches = [[row(1, 0.0), row(1, 1.2)], [row(1, 60.0)], [row(1, 61.0)]]
    got, _ = run(lambda: live.sliding_counts(landing.stream(), "2 seconds", "1 second", "5 seconds"), "sliding", landing, batches)
    assert {(r.window.start - T0).total_seconds(): r.pkt_count for r in got} == {-1.0: 1, 0.0: 2, 1.0: 1}
    other = Landing(spark, tmp_path / "sessions")
    got, _ = run(lambda: live.session_counts(other.stream(), "600 milliseconds", "5 seconds"), "sessions", other, [[row(1, 0.0), row(1, 0.5), row(1, 3.0)], [row(1, 60.0)], [row(1, 61.0)]])
    assert sorted(r.pkt_count for r in got) == [1, 2]


def test_repeats_within_the_delay_go(spark, landing):
    got, _ = run(lambda: live.without_repeats(landing.stream(), 0.5), "repeats", landing, [[row(1, 0.2), row(1, 0.0), row(1, 0.1, "b"), row(2, 0.1), row(1, 0.6)], [row(1, 1.0), row(1, 30.0)], [row(1, 30.2), row(1, 30.5)]])
    assert sorted((r.capture_id, r.kind, (r.ts - T0).total_seconds()) for r in got) == [(1, "a", 0.0), (1, "a", 0.6), (1, "a", 30.0), (1, "a", 30.5), (1, "b", 0.1), (2, "a", 0.1)]


def test_history_is_ordered_and_checked_again(spark, landing):
    steps = spark.createDataFrame([("x", i, a) for i, a in enumerate(["stand", "walk", "sit", "walk", "stand"])], "seq_id string, pos int, action string")
    check = live.graph_check(conformance.adjacency(conformance.as_sequences(steps)))
    got, _ = run(lambda: live.action_history(landing.stream(), 3, check), "history2", landing, [[row(1, 2.0, "walk"), row(1, 1.0, "stand"), row(1, 1.5, "stand")], [row(1, 3.0, "sit"), row(1, 4.0, "walk")], [row(1, 5.0, "jump")]], "update")
    assert [(r.history, r.status) for r in got] == [(["stand", "walk"], "NORMAL"), (["walk", "sit", "walk"], "NORMAL"), (["sit", "walk", "jump"], "UNKNOWN")]
    assert check(["stand", "sit"]) == "ANOMALY"


def test_batches_are_scored_and_counted(spark, landing, tmp_path):
    rows = [row(1, i, size=100 + i % 7) for i in range(300)] + [row(1, 500, size=9000)]
    landing.put(rows)
    score = lambda df: outliers.isolation_forest(df.withColumn("id", F.monotonically_increasing_id()), "id", ["size"], 0.02, trees=20)
    query = live.score_batches(live.counted(landing.stream()), score, lambda df, i: df.write.mode("overwrite").parquet(f"{tmp_path}/out/{i}")).start()
    try:
        query.processAllAvailable()
        assert live.progress(query)["rows"] == 301 and live.progress(query)["error"] is None
    finally:
        query.stop()
    got = spark.read.parquet(f"{tmp_path}/out/0")
    assert got.count() == 301 and got.orderBy("score").first()["size"] == 9000


def test_progress_holds_what_was_observed(spark, landing):
    _, seen = run(lambda: live.counted(landing.stream()), "seen", landing, [[row(1, 0.0), row(2, 1.0)], [row(1, 2.0, size=7)]])
    assert seen["rows"] == 3 and seen["latest"].packets == 1 and seen["latest"].bytes == 7


def test_captures_land_and_are_read_once(spark, tmp_path):
    folder = tmp_path / "caps"
    folder.mkdir()
    record = lambda n: struct.pack("<IIII", n, 5, 4, 4) + b"abcd"
    (folder / "a.pcap").write_bytes(b"\xd4\xc3\xb2\xa1" + b"\0" * 20 + record(1) + record(2))
    query = live.read_captures(spark, str(folder)).select("idx", "ts_us", "status").writeStream.format("memory").queryName("frames").start()
    try:
        query.processAllAvailable()
        (folder / "b.pcap").write_bytes(b"\xd4\xc3\xb2\xa1" + b"\0" * 20 + record(3))
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted((r.idx, r.ts_us, r.status) for r in spark.table("frames").collect()) == [(1, 1_000_005, "ok"), (1, 3_000_005, "ok"), (2, 2_000_005, "ok")]


@pytest.fixture
def totals(spark):
    own = live.Totals()
    spark.streams.addListener(own)
    yield own
    spark.streams.removeListener(own)


def follow(landing, totals, frame, name, mode, batches):
    """The rows of a stream over batches, and after each what the listener has counted."""
    import time

    landing.put(batches[0])
    query = frame().writeStream.format("memory").queryName(name).outputMode(mode).start()
    seen = []
    try:
        for i, rows in enumerate(batches):
            if i:
                landing.put(rows)
            query.processAllAvailable()
            ended = time.time() + 20
            while totals.of(query)["rows"] < sum(map(len, batches[: i + 1])) and time.time() < ended:
                time.sleep(0.1)
            time.sleep(0.5)
            seen.append(dict(totals.of(query)))
        return landing.spark.table(name).collect(), seen
    finally:
        query.stop()


def test_state_of_ended_captures_goes_and_late_rows_are_counted(landing, totals):
    batches = [[row(1, 0.0), row(2, 0.0), row(3, 0.0)], [row(1, 100.0)], [row(1, 101.0)], [row(2, 1.0), row(1, 102.0)], [row(2, 103.0), row(1, 104.0)], [row(1, 105.0)]]
    got, seen = follow(landing, totals, lambda: live.action_history(landing.stream(), late="10 seconds", idle=30.0), "ended", "update", batches)
    assert seen[0]["state"] >= 3 and seen[2]["state"] < seen[0]["state"]  # captures 2 and 3 ended when the watermark passed 30 s
    assert seen[-1]["late"] == 1 and [s["rows"] for s in seen] == [3, 4, 5, 7, 9, 10]
    assert [r.history for r in got if r.capture_id == 2] == [["a"], ["a"]]  # the late row left no trace, the one at 103 began anew


def test_repeats_are_forgotten_when_a_pair_ends(landing, totals):
    batches = [[row(1, 0.0), row(1, 0.2), row(2, 0.0, "b")], [row(1, 60.0)], [row(1, 61.0)], [row(1, 61.2)]]
    got, seen = follow(landing, totals, lambda: live.without_repeats(landing.stream(), 0.5, "1 second", 5.0), "pairs", "append", batches)
    assert sorted((r.capture_id, (r.ts - T0).total_seconds()) for r in got) == [(1, 0.0), (1, 60.0), (1, 61.0), (2, 0.0)]
    assert seen[-1]["state"] < seen[0]["state"]


def test_late_rows_of_windows_are_counted(landing, totals):
    batches = [[row(1, 0.1)], [row(1, 60.0)], [row(1, 61.0)], [row(1, 1.0), row(2, 2.0), row(1, 62.0)], [row(1, 70.0)]]
    got, seen = follow(landing, totals, lambda: live.tumbling_features(landing.stream(), "1 second", "2 seconds"), "dropped", "append", batches)
    assert seen[-1]["late"] == 2 and seen[-1]["batches"] >= 5 and seen[-1]["rows"] == 7
