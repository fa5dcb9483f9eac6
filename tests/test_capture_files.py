"""Capture files in byte ranges: every frame once, whatever the size of the ranges, and streams of growing files."""

import random
import struct

import pytest

from tidewire.sources import capture, capture_files
from tidewire.sources.capture_files import read_captures, register


def pcap(order, nanos, rows, snap=65535, tail=b""):
    magic = {("<", 1000): 0xA1B2C3D4, ("<", 1): 0xA1B23C4D, (">", 1000): 0xA1B2C3D4, (">", 1): 0xA1B23C4D}[order, nanos]
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, snap, 1)
    for us, frame, length in rows:
        out += struct.pack(order + "IIII", us // 1_000_000, us % 1_000_000 * 1000 // nanos, len(frame), length) + frame
    return out + tail


def rows_of(rng, n, largest=400):
    out, t = [], 1_700_000_000_000_000
    for _ in range(n):
        t += rng.randrange(2_000_000)
        frame = rng.choice([bytes, lambda k: rng.randbytes(k)])(rng.randrange(1, largest))
        out.append((t, frame, len(frame) + rng.randrange(3)))
    return out


@pytest.fixture
def folder(tmp_path):
    rng = random.Random(9)
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.pcap").write_bytes(pcap("<", 1000, rows_of(rng, 300)))
    (tmp_path / "deep" / "b.pcap").write_bytes(pcap(">", 1, rows_of(rng, 200), tail=b"\x65\x53\xf1\x00\x00"))
    (tmp_path / "c.pcap").write_bytes(pcap("<", 1, rows_of(rng, 50), tail=struct.pack("<IIII", 1_700_000_500, 5, 300, 300) + b"x" * 99))
    (tmp_path / "bad.pcap").write_bytes(b"not a capture, but long enough for a header")
    (tmp_path / "empty.pcap").write_bytes(b"")
    (tmp_path / "none.pcap").write_bytes(pcap("<", 1000, []))
    (tmp_path / "other.txt").write_bytes(b"no")
    return tmp_path


def told(rows):
    return sorted((r.capture_id.rpartition("/")[2], r.idx, r.ts_us, r.orig_len, bytes(r.frame or b""), r.status) for r in rows)


@pytest.mark.parametrize("split", [400, 20_000, 1 << 30])
def test_ranges_give_the_frames_of_whole_files(spark, folder, split):
    # Spark's reader of whole files leaves out the empty one.
    want = sorted([*told(capture.read_captures(spark, str(folder)).collect()), ("empty.pcap", 0, 0, 0, b"", "bad")])
    got = read_captures(spark, str(folder), split)
    assert told(got.collect()) == want and len(want) > 550
    if split == 20_000:
        narrow = read_captures(spark, f"file:{folder}", split, ("ts_us",))
        assert narrow.columns == ["capture_id", "idx", "ts_us"] and sorted((r.idx, r.ts_us) for r in narrow.collect()) == sorted((w[1], w[2]) for w in want)


def test_payloads_that_look_like_records_do_not_mislead(spark, tmp_path):
    """A payload that holds a whole capture: ranges that begin in it find a chain, which the check tells from the file's own."""
    rng = random.Random(1)
    inner = b"".join(struct.pack("<IIII", 1_700_000_100, 7, 10, 10) + b"y" * 10 for _ in range(2000))
    rows = [*rows_of(rng, 20), (1_700_000_050_000_000, inner, len(inner)), *rows_of(rng, 20)]
    (tmp_path / "a.pcap").write_bytes(pcap("<", 1000, rows))
    for split in (5000, 50_000):
        assert told(read_captures(spark, str(tmp_path), split).collect()) == told(capture.read_captures(spark, str(tmp_path)).collect())


def test_many_tasks_read_one_file(spark, tmp_path):
    rng = random.Random(6)
    (tmp_path / "a.pcap").write_bytes(pcap("<", 1000, rows_of(rng, 30_000, 1400)))
    register(spark)
    own = spark.read.format("capture").option("splitBytes", 1 << 20).load(str(tmp_path))
    parts = own.groupBy("part").count().collect()
    assert len(parts) >= 16 and sum(r["count"] for r in parts) == 30_000 and max(r["count"] for r in parts) < 3000
    assert own.rdd.getNumPartitions() == len(parts)


def test_a_stream_follows_a_growing_file(spark, tmp_path):
    rng = random.Random(3)
    rows = rows_of(rng, 60)
    whole = pcap("<", 1000, rows)
    (tmp_path / "in").mkdir()
    target = tmp_path / "in" / "a.pcap"
    target.write_bytes(whole[:10])
    register(spark)
    query = spark.readStream.format("capture").option("splitBytes", 500).load(str(tmp_path / "in")).writeStream.format("memory").queryName("growing").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        for edge in (1500, 1501, 4000, len(whole) - 3, len(whole)):
            target.write_bytes(whole[:edge])
            query.processAllAvailable()
        (tmp_path / "in" / "b.pcap").write_bytes(pcap(">", 1000, rows[:5]))
        query.processAllAvailable()
    finally:
        query.stop()
    got = spark.table("growing").collect()
    assert sorted((r.capture_id[-6:], r.ts_us, bytes(r.frame)) for r in got) == sorted([("a.pcap", t, f) for t, f, _ in rows] + [("b.pcap", t, f) for t, f, _ in rows[:5]])


def test_written_captures_are_read_again(spark, tmp_path):
    rng = random.Random(2)
    frames = [(c, i, t, n, f) for c in ("x", "y") for i, (t, f, n) in enumerate(rows_of(rng, 40))]
    done = capture_files.write_captures(spark.createDataFrame(frames, "capture_id string, idx long, ts_us long, orig_len long, frame binary"), str(tmp_path)).collect()
    assert sorted(map(tuple, done)) == [("x", 40), ("y", 40)]
    got = read_captures(spark, str(tmp_path), 700).collect()
    assert sorted((r.capture_id[-6:-5], r.idx - 1, r.ts_us, r.orig_len, bytes(r.frame)) for r in got) == sorted(frames)
