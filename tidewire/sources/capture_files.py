"""Capture files as a Spark data source: byte ranges of a file read by many tasks, and files that grow as a stream.

`spark.read.format("capture").load(path)` and `spark.readStream.format("capture").load(path)` after `register(spark)`. A range owns the
records that end in it. It finds where records begin anew: a place before it from which a chain of plausible record headers leads
on. A schema with fewer columns is read without the rest: without `frame` only headers are touched.

Options: splitBytes (64 MB), suffix (.pcap), mode: frames, or ranges for one row a range with what its chain began and ended with.
Files are opened by Arrow's file systems: local paths, and the schemes that it has (hdfs, s3, gs, abfs). Files in a store that only
Spark reads go through `capture.read_captures`, a task a file.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from .capture import MAGICS

HEADER, RECORD = 24, 16
SPLIT = 64 << 20
#: Bytes that a record can hold where the file doesn't say, and bytes fetched at a time.
LARGEST, FETCH = 262_144, 4 << 20
#: Plausible headers in a row that make a chain, and seconds that they may lie from the file's first record: 20 years.
CHAIN, SPREAD = 6, 20 * 31_557_600

#: capture_id, part: the file and the number of the range; n: the record's number in it from 0; at: its place in the file.
FRAMES = "capture_id string, part int, n long, at long, ts_us long, orig_len long, frame binary, status string"
RANGES = "capture_id string, part int, first long, last long, frames long"
_KINDS = {"capture_id": pa.string(), "part": pa.int32(), "n": pa.int64(), "at": pa.int64(), "ts_us": pa.int64(), "orig_len": pa.int64(), "frame": pa.binary(), "status": pa.string(), "first": pa.int64(), "last": pa.int64(), "frames": pa.int64()}


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if re.match(r"file:/+", path):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listed(path: str, suffix: str) -> list[tuple[str, int]]:
    """Files below a path and their sizes, by name."""
    store, inner = opened(path)
    info = store.get_file_info(inner)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(inner, recursive=True)) if info.type == fs.FileType.Directory else []
    head = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    return sorted((head + f.path, f.size) for f in found if f.type == fs.FileType.File and (f.path.endswith(suffix) or f is info))


class Chunk(InputPartition):
    """Bytes (low, high] of a file; last: nothing more will follow, so a record that the file's end cuts off is told."""

    def __init__(self, path: str, part: int, low: int, high: int, last: bool):
        self.path, self.part, self.low, self.high, self.last = path, part, low, high, last


def chunks(path: str, low: int, high: int, split: int, last: bool, part: int = 0) -> list[Chunk]:
    edges = [*range(low, high, split), high]
    return [Chunk(path, part + i, a, b, last and b == high) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]


class _Bytes:
    """A file read by places, FETCH bytes or more at a time."""

    def __init__(self, path: str):
        store, inner = opened(path)
        self.file = store.open_input_file(inner)
        self.size = self.file.size()
        self.base, self.held = 0, b""

    def at(self, place: int, n: int) -> memoryview:
        """Up to n bytes from a place."""
        if place < self.base or place + n > self.base + len(self.held):
            self.base, self.held = place, self.file.read_at(max(n, min(FETCH, self.size - place)), place) if place < self.size else b""
        return memoryview(self.held)[place - self.base : place - self.base + n]


class _Format:
    """Byte order, fractions and limits of a file, from its header and first record."""

    def __init__(self, data: _Bytes):
        head = bytes(data.at(0, HEADER))
        self.good = len(head) == HEADER and head[:4] in MAGICS
        if not self.good:
            return
        self.order, self.nanos = MAGICS[head[:4]]
        self.record = struct.Struct(self.order + "IIII")
        (snap,) = struct.unpack_from(self.order + "I", head, 16)
        self.most = snap if 0 < snap <= 1 << 27 else LARGEST
        first = bytes(data.at(HEADER, RECORD))
        self.since = self.record.unpack(first)[0] if len(first) == RECORD else 0

    def plausible(self, raw: np.ndarray) -> np.ndarray:
        """For each place of some bytes: whether a record header may stand there."""
        n = len(raw) - RECORD + 1
        if n <= 0:
            return np.zeros(0, dtype=bool)
        order = (3, 2, 1, 0) if self.order == ">" else (0, 1, 2, 3)
        number = lambda at: sum(raw[at + i : at + i + n].astype(np.int64) << (8 * shift) for i, shift in enumerate(order))
        kept, length = number(8), number(12)
        out = (kept > 0) & (kept <= self.most) & (kept <= length) & (length <= 1 << 27)
        return out & (number(4) < 1_000_000_000 // self.nanos) & (np.abs(number(0) - self.since) <= SPREAD)

    def begin(self, data: _Bytes, low: int) -> int | None:
        """Where a record begins that ends after `low`, or an earlier one of its chain; None if there is no chain."""
        if low <= HEADER:
            return HEADER
        start = max(HEADER, low - self.most - RECORD)
        window = np.frombuffer(bytes(data.at(start, 2 * (low - start) + FETCH // 4)), dtype=np.uint8)
        good = self.plausible(window)
        for first in np.flatnonzero(good[: low - start + RECORD]).tolist():
            at, links = first, 0
            while at < len(good) and good[at] and links < CHAIN:
                at, links = at + RECORD + int.from_bytes(window[at + 8 : at + 12].tobytes(), "big" if self.order == ">" else "little"), links + 1
            if links == CHAIN or (links and start + at == data.size) or (links > 1 and at >= len(good)):
                return start + first
        return None


def records(chunk: Chunk, bodies: bool) -> Iterator[tuple[int, int, int, memoryview | None, str]]:
    """(place, microseconds, original length, bytes, status) of the records that end in a chunk."""
    data = _Bytes(chunk.path)
    form = _Format(data)
    if not form.good:
        if chunk.low <= HEADER:
            yield 0, 0, 0, None, "bad"
        return
    at = form.begin(data, chunk.low)
    while at is not None and at < min(chunk.high, data.size):
        head = data.at(at, RECORD)
        if len(head) == RECORD:
            seconds, fraction, kept, length = form.record.unpack(head)
        if len(head) < RECORD or at + RECORD + kept > data.size:
            if chunk.last:
                yield at, 0, 0, None, "truncated"
            return
        end = at + RECORD + kept
        if end > chunk.high:
            return
        if end > chunk.low:
            yield at, seconds * 1_000_000 + fraction * form.nanos // 1_000, length, data.at(at + RECORD, kept) if bodies else None, "ok"
        at = end


def _batches(chunk: Chunk, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The columns asked for, batches of up to 4,096 records or about FETCH bytes."""
    columns: dict[str, list] = {c: [] for c in names}
    held = 0
    schema = pa.schema([(c, _KINDS[c]) for c in names])

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[c], type=_KINDS[c]) for c in names], schema=schema)

    for n, (at, ts_us, length, frame, status) in enumerate(records(chunk, "frame" in columns)):
        own = {"capture_id": chunk.path, "part": chunk.part, "n": n, "at": at, "ts_us": ts_us, "orig_len": length, "frame": None if frame is None else bytes(frame), "status": status}
        for c in names:
            columns[c].append(own[c])
        held += len(frame) if frame is not None else 0
        if n % 4096 == 4095 or held >= FETCH:
            yield batch()
            columns, held = {c: [] for c in names}, 0
    if names and columns[names[0]]:
        yield batch()


def _options(given: dict) -> tuple[str, str, int, str]:
    """Path, suffix, bytes a range and mode; names of options in any case."""
    own = {k.lower(): v for k, v in given.items()}
    return own["path"], own.get("suffix", ".pcap"), int(own.get("splitbytes", SPLIT)), own.get("mode", "frames")


class CaptureReader(DataSourceReader):
    def __init__(self, options: tuple[str, str, int, str], schema: StructType):
        self.path, self.suffix, self.split, self.mode = options
        self.names = [f.name for f in schema.fields]

    def partitions(self) -> list[Chunk]:
        out = []
        for path, size in listed(self.path, self.suffix):
            # A file without a record still has one chunk: it may be bad.
            out += chunks(path, HEADER, max(size, HEADER + 1), self.split, True)
        return out

    def read(self, partition: Chunk) -> Iterator[pa.RecordBatch]:
        if self.mode == "frames":
            yield from _batches(partition, self.names)
            return
        first = last = None
        frames = 0
        for at, _, _, _, status in records(partition, False):
            first, frames, last = at if first is None else first, frames + 1, at if status == "ok" else None
        if last is not None:
            data = _Bytes(partition.path)
            last += RECORD + _Format(data).record.unpack(data.at(last, RECORD))[2]
        own = {"capture_id": partition.path, "part": partition.part, "first": first, "last": last, "frames": frames}
        yield pa.RecordBatch.from_pylist([{c: own[c] for c in self.names}], schema=pa.schema([(c, _KINDS[c]) for c in self.names]))


class CaptureStream(DataSourceStreamReader):
    """Offsets are the bytes seen of each file; a record is read once, when it is whole."""

    def __init__(self, options: tuple[str, str, int, str], schema: StructType):
        self.path, self.suffix, self.split, _ = options
        self.names = [f.name for f in schema.fields]

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        return dict(listed(self.path, self.suffix))

    def partitions(self, start: dict, end: dict) -> list[Chunk]:
        return [c for path, size in sorted(end.items()) if size > max(start.get(path, 0), HEADER) for c in chunks(path, max(start.get(path, 0), HEADER), size, self.split, False)]

    def read(self, partition: Chunk) -> Iterator[pa.RecordBatch]:
        yield from _batches(partition, self.names)


class CaptureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return RANGES if self.options.get("mode") == "ranges" else FRAMES

    def reader(self, schema: StructType) -> CaptureReader:
        return CaptureReader(_options(self.options), schema)

    def streamReader(self, schema: StructType) -> CaptureStream:  # noqa: N802
        return CaptureStream(_options(self.options), schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CaptureSource)


def write_captures(frames: DataFrame, folder: str) -> DataFrame:
    """Writes the frames (capture_id, idx, ts_us, orig_len, frame) of each capture to a file of its name in a folder, in the order of idx: capture_id, frames.

    Lazy: the files are there once the result has been read. A file is one task's work, written batch by batch under another name and
    then renamed, so a task that runs again leaves no half file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, inner = opened(folder)
        store.create_dir(inner, recursive=True)
        out, name, n, done = None, None, 0, []

        def close() -> None:
            out.close()
            store.move(f"{inner}/.{name}.{token}", f"{inner}/{name}.pcap")
            done.append((name, n))

        for batch in batches:
            for capture, ts_us, length, frame in zip(*(batch.column(c).to_pylist() for c in ("capture_id", "ts_us", "orig_len", "frame")), strict=True):
                if capture != name:
                    if out is not None:
                        close()
                    token, name, n = uuid.uuid4().hex, capture, 0
                    out = store.open_output_stream(f"{inner}/.{name}.{token}")
                    out.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, LARGEST, 1))
                out.write(struct.pack("<IIII", ts_us // 1_000_000, ts_us % 1_000_000, len(frame), length) + frame)
                n += 1
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], type=pa.string()), pa.array([d[1] for d in done], type=pa.int64())], names=["capture_id", "frames"])

    rows = frames.select(F.col("capture_id").cast("string").alias("capture_id"), "idx", "ts_us", "orig_len", "frame").repartition("capture_id").sortWithinPartitions("capture_id", "idx")
    return rows.mapInArrow(run, "capture_id string, frames long")


def read_captures(spark: SparkSession, path: str, split: int = SPLIT, columns: tuple[str, ...] = ("ts_us", "orig_len", "frame", "status")) -> DataFrame:
    """capture_id, idx and the columns of all frames below a path: idx is the record's number in its file from 1, 0 for a file that is none.

    Chains are checked before use: each range must begin where the one before it ended. Files for which that fails (a payload that
    looks like many record headers can mislead a range) are read whole instead, so the result never depends on where a file was cut.
    """
    register(spark)
    source = lambda **options: spark.read.format("capture").options(splitBytes=split, **options)
    own = Window.partitionBy("capture_id").orderBy("part")
    ranges = source(mode="ranges").load(path)
    ranges = ranges.withColumn("_end", F.last("last", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_before", F.coalesce(F.sum("frames").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    broken = ranges.where((F.col("first") > 0) & (F.col("first") != F.coalesce("_end", F.lit(HEADER)))).select("capture_id").distinct()
    wrong = [r.capture_id for r in broken.collect()]
    kinds = {c.split()[0]: c.split()[1] for c in FRAMES.split(", ")}
    wanted = ["capture_id", "part", "n", *[c for c in columns if c not in ("capture_id", "idx")]]
    if "status" not in wanted:
        wanted.append("status")
    schema = ", ".join(f"{c} {kinds[c]}" for c in wanted)
    rows = source().schema(schema).load(path)
    number = F.when(F.col("status") == "bad", 0).otherwise(F.col("_before") + F.col("n") + 1).alias("idx")
    kept = ["capture_id", number, *[c for c in columns if c not in ("capture_id", "idx")]]
    right = rows if not wrong else rows.where(~F.col("capture_id").isin(wrong))
    out = right.join(ranges.select("capture_id", "part", "_before"), ["capture_id", "part"]).select(*kept)
    for name in wrong:
        whole = spark.read.format("capture").options(splitBytes=1 << 62).schema(schema).load(name)
        out = out.unionByName(whole.withColumn("_before", F.lit(0).cast("long")).select(*kept))
    return out
