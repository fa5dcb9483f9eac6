"""Helpers that several corpus operators share: words as numpy arrays, shared folders."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step looks at; a longer row is a step of its own.
STEP = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F] after A-Z became a-z; bytes of longer UTF-8 characters are all over 0x7F.
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[65:91] = IS_WORD[97:123] = IS_WORD[128:] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base ** i modulo 2 ** 64, for i below n at least."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        step = np.full(max(n, STEP + 1024), base & (2**64 - 1), dtype=np.uint64)
        step[0] = 1
        have = _POWERS[base] = np.cumprod(step, dtype=np.uint64)
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA24BAED4963EE407)
    return h ^ (h >> np.uint64(32))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text or binary column and the row offsets into them; a null row is empty."""
    column = column.cast(pa.binary()) if pa.types.is_string(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, dtype=np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)), offsets


def steps(offsets: np.ndarray, limit: int = STEP) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold up to limit bytes, or a single row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


class Words:
    """The words of rows lo to hi: hash, row (from 0 for lo), first and last byte + 1 within the row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lo: int, hi: int):
        base, cuts = int(offsets[lo]), offsets[lo : hi + 1] - offsets[lo]
        text = LOWER[data[base : base + int(cuts[-1])]]
        self.rows = hi - lo
        if not len(text):
            self.hash, self.row = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
            self.start = self.end = np.zeros(0, dtype=np.int64)
            self.count = np.zeros(self.rows, dtype=np.int64)
            return
        on = IS_WORD[text]
        first, last = on.copy(), on.copy()
        first[1:] &= ~on[:-1]
        last[:-1] &= ~on[1:]
        edges = cuts[(cuts > 0) & (cuts < len(text))]
        first[edges] |= on[edges]
        last[edges - 1] |= on[edges - 1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.hash = span_hashes(text, start, end)
        self.row = np.searchsorted(cuts, start, side="right") - 1
        self.start, self.end = start - cuts[self.row], end - cuts[self.row]
        self.count = np.bincount(self.row, minlength=self.rows)


def span_hashes(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each byte string [start, end) of a text, wherever it stands; starts in order, ends nearly so."""
    out, a = np.zeros(len(start), dtype=np.uint64), 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(end, start[a] + STEP, side="right")))
        s, e = int(start[a]), int(end[a:b].max())
        p = powers(e - s + 1)
        total = np.zeros(e - s + 1, dtype=np.uint64)
        np.cumsum((text[s:e].astype(np.uint64) + np.uint64(1)) * p[: e - s], out=total[1:])
        # Each sum is divided by the power of the word's first byte, so that equal words agree wherever they stand.
        out[a:b] = (total[end[a:b] - s] - total[start[a:b] - s]) * _inverse(e - s + 1)[start[a:b] - s]
        a = b
    return mix(out)


def _inverse(n: int) -> np.ndarray:
    return powers(n, pow(_BASE, -1, 2**64))


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """A hash for each k consecutive words; those that cross rows are to be masked by the caller."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.full(n, k, dtype=np.uint64)
    for j in range(k):
        h = (h ^ words[j : j + n]) * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(31)
    return mix(h)


def word_hash(word: str) -> int:
    """The hash that Words gives a single word."""
    raw = np.frombuffer(word.encode(), dtype=np.uint8)
    return int(Words(raw, np.array([0, len(raw)]), 0, 1).hash[0])


def _add(kind: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for *key, counts in zip(*(batch.column(c).to_pylist() for c in ("chunk", "part", "counts")), strict=True):
                own = np.frombuffer(counts, dtype=kind)
                key = tuple(key)
                sums[key] = sums[key] + own if key in sums else own
        columns = [pa.array([k[i] for k in sums], type=pa.int32()) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([v.tobytes() for v in sums.values()], type=pa.binary())], names=["chunk", "part", "counts"])

    return run


def summed(chunks: DataFrame, kind: type, parts: int = 256) -> dict[int, np.ndarray]:
    """The sum of the arrays (counts, as bytes) of each chunk, in two steps: no task adds up what all partitions counted.

    The chunks and their arrays are of a fixed number and size, so that their sums fit the driver however large the corpus.
    """
    out = "chunk int, part int, counts binary"
    own = chunks.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(parts))).select("chunk", "part", "counts")
    first = own.repartition("chunk", "part").mapInArrow(_add(kind), out)
    last = first.select("chunk", F.lit(0).alias("part"), "counts").repartition("chunk").mapInArrow(_add(kind), out)
    return {r.chunk: np.frombuffer(bytes(r.counts), dtype=kind) for r in last.collect()}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may go without: it gets a temporary one."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        there = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", there)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(there)
    return there


def cut(frame: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint()


#: Spark's setting that frees a query's shuffle files as it ends, which a query that ends in a written table no longer needs.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(frame: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The frame as a Parquet table in the shared folder, and its path; its shuffle files go."""
    spark = frame.sparkSession
    path, before = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", spark.conf.get(_FREE, None)
    spark.conf.set(_FREE, "true")
    try:
        frame.write.parquet(path)
    finally:
        spark.conf.unset(_FREE) if before is None else spark.conf.set(_FREE, before)
    return spark.read.schema(frame.schema).parquet(path), path


#: Spark's setting for the bytes of one Arrow batch, and the bytes that texts get.
_BATCH, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20


def bounded_batches(spark: SparkSession) -> None:
    """From now on batches for Python workers end at BATCH bytes (a longer row is alone), unless the session has a bound of its own.

    Spark's batches are of 10,000 rows, however long: 20 MB of texts, held by Spark, again as they grow, and by the worker.
    """
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH))


def discard(spark: SparkSession, path: str) -> None:
    """Remove a written table that nothing reads any more."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark._jsc.hadoopConfiguration()).delete(own, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shielded(frame: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The frame with its columns named by their places, so that none has a name that an operator uses itself; the new names by the old."""
    new = [f"_c{i}" for i in range(len(frame.columns))]
    return frame.toDF(*new), dict(zip(frame.columns, new, strict=True))


def restored(frame: DataFrame, new: dict[str, str], results: dict[str, Column]) -> DataFrame:
    """The columns under their old names, then the results; a column with the name of a result gives way to it."""
    taken = {c.lower() for c in results}
    return frame.select(*[F.col(n).alias(c) for c, n in new.items() if c.lower() not in taken], *[v.alias(c) for c, v in results.items()])
