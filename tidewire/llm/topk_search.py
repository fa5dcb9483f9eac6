"""Exact top-k search by integer inner product over a bit-sliced index.

The rows are dealt to shards. A shard's index holds, for each attribute and each binary place of its quantised values, a bitmap over
the shard's rows. A query's score is a weighted sum of attributes, so its slices are made by bitmap addition: for each binary
place of the weights, from the most significant one down, the sum so far is doubled and the slices of the attributes whose weight
has that bit are added by full adders (xor, and, or) over whole bitmaps. The top rows are then picked from the most significant
slice of the score downward, and the rows that tie at the boundary are resolved by their ids.

Values and weights are shifted to be no less than 0. A shift of the values adds the same to all scores of a query; a shift of the
weights adds a multiple of a row's sum of values, which is one more attribute.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of an index shard, queries of a block, and queries that one step adds bitmaps for.
SHARD, BLOCK, STEP = 8192, 16_384, 128


def _matrix(column: pa.Array, width: int, scale: float) -> np.ndarray:
    """rows x width of floor(scale * x), zeros after a shorter row's end; what is over the width is left out."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), dtype=np.int64)
    row = np.repeat(np.arange(len(column)), sizes)
    at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    own = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
    out[row[at < width], at[at < width]] = own[at < width]
    return out


def _whole(column: pa.ChunkedArray) -> pa.Array:
    own = column.combine_chunks()
    return own.chunk(0) if isinstance(own, pa.ChunkedArray) else own


def _bits(top: int) -> int:
    return max(int(top).bit_length(), 1)


def slices(values: np.ndarray) -> list[np.ndarray]:
    """A bitmap over the rows for each binary place of values no less than 0, the least significant first."""
    padded = np.pad(values, (0, -len(values) % 64))
    return [np.packbits(((padded >> b) & 1).astype(np.uint8), bitorder="little").view(np.uint64) for b in range(_bits(values.max(initial=0)))]


class Index:
    """The slices of a shard; rows are in the order of their ids."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, values = ids[order], values[order]
        self.low = int(values.min(initial=0))
        own = values - self.low
        self.top = int(own.sum(axis=1).max(initial=0))
        self.attributes = [slices(own[:, a]) for a in range(own.shape[1])]
        self.rest = slices(self.top - own.sum(axis=1))

    @property
    def words(self) -> int:
        return len(self.rest[0])

    def scores(self, weights: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """The slices (queries x words each) of the scores less an offset of each query, and the offsets."""
        low = np.minimum(weights.min(axis=1, initial=0), 0)
        # sum(w * x) = sum((w - low) * x') - low * (top - sum(x')) + low * top + shift * sum(w), all of x' = x - shift and w - low no less than 0.
        own = np.c_[weights - low[:, None], -low]
        inputs = [*self.attributes, self.rest]
        offset = low * self.top + self.low * weights.sum(axis=1)
        total: list[np.ndarray] = []
        shape = (len(weights), self.words)
        masked, carry, both = (np.empty(shape, dtype=np.uint64) for _ in range(3))
        for j in range(_bits(own.max(initial=0)) - 1, -1, -1):
            total = [np.zeros(shape, dtype=np.uint64), *total] if total else []
            on = np.where((own >> j) & 1, ~np.uint64(0), np.uint64(0))
            part: list[np.ndarray] = []
            for a, bitmaps in enumerate(inputs):
                mask = on[:, a : a + 1]
                if mask.any():
                    _add(part, [(bitmap, mask) for bitmap in bitmaps], masked, carry, both)
            _add(total, [(bitmap, None) for bitmap in part], masked, carry, both)
        return total, offset


def _add(total: list[np.ndarray], bitmaps: list[tuple[np.ndarray, np.ndarray | None]], masked: np.ndarray, carry: np.ndarray, both: np.ndarray) -> None:
    """Add a number given by bitmaps, each under a mask, to the number of `total`, in place; full adders, then half adders for the carry."""
    carry[:] = 0
    for b, (bitmap, mask) in enumerate(bitmaps):
        x = bitmap if mask is None else np.bitwise_and(bitmap, mask, out=masked)
        if b == len(total):
            total.append(np.bitwise_xor(x, carry))
            np.bitwise_and(x, carry, out=carry)
            continue
        own = total[b]
        np.bitwise_and(own, x, out=both)
        np.bitwise_xor(own, x, out=own)
        np.bitwise_and(own, carry, out=masked)
        np.bitwise_xor(own, carry, out=own)
        np.bitwise_or(both, masked, out=carry)
    b = len(bitmaps)
    while carry.any():
        if b == len(total):
            total.append(carry.copy())
            return
        np.bitwise_and(total[b], carry, out=both)
        np.bitwise_xor(total[b], carry, out=total[b])
        carry[:] = both
        b += 1


def pick(score: list[np.ndarray], rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps (queries x words) of the rows sure to be among the k best of `rows`, and of those that tie for the places left."""
    sure, open_ = np.zeros_like(rows), rows.copy()
    count = lambda bitmap: np.bitwise_count(bitmap).sum(axis=1, dtype=np.int64)
    for bitmap in score[::-1]:
        ones = open_ & bitmap
        many = (count(sure) + count(ones) > k)[:, None]
        sure = np.where(many, sure, sure | ones)
        open_ = np.where(many, ones, open_ & ~bitmap)
    # Once k rows are sure nothing is open that could still be taken.
    return sure, np.where((count(sure) < k)[:, None], open_, np.uint64(0))


def _positions(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def search(index: Index, weights: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row's id, score) of each query's k best rows of the index, rows of the query's own id left out, ties to the smaller id."""
    everything = slices(np.ones(len(index.ids), dtype=np.int64))[0]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for lo in range(0, len(weights), STEP):
        score, offset = index.scores(weights[lo : lo + STEP])
        rows = np.tile(everything, (len(offset), 1))
        first, last = np.searchsorted(index.ids, own[lo : lo + STEP], side="left"), np.searchsorted(index.ids, own[lo : lo + STEP], side="right")
        for i in np.flatnonzero(last > first).tolist():
            for r in range(first[i], last[i]):
                rows[i, r // 64] &= ~(np.uint64(1) << np.uint64(r % 64))
        sure, tied = pick(score, rows, k)
        for i in range(len(offset)):
            at = _positions(sure[i])
            at = np.r_[at, _positions(tied[i])[: k - len(at)]]
            value = sum(((bitmap[i, at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << b for b, bitmap in enumerate(score)) + offset[i] if len(at) else at
            found.append((np.full(len(at), lo + i), index.ids[at], value))
    return tuple(np.concatenate([f[j] for f in found]) if found else np.zeros(0, dtype=np.int64) for j in range(3))


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k rows of the highest inner product of floor(scale * component).

    Ties go to the smaller id. Rows and queries without an id, a null vector, or one with null or non-finite components
    take no part; a shorter vector has zeros at its end; a query leaves out all rows of its own id; repeated rows are rows of
    their own; queries of one id and different vectors have a ranking each; scores must fit 64 bits; empty tables give no
    rows; other columns are ignored. A shard's index is made once; it meets the queries, a stated set, in blocks of about BLOCK, so no
    task holds either side whole.
    """
    valid = f"{id_col} IS NOT NULL AND {vector_col} IS NOT NULL AND NOT exists({vector_col}, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))"
    have = rows.where(valid).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    asked = queries.where(valid).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    # The numbers of rows, invalid ones too, are read without the vectors.
    shards, blocks = (max(-(-frame.count() // size), 1) for frame, size in ((rows, SHARD), (queries, BLOCK)))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # Of equal rows at most k can be among the best, so that no id and no vector fills a shard.
    few = have.groupBy("id", "v").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("n"))
    left = few.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n")))).withColumn("shard", F.pmod(F.xxhash64("id", "v", "copy"), F.lit(shards)).cast("int")).select("id", "v", "shard")
    right = asked.distinct().select("id", "v", F.xxhash64("v").alias("key"), F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int").alias("block")).withColumn("shard", each(shards))

    def build(group: pa.Table) -> pa.Table:
        v = _whole(group.column("v"))
        width = int(np.diff(v.offsets.to_numpy()).max(initial=0))
        index = Index(group.column("id").to_numpy(), _matrix(v, width, scale))
        bitmaps = [*(s for own in index.attributes for s in own), *index.rest]
        sizes = np.array([*(len(own) for own in index.attributes), len(index.rest)], dtype=np.int64)
        parts = [index.ids.tobytes(), sizes.tobytes(), np.concatenate(bitmaps).tobytes()]
        return pa.table([pa.array([group.column("shard")[0].as_py()], type=pa.int32()), *[pa.array([p], type=pa.binary()) for p in parts], pa.array([index.low]), pa.array([index.top])], names=["shard", "ids", "sizes", "bitmaps", "low", "top"])

    def run(shard: pa.Table, block: pa.Table) -> pa.Table:
        at = [np.zeros(0, dtype=np.int64)] * 4
        if shard.num_rows and block.num_rows:
            index = Index.__new__(Index)
            index.ids, sizes = (np.frombuffer(shard.column(c)[0].as_py(), dtype=np.int64) for c in ("ids", "sizes"))
            bitmaps = list(np.frombuffer(shard.column("bitmaps")[0].as_py(), dtype=np.uint64).reshape(int(sizes.sum()), -1))
            ends = np.cumsum(sizes).tolist()
            parts = [bitmaps[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            index.low, index.top, index.attributes, index.rest = shard.column("low")[0].as_py(), shard.column("top")[0].as_py(), parts[:-1], parts[-1]
            own, keys = block.column("id").to_numpy(), block.column("key").to_numpy()
            query, row, score = search(index, _matrix(_whole(block.column("v")), len(index.attributes), scale), own, k)
            at = [own[query], keys[query], row, score]
        return pa.table([pa.array(a, type=pa.int64()) for a in at], names=["query_id", "key", "vec_id", "score"])

    index = left.groupBy("shard").applyInArrow(build, "shard int, ids binary, sizes binary, bitmaps binary, low long, top long").withColumn("block", each(blocks))
    found = index.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(run, "query_id long, key long, vec_id long, score long")
    best = F.row_number().over(Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
