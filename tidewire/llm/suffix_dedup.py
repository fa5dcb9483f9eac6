"""Removal of long byte strings that occur twice anywhere, by a sparse enhanced suffix array.

The suffix array holds one suffix for each anchor: the 40-byte string with the least hash in any `length`-byte window
(a minimizer). What a window's anchor is depends on the window's bytes alone, so two equal windows have their anchor at the
same place, and every repeated window shows in the block of suffixes that begin with one anchor string. An anchor's
context is the bytes of all its windows. Equal contexts are one suffix: they are repeats as a whole, and only one of them
goes on to be compared with different contexts. Blocks are dealt
out by anchor. A stack scan over a block's longest common prefixes gives its common-prefix intervals; in each, the members'
left contexts are sorted, and where they differ (left-extension diversity) each member's longest shared left extension
is the bound of its maximal repeat. An interval of depth r and a shared left extension l give a repeat of l + r bytes, and
all its occurrences are reported.

A block of more than BLOCK different contexts is split by further bytes to the left and right of the anchor: a repeat that
begins l bytes before the anchor reaches length - l bytes beyond its start, so all repeats with l in one range of STRIDE values
share a core of length - STRIDE + 1 bytes. Contexts are dealt to pieces by their cores; equal pieces are folded again, and
the others are blocks of their own. In a piece that is still too large the strings of exactly `length` bytes are the
intervals, as all else is shared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import buffers, discard, mix, powers, span_hashes, steps, written

ANCHOR = 40
#: Different contexts that one task compares, and the window starts that share a piece of a larger block.
BLOCK, STRIDE = 4096, 13
_B1 = 0x9E3779B97F4A7C15 | 1


def _rolling(text: np.ndarray, k: int) -> np.ndarray:
    """A hash for each k consecutive bytes, by steps so that a long row needs bounded memory."""
    n, size = len(text) - k + 1, 1 << 19
    out = np.empty(max(n, 0), dtype=np.uint64)
    p, q = powers(size + k, _B1), powers(size + k, pow(_B1, -1, 2**64))
    for a in range(0, n, size):
        b = min(n, a + size)
        total = np.zeros(b - a + k, dtype=np.uint64)
        np.cumsum((text[a : b + k - 1].astype(np.uint64) + np.uint64(1)) * p[: b - a + k - 1], out=total[1:])
        out[a:b] = (total[k:] - total[:-k]) * q[: b - a]
    return mix(out)


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        keys, size = np.minimum(keys[:-size], keys[size:]), size * 2
    rest = width - size
    return np.minimum(keys[:-rest], keys[rest:]) if rest else keys


def anchors(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of all windows, the leftmost of equal hashes, and the starts of the first and last window of each."""
    parts, width, size = [], length - ANCHOR + 1, 1 << 19
    for a in range(0, max(len(text) - length + 1, 0), size):
        h = _rolling(text[a : a + size + length - 1], ANCHOR)
        keys = (h & np.uint64(0xFFFFFFFFFFF00000)) | np.arange(len(h), dtype=np.uint64)
        at = (_least(keys, width) & np.uint64(0xFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        parts.append((at[first] + a, h[at[first]], first + a, np.r_[first[1:], len(at)] - 1 + a))
    if not parts:
        return (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), *[np.zeros(0, dtype=np.int64)] * 2)
    at, h, first, last = (np.concatenate(x) for x in zip(*parts, strict=True))
    new = np.r_[True, at[1:] != at[:-1]]  # a run that two steps share counts once
    return at[new], h[new], first[new], last[np.r_[new[1:], True]]


def _emit_anchors(length: int):
    """An anchor's place with how far its windows reach to the left and right, packed as place, 16 bits, 16 bits; hashes of anchor and context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("data"))
            for lo, hi in steps(offsets):
                text = data[offsets[lo] : offsets[hi]]
                at, h, first, last = anchors(text, length)
                cuts = offsets[lo : hi + 1] - offsets[lo]
                row = np.searchsorted(cuts, at, side="right") - 1
                first, last = np.maximum(first, cuts[row]), np.minimum(last, cuts[row + 1] - length)
                ok = first <= last
                at, h, first, last, row = (x[ok] for x in (at, h, first, last, row))
                reach = ((at - first) << 16) | (last + length - at)
                context = mix(span_hashes(text, first, last + length) + reach.astype(np.uint64))
                packed = ((at - cuts[row]) << 32) | reach
                yield pa.RecordBatch.from_arrays([batch.column("digest").take(pa.array(row + lo)), pa.array(packed), pa.array(h.view(np.int64)), pa.array(context.view(np.int64))], names=["digest", "at", "anchor", "context"])

    return run


def _lists(batch: pa.RecordBatch) -> Iterator[tuple[bytes, bytes, list[np.ndarray]]]:
    """Each text's digest, bytes and listed places (place, left, right, key, whether of a large block)."""
    for digest, text, own in zip(batch.column("digest").to_pylist(), batch.column("data"), batch.column("places"), strict=True):
        packed, key = (own.values.field(k).to_numpy(zero_copy_only=False) for k in ("at", "key"))
        yield digest, text.as_py(), [packed >> 32, (packed >> 16) & 0xFFFF, packed & 0xFFFF, key, np.array(own.values.field("kind").to_pylist()) == "large"]


def _emit_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes around each listed place."""
    for batch in batches:
        out: list[list] = [[], [], [], [], [], []]
        held = 0
        for digest, text, places in _lists(batch):
            for a, l, r, key, large in zip(*(x.tolist() for x in places), strict=True):
                for column, v in zip(out, (digest, key, a, l, text[a - l : a + r], large), strict=True):
                    column.append(v)
                held += l + r
                if held > 8 << 20:
                    yield _contexts(out)
                    out, held = [[] for _ in out], 0
        yield _contexts(out)


def _contexts(columns: list[list]) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=["digest", "anchor", "at", "left_n", "context", "large"])


def _spans_of(text: bytes, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of the byte strings [first, last) of a text, in any order."""
    order = np.lexsort((last, first))
    out = np.empty(len(first), dtype=np.uint64)
    out[order] = span_hashes(np.frombuffer(text, dtype=np.uint8), first[order], last[order])
    return out


def _emit_pieces(length: int):
    """Each listed place once for each range of STRIDE window starts: reach of the windows, hashes of their core and of all their bytes."""
    n = -(-(length - ANCHOR + 1) // STRIDE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], []]
            digests = []
            for digest, text, (at, left, right, key, _) in _lists(batch):
                j = np.tile(np.arange(n), len(at))
                at, left, right, key = (np.repeat(x, n) for x in (at, left, right, key))
                least, most = np.maximum(j * STRIDE, length - right), np.minimum(j * STRIDE + STRIDE - 1, left)
                at, j, least, most, key = (x[least <= most] for x in (at, j, least, most, key))
                core = _spans_of(text, at - j * STRIDE, at + length - j * STRIDE - STRIDE + 1)
                core = mix(core ^ mix(key.view(np.uint64) + j.astype(np.uint64)))
                reach = (most << 16) | (length - least)
                whole = mix(_spans_of(text, at - most, at + length - least) + reach.astype(np.uint64))
                digests += [digest] * len(at)
                for column, v in zip(out, ((at << 32) | reach, core.view(np.int64), whole.view(np.int64)), strict=True):
                    column.append(v)
            columns = [pa.array(np.concatenate(c) if c else [], type=pa.int64()) for c in out]
            yield pa.RecordBatch.from_arrays([pa.array(digests, type=pa.binary()), *columns], names=["digest", "at", "anchor", "context"])

    return run


def _emit_windows(length: int):
    """The strings of exactly `length` bytes in each listed piece, by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digest, text, (at, left, right, key, _) in _lists(batch):
                size = left + right - length + 1
                piece = np.repeat(np.arange(len(at)), size)
                first = (at - left)[piece] + np.arange(len(piece)) - np.repeat(np.cumsum(size) - size, size)
                h = _spans_of(text, first, first + length)
                yield pa.RecordBatch.from_arrays([pa.array([digest] * len(first), type=pa.binary()), pa.array(first.astype(np.int32)), pa.array(key[piece]), pa.array(h.view(np.int64))], names=["digest", "first", "anchor", "context"])

    return run


def _padded(data: np.ndarray, start: np.ndarray, n: np.ndarray, width: int, step: int) -> np.ndarray:
    steps_ = np.arange(width)
    at = np.clip(start[:, None] + step * steps_[None, :], 0, max(len(data) - 1, 0))
    return np.where(steps_[None, :] < n[:, None], data[at], 0).astype(np.uint8)


def _shared(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of the rows of a and b."""
    differ = a != b
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])
    return np.minimum(first, np.minimum(na, nb))


def _sorted(rows: np.ndarray, n: np.ndarray, group: np.ndarray) -> np.ndarray:
    words = np.ascontiguousarray(np.pad(rows, ((0, 0), (0, -rows.shape[1] % 8)))).view(">u8")
    return np.lexsort((n, *words.T[::-1], group))


def intervals(lcp: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """The common-prefix intervals (first, last, depth) of at least the given depth, by a stack scan; lcp[i] is that of i and i + 1."""
    stack: list[tuple[int, int]] = []
    for i, depth in enumerate([*lcp.tolist(), -1]):
        first = i
        while stack and stack[-1][1] > depth:
            first, r = stack.pop()
            yield first, i, r
        if depth >= least and (not stack or stack[-1][1] < depth):
            stack.append((first, depth))


def repeats(right: np.ndarray, n_right: np.ndarray, left: np.ndarray, n_left: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix the bytes before and from its place that repeats of at least the given length cover; (-1, -1) if none."""
    before, after = np.full(len(group), -1), np.full(len(group), -1)
    order = _sorted(right, n_right, group)
    right, n_right, left, n_left, g = right[order], n_right[order], left[order], n_left[order], group[order]
    lcp = np.where(g[1:] == g[:-1], _shared(right[1:], right[:-1], n_right[1:], n_right[:-1]), -1)
    sizes = np.bincount(np.cumsum(np.r_[0, (g[1:] != g[:-1]).astype(int)])) if len(g) else np.zeros(0, dtype=int)
    ends = np.cumsum(sizes)
    b, a = np.full(len(g), -1), np.full(len(g), -1)
    two = (ends - 2)[sizes == 2]
    if len(two):  # blocks of two: one interval of two members
        l = _shared(left[two], left[two + 1], n_left[two], n_left[two + 1])
        ok = l + lcp[two] >= length
        for side in (two[ok], two[ok] + 1):
            b[side], a[side] = l[ok], lcp[two[ok]]
    for k in np.flatnonzero(sizes > 2).tolist():
        s, e = int(ends[k] - sizes[k]), int(ends[k])
        place = np.empty(e - s, dtype=np.int64)
        place[_sorted(left[s:e], n_left[s:e], np.zeros(e - s))] = np.arange(e - s)
        for first, last, depth in intervals(lcp[s : e - 1], ANCHOR):
            members = s + first + np.argsort(place[first : last + 1], kind="stable")
            shared = _shared(left[members[1:]], left[members[:-1]], n_left[members[1:]], n_left[members[:-1]])
            most = np.maximum(np.r_[shared, -1], np.r_[-1, shared])
            ok = most + depth >= length
            at = members[ok]
            b[at], a[at] = np.maximum(b[at], most[ok]), np.maximum(a[at], depth)
    before[order], after[order] = b, a
    return before, after


def _find_repeats(length: int):
    reach = length - ANCHOR

    def solve(batch: pa.Table) -> pa.RecordBatch:
        batch = batch.combine_chunks()
        data, offsets = buffers(batch.column("context").chunk(0))
        left_n = batch.column("left_n").to_numpy()
        at = batch.column("at").to_numpy()
        start, n_right = offsets[:-1] + left_n, np.diff(offsets) - left_n
        before, after = repeats(_padded(data, start, n_right, length, 1), n_right, _padded(data, start - 1, left_n, reach, -1), left_n, batch.column("anchor").to_numpy(), length)
        ok = np.flatnonzero(after >= 0)
        return pa.RecordBatch.from_arrays([batch.column("digest").chunk(0).take(pa.array(ok)), pa.array((at[ok] - before[ok]).astype(np.int32)), pa.array((at[ok] + after[ok]).astype(np.int32))], names=["digest", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor = batch.column("anchor").to_numpy()
            edge = np.flatnonzero(anchor != anchor[-1])
            cut = int(edge[-1]) + 1 if len(edge) else 0
            same = kept and kept[-1].column("anchor")[-1].as_py() == int(anchor[0])
            if kept and (not same or cut):
                if same:
                    kept.append(batch.slice(0, cut))
                    batch = batch.slice(cut)
                    cut = 0
                yield solve(pa.Table.from_batches(kept))
                kept = []
            if cut:
                yield solve(pa.Table.from_batches([batch.slice(0, cut)]))
                batch = batch.slice(cut)
            if batch.num_rows:
                kept.append(batch)
        if kept:
            yield solve(pa.Table.from_batches(kept))

    return run


def merged(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of the spans [first, last) as spans in order that don't touch."""
    order = np.argsort(first, kind="stable")
    first, top = first[order], np.maximum.accumulate(last[order])
    new = np.r_[True, first[1:] > top[:-1]]
    return first[new], top[np.r_[new[1:], True]]


def _cut_spans(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, text, spans in zip(*(batch.column(k) for k in ("digest", "data", "spans")), strict=True):
                raw = text.as_py()
                if spans.is_valid:
                    first, last = merged(spans.values.field("first").to_numpy(), spans.values.field("last").to_numpy())
                else:
                    first = last = np.zeros(0, dtype=np.int64)
                kept = b"".join(raw[a:b] for a, b in zip([0, *last.tolist()], [*first.tolist(), len(raw)], strict=True))
                rows.append((digest.as_py(), len(raw), len(raw) - len(kept), len(first), hashlib.sha256(kept).hexdigest(), list(zip(first.tolist(), last.tolist(), strict=True)), kept if with_text else None))
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])), pa.binary()]
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            columns[5] = [[{"first": a, "last": b} for a, b in x] for x in columns[5]]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=k) for c, k in zip(columns, kinds, strict=True)], names=["digest", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    return run


_PLACE = "digest binary, at long, anchor long, context long"
_CONTEXT = "digest binary, anchor long, at int, left_n int, context binary, large boolean"


def _anew(c: str) -> Column:
    """A key of counts made anew before a join: then both sides are shuffled for it, and a hot key can be split."""
    return F.col(c).bitwiseXOR(F.lit(0)).alias(c)


def _listed(places: DataFrame) -> DataFrame:
    """digest, places: the places of each text that matter, with their kind; written to the shared folder.

    covered: an equal context stands elsewhere. small, large: one of each different context of an anchor that has several, by
    whether these are more than BLOCK. A text that came several times counts as often, and its places are listed once.
    """
    spark = places.sparkSession
    kinds = places.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("context").alias("lo"), F.max("context").alias("hi"))
    found = places.join(kinds.where("n > 1").select(_anew("anchor"), "lo", "hi"), "anchor").select("digest", "at", "anchor", "context", (F.col("lo") == F.col("hi")).alias("one"))
    found, path = written(found, "places")
    open_, own = found.where("NOT one"), F.xxhash64("digest", "at")
    contexts = open_.groupBy("anchor", "context").agg(F.count(F.lit(1)).alias("n"), F.min(own).alias("least"))
    # Both uses ask for the same columns, so that the counts are shuffled once.
    sizes = contexts.groupBy("anchor").agg((F.count_if((F.col("n") > 0) & F.col("least").isNotNull()) > BLOCK).alias("large")).select(_anew("anchor"), "large")
    told = open_.join(contexts.select(_anew("anchor"), _anew("context"), "n", "least"), ["anchor", "context"])
    kind = lambda key, kind: F.struct("at", key.alias("key"), kind.alias("kind")).alias("place")
    covered = [f.select("digest", kind(F.lit(0).cast("long"), F.lit("covered"))) for f in (found.where("one"), told.where("n > 1 AND least IS NOT NULL"))]
    ones = told.where((own == F.col("least")) & (F.col("n") > 0)).join(sizes, "anchor").select("digest", kind(F.col("anchor"), F.when(F.col("large"), "large").otherwise("small")))
    lists = covered[0].unionByName(covered[1]).unionByName(ones).groupBy("digest").agg(F.collect_set("place").alias("places"))
    out = written(lists, "lists")[0]
    discard(spark, path)
    return out


def _of(*kinds: str) -> Column:
    return F.filter("places", lambda p: p["kind"].isin(*kinds)).alias("places")


def _covered(lists: DataFrame) -> DataFrame:
    """The spans of covered places."""
    at = F.col("place.at")
    place, left, right = F.shiftright(at, 32), F.shiftright(at, 16).bitwiseAND(0xFFFF), at.bitwiseAND(0xFFFF)
    return lists.select("digest", F.explode(_of("covered")).alias("place")).select("digest", (place - left).cast("int").alias("first"), (place + right).cast("int").alias("last"))


def _split(large: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Smaller blocks of the contexts of large ones, and the spans that need no comparison.

    The contexts are texts of their own here, each with one place; the name of such a text is the document's digest with
    the byte where the context starts.
    """
    begin = F.col("at") - F.col("left_n")
    packed = F.shiftleft(F.col("left_n").cast("long"), 32).bitwiseOR(F.shiftleft(F.col("left_n").cast("long"), 16)).bitwiseOR((F.octet_length("context") - F.col("left_n")).cast("long"))
    own = large.select(F.concat("digest", F.unhex(F.lpad(F.hex(begin.cast("long")), 8, "0"))).alias("digest"), F.col("context").alias("data"), F.array(F.struct(packed.alias("at"), F.col("anchor").alias("key"), F.lit("large").alias("kind"))).alias("places"))
    pieces = _listed(own.mapInArrow(_emit_pieces(length), _PLACE))
    data = own.select("digest", "data")
    blocks = data.join(pieces.select("digest", _of("small")).where("size(places) > 0"), "digest").mapInArrow(_emit_contexts, _CONTEXT).drop("large")
    windows = data.join(pieces.select("digest", _of("large")).where("size(places) > 0"), "digest").mapInArrow(_emit_windows(length), "digest binary, first int, anchor long, context long")
    often = windows.groupBy("anchor", "context").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(_anew("anchor"), _anew("context"))
    spans = _covered(pieces).unionByName(windows.join(often, ["anchor", "context"]).select("digest", "first", (F.col("first") + length).cast("int").alias("last")))
    home, start = F.substring("digest", 1, 12).alias("digest"), F.conv(F.hex(F.substring("digest", 13, 4)), 16, 10).cast("int")
    return blocks.select(home, "anchor", (F.col("at") + start).alias("at"), "left_n", "context"), spans.select(home, (F.col("first") + start).alias("first"), (F.col("last") + start).alias("last"))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, with_text: bool = False) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256, spans (byte ranges removed), kept (the other bytes, if with_text).

    Every byte that lies in a `length`-byte string which starts anywhere else too is removed. Null texts are empty; texts below
    `length` bytes are kept whole; repeated rows, null ids and repeated ids are documents of their own; other columns
    are ignored; an empty table gives no rows. Texts are handled once for each distinct content (by 96 bits of its MD5);
    equal contexts of an anchor are told by 64 bits more than the anchor's.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data")).withColumn("digest", F.substring(F.unhex(F.md5("data")), 1, 12))
    texts = base.groupBy("digest").agg(F.first("data").alias("data"))
    lists = _listed(base.select("digest", "data").mapInArrow(_emit_anchors(length), _PLACE))
    # Only the contexts are compared from here on: the texts aren't shuffled again before they are cut.
    contexts, _ = written(texts.join(lists.select("digest", _of("small", "large")).where("size(places) > 0"), "digest").mapInArrow(_emit_contexts, _CONTEXT), "contexts")
    blocks, spans = contexts.where("NOT large").drop("large"), _covered(lists)
    large = contexts.where("large")
    if large.limit(1).count():
        more_blocks, more_spans = _split(large, length)
        blocks, spans = blocks.unionByName(more_blocks), spans.unionByName(more_spans)
    spans = spans.unionByName(blocks.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_find_repeats(length), "digest binary, first int, last int"))
    cuts = spans.groupBy("digest").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    kept = texts.join(cuts, "digest", "left").select("digest", "data", "spans").mapInArrow(
        _cut_spans(with_text), "digest binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<first:long,last:long>>, kept binary"
    )
    out = base.select("id", "digest").join(kept, "digest").drop("digest").withColumnRenamed("id", id_col)
    return out if with_text else out.drop("kept")
