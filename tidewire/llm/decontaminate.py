"""Benchmark decontamination with an FM-index for each shard of training texts.

A shard is the words of some documents, one symbol for each word that the test items hold; other words end a run, and runs
shorter than the shortest phrase are left out, as no phrase can lie there. All phrases are searched backward at once through
the ranks of a wavelet matrix, the occurrences are located by walking to sampled suffix positions, and overlapping
occurrences are merged into removal spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import Words, buffers, cut, discard, restored, shielded, steps, written

#: Symbols of a shard, apart from a longer document's.
SHARD = 1 << 20
SAMPLE = 16


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes of a text over symbols from 1, with 0 between runs; each 0 counts as a symbol of its own, smaller than all others."""
    n = len(text)
    rank = np.where(text == 0, np.arange(n), n + text.astype(np.int64))
    order = np.argsort(rank, kind="stable")
    new = np.r_[True, rank[order[1:]] != rank[order[:-1]]]
    starts = np.flatnonzero(new)
    rank[order] = np.repeat(starts, np.diff(np.r_[starts, n]))
    step = 1
    while True:
        sizes = np.diff(np.r_[starts, n])
        many = sizes > 1
        if not many.any():
            return order
        slots = np.flatnonzero(np.repeat(many, sizes))
        own = order[slots]
        after = own + step
        second = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        by = np.lexsort((second, rank[own]))
        own, second = own[by], second[by]
        first = rank[own]
        order[slots] = own
        head = np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])]
        rank[own] = slots[np.maximum.accumulate(np.where(head, np.arange(len(own)), 0))]
        starts = np.unique(np.r_[starts, slots[head]])
        step *= 2


class FMIndex:
    """Counts and locates words sequences in a text over symbols 1 to sigma, with 0 between runs."""

    def __init__(self, text: np.ndarray, sigma: int):
        text = np.r_[text, 0]
        order = suffix_array(text)
        bwt = text[order - 1]
        self.before = np.searchsorted(text[order], np.arange(sigma + 2))
        self.levels = []
        for level in range(max(int(sigma).bit_length(), 1) - 1, -1, -1):
            bit = (bwt >> level) & 1
            ones = np.zeros(len(bit) + 1, dtype=np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append((level, ones, len(bit) - int(ones[-1])))
            bwt = np.r_[bwt[bit == 0], bwt[bit == 1]]
        # A place after a 0 is always sampled, so that no walk needs the order of the 0s.
        sampled = (order % SAMPLE == 0) | (text[order - 1] == 0)
        self.sampled, self.at = np.r_[0, np.cumsum(sampled)], order[sampled]

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often the symbol stands among the first i of the transform."""
        lo, hi = np.zeros(len(i), dtype=np.int64), i.astype(np.int64)
        for level, ones, zeros in self.levels:
            bit = ((symbol >> level) & 1).astype(bool)
            a, b = ones[lo], ones[hi]
            lo, hi = np.where(bit, zeros + a, lo - a), np.where(bit, zeros + b, hi - b)
        return hi - lo

    def symbol(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), dtype=np.int64)
        for level, ones, zeros in self.levels:
            bit = ones[i + 1] - ones[i]
            out |= bit.astype(np.int64) << level
            i = np.where(bit == 1, zeros + ones[i], i - ones[i])
        return out

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [first, last) of each phrase; phrases: a row of symbols each."""
        first = np.zeros(len(phrases), dtype=np.int64)
        last = np.full(len(phrases), int(self.sampled.shape[0]) - 1, dtype=np.int64)
        alive = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[alive, j]
            first[alive] = self.before[c] + self.rank(c, first[alive])
            last[alive] = self.before[c] + self.rank(c, last[alive])
            alive = alive[first[alive] < last[alive]]
        return first, np.maximum(first, last)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        rows, walked, out = rows.copy(), np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            r = rows[todo]
            here = self.sampled[r + 1] > self.sampled[r]
            out[todo[here]] = self.at[self.sampled[r[here]]] + walked[todo[here]]
            todo, r = todo[~here], r[~here]
            c = self.symbol(r)
            rows[todo] = self.before[c] + self.rank(c, r)
            walked[todo] += 1
        return out


class Phrases:
    """The windows of a block of items, as symbols: per length a table of the different windows and, for each, the items that have it.

    All of it is in arrays, about 50 bytes a word of the items: a window's owners are a stretch of one array of item numbers.
    """

    def __init__(self, items: list[tuple[object, str]], window: int):
        items = [(i, t) for i, t in items if i is not None]
        data, offsets = buffers(pa.array([t or "" for _, t in items], type=pa.string()).cast(pa.binary()))
        words = Words(data, offsets, 0, len(items))
        self.names = sorted({str(i) for i, _ in items})
        number = {n: k for k, n in enumerate(self.names)}
        owner = np.array([number[str(i)] for i, _ in items], dtype=np.int32)
        self.vocabulary, symbol = np.unique(words.hash, return_inverse=True)
        symbol = (symbol + 1).astype(np.int32)
        ends = np.cumsum(words.count)
        size = np.minimum(words.count, window)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in np.unique(size[size > 0]).tolist():
            own = np.flatnonzero(size == n)
            many = words.count[own] - n + 1
            row = np.repeat(own, many)
            start = np.repeat((ends - words.count)[own], many) + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            table = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(symbol, n)[start])
            order = np.lexsort((owner[row], *table.T[::-1]))
            table, who = table[order], owner[row][order]
            new = np.r_[True, (table[1:] != table[:-1]).any(axis=1)]
            first = new | np.r_[True, who[1:] != who[:-1]]  # an item counts once for a window
            edges = np.r_[np.flatnonzero(new[first]), int(first.sum())]
            self.by_length[n] = (table[new], edges, who[first])
        self.shortest = min(self.by_length, default=0)


def _hits(phrases: Phrases, words: Words) -> tuple[np.ndarray, dict[int, set[str]]]:
    """Which words lie in an occurrence; the items that occur, by row."""
    hit, items = np.zeros(len(words.hash), dtype=bool), {}
    if not phrases.shortest or not len(words.hash):
        return hit, items
    at = np.minimum(np.searchsorted(phrases.vocabulary, words.hash), len(phrases.vocabulary) - 1)
    symbol = np.where(phrases.vocabulary[at] == words.hash, at + 1, 0)
    new = np.r_[True, (words.row[1:] != words.row[:-1]) | (symbol[1:] == 0) | (symbol[:-1] == 0)]
    run = np.cumsum(new) - 1
    keep = (symbol > 0) & (np.bincount(run)[run] >= phrases.shortest)
    place = np.flatnonzero(keep)
    if not len(place):
        return hit, items
    gap = np.flatnonzero(np.r_[False, run[place[1:]] != run[place[:-1]]])
    text, origin = np.insert(symbol[place], gap, 0), np.insert(place, gap, -1)
    index = FMIndex(text, len(phrases.vocabulary))
    cover = np.zeros(len(text) + 1, dtype=np.int64)
    for n, (symbols, edges, who) in phrases.by_length.items():
        first, last = index.search(symbols)
        found = np.flatnonzero(last > first)
        counts = (last - first)[found]
        if not len(found):
            continue
        rows = np.repeat(first[found] - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())
        where, which = index.locate(rows), np.repeat(found, counts)
        np.add.at(cover, where, 1)
        np.add.at(cover, where + n, -1)
        for pair in np.unique(words.row[origin[where]] * len(symbols) + which).tolist():
            row, phrase = divmod(pair, len(symbols))
            items.setdefault(row, set()).update(phrases.names[k] for k in who[edges[phrase] : edges[phrase + 1]].tolist())
    on = np.cumsum(cover[:-1]) > 0
    hit[origin[on & (origin >= 0)]] = True
    return hit, items


def _marked(words: Words, spans: pa.Array, hit: np.ndarray) -> None:
    """Mark the words that lie in spans found before."""
    edges = np.diff(spans.offsets.to_numpy())
    row = np.repeat(np.arange(len(edges)), edges)
    first, last = (spans.flatten().field(k).to_numpy(zero_copy_only=False) for k in ("first", "last"))
    place = (words.row << 40) + words.start
    cover = np.zeros(len(hit) + 1, dtype=np.int64)
    np.add.at(cover, np.searchsorted(place, (row << 40) + first), 1)
    np.add.at(cover, np.searchsorted(place, (row << 40) + last), -1)
    hit |= np.cumsum(cover[:-1]) > 0


def _scan(phrases: Phrases, text_col: str, names: list[str], cut_text: bool, again: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(text_col))
            for lo, hi in steps(offsets, 6 * SHARD):
                words = Words(data, offsets, lo, hi)
                hit, items = _hits(phrases, words)
                known = batch.column("_items").slice(lo, hi - lo).to_pylist() if again else [()] * (hi - lo)
                if again:
                    _marked(words, batch.column("_spans").slice(lo, hi - lo), hit)
                start = np.flatnonzero(hit & ~(np.r_[False, hit[:-1]] & np.r_[False, words.row[1:] == words.row[:-1]]))
                end = np.flatnonzero(hit & ~(np.r_[hit[1:], False] & np.r_[words.row[1:] == words.row[:-1], False]))
                edges = np.searchsorted(words.row[start], np.arange(hi - lo + 1))
                spans = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.StructArray.from_arrays([pa.array(words.start[start]), pa.array(words.end[end])], names=["first", "last"]))
                columns = [batch.column(k).slice(lo, hi - lo) for k in names]
                if cut_text:
                    own, at = batch.column(text_col).slice(lo, hi - lo), names.index(text_col)
                    if len(start):
                        texts = own.to_pylist()
                        for i in np.unique(words.row[start]).tolist():
                            a, b = words.start[start[edges[i] : edges[i + 1]]].tolist(), words.end[end[edges[i] : edges[i + 1]]].tolist()
                            parts = [texts[i][x:y].strip() for x, y in zip([0, *b], [*a, len(texts[i])], strict=True)]
                            texts[i] = b"\n".join(x for x in parts if x)
                        columns[at] = pa.array(texts, type=pa.binary())
                found = [sorted({*known[i], *items.get(i, ())}) for i in range(hi - lo)]
                columns += [pa.array(words.count.astype(np.int64)), pa.array(np.bincount(words.row[hit], minlength=hi - lo).astype(np.int64)), pa.array(found, type=pa.list_(pa.string())), spans]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "_n_words", "_n_hit", "_items", "_spans"])

    return run


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, keep: list[str] | None = None, cut_text: bool = False, block_bytes: int = 4 << 20) -> DataFrame:
    """The columns `keep` (all, unless given) with _n_words, _n_hit, _items (ids of occurring items as sorted strings), _spans (byte ranges).

    With cut_text the text loses its hit spans; what is left is joined by line breaks. The test items are a stated query
    set: their texts go to the tasks in blocks of at most `block_bytes`, one pass over the
    documents for each block, written before the next, and the hits of all blocks are united before spans are formed or cut. Items
    with a null id take no part; null texts
    have no words; rows without hits come back unchanged; repeated rows are judged one by one; an empty table gives no rows.
    Columns may have any names, but those of the results are replaced by them.
    """
    names = keep or docs.columns
    own, new = shielded(docs.select(*list(dict.fromkeys([*names, text_col]))))
    text = new[text_col]
    kind = own.schema[text].dataType
    sized = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where("i IS NOT NULL")
    total = sized.agg(F.coalesce(F.sum(F.octet_length("t") + 64), F.lit(0))).first()[0]
    blocks = -(-total // block_bytes) or 1
    frame = own.withColumn(text, F.col(text).cast("binary"))
    found = StructType([StructField("_n_words", LongType()), StructField("_n_hit", LongType()), StructField("_items", ArrayType(StringType())), StructField("_spans", ArrayType(StructType([StructField("first", LongType()), StructField("last", LongType())])))])
    schema = StructType([*frame.schema.fields, *found.fields])
    before = None
    for b in range(blocks):
        # Only one block is with the driver and in the plan.
        part = [(r.i, r.t) for r in sized.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b).collect()]
        if b:
            frame, path = written(frame, "hits")
            if before:
                discard(docs.sparkSession, before)
            before = path
        frame = frame.mapInArrow(_scan(Phrases(part, window), text, list(new.values()), cut_text and b == blocks - 1, b > 0), schema)
    if before:
        # The last block's result is cut from the table before it, which then goes too.
        frame = cut(frame)
        discard(docs.sparkSession, before)
    frame = frame.withColumn(text, F.col(text).cast(kind))
    return restored(frame, {c: new[c] for c in names}, {f.name: F.col(f.name) for f in found.fields})
