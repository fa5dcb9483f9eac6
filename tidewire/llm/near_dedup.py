"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

A text is the multiset of its five-word shingles, each weighing its count times its inverse document frequency. Document frequencies
are those of hashed features, as in common hashing TF-IDF: one fixed-size table of counts over all documents. 48 consistent
weighted samples of a text agree with those of another with the chance of their weighted Jaccard similarity. Texts that share the
three samples of one of 16 bands meet in a bucket; links that span
the buckets are verified by the exact similarity of the whole texts, and verified links are joined to classes. Then all members of a
bucket that are still in different classes are compared, large buckets by pairs of tiles, and each pair whose samples don't
rule it out is verified where it is found. Texts of equal word sequences are one node throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, buffers, cut, grams, mix, steps, summed

FEATURES = 1 << 18
BANDS, ROWS = 16, 3
SAMPLES = BANDS * ROWS
#: Members of a bucket that one step compares; larger buckets are linked by parts first and then compared by pairs of tiles.
BUCKET = 3000
CHUNK = 4096
_TABLE = 1 << 16


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, count) of the different shingles of each row, in order; a row of fewer than k words, but not none, is one shingle."""
    full = grams(words.hash, k)
    inside = words.row[: len(full)] == words.row[k - 1 :] if len(full) else np.zeros(0, dtype=bool)
    row, h = [words.row[: len(full)][inside]], [full[inside]]
    ends = np.cumsum(words.count)
    for n in range(1, k):
        short = np.flatnonzero(words.count == n)
        if len(short):
            own = grams(words.hash, n)
            row.append(short)
            h.append(own[ends[short] - n])
    row, h = np.concatenate(row), np.concatenate(h)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.r_[True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])][: len(h)]
    at = np.flatnonzero(new)
    return row[at], h[at], np.diff(np.r_[at, len(h)])


def sequence_keys(words: Words) -> np.ndarray:
    """Two 64-bit hashes of each row's word sequence, as rows x 2."""
    begin = np.cumsum(words.count) - words.count
    within = (np.arange(len(words.hash)) - begin[words.row]).astype(np.uint64)
    out = np.zeros((words.rows, 2), dtype=np.uint64)
    some = np.flatnonzero(words.count)
    for j, salt in enumerate((0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)):
        if len(some):
            out[some, j] = np.add.reduceat(mix(words.hash ^ mix(within + np.uint64(salt))), begin[some])
    out[:, 1] ^= words.count.astype(np.uint64)
    return out


def _random_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20150401)
    r = rng.gamma(2.0, 1.0, _TABLE).astype(np.float32)
    log_c = np.log(rng.gamma(2.0, 1.0, _TABLE)).astype(np.float32)
    beta = rng.random(_TABLE).astype(np.float32)
    return r, log_c, beta, rng.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def weighted_samples(row: np.ndarray, h: np.ndarray, weight: np.ndarray, rows: int) -> np.ndarray:
    """rows x SAMPLES: 32 bits of each consistent weighted sample; rows without shingles have zeros."""
    out = np.zeros((rows, SAMPLES), dtype=np.uint32)
    if not len(row):
        return out
    r_, log_c, beta_, salts = _random_tables()
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    sizes = np.diff(np.r_[starts, len(row)])
    log_w, some = np.log(weight).astype(np.float32), row[starts]
    for m in range(SAMPLES):
        z = h * salts[m]
        z ^= z >> np.uint64(29)
        r, beta = r_[(z >> np.uint64(48)).astype(np.int64)], beta_[((z >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.int64)]
        t = np.floor(log_w / r + beta)
        log_a = log_c[((z >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.int64)] - r * (t - beta + 1)
        least = np.flatnonzero(log_a == np.repeat(np.minimum.reduceat(log_a, starts), sizes))
        at = least[np.searchsorted(least, starts)]
        out[some, m] = (mix(h[at] + t[at].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
    return out


def _count_features(k: int):
    """Document frequencies of a partition, as chunks of CHUNK counts, and the number of its documents (chunk -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, docs = np.zeros(FEATURES, dtype=np.int64), 0
        for batch in batches:
            data, offsets = buffers(batch.column("_text"))
            docs += batch.num_rows
            for lo, hi in steps(offsets):
                row, h, _ = shingles(Words(data, offsets, lo, hi), k)
                feature = (row.astype(np.int64) << 18) | (h & np.uint64(FEATURES - 1)).astype(np.int64)
                counts += np.bincount(np.unique(feature) & (FEATURES - 1), minlength=FEATURES)
        parts = [counts[a : a + CHUNK].tobytes() for a in range(0, FEATURES, CHUNK)] + [np.array([docs]).tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([*range(FEATURES // CHUNK), -1], type=pa.int32()), pa.array(parts, type=pa.binary())], names=["chunk", "counts"])

    return run


def inverse_frequencies(texts: DataFrame, k: int) -> np.ndarray:
    """ln((1 + documents) / (1 + documents with the feature)) + 1 for each hashed feature: FEATURES numbers, however large the corpus."""
    sums = summed(texts.mapInArrow(_count_features(k), "chunk int, counts binary"), np.int64)
    docs = int(sums.pop(-1, [0])[0])
    counts = np.concatenate([sums.get(i, np.zeros(CHUNK, dtype=np.int64)) for i in range(FEATURES // CHUNK)])
    return (np.log((1 + docs) / (1 + counts)) + 1).astype(np.float32)


def _sign(k: int, idf: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("_text"))
            for lo, hi in steps(offsets):
                words = Words(data, offsets, lo, hi)
                row, h, n = shingles(words, k)
                samples = weighted_samples(row, h, n * idf[(h & np.uint64(FEATURES - 1)).astype(np.int64)], hi - lo)
                keys = sequence_keys(words).astype(">u8")
                node = [x.tobytes() if c else None for x, c in zip(keys, words.count.tolist(), strict=True)]
                columns = [batch.column(c).slice(lo, hi - lo) for c in ("_id", "_digest")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(node, type=pa.binary()), pa.array([x.tobytes() for x in samples], type=pa.binary())], names=["_id", "_digest", "node", "samples"])

    return run


def _band_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        samples = np.frombuffer(b"".join(batch.column("samples").to_pylist()), dtype=np.uint32).reshape(-1, BANDS, ROWS).astype(np.uint64)
        h = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(0xD6E8FEB86659FD93) + np.zeros((len(samples), 1), dtype=np.uint64)
        for j in range(ROWS):
            h = mix(h ^ samples[:, :, j])
        # The last four bits of a bucket are its band.
        h = (h & ~np.uint64(BANDS - 1)) | np.arange(BANDS, dtype=np.uint64)[None, :]
        node = batch.column("node").take(pa.array(np.repeat(np.arange(len(samples)), BANDS)))
        yield pa.RecordBatch.from_arrays([pa.array(h.reshape(-1).view(np.int64)), node], names=["bucket", "node"])


def _finer_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of a large bucket meet again where another of 12 samples agrees too: similar ones miss all with a chance below 1e-8."""
    for batch in batches:
        samples = np.frombuffer(b"".join(batch.column("samples").to_pylist()), dtype=np.uint32).reshape(-1, SAMPLES)
        bucket = batch.column("bucket").to_numpy().view(np.uint64)
        at = (bucket[:, None] % np.uint64(SAMPLES) + np.arange(1, 24, 2, dtype=np.uint64)[None, :]) % np.uint64(SAMPLES)
        own = np.take_along_axis(samples, at.astype(np.int64), axis=1).astype(np.uint64)
        h = mix(mix(bucket[:, None] + at * np.uint64(0x9E3779B97F4A7C15)) ^ own)
        again = pa.array(np.repeat(np.arange(len(samples)), at.shape[1]))
        yield pa.RecordBatch.from_arrays([pa.array(h.reshape(-1).view(np.int64)), *[batch.column(c).take(again) for c in ("node", "samples")]], names=["bucket", "node", "samples"])


def _agreements(samples: np.ndarray, size: int = 256) -> Iterator[tuple[int, np.ndarray]]:
    """Shares of equal samples between some members and all, by blocks of members."""
    columns = np.ascontiguousarray(samples.T)
    for lo in range(0, len(samples), size):
        equal = np.zeros((min(size, len(samples) - lo), len(samples)), dtype=np.uint8)
        for c in columns:
            equal += c[lo : lo + size, None] == c[None, :]
        yield lo, equal / np.float32(samples.shape[1])


def spanning_links(samples: np.ndarray, least: float, hubs: int = 2) -> list[tuple[int, int]]:
    """Links of each member to the members that agree most with the bucket at large, and to the one that agrees most with it."""
    n = len(samples)
    totals, nearest = np.zeros(n), []
    for lo, share in _agreements(samples):
        totals += share.sum(axis=0)
        rows = np.arange(len(share))
        share[rows, lo + rows] = -1
        best = share.argmax(axis=1)
        nearest += [(lo + i, int(best[i])) for i in rows[share[rows, best] >= least].tolist()]
    out = {(min(p), max(p)) for p in nearest}
    for hub in np.argsort(-totals, kind="stable")[:hubs].tolist():
        near = np.flatnonzero((samples == samples[hub]).mean(axis=1) >= least).tolist()
        out |= {(min(i, hub), max(i, hub)) for i in near if i != hub}
    return sorted(out)


def cross_pairs(samples: np.ndarray, component: np.ndarray, tile: np.ndarray, band: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of members of different components that agree in at least `least` of their samples, the nearest first in each block.

    Where the members are of two tiles, pairs within a tile are left to another step; so are those that share an earlier band.
    """
    component = np.unique(component, return_inverse=True)[1]
    if not len(component) or component.max() == 0:
        return
    two = tile.min() != tile.max()
    bands = samples.reshape(-1, BANDS, ROWS)
    for lo, share in _agreements(samples):
        ok = (share >= least) & (component[lo : lo + len(share), None] != component[None, :])
        if two:
            ok &= tile[lo : lo + len(share), None] != tile[None, :]
        i, j = np.nonzero(ok)
        i, j, near = i[j > i + lo] + lo, j[j > i + lo], share[i, j][j > i + lo]
        first = np.concatenate([(bands[i[x : x + 4096]] == bands[j[x : x + 4096]]).all(axis=2).argmax(axis=1) for x in range(0, len(i), 4096)] or [i])
        order = np.argsort(-near, kind="stable")
        order = order[first[order] == band]
        yield i[order], j[order]


def _groups(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[tuple[int, int], list[list]]]:
    """The columns of each (bucket, pair); rows come sorted by both."""
    key, held = None, [[] for _ in names]
    for batch in batches:
        for b, p, *row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "pair", *names)), strict=True):
            if (b, p) != key:
                if key is not None:
                    yield key, held
                key, held = (b, p), [[] for _ in names]
            for column, v in zip(held, row, strict=True):
                column.append(v)
    if key is not None:
        yield key, held


def _pairs_of(bucket: int, component: list[bytes], samples: list[bytes], tile: list[int], least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    s = np.frombuffer(b"".join(samples), dtype=np.uint32).reshape(-1, SAMPLES)
    return cross_pairs(s, np.array([c.hex() for c in component]), np.array(tile), bucket & (BANDS - 1), least)


_MEMBER = "bucket long, pair long, node binary, component binary, samples binary, tile int"


def _in_question(least: float):
    """The members of each step that are in any pair to be verified: only their texts are fetched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket, pair), held in _groups(batches, ("node", "component", "samples", "tile")):
            some = np.zeros(len(held[0]), dtype=bool)
            for i, j in _pairs_of(bucket, *held[1:], least):
                some[i] = some[j] = True
            at = np.flatnonzero(some).tolist()
            if at:
                kept = [pa.array([c[x] for x in at], type=t) for c, t in zip(held, (pa.binary(), pa.binary(), pa.binary(), pa.int32()), strict=True)]
                keys = [pa.array([v] * len(at), type=pa.int64()) for v in (bucket, pair)]
                yield pa.RecordBatch.from_arrays([*keys, *kept], names=["bucket", "pair", "node", "component", "samples", "tile"])

    return run


def _cross_links(k: int, idf: np.ndarray, threshold: float, least: float):
    """Verified links between the components of each step; a pair is passed over only where verified links join its components already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket, _), (nodes, component, samples, tile, texts) in _groups(batches, ("node", "component", "samples", "tile", "_text")):
            own = vectors(pa.array(texts, type=pa.binary()), k, idf)
            total = np.array([w.sum(dtype=np.float64) for _, w in own])
            root = {c: c for c in component}

            def top(c: bytes) -> bytes:
                while root[c] != c:  # noqa: B023
                    root[c] = c = root[root[c]]  # noqa: B023
                return c

            links = []
            for i, j in _pairs_of(bucket, component, samples, tile, least):
                # The lesser total over the greater bounds the similarity.
                may = np.minimum(total[i], total[j]) >= (threshold - 1e-6) * np.maximum(total[i], total[j])
                for a, b in zip(i[may].tolist(), j[may].tolist(), strict=True):
                    x, y = top(component[a]), top(component[b])
                    if x != y and weighted_jaccard(*own[a], *own[b]) >= threshold:
                        root[x] = y
                        links.append((min(nodes[a], nodes[b]), max(nodes[a], nodes[b])))
            yield _pairs(links)

    return run


def _links(least: float):
    """Links of each bucket; rows come sorted by bucket and samples, so equal texts are near in a bucket that is taken in parts."""

    def solve(nodes: list[bytes], samples: list[bytes]) -> list[tuple[bytes, bytes]]:
        if len(nodes) < 2:
            return []
        found = spanning_links(np.frombuffer(b"".join(samples), dtype=np.uint32).reshape(-1, SAMPLES), least)
        return [(min(nodes[a], nodes[b]), max(nodes[a], nodes[b])) for a, b in found if nodes[a] != nodes[b]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, head = None, ([], []), None
        for batch in batches:
            links: list[tuple[bytes, bytes]] = []
            for b, *row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "node", "samples")), strict=True):
                if b != bucket or len(held[0]) >= BUCKET:
                    links += solve(*held)
                    # The first member of a bucket leads each of its parts.
                    held = ([], [])
                    if b != bucket:
                        bucket, head = b, row
                    else:
                        for column, v in zip(held, head, strict=True):
                            column.append(v)
                for column, v in zip(held, row, strict=True):
                    column.append(v)
            yield _pairs(links)
        yield _pairs(solve(*held))

    return run


def _pairs(links: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    links = sorted(set(links))
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], type=pa.binary()), pa.array([x[1] for x in links], type=pa.binary())], names=["a", "b"])


def weighted_jaccard(h1: np.ndarray, w1: np.ndarray, h2: np.ndarray, w2: np.ndarray) -> float:
    """Sum of the lesser weights over the sum of the greater ones; shingles in order."""
    if not len(h1) or not len(h2):
        return 0.0
    at = np.minimum(np.searchsorted(h2, h1), len(h2) - 1)
    same = h2[at] == h1
    both = float(np.minimum(w1[same], w2[at[same]]).sum(dtype=np.float64))
    return both / (float(w1.sum(dtype=np.float64)) + float(w2.sum(dtype=np.float64)) - both)


def vectors(column: pa.Array, k: int, idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The shingles of each text, in order, and their weights."""
    data, offsets = buffers(column)
    out = []
    for lo, hi in steps(offsets):
        row, h, n = shingles(Words(data, offsets, lo, hi), k)
        edges = np.searchsorted(row, np.arange(hi - lo + 1))
        w = n * idf[(h & np.uint64(FEATURES - 1)).astype(np.int64)]
        out += [(h[a:b], w[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return out


def _verify(k: int, idf: np.ndarray, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                similarity = [weighted_jaccard(*x, *y) for x, y in zip(vectors(part.column("text_a"), k, idf), vectors(part.column("text_b"), k, idf), strict=True)]
                ok = pa.array(np.flatnonzero(np.array(similarity) >= threshold))
                yield pa.RecordBatch.from_arrays([part.column("a").take(ok), part.column("b").take(ok)], names=["a", "b"])

    return run


def components(links: DataFrame) -> DataFrame:
    """node, component (its least node) of each node that has a link, by passing on least labels and jumping; a checkpoint each round."""
    anew = lambda c: F.concat(c, F.lit(b"")).alias(c)
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.least("a", F.min("b")).alias("component")).select(F.col("a").alias("node"), "component"))
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("near")).withColumnRenamed("a", "node")
        lower = labels.join(seen, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        up = lower.select(F.col("node").alias("component"), F.col("component").alias("top")).select(anew("component"), "top")
        new = cut(lower.join(up, "component", "left").select("node", "old", F.least("component", F.coalesce("top", "component")).alias("component")))
        labels = new.select("node", "component")
        if not new.where("old != component").limit(1).count():
            return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: float = 0.8) -> DataFrame:
    """_id, _digest (MD5 of the text), class_id, class_size, stays, copies: one row for each different (id, text).

    Two texts are linked if the weighted Jaccard similarity of their TF-IDF shingles is at least the threshold; a class is what
    links connect, its id the least document id, and class_size counts its rows. stays marks one row of each class, that of the
    least id (nulls last), then of the least digest; copies says how often the (id, text) came. Words are those of A-Z lower-
    cased; a text of fewer than k words is one shingle; texts without words (nulls too) are classes of their own, one for
    each (id, text). An empty table gives no rows. Buckets of any size are compared whole: where more than BUCKET members are in
    different classes after the first links, each pair of tiles of them is a step of its own.
    """
    base = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_text")).withColumn("_digest", F.unhex(F.md5("_text")))
    idf = inverse_frequencies(base.select("_text"), k)
    kind = base.schema["_id"].dataType.simpleString()
    signed = cut(base.mapInArrow(_sign(k, idf), f"_id {kind}, _digest binary, node binary, samples binary"))
    nodes = cut(signed.where("node IS NOT NULL").groupBy("node").agg(F.min("_digest").alias("_digest"), F.first("samples").alias("samples")))
    rows = nodes.mapInArrow(_band_keys, "bucket long, node binary")
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("bucket").bitwiseXOR(F.lit(0)).alias("bucket"), (F.col("n") > BUCKET).alias("large"))
    members = cut(rows.join(sizes, "bucket"))
    samples = cut(nodes.join(members.select("node").distinct(), "node"))
    wanted = samples.select("node", "_digest")
    texts = cut(base.select("_digest", "_text").join(wanted, "_digest").groupBy("node").agg(F.first("_text").alias("_text")))
    deviation = math.sqrt(threshold * (1 - threshold) / SAMPLES)
    least, least_cross = threshold - 3.5 * deviation, threshold - 5 * deviation

    def candidates() -> DataFrame:
        full = members.join(samples.select("node", "samples"), "node").select("bucket", "node", "samples", "large")
        finer = full.where("large").drop("large").mapInArrow(_finer_keys, "bucket long, node binary, samples binary")
        dealt = full.where("NOT large").drop("large").unionByName(finer).repartition("bucket").sortWithinPartitions("bucket", "samples")
        return dealt.mapInArrow(_links(least), "a binary, b binary").distinct()

    def crossing(labels: DataFrame) -> DataFrame:
        """Members of buckets with several components, dealt to steps of at most about BUCKET: the largest component's tiles meet the others' only."""
        own = cut(members.select("bucket", "node").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")))
        counts = own.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("most"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
        tiles = lambda n: F.ceil(n / F.lit(BUCKET / 2)).cast("int")
        counts = counts.select(F.col("bucket").bitwiseXOR(F.lit(0)).alias("bucket"), F.col("most.component").alias("largest"), F.when(F.col("n") <= BUCKET, 0).otherwise(tiles(F.col("n") - F.col("most.n"))).alias("others"), F.when(F.col("n") <= BUCKET, 0).otherwise(tiles(F.col("most.n"))).alias("mains"))
        # Tiles 0 to others - 1 are of the other components, those after them of the largest.
        inner = F.col("component") == F.col("largest")
        all_tiles = F.col("others") + F.col("mains")
        hashed = lambda n: F.pmod(F.xxhash64("node"), F.greatest(n, F.lit(1))).cast("int")
        dealt = own.join(counts, "bucket").withColumn("tile", F.when(F.col("others") == 0, 0).when(inner, F.col("others") + hashed(F.col("mains"))).otherwise(hashed(F.col("others"))))
        met = F.when(F.col("others") == 0, F.array(F.lit(0))).when(inner, F.sequence(F.lit(0), F.col("others") - 1)).otherwise(F.sequence(F.lit(0), all_tiles - 1))
        dealt = dealt.withColumn("_other", F.explode(met)).withColumn("pair", (F.least("tile", "_other").cast("long") * F.greatest(all_tiles, F.lit(1)) + F.greatest("tile", "_other")))
        dealt = dealt.select("bucket", "pair", "node", "component", "tile").join(samples.select("node", "samples"), "node")
        return dealt.select("bucket", "pair", "node", "component", "samples", "tile").repartition("bucket", "pair").sortWithinPartitions("bucket", "pair")

    def verified(pairs: DataFrame) -> DataFrame:
        left = texts.select(F.col("node").alias("a"), F.col("_text").alias("text_a"))
        right = texts.select(F.col("node").alias("b"), F.col("_text").alias("text_b"))
        return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(_verify(k, idf, threshold), "a binary, b binary")

    links = cut(verified(candidates()))
    # Members that the first links left in different components are all compared.
    question = crossing(components(links)).mapInArrow(_in_question(least_cross), _MEMBER)
    fetched = question.join(texts, "node").select("bucket", "pair", "node", "component", "samples", "tile", "_text").repartition("bucket", "pair").sortWithinPartitions("bucket", "pair")
    more = cut(fetched.mapInArrow(_cross_links(k, idf, threshold, least_cross), "a binary, b binary").distinct())
    labels = components(links.unionByName(more))
    classed = signed.groupBy("_id", "_digest", "node").agg(F.count(F.lit(1)).alias("copies")).join(labels, "node", "left")
    alone = F.concat(F.lit(b"-"), F.coalesce(F.col("_id").cast("string").cast("binary"), F.lit(b"?")), F.lit(b"-"), "_digest")
    classed = classed.withColumn("component", F.coalesce("component", "node", alone))
    first = F.struct(F.col("_id").isNull(), F.col("_id"), F.col("_digest"))
    totals = classed.groupBy("component").agg(F.min("_id").alias("class_id"), F.sum("copies").alias("class_size"), F.min(first).alias("first")).select(F.concat("component", F.lit(b"")).alias("component"), "class_id", "class_size", "first")
    return classed.join(totals, "component").select("_id", "_digest", "class_id", "class_size", (first == F.col("first")).alias("stays"), "copies")
