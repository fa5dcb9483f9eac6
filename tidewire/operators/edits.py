"""Texts near each other by edit distance: a join by shared segments, all pairs by blocks, and nearest templates by a trie.

The join: texts of distance d share a piece unchanged if one of them is cut into d + 1 pieces. So the longer text is cut into as many pieces as
its length and the least similarity allow, the shorter one offers the parts of itself that could be such a piece, where it could stand, and
only pairs that meet in one are compared. Nothing is lost at any similarity; how few pairs meet depends on how long the pieces are,
which is a text's length over the number of edits, and on how many letters there are.

All pairs: texts are dealt to blocks, each pair of blocks is one group of rows, and what is made of its similarities (sums, counts, the
best ones) leaves the task instead of the pairs. The work is that of all pairs of different texts; memory is that of two blocks.

The trie: templates with a common beginning share the row of the edit table there, and a branch is left as soon as all of its row is over the
distance looked for, which grows from 0 until enough templates are found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import edit_similarity


def _most_edits(length: Column, least: float) -> Column:
    """The edits that a pair with this longer length may have; a hair over the bound, as the comparison itself decides."""
    return F.floor((1 - least) * length + 1e-6).cast("int")


def near_pairs(texts: DataFrame, least: float, within: bool = True) -> DataFrame:
    """label_a, text_a, label_b, text_b, similarity of at least `least` (over 0) of pairs of different rows (label, text); text_a < text_b
    within a label, label_a < label_b else. Texts of one label are different. An empty text is near none."""
    if not 0 < least <= 1:
        raise ValueError("least must be over 0 and at most 1")
    own = texts.select("label", "text").distinct().withColumn("n", F.length("text")).where("n > 0")
    key = F.col("label") if within else F.lit("")
    # Pieces of each text as the longer one: piece i of `cuts` begins at `at` (from 0) and has `size` letters, the last ones a letter more.
    cuts = _most_edits(F.col("n"), least) + 1
    base, more = F.floor(F.col("n") / F.col("cuts")).cast("int"), F.col("n") % F.col("cuts")
    begins = lambda i: i * base + F.greatest(F.lit(0), i - (F.col("cuts") - more))
    pieces = own.withColumn("cuts", F.least(cuts, F.col("n"))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    pieces = pieces.withColumns({"at": begins(F.col("i")).cast("int"), "size": (base + F.when(F.col("i") >= F.col("cuts") - more, 1).otherwise(0)).cast("int")})
    pieces = pieces.select(F.col("label").alias("label_l"), F.col("text").alias("text_l"), F.xxhash64(key, "n", "i", F.expr("substring(text, at + 1, size)")).alias("key"))
    # Parts of each text as the shorter one, for all lengths that its partner may have. With i edits at most before piece i and as many after
    # it as are left, the part stands within both distances of the piece's place, from the front and from the end.
    offers = own.withColumn("m", F.explode(F.sequence(F.col("n"), F.floor(F.col("n") / F.lit(least) + 1e-6).cast("int"))))
    offers = offers.withColumn("cuts", F.least(_most_edits(F.col("m"), least) + 1, F.col("m"))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    base, more = F.floor(F.col("m") / F.col("cuts")).cast("int"), F.col("m") % F.col("cuts")
    offers = offers.withColumns({"at": (F.col("i") * base + F.greatest(F.lit(0), F.col("i") - (F.col("cuts") - more))).cast("int"), "size": (base + F.when(F.col("i") >= F.col("cuts") - more, 1).otherwise(0)).cast("int")})
    behind = F.col("at") + F.col("n") - F.col("m")
    left = F.col("cuts") - 1 - F.col("i")
    low = F.greatest(F.lit(0), F.col("at") - F.col("i"), behind - left)
    high = F.least(F.col("n") - F.col("size"), F.col("at") + F.col("i"), behind + left)
    offers = offers.withColumns({"low": low.cast("int"), "high": high.cast("int")}).where("low <= high").withColumn("p", F.explode(F.sequence("low", "high")))
    offers = offers.select(F.col("label").alias("label_s"), F.col("text").alias("text_s"), F.xxhash64(key, "m", "i", F.expr("substring(text, p + 1, size)")).alias("key")).distinct()
    met = pieces.join(offers, "key").where((F.col("label_l") == F.col("label_s")) & (F.col("text_l") != F.col("text_s")) if within else F.col("label_l") != F.col("label_s"))
    first = F.col("text_s") < F.col("text_l") if within else F.col("label_s") < F.col("label_l")
    side = lambda c, a, b: F.when(first, F.col(f"{c}_{a}")).otherwise(F.col(f"{c}_{b}"))
    pairs = met.select(side("label", "s", "l").alias("label_a"), side("text", "s", "l").alias("text_a"), side("label", "l", "s").alias("label_b"), side("text", "l", "s").alias("text_b")).distinct()
    return pairs.withColumn("similarity", edit_similarity(F.col("text_a"), F.col("text_b"))).where(F.col("similarity") >= least)


#: Pairs whose edit tables are kept as vectors at once, and words of all of them.
AT_ONCE, WORDS = 1 << 15, 1 << 18


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts in a row, where each begins, and lengths."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), np.cumsum(sizes) - sizes, sizes


def _single(a: str, b: str) -> int:
    """Edit distance with the columns of the table as whole numbers of as many bits as a has letters: for few texts, which may be long."""
    if not a or not b:
        return max(len(a), len(b))
    codes = _codes([a])[0]
    where = {chr(c): int.from_bytes(np.packbits(codes == c, bitorder="little").tobytes(), "little") for c in np.unique(codes).tolist()}
    score = len(a)
    full, top = (1 << score) - 1, score - 1
    up, down = full, 0
    for letter in b:
        eq = where.get(letter, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = down | (full & ~(xh | up)), up & xh
        score += ((ph >> top) & 1) - ((mh >> top) & 1)
        ph, mh = (ph << 1) | 1, mh << 1
        up, down = (mh | ~(xv | ph)) & full, ph & xv & full
    return score


def distances(left: list[str], right: list[str]) -> np.ndarray:
    """Edit distances of each text of `left` (rows) to each of `right` (columns), by bit vectors (Myers) over many pairs at once.

    A column of the edit table is kept as the bits where it goes up and down, in words of 64 letters of the left text; one step takes the
    next letter of all right texts that go on. Left texts end at the top bit: rows below their first letter are equal and stay so.
    """
    out = np.empty((len(left), len(right)), dtype=np.int32)
    if not left or not right:
        return out
    words = max(1, -(-max(map(len, left)) // 64))
    if min(len(left) * len(right), AT_ONCE) < 32 + 8 * words:
        for i, a in enumerate(left):
            out[i] = [_single(a, b) for b in right]
        return out
    one, last = np.uint64(1), np.uint64(63)
    order = np.array(sorted(range(len(right)), key=lambda i: -len(right[i])))  # texts that go on stand first
    codes, begins, sizes = _codes([right[i] for i in order])
    going = np.searchsorted(-sizes, -np.arange(sizes[0] + 1), side="left")  # texts of more than so many letters
    lefts = np.array(sorted(range(len(left)), key=lambda i: len(left[i])))  # texts of as many words stand together
    at = 0
    while at < len(lefts):
        most = max(1, min(AT_ONCE // len(right), WORDS // (len(right) * max(1, -(-len(left[lefts[at]]) // 64)))))
        rows, at = lefts[at : at + most], at + most
        own, _, lengths = _codes([left[i] for i in rows])
        n, w = len(rows), max(1, -(-int(lengths[-1]) // 64))
        letters, numbers = np.unique(own, return_inverse=True)
        # For each letter, the places of each left text that hold it; the last row is of letters that none has.
        place = np.arange(len(own)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(64 * w - lengths, lengths)
        where = np.zeros((w, len(letters) + 1, n), dtype=np.uint64)
        np.bitwise_or.at(where, (place // 64, numbers, np.repeat(np.arange(n), lengths)), one << (place % 64).astype(np.uint64))
        number = np.searchsorted(letters, codes)
        number = np.where((number < len(letters)) & (letters[np.minimum(number, len(letters) - 1)] == codes), number, len(letters)) if len(letters) else np.zeros(len(codes), dtype=np.int64)
        real = np.array([[((1 << 64 * w) - (1 << 64 * w - m)) >> 64 * b & (1 << 64) - 1 for m in lengths.tolist()] for b in range(w)], dtype=np.uint64)
        up = [np.repeat(real[b][None], len(right), axis=0) for b in range(w)]
        down = [np.zeros((len(right), n), dtype=np.uint64) for _ in range(w)]
        score = np.repeat(lengths[None].astype(np.int64), len(right), axis=0)
        for j in range(int(sizes[0])):
            k = int(going[j])
            now = number[begins[:k] + j]
            rises, falls = one, None
            for b in range(w):
                u, d, eq = up[b][:k], down[b][:k], where[b][now]
                xv = eq | d
                if falls is not None:
                    eq |= falls
                xh = eq & u
                xh += u
                xh ^= u
                xh |= eq
                ph = xh | u
                np.invert(ph, out=ph)
                ph |= d
                xh &= u  # from here on the falls of the row
                more, less = ph >> last, xh >> last
                ph <<= one
                ph |= rises
                xh <<= one
                if falls is not None:
                    xh |= falls
                np.bitwise_and(ph, xv, out=d)
                xv |= ph
                np.invert(xv, out=xv)
                np.bitwise_or(xh, xv, out=u)
                rises, falls = more, less
            score[:k] += rises.view(np.int64)
            score[:k] -= falls.view(np.int64)
        out[np.ix_(rows, order)] = score.T
    return out


def similarities(left: list[str], right: list[str]) -> np.ndarray:
    """1 less the edit distance over the longer length, of each text of `left` to each of `right`; 1 for two empty texts."""
    longest = np.maximum(np.array([len(t) for t in left], dtype=np.int64)[:, None], np.array([len(t) for t in right], dtype=np.int64)[None, :])
    return 1 - distances(left, right) / np.maximum(longest, 1)


def alike(a: Column, b: Column) -> Column:
    """The similarity of two columns of texts, null if one is: as edit_similarity, many rows at once. For rows that share their texts with others."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        out = np.full(len(x), np.nan)
        whole = np.flatnonzero((x.notna() & y.notna()).to_numpy())
        if len(whole):
            own, i = np.unique(x.to_numpy(dtype=object)[whole], return_inverse=True)
            other, j = np.unique(y.to_numpy(dtype=object)[whole], return_inverse=True)
            if len(own) * len(other) <= 4 * len(whole):
                out[whole] = similarities(own.tolist(), other.tolist())[i, j]
            else:
                for k in range(len(other)):
                    rows = np.flatnonzero(j == k)
                    out[whole[rows]] = similarities(own[i[rows]].tolist(), [other[k]])[:, 0]
        return pd.Series(out)

    return run(a, b)


#: Rows and letters of a block, and rows from which a table has several blocks, up to SPREAD of them.
TEXTS, LETTERS, LEAST, SPREAD = 2048, 1 << 17, 64, 8


def by_blocks(texts: DataFrame, fold: Callable[[pa.Table, pa.Table, np.ndarray, bool], pa.Table], schema: str, within: bool, weight: Column | None = None, most: int = TEXTS) -> DataFrame:
    """What fold(rows, other rows, similarities, whether both are the same) makes of each pair of blocks of the rows (label, text, and more), of a schema.

    Within, blocks are of one label. A pair of blocks comes once, a block with itself too. A block has about `most` of the weight (1 a row)
    and LETTERS letters. Rows without label or text are left out.
    """
    own = texts.where("label IS NOT NULL AND text IS NOT NULL").withColumn("_group", F.col("label").cast("string") if within else F.lit(""))
    sizes = own.groupBy("_group").agg(F.sum(F.lit(1) if weight is None else weight).alias("_w"), F.sum(F.length("text")).alias("_l"))
    sizes = sizes.select("_group", F.ceil(F.greatest(F.col("_w") / most, F.col("_l") / LETTERS, F.least(F.col("_w") / LEAST, F.lit(float(SPREAD))))).cast("int").alias("_blocks"))
    dealt = own.join(sizes if within else F.broadcast(sizes), "_group").withColumn("_block", F.pmod(F.xxhash64(*texts.columns), "_blocks").cast("int"))
    place = lambda x: F.struct(F.least(x, "_block").alias("i"), F.greatest(x, "_block").alias("j"), (x < F.col("_block")).alias("second"))
    pairs = dealt.withColumn("_p", F.explode(F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), place))).select("_group", F.col("_p.i").alias("_i"), F.col("_p.j").alias("_j"), F.col("_p.second").alias("_second"), *texts.columns)
    spark = texts.sparkSession
    tasks = max(8 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        same = table["_i"][0].as_py() == table["_j"][0].as_py()
        second = table["_second"]
        a, b = table.filter(pa.compute.invert(second)), table.filter(second)
        b = a if same else b
        sides = [np.unique(np.array(t["text"].to_pylist(), dtype=object), return_inverse=True) for t in (a, b)]
        (x, i), (y, j) = sides
        found = similarities(x.tolist(), y.tolist())
        return fold(a, b, found[i][:, j], same)

    return pairs.repartition(tasks, "_group", "_i", "_j").groupBy("_group", "_i", "_j").applyInArrow(run, schema)


class Trie:
    """Templates (number, text) by their letters: each node has its letters' nodes, and the numbers and length of the texts that end there."""

    def __init__(self, templates: list[tuple[int, str]]):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        for number, text in templates:
            at = 0
            for letter in text:
                to = self.children[at].get(letter)
                if to is None:
                    to = self.children[at][letter] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                at = to
            self.ends[at].append(number)

    def within(self, text: str, most: int) -> list[tuple[int, float, int]]:
        """(distance, share of the longer length, number) of the templates at most that far."""
        n, out = len(text), []
        todo = [(0, 0, list(range(n + 1)))]
        while todo:
            node, depth, row = todo.pop()
            if self.ends[node] and row[n] <= most:
                out += [(row[n], row[n] / max(n, depth, 1), number) for number in self.ends[node]]
            for letter, to in self.children[node].items():
                above, new = row[0], [row[0] + 1]
                last = least = new[0]
                for j in range(1, n + 1):
                    here = row[j]
                    value = above if text[j - 1] == letter else above + 1
                    if here + 1 < value:
                        value = here + 1
                    if last + 1 < value:
                        value = last + 1
                    new.append(value)
                    last, above = value, here
                    if value < least:
                        least = value
                if least <= most:
                    todo.append((to, depth + 1, new))
        return out

    def nearest(self, text: str, top: int) -> list[tuple[int, float, int]]:
        """The first `top` templates by distance, share of the length and number."""
        most, longest = 0, len(text)
        while True:
            found = self.within(text, most)
            # A template that is farther than both lengths together doesn't exist, so the search ends there.
            if len(found) >= top or most > longest + self.depth:
                return sorted(found)[:top]
            most = most + 1 if most < 4 else 2 * most

    @property
    def depth(self) -> int:
        own = getattr(self, "_depth", None)
        if own is None:
            level, own = [0], -1
            while level:
                own, level = own + 1, [c for n in level for c in self.children[n].values()]
            self._depth = own
        return own


def nearest_templates(texts: DataFrame, templates: list[tuple[int, str]], top: int) -> DataFrame:
    """text, template_id, distance, ratio: the `top` nearest of the templates for each row of texts (text); each task builds their trie once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = None
        for b in batches:
            trie = trie or Trie(templates)
            rows = [(t, number, distance, ratio) for t in b["text"] for distance, ratio, number in trie.nearest(t, top)]
            yield pd.DataFrame(rows, columns=["text", "template_id", "distance", "ratio"])

    return texts.select("text").mapInPandas(run, "text string, template_id long, distance int, ratio double")
