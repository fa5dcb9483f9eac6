"""Training sets from corpora and packets: tokens, vocabularies, packing, masking, pairs, splits.

Randomness is a hash of ids, positions and a seed, so a rerun gives the same rows under any partitioning.
"""

from __future__ import annotations

import math
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import checkpointed
from .scans import HOT, Ordered, ranked

RESERVED = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]"]


def unit_hash(*parts: Column | str, seed: int = 0) -> Column:
    """A number in [0, 1) from 52 bits of an MD5, which any engine can draw too."""
    text = F.concat_ws(":", F.lit(str(seed)), *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z0-9]+)"), F.lit(1))


def tokens_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, pos, token."""
    return docs.select(F.col(id_col).alias("id"), F.posexplode(words(F.col(text_col))).alias("pos", "token"))


def lines_to_documents(lines: DataFrame, file: str, order: str, text: str) -> DataFrame:
    """Lines of files as documents: file, doc (a number that grows at blank lines), lines in order. Blank lines belong to none."""
    w = Window.partitionBy(file).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("_blank", F.trim(text) == "").withColumn("doc", F.sum(F.col("_blank").cast("int")).over(w)).where("NOT _blank")
    return rows.groupBy(file, "doc").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]).alias("lines"))


def vocabulary(tokens: DataFrame, least: int = 1, reserved: list[str] | None = None) -> DataFrame:
    """token, n, id: tokens of at least `least` uses by falling frequency, then by name, after the reserved ones.

    Frequencies are counted first; the numbering runs over the vocabulary.
    """
    names = RESERVED if reserved is None else reserved
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= least) & ~F.col("token").isin(names))
    numbered = ranked(counts, [-F.col("n"), F.col("token")]).select("token", "n", (F.col("position") + len(names)).cast("int").alias("id"))
    return tokens.sparkSession.createDataFrame([(t, 0, i) for i, t in enumerate(names)], "token string, n long, id int").unionByName(numbered)


def token_ids(tokens: DataFrame, vocab: DataFrame, length: int, unknown: int = 1) -> DataFrame:
    """id, ids, mask: ids of the first `length` tokens, padded with 0."""
    rows = tokens.where(F.col("pos") < length).join(vocab.select("token", F.col("id").alias("t")), "token", "left")
    own = rows.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("t", F.lit(unknown)).alias("t")))), lambda x: x["t"]).alias("_ids"))
    pad = F.array_repeat(F.lit(0), length - F.size("_ids"))
    return own.select("id", F.concat("_ids", pad).alias("ids"), F.concat(F.array_repeat(F.lit(1), F.size("_ids")), pad).alias("mask"))


def global_positions(df: DataFrame, order: str, weight: Column | None = None) -> DataFrame:
    """Adds position: the sum of weights (1 each) of the rows before, in the given order, from 0; see `scans.ranked`."""
    return ranked(df, [F.col(order)], {"position": F.lit(1).cast("long") if weight is None else weight.cast("long")})


def pack_documents(tokens: DataFrame, length: int) -> DataFrame:
    """block, tokens: the corpus in document order cut to blocks of `length` tokens, the last one shorter.

    A document's place is the sum of the sizes before it; blocks are gathered from its place and the token's.
    """
    sizes = tokens.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    placed = global_positions(sizes, "id", F.col("n"))
    rows = tokens.join(placed.select("id", "position"), "id").withColumn("at", F.col("position") + F.col("pos"))
    return rows.groupBy(F.floor(F.col("at") / length).alias("block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda x: x["token"]).alias("tokens"))


def mask_tokens(tokens: DataFrame, share: float = 0.15, seed: int = 0, epoch: int = 0) -> DataFrame:
    """id, pos, token, masked, shown: of each text max(1, round(share * n)) positions by hash; of those 80 % show [MASK], 10 % another token of the text, 10 % themselves."""
    s = seed * 1_000_003 + epoch
    by = Window.partitionBy("id").orderBy(unit_hash("id", "pos", seed=s), "pos")
    rows = tokens.withColumns({"_r": F.row_number().over(by), "_n": F.count(F.lit(1)).over(Window.partitionBy("id"))}).withColumn("masked", F.col("_r") <= F.greatest(F.lit(1), F.floor(share * F.col("_n") + 0.5)))
    u = unit_hash("id", "pos", seed=s + 1)
    other = F.lead("token", 1).over(by)
    shown = F.when(~F.col("masked"), F.col("token")).when(u < 0.8, "[MASK]").when(u < 0.9, F.coalesce(other, "token")).otherwise(F.col("token"))
    return rows.select("id", "pos", "token", "masked", shown.alias("shown"))


def causal_pairs(tokens: DataFrame) -> DataFrame:
    """id, pos, token, next: the token after each, [SEP] after the last."""
    w = Window.partitionBy("id").orderBy("pos")
    return tokens.select("id", "pos", "token", F.coalesce(F.lead("token").over(w), F.lit("[SEP]")).alias("next"))


def both_way_targets(tokens: DataFrame) -> DataFrame:
    w = Window.partitionBy("id").orderBy("pos")
    return tokens.select("id", "pos", "token", F.coalesce(F.lag("token").over(w), F.lit("[CLS]")).alias("previous"), F.coalesce(F.lead("token").over(w), F.lit("[SEP]")).alias("next"))


def span_targets(masked: DataFrame) -> DataFrame:
    """id, sentinel, first, tokens: each run of masked tokens is one sentinel of its text, numbered from 0."""
    w = Window.partitionBy("id").orderBy("pos")
    new = (F.col("masked") & ~F.coalesce(F.lag("masked").over(w), F.lit(False))).cast("int")
    runs = masked.withColumn("_new", new).withColumn("sentinel", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).where("masked")
    return runs.groupBy("id", "sentinel").agg(F.min("pos").alias("first"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]).alias("tokens"))


def sentence_pairs(sentences: DataFrame, seed: int = 0) -> DataFrame:
    """id, pos, a, b, is_next: each sentence with the one after it or, by hash, with that of another text.

    The partner is the first sentence of the text that follows in hash order, so a join is by rank and not with all texts.
    """
    w = Window.partitionBy("id").orderBy("pos")
    rows = sentences.withColumn("_after", F.lead("text").over(w)).where("_after IS NOT NULL").withColumn("is_next", unit_hash("id", "pos", seed=seed) < 0.5)
    heads = sentences.where("pos = 0").withColumn("_h", unit_hash("id", seed=seed + 1))
    heads = global_positions(heads, "_h")
    n = heads.count()
    partner = heads.select(((F.col("position") + n - 1) % max(n, 1)).alias("_slot"), F.col("text").alias("_other"))
    own = heads.select("id", F.col("position").alias("_slot")).join(partner, "_slot").select("id", "_other")
    return rows.join(own, "id").select("id", "pos", F.col("text").alias("a"), F.when(F.col("is_next"), F.col("_after")).otherwise(F.col("_other")).alias("b"), "is_next")


def order_pairs(sentences: DataFrame, seed: int = 0) -> DataFrame:
    """id, pos, a, b, swapped: consecutive sentences, swapped by hash."""
    w = Window.partitionBy("id").orderBy("pos")
    rows = sentences.withColumn("_after", F.lead("text").over(w)).where("_after IS NOT NULL").withColumn("swapped", unit_hash("id", "pos", seed=seed) < 0.5)
    return rows.select("id", "pos", F.when(F.col("swapped"), F.col("_after")).otherwise(F.col("text")).alias("a"), F.when(F.col("swapped"), F.col("text")).otherwise(F.col("_after")).alias("b"), "swapped")


def repeat_corpus(df: DataFrame, k: int) -> DataFrame:
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))


def hash_split(df: DataFrame, key: str, parts: dict[str, float], seed: int = 0) -> DataFrame:
    """Adds split: by the key's hash, each part about its share of the rows."""
    out, edge, u = None, 0.0, unit_hash(key, seed=seed)
    for name, share in parts.items():
        edge += share
        out = F.when(u < edge, name) if out is None else out.when(u < edge, name)
    return df.withColumn("split", out.otherwise(list(parts)[-1]))


def stratified_split(df: DataFrame, key: str, label: str, parts: dict[str, float], seed: int = 0, most: int = HOT) -> DataFrame:
    """Adds split: exact shares within each label, by rank of the key's hash."""
    sizes = df.groupBy(F.col(label).alias("_label")).agg(F.count(F.lit(1)).alias("_size"))
    rows = Ordered(df.withColumn("_draw", unit_hash(key, seed=seed)), [label], ["_draw", key], most).running("_place", F.lit(1)).table()
    rows = rows.join(sizes, F.col(label).eqNullSafe(F.col("_label")))
    rank = (F.col("_place") - 1) / F.col("_size")
    out, edge = None, 0.0
    for name, share in parts.items():
        edge += share
        out = F.when(rank < edge, name) if out is None else out.when(rank < edge, name)
    return rows.withColumn("split", out.otherwise(list(parts)[-1])).drop("_draw", "_place", "_label", "_size")


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """The n rows of the least hashes of the key."""
    return df.orderBy(unit_hash(key, seed=seed), key).limit(n)


def encode_categories(df: DataFrame, column: str) -> DataFrame:
    """Adds code: the place, from 0, of the value among the different ones in order; joined, not windowed over rows."""
    codes = df.select(column).where(F.col(column).isNotNull()).distinct()
    codes = ranked(codes, [F.col(column)]).select(column, F.col("position").cast("int").alias("code"))
    return df.join(F.broadcast(codes) if codes.limit(100_001).count() <= 100_000 else codes, column, "left")


def impute_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null and NaN values become the mean of the others."""
    clean = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")), F.col(c))
    means = df.agg(*[F.avg(clean(c)).alias(f"_m_{c}") for c in columns])
    return df.crossJoin(F.broadcast(means)).withColumns({c: F.coalesce(clean(c).cast("double"), F.col(f"_m_{c}")) for c in columns}).drop(*[f"_m_{c}" for c in columns])


def finite_or_zero(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null, NaN and infinite values become 0."""
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return df.withColumns({c: F.when(bad(c), 0.0).otherwise(F.col(c)) for c in columns})


def sure_merges(pairs: list[tuple[str, str, int]], known: set[str], room: int, all_: bool) -> list[tuple[str, str]]:
    """The merges that are next, one after the other, as far as the most frequent pairs alone can tell; at least the first.

    pairs: (a, b, n) by falling frequency, then by name; all_: whether there are no others. A pair is sure to be next if none before it in
    the list shares a symbol with it: then its own count stands. A pair that a merge makes occurs at most as often as the one that it
    comes from, which has a symbol of the merge and stands further down; only where that one is as frequent may the new one come first by name, so
    the list ends there. It also ends after a merge into a symbol that is there already, as its counts then add up.
    """
    out: list[tuple[str, str]] = []
    used: set[str] = set()
    for a, b, n in pairs:
        if out:
            tied = any(m == n and (x, y) not in out and (x in used or y in used) for x, y, m in pairs)
            if a in used or b in used or tied or (not all_ and n == pairs[-1][2]):
                break
        out.append((a, b))
        used |= {a, b}
        again = a + b in known
        known.add(a + b)
        if again or len(out) == room:
            break
    return out


def learn_merges(tokens: DataFrame, merges: int, looked_at: int = 2000) -> list[tuple[str, str]]:
    """Byte-pair merges over the different words: the most frequent pair each time, ties by name.

    A round counts all pairs, brings the `looked_at` most frequent to the driver, and does all merges that they make sure, see
    `sure_merges`, in one pass over the words, whose lineage is cut in the shared folder.
    """
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    words_ = checkpointed(counts.select(F.array_compact(F.transform(F.split("token", ""), lambda c: F.when(c != "", c))).alias("parts"), "n").where(F.size("parts") > 1))
    out: list[tuple[str, str]] = []
    known: set[str] = set()

    def merged(batch: list[tuple[str, str]]):
        follows = dict(batch)  # no symbol is in two of them

        def run(batches):
            import pyarrow as pa

            for rows in batches:
                new = []
                for parts in rows.column("parts").to_pylist():
                    own, i = [], 0
                    while i < len(parts):
                        if i + 1 < len(parts) and follows.get(parts[i]) == parts[i + 1]:
                            own.append(parts[i] + parts[i + 1])
                            i += 2
                        else:
                            own.append(parts[i])
                            i += 1
                    new.append(own)
                yield pa.RecordBatch.from_arrays([pa.array(new, type=pa.list_(pa.string())), rows.column("n")], names=["parts", "n"])

        return run

    while len(out) < merges:
        pairs = words_.select("n", F.explode(F.transform(F.sequence(F.lit(0), F.size("parts") - 2), lambda i: F.struct(F.get("parts", i).alias("a"), F.get("parts", i + 1).alias("b")))).alias("p"))
        rows = pairs.groupBy("p.a", "p.b").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "a", "b").limit(looked_at).collect()
        if not rows:
            break
        batch = sure_merges([(r.a, r.b, r.n) for r in rows], known, merges - len(out), len(rows) < looked_at)
        out += batch
        if len(out) < merges:
            words_ = checkpointed(words_.mapInArrow(merged(batch), "parts array<string>, n long").where(F.size("parts") > 1))
    return out


def span_masks(n: int, draws: list[float], order: list[float], share: float, p: float, longest: int) -> list[bool]:
    """Which of n places are masked: spans of geometric length follow each other from the first place; in the order of `order` they are
    taken while they fit the number to mask, a span that doesn't fit is passed over."""
    total = 1 - (1 - p) ** longest
    spans, at = [], 0
    while at < n:
        length = 1 + int(math.log(1 - draws[at] * total) / math.log(1 - p))
        spans.append((order[at], at, min(max(1, min(length, longest)), n - at)))
        at += max(1, min(length, longest))
    left, out = max(1, round(n * share)), [False] * n
    for _, first, length in sorted(spans):
        if length <= left:
            out[first : first + length] = [True] * length
            left -= length
        if not left:
            break
    return out


def mask_spans(tokens: DataFrame, share: float = 0.15, p: float = 0.2, longest: int = 10, length: int = 512, seed: int = 0) -> DataFrame:
    """id, block, pos, token, masked: spans of geometric length cover each sequence of up to `length` tokens, and some of them, about `share` of the
    tokens, are masked (see span_masks). Draws and order come from hashes of id and place, so that a rerun masks the same."""
    own = tokens.select("id", F.floor(F.col("pos") / length).cast("int").alias("block"), "pos", "token", unit_hash("id", "pos", seed=seed).alias("u"), unit_hash("id", "pos", seed=seed + 1).alias("v"))
    rows = own.groupBy("id", "block").agg(F.array_sort(F.collect_list(F.struct("pos", "token", "u", "v"))).alias("rows"))
    rows = rows.select("id", "block", F.transform("rows", lambda r: r["pos"]).alias("pos"), F.transform("rows", lambda r: r["token"]).alias("token"), F.transform("rows", lambda r: r["u"]).alias("u"), F.transform("rows", lambda r: r["v"]).alias("v"))

    @F.pandas_udf("array<boolean>")
    def masks(u: pd.Series, v: pd.Series) -> pd.Series:
        return pd.Series([span_masks(len(a), list(a), list(b), share, p, longest) for a, b in zip(u, v, strict=True)])

    found = rows.withColumn("masked", masks("u", "v"))
    return found.select("id", "block", F.explode(F.arrays_zip("pos", "token", "masked")).alias("r")).select("id", "block", "r.pos", "r.token", "r.masked")


def basic_tokens(text: Column) -> Column:
    """Words of a text: control characters go, CJK characters and signs stand alone, letters are lower-cased and lose their accents."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else _basic_tokens(t))

    return run(text)


_CJK = re.compile("([\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0002a6df\U0002a700-\U0002ceaf\U0002f800-\U0002fa1f])")


def _basic_tokens(text: str) -> list[str]:
    kept = "".join(" " if c in "\t\n\r" else c for c in text if c in "\t\n\r" or not (ord(c) in (0, 0xFFFD) or unicodedata.category(c).startswith("C")))
    plain = "".join(c for c in unicodedata.normalize("NFD", _CJK.sub(r" \1 ", kept).lower()) if unicodedata.category(c) != "Mn")
    sign = lambda c: (c.isascii() and c.isprintable() and not c.isalnum() and c != " ") or unicodedata.category(c).startswith("P")
    return "".join(f" {c} " if sign(c) else c for c in plain).split()


def three_way_pairs(sentences: DataFrame, seed: int = 0) -> DataFrame:
    """id, pos, a, b, kind: the next sentence, that of another text, or the next one with its words in hashed order, each for a third."""
    pairs = sentence_pairs(sentences, seed)
    after = sentences.select("id", (F.col("pos") - 1).alias("pos"), F.col("text").alias("_next"))
    u = unit_hash("id", "pos", seed=seed + 2)
    other = sentence_pairs(sentences, seed).where("NOT is_next").select("id", F.col("b").alias("_other")).groupBy("id").agg(F.min("_other").alias("_other"))
    own = pairs.select("id", "pos", "a").join(after, ["id", "pos"]).join(other, "id", "left")
    shuffled = F.array_join(F.transform(F.array_sort(F.transform(F.split("_next", " "), lambda x, i: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), "id", i.cast("string"), x).cast("binary")).alias("h"), x.alias("x")))), lambda s: s["x"]), " ")
    kind = F.when((u < 1 / 3) & F.col("_other").isNotNull(), "random").when(u < 2 / 3, "next").otherwise("reordered")
    return own.select("id", "pos", "a", F.when(kind == "random", F.col("_other")).when(kind == "next", F.col("_next")).otherwise(shuffled).alias("b"), kind.alias("kind"))


def structured_tokens(field: Column, value: Column) -> Column:
    """Ids of a field's value: numbers modulo 1000 from 1200, other words by 32 bits of their MD5 modulo 500 from 1300, led by the field's own id."""
    word = lambda x: 1300 + F.conv(F.substring(F.md5(x.cast("binary")), 1, 8), 16, 10).cast("long") % 500
    parts = F.regexp_extract_all(F.lower(value), F.lit(r"([0-9]+|[a-z]+)"), F.lit(1))
    return F.concat(F.array(word(F.lower(field))), F.transform(parts, lambda x: F.when(x.rlike("^[0-9]+$"), 1200 + F.coalesce(x.try_cast("decimal(38,0)") % 1000, F.lit(0)).cast("long")).otherwise(word(x))))


# Words of the hybrid vocabulary, numbered from 256 in this order.
HYBRID = "<unk> <pad> <bos> <eos> GET POST HTTP Host User-Agent SELECT FROM WHERE INSERT UPDATE script alert document window cmd exec system bash powershell".split()


def hybrid_tokens(text: Column, known: list[str] | None = None, length: int = 1024) -> Column:
    """A struct: ids of a text's words and signs (known words from 256 on, of others each byte + 4) and starts, the place in the text, from 0, of the word that
    each id belongs to; the first `length` ids. A word is letters, numbers and _; every other character but white space is a sign of its own."""
    names = HYBRID if known is None else known
    codes = F.create_map(*[x for i, w in enumerate(names) for x in (F.lit(w), F.lit(256 + i))])
    pattern, text = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x1c-\x1f\x85\p{Z}]", F.coalesce(text, F.lit(""))
    # Each word gives an id at least, so no more words than ids are looked at.
    words_ = F.slice(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), 1, length)
    gaps = F.slice(F.split(text, pattern), 1, length)
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    starts = F.aggregate(F.zip_with(words_, gaps, lambda w, g: F.struct(w.alias("w"), g.alias("g"))), begin, lambda a, x: F.struct((a["at"] + F.coalesce(F.length(x["g"]), F.lit(0)) + F.coalesce(F.length(x["w"]), F.lit(0))).alias("at"), F.concat(a["starts"], F.array(a["at"] + F.coalesce(F.length(x["g"]), F.lit(0)))).alias("starts")))["starts"]
    own = lambda w: F.when(codes[w].isNotNull(), F.array(codes[w])).otherwise(F.transform(F.split(F.regexp_replace(F.hex(w.cast("binary")), "(..)(?=.)", "$1 "), " "), lambda h: F.conv(h, 16, 10).cast("int") + 4))
    each = F.zip_with(words_, starts, lambda w, s: F.transform(own(w), lambda i: F.struct(i.alias("id"), s.alias("start"))))
    pairs = F.slice(F.flatten(F.filter(each, lambda x: x.isNotNull())), 1, length)
    return F.struct(F.transform(pairs, lambda p: p["id"]).alias("ids"), F.transform(pairs, lambda p: p["start"]).alias("starts"))


def split_words(tokens: DataFrame, vocabulary_: list[str], unknown: str = "[UNK]") -> DataFrame:
    """id, pos, pieces: each word cut into the longest vocabulary entries from the left, later ones led by ##; unknown if none fits.

    The different words are cut once, in Arrow batches, and joined back; the vocabulary is a bounded list that goes to the tasks.
    """
    from collections.abc import Iterator

    import pandas as pd

    known = frozenset(vocabulary_)
    longest = max(map(len, known), default=1)

    def cut(word: str) -> list[str]:
        out, at = [], 0
        while at < len(word):
            lead = "##" if at else ""
            end = next((e for e in range(min(len(word), at + longest), at, -1) if lead + word[at:e] in known), 0)
            if not end:
                return [unknown]
            out.append(lead + word[at:end])
            at = end
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"token": b["token"], "pieces": b["token"].map(cut)})

    pieces = tokens.select("token").distinct().mapInPandas(run, "token string, pieces array<string>")
    return tokens.join(pieces, "token").select("id", "pos", "pieces")
