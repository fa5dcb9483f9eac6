"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only.

Each document draws the key -ln(u) / weight, u from a hash of its id and the seed; a source's documents in the order of their
keys are a weighted sample without replacement. What a source's target holds of complete epochs takes every document as
often; the rest of the target takes documents in key order up to the rest's words, the last one in part (its first words).
The prefix sums are taken in two steps: key ranges within a source are summed first, so that no source is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Documents of a source that share a range of keys, about.
RANGE = 2_000
#: Sources whose plan is broadcast; more are joined by source.
FEW = 50_000


def n_words(text: str) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float, weights: tuple[float, ...], most: float) -> DataFrame:
    """source, source_size, docs -> with target: weights repeat over the sources by code point, null last; no target is over most * source_size.

    The fixpoint of resharing is min(most * size, weight * level); the level follows from the sources sorted by size over weight.
    """
    everything = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("_w", F.element_at(cycle, (F.row_number().over(everything) - 1) % len(weights) + 1))
    by_cap = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), F.col("source").cast("binary")).rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy()
    capped = ranked.withColumn("_cap", most * F.col("source_size"))
    level = (F.sum("source_size").over(total) * share - F.coalesce(F.sum("_cap").over(by_cap), F.lit(0.0))) / (F.sum("_w").over(total) - F.coalesce(F.sum("_w").over(by_cap), F.lit(0.0)))
    levels = capped.withColumn("_level", level).withColumn("_fits", F.col("_cap") / F.col("_w") >= F.col("_level"))
    chosen = levels.withColumn("_chosen", F.min(F.when(F.col("_fits"), F.struct(F.col("_cap") / F.col("_w"), F.col("_level").alias("level")))).over(total)["level"])
    return chosen.select("source", "source_size", "docs", F.least("_cap", F.col("_w") * F.coalesce("_chosen", F.lit(float("inf")))).alias("target"))


def mix_sources(docs: DataFrame, quality: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 2.0, seed: int = 7, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, size, source_size, target, taken, then the columns `keep` of docs. quality: id and a weight over 0 (others weigh 1).

    taken counts the words that the mix takes of a document, repeats included, at most `most` (2) times its size, and sums to
    the whole part of the target in every source. Null and empty texts have size 0 and are taken 0 times; a null source is a
    source of its own; equal keys are ordered by id, size and a hash of the text, so rows that agree in these are alike and a
    rerun gives the same rows; rows without an id draw by their text; an empty table gives no rows.
    """
    base = docs.select(F.col(id_col).alias("_id"), n_words(text_col).alias("size"), F.col(source_col).alias("source"), F.xxhash64(text_col).alias("_hash"), F.when(F.col(id_col).isNull(), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))).alias("_content"), *[F.col(c).alias(f"_keep_{c}") for c in keep])
    if quality is not None:
        given = quality.select(F.col(quality.columns[0]).alias("_id"), F.col(quality.columns[1]).cast("double").alias("_q")).where("_q > 0").groupBy("_id").agg(F.max("_q").alias("_q"))
        base = base.join(given, "_id", "left")
    weight = F.coalesce("_q", F.lit(1.0)) if quality is not None else F.lit(1.0)
    # 52 bits of an MD5 as u in (0, 1); any SQL engine draws the same.
    drawn = F.coalesce(F.col("_id").cast("string"), F.concat(F.lit("null:"), "_content"))
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), drawn).cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    base = base.withColumns({"_u": u, "_weight": weight}).withColumn("_key", -F.log("_u") / F.col("_weight"))
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    sizes = cut(sizes)
    few = sizes.limit(FEW + 1).count() <= FEW
    plan = targets(sizes, share, weights, most).withColumn("_ranges", F.ceil(F.col("docs") / RANGE))
    plan = plan.withColumn("_epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)).withColumn("_rest", F.floor("target") - F.col("_epochs") * F.col("source_size"))
    joined = base.withColumnRenamed("source", "_own").join(F.broadcast(plan) if few else plan, F.col("_own").eqNullSafe(F.col("source")))
    # 1 - exp(-key) is -expm1(-key): near uniform for weights about 1, and in the order of the keys for any.
    ranged = joined.withColumn("_range", F.least(F.col("_ranges") - 1, F.floor(-F.expm1(-F.col("_key")) * F.col("_ranges"))))
    before = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("source", "_range").agg(F.sum("size").alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    sums = sums.select(F.col("source").alias("_source"), F.col("_range").alias("_r"), "_before")
    # Only the range in which the rest ends needs its order; ranges before it are taken whole, those after it not at all.
    placed = ranged.join(sums, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_range") == F.col("_r")))
    within = Window.partitionBy("source", "_range").orderBy("_key", F.col("_id").isNull(), "_id", "size", "_hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = F.col("_rest") - F.col("_before") - (F.sum("size").over(within) - F.col("size"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), left))
    return placed.select(F.col("_id").alias(id_col), "size", "source_size", "target", (F.col("_epochs") * F.col("size") + part).cast("long").alias("taken"), *[F.col(f"_keep_{c}").alias(c) for c in keep])
