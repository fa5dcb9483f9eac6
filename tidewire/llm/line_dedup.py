"""Removal of repeated passages of lines: overlapping windows of three consecutive lines are compared across all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import restored, shielded


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3) -> DataFrame:
    """All columns of docs, with the text cut, and _n_lines, _n_removed.

    Lines end at \\n. A window is `window` consecutive lines that hold a visible character; windows are the same when their
    lines are equal byte for byte. A window's first occurrence is that of the least document id (nulls last), then of the
    least line; all lines that any later occurrence covers go. Documents of fewer lines keep them all; a null text stays
    null with 0 lines, an empty one has one line. Rows that share an id share its place in this order, so equal windows at
    equal lines of such rows are first occurrences alike; an empty table gives no rows. Columns of docs may have any names,
    but those of the results (_n_lines, _n_removed) are replaced by them.
    """
    own, new = shielded(docs)
    key, text = F.col(new[id_col]), F.col(new[text_col])
    place = F.struct(F.col("id").isNull().alias("no"), F.col("id").alias("id"), F.col("line").alias("line"))
    starts = F.when(F.size("lines") >= window, F.sequence(F.lit(0), F.size("lines") - window))
    passage = lambda i: F.array_join(F.slice("lines", i + 1, window), "\n")
    rows = own.select(key.alias("id"), F.xxhash64(text).alias("hash"), F.split(text, "\n").alias("lines"))
    windows = rows.select("id", "hash", F.explode(F.transform(starts, lambda i: F.struct(i.alias("line"), passage(i).alias("passage")))).alias("w"))
    windows = windows.where(F.col("w.passage").rlike(r"\S")).select("id", "hash", F.col("w.line").alias("line"), F.unhex(F.md5(F.col("w.passage").cast("binary"))).alias("key"))
    firsts = windows.groupBy("key").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last")
    # The key is made anew so that both sides are shuffled for the join, which lets a very common window be split among tasks.
    firsts = firsts.select(F.concat("key", F.lit(b"")).alias("key"), "first")
    later = windows.join(firsts, "key").where(place != F.col("first"))
    cuts = later.groupBy("id", "hash").agg(F.collect_set("line").alias("starts"))
    found = own.join(cuts, key.eqNullSafe(F.col("id")) & (F.xxhash64(text) == F.col("hash")), "left")
    gone = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + window - 1))))
    # The lines are bound to a variable, so that the text is split once and not for each line that stays.
    stay = lambda lines: F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone), lambda i: F.get(lines, i))
    kept = F.transform(F.array(F.split(text, "\n")), lambda lines: F.array_join(stay(lines), "\n"))[0]
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n"))).cast("long")
    n_removed = F.when(F.col("starts").isNull(), 0).otherwise(F.size(gone)).cast("long")
    out = found.withColumns({"n_lines": n_lines, "n_removed": n_removed, new[text_col]: F.when(F.col("starts").isNull(), text).otherwise(kept)})
    return restored(out, new, {"_n_lines": F.col("n_lines"), "_n_removed": F.col("n_removed")})
