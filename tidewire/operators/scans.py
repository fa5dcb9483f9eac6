"""Work in order over groups of any size: windows that look back a few rows, running sums, and ranks of a whole table.

A window puts a group into one task. Groups of up to HOT rows are left to it. Larger ones are dealt to ranges of their order by
Spark's range partitioner, so that a flow that holds most of the rows runs on all cores: windows see, before the first row of a
range, copies of the rows that stand just before it (and lose them afterwards), and running sums get what the ranges before
have summed up. The same sums over ranges number a whole table without a window over all its rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..sources.shared import checkpointed

#: Rows of a group that one window takes.
HOT = 2_000_000


class Ordered:
    """Rows in groups (keys), each in an order, to which windows and running sums are added whatever the size of a group.

    The order is of columns, ascending, nulls first; equal rows of one group stand in any order, so end it with something unique. Rows that
    agree in the whole order aren't parted. Columns that begin with `_scan` are taken.
    """

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], most: int = HOT):
        self.keys, self.order = keys, order
        self.plain, self.ranged = df, None
        counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_scan_n")).where(F.col("_scan_n") > most)
        total = counts.agg(F.sum("_scan_n")).first()[0]
        if not total:
            return
        hot = counts.select(*[F.col(k).alias(f"_scan_{i}") for i, k in enumerate(keys)])
        match = F.lit(True)
        for i, k in enumerate(keys):
            match = match & F.col(k).eqNullSafe(F.col(f"_scan_{i}"))
        self.plain = df.join(hot, match, "left_anti")
        rows = df.join(hot, match, "left_semi").repartitionByRange(-(-2 * total // most), *keys, *order)
        self.ranged = checkpointed(rows.withColumn("_scan_range", F.spark_partition_id()))

    def _window(self, *more: str) -> WindowSpec:
        return Window.partitionBy(*more, *self.keys).orderBy(*self.order)

    def reach(self, add: Callable[[DataFrame, WindowSpec], DataFrame], back: int) -> Ordered:
        """add(rows, window) adds columns by windows that look back up to `back` rows; it must keep all rows and columns."""
        self.plain = add(self.plain, self._window())
        if self.ranged is None:
            return self
        rows, keys = self.ranged, self.keys
        sizes = rows.groupBy("_scan_range", *keys).agg(F.count(F.lit(1)).alias("_scan_n"))
        # Of each range, the ranges of the same group after it and how many rows stand between; each has a row at least, so `back` of them do.
        after = Window.partitionBy(*keys).orderBy("_scan_range").rowsBetween(1, back)
        below = F.sum("_scan_n").over(Window.partitionBy(*keys).orderBy("_scan_range")) - F.col("_scan_n")
        sizes = sizes.withColumn("_scan_below", below)
        nexts = sizes.withColumn("_scan_next", F.collect_list(F.struct(F.col("_scan_range").alias("range"), F.col("_scan_below").alias("below"))).over(after)).where(F.size("_scan_next") > 0)
        ends = rows.withColumn("_scan_back", F.row_number().over(Window.partitionBy("_scan_range", *keys).orderBy(*[F.desc_nulls_last(c) for c in self.order]))).where(F.col("_scan_back") <= back).alias("e")
        nexts = nexts.alias("n")
        match = F.col("e._scan_range") == F.col("n._scan_range")
        for k in keys:
            match = match & F.col(f"e.{k}").eqNullSafe(F.col(f"n.{k}"))
        # Rows of this group between a row and the range that it is copied to: those after it in its own, and the ranges in between.
        near = F.filter("n._scan_next", lambda x: x["below"] - F.col("n._scan_below") - F.col("n._scan_n") + F.col("e._scan_back") <= back)
        copies = ends.join(nexts, match).select(*[F.col(f"e.{c}").alias(c) for c in rows.columns if c != "_scan_range"], F.explode(F.transform(near, lambda x: x["range"])).alias("_scan_range"), F.lit(True).alias("_scan_copy"))
        both = rows.withColumn("_scan_copy", F.lit(False)).unionByName(copies)
        self.ranged = add(both, self._window("_scan_range")).where(~F.col("_scan_copy")).drop("_scan_copy")
        return self

    def running(self, out: str, value: Column) -> Ordered:
        """Adds out: the sum of value over the rows of the group up to this one."""
        so_far = lambda w: F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
        self.plain = self.plain.withColumn(out, so_far(self._window()))
        if self.ranged is None:
            return self
        rows, keys = self.ranged, self.keys
        sums = rows.groupBy("_scan_range", *keys).agg(F.sum(value).alias("_scan_sum"))
        before = F.sum("_scan_sum").over(Window.partitionBy(*keys).orderBy("_scan_range").rowsBetween(Window.unboundedPreceding, -1))
        sums = sums.select("_scan_range", *keys, before.alias("_scan_sum")).alias("s")
        rows = rows.withColumn(out, so_far(self._window("_scan_range"))).alias("r")
        match = F.col("r._scan_range") == F.col("s._scan_range")
        for k in keys:
            match = match & F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}"))
        total = F.when(F.col("s._scan_sum").isNull(), F.col(f"r.{out}")).otherwise(F.col("s._scan_sum") + F.coalesce(F.col(f"r.{out}"), F.lit(0)))
        self.ranged = rows.join(sums, match, "left").select(*[F.col(f"r.{c}").alias(c) for c in rows.columns if c != out], total.alias(out))
        return self

    def table(self) -> DataFrame:
        """All rows with what was added."""
        return self.plain if self.ranged is None else self.plain.unionByName(self.ranged.drop("_scan_range"))


def ranked(df: DataFrame, order: list[Column], sums: dict[str, Column] | None = None) -> DataFrame:
    """Adds position, or each of the sums named: over the rows before, in the given order (ascending, nulls first), from 0.

    Rows are put into ranges of the order by quantiles that Spark samples from it; only the ranges' sums, a row each, pass one
    window, so clustered or equal values of the first column spread over all tasks like others do. Rows equal in the whole order
    stay in one range, in any order.
    """
    sums = {"position": F.lit(1).cast("long")} if sums is None else sums
    names, own = [f"_scan_{i}" for i in range(len(order))], {c: f"_scan_w{i}" for i, c in enumerate(sums)}
    rows = df.withColumns({**dict(zip(names, order, strict=True)), **{own[c]: v for c, v in sums.items()}})
    rows = checkpointed(rows.repartitionByRange(*names).withColumn("_scan_range", F.spark_partition_id()))
    before = Window.orderBy("_scan_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("_scan_range").agg(*[F.sum(w).alias(w) for w in own.values()])
    totals = totals.select("_scan_range", *[F.coalesce(F.sum(w).over(before), F.lit(0)).alias(f"{w}b") for w in own.values()])
    within = Window.partitionBy("_scan_range").orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    # One row for each partition of the table: small enough to send to all tasks.
    placed = rows.join(F.broadcast(totals), "_scan_range").withColumns({c: F.col(f"{w}b") + F.coalesce(F.sum(w).over(within), F.lit(0)) for c, w in own.items()})
    return placed.drop("_scan_range", *names, *own.values(), *[f"{w}b" for w in own.values()])
