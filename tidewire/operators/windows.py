"""Time series operators: trailing flow features, fixed windows, sessions, runs, smoothing.

Gaps, trailing features, sessions, runs and count windows go through `scans.Ordered`, so a flow or capture of any size spreads over all
tasks. The other windows are partitioned by capture and a fixed window, or by what runs and sessions have left of a capture.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .scans import HOT, Ordered


def flow_id() -> Column:
    return F.concat_ws("|", F.least("src", "dst"), F.greatest("src", "dst"))


def _burst(gaps: Column) -> Column:
    """1 + the longest run of true values."""
    start = F.struct(F.lit(1).alias("n"), F.lit(1).alias("most"))
    return F.aggregate(gaps, start, lambda a, g: F.struct(F.when(g, a["n"] + 1).otherwise(1).alias("n"), F.greatest(a["most"], F.when(g, a["n"] + 1).otherwise(1)).alias("most")), lambda a: a["most"])


def intervals(packets: DataFrame, keys: list[str], order: list[str], most: int = HOT) -> DataFrame:
    """Adds interval: seconds since the row of the group before it, 0 for the first."""
    return Ordered(packets, keys, order, most).reach(lambda rows, w: rows.withColumn("interval", F.coalesce(F.col("ts_us") - F.lag("ts_us").over(w), F.lit(0)) / 1e6), 1).table()


def trailing_flow_features(packets: DataFrame, window: int = 20, burst_us: int = 10_000, most: int = HOT) -> DataFrame:
    """Features of each packet from the last `window` packets of its flow: gaps, direction balance, burst, periodicity, sizes.

    Gaps are taken from whole microseconds; the first packet of a window has none, so gap frames are one row shorter, and
    those of gap differences two.
    """

    def add(rows: DataFrame, flow: WindowSpec) -> DataFrame:
        last, gaps, jumps = flow.rowsBetween(1 - window, 0), flow.rowsBetween(2 - window, 0), flow.rowsBetween(3 - window, 0)
        rows = rows.withColumn("_gap", F.col("ts_us") - F.lag("ts_us").over(flow)).withColumn("_jump", F.abs(F.col("_gap") - F.lag("_gap").over(flow)))
        ms = F.col("_gap") / 1000.0
        n = F.count(F.lit(1)).over(last)
        mean, std = F.avg(ms).over(gaps), F.stddev_pop(ms).over(gaps)
        many = lambda c: F.when(n > 1, c).otherwise(0.0)
        up, down = (F.count(F.when(F.col("direction") == d, 1)).over(last) for d in ("up", "down"))
        size_mean = F.avg("size").over(last)
        return rows.withColumns({
            "iat_mean": many(mean), "iat_std": many(std), "iat_cv": many(std / F.greatest(mean, F.lit(0.001))), "direction_balance": (up - down) / F.greatest(up + down, F.lit(1)),
            "burst_intensity": many(_burst(F.collect_list(F.col("_gap") < burst_us).over(gaps)).cast("double")), "periodicity_score": F.when(n > 2, 1 / (1 + F.avg(F.col("_jump") / 1000.0).over(jumps))).otherwise(0.0),
            "size_cv": many(F.stddev_pop("size").over(last) / F.greatest(size_mean, F.lit(1.0))),
        }).drop("_gap", "_jump")

    # Nothing that a row gets depends on more than the window - 1 rows before it.
    return Ordered(packets.withColumn("flow", flow_id()), ["capture_id", "flow"], ["ts_us", "idx"], most).reach(add, window - 1).table().drop("flow")


def whole_flow_features(packets: DataFrame, burst_us: int = 10_000, most: int = HOT) -> DataFrame:
    """The same features once for each flow of a capture; periodicity needs more than three gaps."""

    def add(rows: DataFrame, flow: WindowSpec) -> DataFrame:
        rows = rows.withColumn("_gap", F.col("ts_us") - F.lag("ts_us").over(flow))
        return rows.withColumns({"_jump": F.abs(F.col("_gap") - F.lag("_gap").over(flow)), "_far": F.when(F.col("_gap") < burst_us, 0).otherwise(1)})

    # Bursts as islands of short gaps, so that no flow is gathered into a list.
    rows = Ordered(packets.withColumn("flow", flow_id()), ["capture_id", "flow"], ["ts_us", "idx"], most).reach(add, 2).running("_island", F.col("_far")).table()
    islands = rows.groupBy("capture_id", "flow", "_island").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"), F.sum(F.col("size").cast("double") * F.col("size")).alias("ss"), F.count("_gap").alias("g"), F.sum("_gap").alias("gs"), F.sum(F.col("_gap").cast("double") * F.col("_gap")).alias("gss"), F.count("_jump").alias("j"), F.sum("_jump").alias("js"), F.sum(F.when(F.col("direction") == "up", 1).otherwise(0)).alias("up"), F.sum(F.when(F.col("direction") == "down", 1).otherwise(0)).alias("down"))
    s = islands.groupBy("capture_id", "flow").agg(F.max("n").alias("burst"), *[F.sum(c).alias(c) for c in ("n", "s", "ss", "g", "gs", "gss", "j", "js", "up", "down")])
    mean, size = F.col("gs") / F.col("g") / 1000, F.col("s") / F.col("n")
    std = F.sqrt(F.greatest(F.col("gss") / F.col("g") / 1e6 - mean * mean, F.lit(0.0)))
    many = lambda c: F.when(F.col("n") > 1, c).otherwise(0.0)
    return s.select(
        "capture_id", "flow", many(mean).alias("iat_mean"), many(std).alias("iat_std"), many(std / F.greatest(mean, F.lit(0.001))).alias("iat_cv"), ((F.col("up") - F.col("down")) / F.greatest(F.col("up") + F.col("down"), F.lit(1))).alias("direction_balance"),
        many(F.col("burst").cast("double")).alias("burst_intensity"), F.when(F.col("g") > 3, 1 / (1 + F.col("js") / F.col("j") / 1000)).otherwise(0.0).alias("periodicity_score"), many(F.sqrt(F.greatest(F.col("ss") / F.col("n") - size * size, F.lit(0.0))) / F.greatest(size, F.lit(1.0))).alias("size_cv"),
    )


def window_features(packets: DataFrame, window_us: int, valid: Column | None = None, kind: Column | None = None, kinds: tuple[int, ...] = ()) -> DataFrame:
    """Fixed windows from each capture's first packet, empty ones included: counts, bytes, directions, sizes, gaps inside the window, ratios.

    With kind and kinds also the number of valid payloads of each message type, and their share of the window's packets.
    """
    valid = F.lit(False) if valid is None else valid
    types = {f"msg_type_{k:02x}_count": F.count_if(F.col("_valid") & (F.col("_kind") == k)) for k in kinds}
    first = packets.groupBy("capture_id").agg(F.min_by("ts_us", "idx").alias("_t0"))
    rows = packets.join(first, "capture_id").withColumn("window_idx", F.floor((F.col("ts_us") - F.col("_t0")) / window_us))
    own = Window.partitionBy("capture_id", "window_idx").orderBy("idx")
    rows = rows.withColumns({"_gap": (F.col("ts_us") - F.lag("ts_us").over(own)) / 1000.0, "_valid": valid, "_kind": F.lit(None).cast("int") if kind is None else kind})
    count = lambda test: F.count_if(test)
    total = lambda test: F.sum(F.when(test, F.col("size")).otherwise(0))
    up, down = F.col("direction") == "up", F.col("direction") == "down"
    seen = rows.groupBy("capture_id", "window_idx").agg(
        F.count(F.lit(1)).alias("pkt_count"), F.sum("size").alias("byte_count"), count(up).alias("up_pkt_count"), count(down).alias("down_pkt_count"), total(up).alias("up_bytes"), total(down).alias("down_bytes"), count(F.col("proto") == 6).alias("tcp_count"), count(F.col("proto") == 17).alias("udp_count"),
        count(F.col("size") <= 128).alias("small_count"), count(F.col("size") >= 1000).alias("large_count"), F.avg("size").alias("mean_len"), F.stddev_pop("size").alias("std_len"), F.avg("_gap").alias("mean_iat_ms"), F.stddev_pop("_gap").alias("std_iat_ms"), count(F.col("_valid")).alias("valid_payload_count"), F.sum(F.when(F.col("_valid"), F.octet_length("payload")).otherwise(0)).alias("payload_byte_count"), *[v.alias(k) for k, v in types.items()],
    )
    grid = seen.groupBy("capture_id").agg(F.max("window_idx").alias("_n")).select("capture_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n"))).alias("window_idx"))
    full = grid.join(seen, ["capture_id", "window_idx"], "left")
    full = full.select("capture_id", "window_idx", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in seen.columns[2:]])
    n = F.greatest(F.col("pkt_count"), F.lit(1))
    return full.withColumns({
        "t_start_s": F.col("window_idx") * (window_us / 1e6), "byte_rate": F.col("byte_count") / (window_us / 1e6), "direction_balance": (F.col("up_pkt_count") - F.col("down_pkt_count")) / n, "len_cv": F.col("std_len") / F.greatest(F.col("mean_len"), F.lit(1.0)),
        "iat_cv": F.col("std_iat_ms") / F.greatest(F.col("mean_iat_ms"), F.lit(1.0)), "small_ratio": F.col("small_count") / n, "large_ratio": F.col("large_count") / n, "valid_payload_ratio": F.col("valid_payload_count") / n,
        **{k.replace("_count", "_ratio"): F.col(k) / n for k in types},
    })


def traffic_profile(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, and mean, std, max and sum of each window column."""
    return rows.groupBy(*keys).agg(*[f(c).cast("double").alias(f"{c}_{name}") for c in columns for name, f in (("mean", F.avg), ("std", F.stddev_pop), ("max", F.max), ("sum", F.sum))])


#: Bytes of a control payload that its profile looks at, and the message types that it counts.
PAYLOAD_BYTES, MESSAGE_TYPES = 380, (1, 2, 3, 4, 5, 6)


def payload_profile(payloads: DataFrame, most: int = HOT) -> DataFrame:
    """capture_id, profile: 1,536 numbers of a capture's valid control payloads (capture_id, idx, ts_us, payload, kind).

    Of each of the first 380 bytes (as a share of 255; 0 past the end) the mean, the deviation, and the mean and deviation of its
    change from payload to payload; of the six message types their number in thousands and share; the number of payloads in thousands,
    the seconds from first to last, mean and deviation of all bytes. Sums per byte go to the shuffle, not bytes.
    """
    padded = F.rpad(F.hex(F.substring("payload", 1, PAYLOAD_BYTES)), 2 * PAYLOAD_BYTES, "0")
    rows = payloads.select("capture_id", "idx", "ts_us", "kind", padded.alias("_hex"))
    rows = Ordered(rows, ["capture_id"], ["idx"], most).reach(lambda df, w: df.withColumn("_before", F.lag("_hex").over(w)), 1).table()
    byte = lambda c: F.conv(F.substring(c, 2 * F.col("pos") + 1, F.lit(2)), 16, 10).cast("double") / 255
    at = rows.select("capture_id", "_hex", "_before", F.explode(F.sequence(F.lit(0), F.lit(PAYLOAD_BYTES - 1))).alias("pos")).select("capture_id", "pos", byte(F.col("_hex")).alias("x"), F.abs(byte(F.col("_hex")) - byte(F.col("_before"))).alias("d"))
    each = at.groupBy("capture_id", "pos").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.coalesce(F.avg("d"), F.lit(0.0)).alias("dm"), F.coalesce(F.stddev_pop("d"), F.lit(0.0)).alias("ds"), F.avg(F.col("x") * F.col("x")).alias("q"))
    lists = each.groupBy("capture_id").agg(F.array_sort(F.collect_list(F.struct("pos", "m", "s", "dm", "ds"))).alias("_l"), F.avg("m").alias("_m"), F.avg("q").alias("_q"))
    totals = rows.groupBy("capture_id").agg(F.count(F.lit(1)).alias("_n"), ((F.max_by("ts_us", "idx") - F.min_by("ts_us", "idx")) / 1e6).alias("_t"), *[F.count_if(F.col("kind") == k).alias(f"_k{k}") for k in MESSAGE_TYPES])
    kinds = [F.col(f"_k{k}") for k in MESSAGE_TYPES]
    parts = [F.col("_l").getField(c) for c in ("m", "s", "dm", "ds")]
    rest = F.array(*[k / 1000 for k in kinds], *[k / F.col("_n") for k in kinds], F.col("_n") / 1000, F.col("_t"), F.col("_m"), F.sqrt(F.greatest(F.col("_q") - F.col("_m") * F.col("_m"), F.lit(0.0))))
    return lists.join(totals, "capture_id").select("capture_id", F.concat(*parts, rest).alias("profile"))


def signal_bins(packets: DataFrame, bin_us: int, bins: int | None = None) -> DataFrame:
    """Sum of sign * size in each bin from the capture's first packet; bins without packets are 0; the last bin is closed."""
    span = packets.groupBy("capture_id").agg(F.min("ts_us").alias("_t0"), F.max("ts_us").alias("_t1"))
    count = F.lit(bins) if bins else F.floor((F.col("_t1") - F.col("_t0")) / bin_us) + 1
    span = span.withColumn("_n", count.cast("long"))
    seen = packets.join(span, "capture_id").groupBy("capture_id", F.least(F.col("_n") - 1, F.floor((F.col("ts_us") - F.col("_t0")) / bin_us)).alias("bin")).agg(F.sum(F.col("sign") * F.col("size")).alias("value"))
    return span.select("capture_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("bin")).join(seen, ["capture_id", "bin"], "left").select("capture_id", "bin", F.coalesce("value", F.lit(0)).alias("value"))


def signal_summary(packets: DataFrame) -> DataFrame:
    return packets.groupBy("capture_id").agg(F.count(F.lit(1)).alias("packets"), ((F.max("ts_us") - F.min("ts_us")) / 1e6).alias("duration_s"), F.count_if(F.col("sign") > 0).alias("positive"), F.count_if(F.col("sign") < 0).alias("negative"), F.avg("size").alias("mean_length"), F.stddev_pop("size").alias("std_length"))


def trim_silence(signal: DataFrame, eps: float = 0.0) -> DataFrame:
    """Without the bins before the first and after the last value over eps; nothing if there is none."""
    edges = signal.where(F.abs("value") > eps).groupBy("capture_id").agg(F.min("bin").alias("_a"), F.max("bin").alias("_b"))
    return signal.join(edges, "capture_id").where(F.col("bin").between(F.col("_a"), F.col("_b"))).select(*signal.columns)


def sessions(rows: DataFrame, keys: list[str], time: str, order: str, gap: int, most: int = HOT) -> DataFrame:
    """Adds session: a number from 0 that grows where the time since the row before is over the gap."""
    own = Ordered(rows, keys, list(dict.fromkeys([time, order])), most)
    new = lambda df, w: df.withColumn("_new", F.when(F.col(time) - F.lag(time).over(w) > gap, 1).otherwise(0))
    return own.reach(new, 1).running("session", F.col("_new")).table().drop("_new")


def session_summary(rows: DataFrame, keys: list[str], time: str, order: str, gap: int, least_rows: int = 1, least_time: int = 0) -> DataFrame:
    out = sessions(rows, keys, time, order, gap).groupBy(*keys, "session").agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("start"), F.max(time).alias("end"))
    return out.where((F.col("n") >= least_rows) & (F.col("end") - F.col("start") >= least_time))


def count_windows(rows: DataFrame, keys: list[str], order: str, size: int = 32, stride: int = 8, most: int = HOT) -> DataFrame:
    """Each row once for each full window of `size` rows, `stride` apart, that holds it: adds window and position."""
    counts = rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("_n"))
    numbered = Ordered(rows, keys, [order], most).running("_rn", F.lit(1)).table().withColumn("_rn", F.col("_rn") - 1)
    match = F.lit(True)
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    numbered = numbered.join(counts, match).drop(*[f"_k{i}" for i in range(len(keys))])
    first, last = F.greatest(F.lit(0), F.ceil((F.col("_rn") - size + 1) / stride)), F.least(F.floor(F.col("_rn") / stride), F.floor((F.col("_n") - size) / stride))
    fits = numbered.where((F.col("_n") >= size) & (first <= last))
    return fits.withColumn("window", F.explode(F.sequence(first.cast("long"), last.cast("long")))).withColumn("position", F.col("_rn") - F.col("window") * stride).drop("_rn", "_n")


def time_windows(rows: DataFrame, keys: list[str], time: str, length: int, step: int, least: int = 1) -> DataFrame:
    """(keys, start, n) of the windows [start, start + length), `step` apart from each key's first row, of at least `least` rows."""
    first = rows.groupBy(*keys).agg(F.min(time).alias("_t0"))
    at = F.col(time) - F.col("_t0")
    starts = F.sequence(F.greatest(F.lit(0), F.floor((at - length) / step) + 1).cast("long"), F.floor(at / step).cast("long"))
    out = rows.join(first, keys).select(*keys, F.explode(starts).alias("w")).groupBy(*keys, (F.col("w") * step).alias("start")).agg(F.count(F.lit(1)).alias("n"))
    return out.where(F.col("n") >= least)


def runs(rows: DataFrame, keys: list[str], order: str, value: str, most: int = HOT) -> DataFrame:
    """Adds run: the number, from 1, of the stretch of equal values that the row is in."""
    new = lambda df, w: df.withColumn("_new", F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.lag(F.lit(1)).over(w) == 1), 0).otherwise(1))
    return Ordered(rows, keys, [order], most).reach(new, 1).running("run", F.col("_new")).table().drop("_new")


def merge_runs(rows: DataFrame, keys: list[str], order: str, value: str, score: str | None = None) -> DataFrame:
    """One row per run: value, first and last of the order column, n, mean score."""
    extra = [F.avg(score).alias("mean_score")] if score else []
    return runs(rows, keys, order, value).groupBy(*keys, "run", value).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n"), *extra)


def compress_runs(rows: DataFrame, keys: list[str], order: str, symbol: str, most: int = 3) -> DataFrame:
    """keys and text: the symbols in order, runs cut to `most`."""
    w = Window.partitionBy(*keys, "run").orderBy(order)
    kept = runs(rows, keys, order, symbol).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most)
    return kept.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, symbol))), lambda x: x[symbol]), "").alias("text"))


def changed_only(rows: DataFrame, keys: list[str], order: str, value: str, most: int = 100) -> DataFrame:
    """keys and history: values that differ from the one before, the last `most` of them."""
    w = Window.partitionBy(*keys).orderBy(order)
    kept = rows.withColumn("_p", F.lag(value).over(w)).where(~F.col(value).eqNullSafe(F.col("_p")))
    last = kept.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where(F.col("_r") <= most)
    return last.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("history"))


def smooth_labels(rows: DataFrame, keys: list[str], order: str, label: str, radius: int = 1) -> DataFrame:
    """Adds smoothed: the most frequent label of the rows around, the first seen of equal ones."""
    around = F.collect_list(label).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(-radius, radius))
    marked = F.transform(F.array_distinct("_around"), lambda x: F.struct((-F.size(F.filter("_around", lambda y: y == x))).alias("n"), F.array_position("_around", x).alias("at"), x.alias("label")))
    return rows.withColumn("_around", around).withColumn("smoothed", F.array_min(marked)["label"]).drop("_around")


def activity_segments(windows: DataFrame, gap: int = 5, least: int = 3) -> DataFrame:
    """Segments of active windows: bytes + packets at least max(1, first quartile of positive values); the whole capture if none holds.

    A segment ends before a pause of more than `gap` windows.
    """
    rows = windows.withColumn("_a", (F.col("byte_count") + F.col("pkt_count")).cast("double"))
    level = rows.groupBy("capture_id").agg(F.greatest(F.lit(1.0), F.coalesce(F.percentile(F.when(F.col("_a") > 0, F.col("_a")), F.lit(0.25)), F.lit(1.0))).alias("_level"), F.min("window_idx").alias("_lo"), F.max("window_idx").alias("_hi"))
    active = rows.join(level, "capture_id").where(F.col("_a") >= F.col("_level")).select("capture_id", "window_idx")
    out = sessions(active, ["capture_id"], "window_idx", "window_idx", gap).groupBy("capture_id", "session").agg(F.min("window_idx").alias("first"), F.max("window_idx").alias("last"))
    out = out.where(F.col("last") - F.col("first") + 1 >= least).select("capture_id", "first", "last")
    rest = level.join(out, "capture_id", "left_anti").select("capture_id", F.col("_lo").alias("first"), F.col("_hi").alias("last"))
    return out.unionByName(rest)


def true_clusters(rows: DataFrame, keys: list[str], order: str, flag: str) -> DataFrame:
    """Per key: number of stretches of true rows, their mean and longest length, mean pause between them, span from first to last."""
    islands = merge_runs(rows, keys, order, flag).where(flag)
    w = Window.partitionBy(*keys).orderBy("first")
    gaps = islands.withColumn("_pause", F.col("first") - F.lag("last").over(w) - 1)
    return gaps.groupBy(*keys).agg(F.count(F.lit(1)).alias("clusters"), F.avg("n").alias("mean_length"), F.max("n").alias("longest"), F.coalesce(F.avg("_pause"), F.lit(0.0)).alias("mean_pause"), (F.max("last") - F.min("first") + 1).alias("span"))


def suppress_repeats(rows: DataFrame, keys: list[str], time: str, label: str, within: int) -> DataFrame:
    """keys and kept: events (time, label) without those of the label of a kept event that began less than `within` before.

    The anchor is the last kept event. An event `within` or more after the one before it is always kept, so events are cut
    there first, and only the pieces between such gaps, a few events each, are folded in order.
    """
    new = lambda df, w: df.withColumn("_new", F.when(F.col(time) - F.lag(time).over(w) < within, 0).otherwise(1))
    pieces = Ordered(rows, [*keys, label], [time]).reach(new, 1).running("_piece", F.col("_new")).table()
    own = F.array_sort(F.collect_list(F.col(time)))
    fold = F.aggregate(own, F.array().cast("array<bigint>"), lambda a, t: F.when((F.size(a) == 0) | (t - F.element_at(a, -1) >= within), F.concat(a, F.array(t.cast("bigint")))).otherwise(a))
    folded = pieces.groupBy(*keys, label, "_piece").agg(fold.alias("_kept"))
    return folded.groupBy(*keys, label).agg(F.array_sort(F.flatten(F.collect_list("_kept"))).alias("kept"))


def fold_short_runs(runs: list[list], least: float) -> list[list]:
    """Runs [first, last, label, confidence, windows] in order, short ones folded, in one pass.

    The first run below `least` (last - first) goes into the one before it, the first of all into the next; the run that takes it
    keeps its label, covers both, has the mean of their confidences and the sum of their windows. All runs before the one at
    hand are long enough, so one pass reaches the fixpoint. At the end neighbours of one label are joined likewise.
    """
    short = lambda r: r[1] - r[0] < least
    into = lambda r, x: [min(r[0], x[0]), max(r[1], x[1]), r[2], (r[3] + x[3]) / 2, r[4] + x[4]]
    out: list[list] = []
    for r in runs:
        if len(out) == 1 and short(out[0]):
            out[0] = into(r, out[0])
        elif out and short(r):
            out[-1] = into(out[-1], r)
        else:
            out.append(list(r))
    joined: list[list] = []
    for r in out:
        if joined and joined[-1][2] == r[2]:
            joined[-1] = into(joined[-1], r)
        else:
            joined.append(r)
    return joined


def merge_short_runs(rows: DataFrame, keys: list[str], least: float) -> DataFrame:
    """keys, first, last, label, confidence, windows: runs below `least` in length merged, see fold_short_runs.

    The result depends on order, so each key is folded in one function call over its runs; rows lack nothing of these columns.
    """
    import pandas as pd

    columns = ["first", "last", "label", "confidence", "windows"]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        own = fold_short_runs(pdf.sort_values("first")[columns].values.tolist(), least)
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in keys), *r] for r in own], columns=[*keys, *columns])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.groupBy(*keys).applyInPandas(fold, ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, *columns]))


def zscore(df: DataFrame, columns: list[str], *by: str) -> DataFrame:
    """Columns less their mean over their population deviation (1 where that is 0), the statistics broadcast or joined by the keys."""
    stats = df.groupBy(*by).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    joined = df.join(stats, list(by)) if by else df.join(F.broadcast(stats))
    return joined.select(*[((F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0)).alias(c) if c in columns else F.col(c) for c in df.columns])


def min_max(df: DataFrame, columns: list[str]) -> DataFrame:
    stats = df.agg(*[F.min(c).alias(f"_l_{c}") for c in columns], *[F.max(c).alias(f"_h_{c}") for c in columns])
    return df.join(F.broadcast(stats)).select(*[((F.col(c) - F.col(f"_l_{c}")) / (F.col(f"_h_{c}") - F.col(f"_l_{c}") + 1e-8)).alias(c) if c in columns else F.col(c) for c in df.columns])
