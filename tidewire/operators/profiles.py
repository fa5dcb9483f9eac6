"""Packet selection, profiles of addresses and ports, connection groups and their verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.net import ip_scope, ip_to_long, service_name


# --- selection -------------------------------------------------------------------------------------------------------
def choose_features(df: DataFrame, features: str | None, allowed: tuple[str, ...], default: tuple[str, ...], keep: tuple[str, ...] = ()) -> DataFrame:
    """Keep named feature columns, after those of the key: comma-separated names or a JSON array; blank means the default; an unknown name is an error."""
    import json

    raw = (features or "").strip()
    names = [str(x).strip() for x in json.loads(raw)] if raw.startswith("[") else [x.strip() for x in raw.split(",")]
    names = [x for x in names if x] or list(default)
    if unknown := [x for x in names if x not in allowed]:
        raise ValueError(f"unsupported features: {', '.join(unknown)}")
    return df.select(*keep, *names)


def filter_ports(packets: DataFrame, include: tuple[int, ...] = (), exclude: tuple[int, ...] = (22,)) -> DataFrame:
    """Drop rows without both ports, rows with an excluded port, and, if ports to include are given, rows without one of them."""
    ports = F.array("src_port", "dst_port")
    out = packets.where(F.col("src_port").isNotNull() & F.col("dst_port").isNotNull())
    if include:
        out = out.where(F.arrays_overlap(ports, F.array(*map(F.lit, include))))
    return out.where(~F.arrays_overlap(ports, F.array(*map(F.lit, exclude)))) if exclude else out


def filter_protocol(packets: DataFrame, protocol: str = "all") -> DataFrame:
    return packets if protocol == "all" else packets.where(F.col("proto") == {"tcp": 6, "udp": 17}[protocol])


def control_packets(packets: DataFrame, flows: DataFrame) -> DataFrame:
    """Rows of the given (src_port, dst_port) flows; all rows of a capture in which none occurs."""
    marked = packets.join(flows.select("src_port", "dst_port").distinct().withColumn("_hit", F.lit(True)), ["src_port", "dst_port"], "left")
    captures = marked.groupBy("capture_id").agg(F.count("_hit").alias("_hits"))
    return marked.join(captures, "capture_id").where(F.col("_hit") | (F.col("_hits") == 0)).select(*packets.columns)


def direction(src: Column, dst: Column, local: list[str] | None = None) -> Column:
    """up from a local address, down to one; otherwise up if the source is the smaller number."""
    by_number = F.when(ip_to_long(src) < ip_to_long(dst), "up").otherwise("down")
    return F.when(src.isin(local), "up").when(dst.isin(local), "down").otherwise(by_number) if local else by_number


def signed_direction(packets: DataFrame, positive: str | None = None) -> DataFrame:
    """Adds sign: +1 for the positive endpoint's packets (its address, or the source of the capture's first packet), else -1."""
    if positive is not None:
        return packets.withColumn("sign", F.when(F.col("src") == positive, 1).otherwise(-1))
    first = packets.groupBy("capture_id").agg(F.min_by("src", "idx").alias("_first"))
    return packets.join(first, "capture_id").withColumn("sign", F.when(F.col("src") == F.col("_first"), 1).otherwise(-1)).drop("_first")


def keep_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns, 0.0 for those that df lacks."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(0.0).alias(c) for c in names])


# --- profiles --------------------------------------------------------------------------------------------------------
def capture_health(packets: DataFrame) -> DataFrame:
    """One row per capture: packets, bytes, first and last time, duration, rate, protocols, multicast, endpoints."""
    scope = ip_scope(F.col("dst"))
    return packets.groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("packets"), F.sum("size").alias("bytes"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), ((F.max("ts_us") - F.min("ts_us")) / 1e6).alias("duration_s"),
        F.count_if(F.col("proto") == 6).alias("tcp"), F.count_if(F.col("proto") == 17).alias("udp"), F.count_if(scope == "multicast").alias("multicast"), F.count_if(F.col("dst").endswith(".255")).alias("broadcast"),
        F.sum(F.octet_length("payload")).alias("payload_bytes"), F.count_if(F.octet_length("payload") == 0).alias("empty"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("destinations"),
        *[F.count_if(F.array_contains(F.array("src_port", "dst_port"), p)).alias(f"port_{p}") for p in (53, 123, 443, 1900)],
    )


def size_distribution(packets: DataFrame, *by: str) -> DataFrame:
    """min, mean, median, p90, p99 and max of sizes; the p-th is the element at int(n * p) of the sorted sizes."""
    # Sizes are counted first: the windows below run over different sizes, not over packets.
    counted = packets.groupBy(*by, "size").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by).orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy(*by)
    ranked = counted.withColumns({"end": F.sum("n").over(w), "total": F.sum("n").over(total)})
    pick = lambda place: F.min(F.when(F.col("end") > place, F.col("size")))
    n = F.col("total")
    return ranked.groupBy(*by).agg(
        F.min("size").alias("min"), (F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"), ((pick(F.floor((n - 1) / 2)) + pick(F.floor(n / 2))) / 2).alias("median"),
        pick(F.least(F.floor(n * 0.9), n - 1)).alias("p90"), pick(F.least(F.floor(n * 0.99), n - 1)).alias("p99"), F.max("size").alias("max"),
    )


def top_talkers(packets: DataFrame, keys: list[str], k: int, by: str = "bytes") -> DataFrame:
    """The k key groups of the most bytes or packets, ties by the keys."""
    out = packets.groupBy(*keys).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("packets"))
    return out.orderBy(F.desc(by), *keys).limit(k)


def address_profile(packets: DataFrame) -> DataFrame:
    """Per address: scope, count, how often it was source and destination, ports it was reached at (sorted, '-' if none)."""
    ends = packets.select(F.col("src").alias("ip"), F.lit(1).alias("s"), F.lit(0).alias("d"), F.lit(None).cast("int").alias("port")).unionByName(packets.select(F.col("dst").alias("ip"), F.lit(0).alias("s"), F.lit(1).alias("d"), F.when(F.col("port") > 0, F.col("port")).alias("port")))
    out = ends.where(F.trim("ip") != "").groupBy(F.trim("ip").alias("ip")).agg(F.sum("s").alias("observed_as_src"), F.sum("d").alias("observed_as_dst"), F.array_sort(F.collect_set("port")).alias("_p"))
    ports = F.when(F.size("_p") > 0, F.array_join(F.col("_p").cast("array<string>"), ", ")).otherwise("-")
    return out.select("ip", ip_scope(F.col("ip")).alias("scope"), (F.col("observed_as_src") + F.col("observed_as_dst")).alias("count"), "observed_as_src", "observed_as_dst", ports.alias("ports"))


def capture_statistics(packets: DataFrame, pad: int = 380, top: int = 5) -> DataFrame:
    """Per capture: packets by protocol, UDP packets with a payload, skipped ones, payload sizes in bands around `pad`, the `top` most frequent ports."""
    udp, n = F.col("proto") == 17, F.col("payload_size")
    full = udp & (n > 0)
    out = packets.groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("total_read"), F.count_if(udp).alias("udp"), F.count_if(F.col("proto") == 6).alias("tcp"), F.count_if(~F.col("proto").isin(6, 17)).alias("other"), F.count_if(full).alias("udp_with_payload"), F.count_if(~udp).alias("skipped_non_udp"), F.count_if(udp & (n == 0)).alias("skipped_empty"),
        F.count_if(full & (n < 50)).alias("below_50"), F.count_if(full & n.between(50, 199)).alias("below_200"), F.count_if(full & n.between(200, pad - 1)).alias(f"below_{pad}"), F.count_if(full & (n == pad)).alias(f"equal_{pad}"), F.count_if(full & (n > pad)).alias(f"over_{pad}"),
    )
    counts = packets.where(F.col("proto").isin(6, 17)).groupBy("capture_id", "port").agg(F.count(F.lit(1)).alias("c"))
    few = counts.withColumn("_r", F.row_number().over(Window.partitionBy("capture_id").orderBy(F.desc("c"), "port"))).where(F.col("_r") <= top)
    ports = few.groupBy("capture_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "port"))), lambda x: x["port"]).alias("top_ports"))
    return out.join(ports, "capture_id", "left")


def port_profile(packets: DataFrame, most: int = 10) -> DataFrame:
    """Per port over 0: service, count, the first `most` source and destination addresses in order.

    Different addresses of a port are found first, and no more than `most` of them a task go on, so that a busy port is no one's list.
    """
    own = packets.where("port > 0")
    out = own.groupBy("port").agg(F.count(F.lit(1)).alias("count"))
    for end in ("src", "dst"):
        place = F.row_number().over(Window.partitionBy("port").orderBy(end))
        few = own.where(F.col(end).isNotNull()).select("port", end).distinct().withColumn("_r", place).where(F.col("_r") <= most)
        lists = few.groupBy("port").agg(F.array_join(F.array_sort(F.collect_list(end)), ", ").alias(f"{end}_ips"))
        out = out.join(lists, "port", "left").withColumn(f"{end}_ips", F.coalesce(f"{end}_ips", F.lit("")))
    return out.withColumn("service", service_name(F.col("port")))


# --- groups and verdicts ---------------------------------------------------------------------------------------------
def connection_groups(candidates: DataFrame, target: str | None = None) -> DataFrame:
    """Candidates by (src, dst): count, ports, sizes, largest entropy and interval, services, scope, whether it is the target."""
    out = candidates.groupBy("src", "dst").agg(
        F.count(F.lit(1)).alias("count"), F.array_sort(F.collect_set(F.when(F.col("port") > 0, F.col("port")))).alias("ports"), F.min("size").alias("size_min"), F.max("size").alias("size_max"), F.max("entropy").alias("entropy_max"), F.max("interval").alias("interval_max")
    )
    names = F.array_sort(F.array_except(F.array_distinct(F.transform("ports", service_name)), F.array(F.lit("unknown"))))
    return out.withColumns({"port_count": F.size("ports"), "services": names, "scope": ip_scope(F.col("dst")), "is_target": F.lit(False) if target is None else F.col("dst") == target})


def group_hints(groups: DataFrame) -> DataFrame:
    """Adds hints: codes of what stands out in a group."""
    tests = {"target": F.col("is_target"), "many_ports": F.col("port_count") >= 5, "public": F.col("scope") == "public", "high_entropy": F.col("entropy_max") >= 7.0, "small_packets": F.col("size_max") <= 80, "dns": F.array_contains("ports", 53)}
    return groups.withColumn("hints", F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in tests.items()])))


def rule_verdict(groups: DataFrame) -> DataFrame:
    """Adds is_risk, reason and confidence where a rule is nearly certain, nulls where none is."""
    has = lambda p: F.array_contains("ports", p)
    rules = [
        ((F.col("dst") == "239.255.255.250") | has(1900), False, "ssdp", 0.97), ((F.col("dst") == "224.0.0.251") | has(5353), False, "mdns", 0.97), (F.col("scope") == "multicast", False, "multicast", 0.9),
        (F.col("scope") == "link-local", False, "link-local", 0.85), (F.col("scope").isin("loopback", "unspecified"), False, "local", 0.8), (F.col("dst").endswith(".255"), False, "broadcast", 0.82), (F.col("port_count") >= 10, True, "port scan", 0.85),
    ]
    pick = lambda i: F.coalesce(*[F.when(r[0], F.lit(r[i])) for r in rules])
    return groups.withColumns({"is_risk": pick(1), "reason": pick(2), "confidence": pick(3)})


def final_verdict(groups: DataFrame, external: DataFrame | None = None) -> DataFrame:
    """Rule verdicts first, then external ones by (src, dst), then the default: no risk, 0.5."""
    own = groups
    if external is not None:
        own = own.join(external.select("src", "dst", F.col("is_risk").alias("_x"), F.col("confidence").alias("_c")), ["src", "dst"], "left")
    else:
        own = own.withColumns({"_x": F.lit(None).cast("boolean"), "_c": F.lit(None).cast("double")})
    source = F.when(F.col("is_risk").isNotNull(), "rule").when(F.col("_x").isNotNull(), "external").otherwise("default")
    return own.withColumns({"verdict_source": source, "confidence": F.coalesce("confidence", "_c", F.lit(0.5)), "is_risk": F.coalesce("is_risk", "_x", F.lit(False))}).drop("_x", "_c")


def judge_summary(judged: DataFrame) -> DataFrame:
    """Counts of groups and packets by verdict, who decided, and whether any group is a risk."""
    risk, n = F.col("is_risk"), F.col("count")
    return judged.agg(
        F.count(F.lit(1)).alias("total_groups"), F.sum(n).alias("total_candidates"), F.count_if(risk).alias("risk_groups"), F.count_if(~risk).alias("benign_groups"), F.coalesce(F.sum(F.when(risk, n)), F.lit(0)).alias("risk_packets"), F.coalesce(F.sum(F.when(~risk, n)), F.lit(0)).alias("benign_packets"),
        F.count_if(F.col("verdict_source") == "rule").alias("rule_decided"), F.count_if(F.col("verdict_source") == "external").alias("external_decided"), F.coalesce(F.bool_or(risk), F.lit(False)).alias("overall_risk"),
    )


def order_groups(groups: DataFrame, limit: int = 40) -> DataFrame:
    """The most suspicious groups first: by ports, target, packets, then addresses."""
    return groups.orderBy(F.desc("port_count"), F.desc("is_target"), F.desc("count"), "src", "dst").limit(limit)


def histogram(df: DataFrame, value: str, bins: int = 28) -> DataFrame:
    """Equal-width bins from the least to the greatest value, the last one closed: bin, center, n. Empty bins are rows too."""
    bounds = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).where("lo IS NOT NULL")
    width = (F.col("hi") - F.col("lo")) / bins
    own = df.select(F.col(value).alias("v")).where("v IS NOT NULL").join(F.broadcast(bounds))
    counts = own.groupBy(F.when(width > 0, F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = bounds.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(counts, "bin", "left").select("bin", (F.col("lo") + width * (F.col("bin") + 0.5)).alias("center"), F.coalesce("n", F.lit(0)).alias("n"))


def edge_histogram(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """Counts between uneven edges, each bin without its upper edge; values outside are left out."""
    rows = df.select(F.coalesce(*[F.when((F.col(value) >= a) & (F.col(value) < b), F.lit(i)) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]).alias("bin"))
    return rows.where("bin IS NOT NULL").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def anomaly_summary(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    return scored.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(label) == -1).alias("abnormal"), F.avg((F.col(label) == -1).cast("double")).alias("ratio"), F.avg(score).alias("mean_score"))


def local_addresses(packets: DataFrame, most: int = 3, frames: int = 5000) -> DataFrame:
    """The `most` private addresses (by text prefix) seen most often among the first frames of each capture."""
    ips = packets.where(F.col("idx") <= frames).select(F.explode(F.array("src", "dst")).alias("ip"))
    private = F.col("ip").startswith("10.") | F.col("ip").startswith("192.168.") | F.col("ip").startswith("172.")
    return ips.where(private).groupBy("ip").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "ip").limit(most)


def control_flows(packets: DataFrame, valid: Column, least: int = 1000, share: float = 0.95) -> DataFrame:
    """Flows (src_port, dst_port) with at least `least` valid payloads that make at least `share` of its packets."""
    out = packets.groupBy("src_port", "dst_port").agg(F.count(F.lit(1)).alias("packets"), F.count_if(valid).alias("valid"))
    return out.where((F.col("valid") >= least) & (F.col("valid") >= share * F.col("packets")))


def merge_captures(a: DataFrame, b: DataFrame, shift_us: int) -> DataFrame:
    """Both captures in time order, the second one's times shifted."""
    return a.unionByName(b.withColumns({"ts_us": F.col("ts_us") + shift_us, "ts": F.col("ts") + shift_us / 1e6})).orderBy("ts_us", "idx")
