"""Views of the driver tables in the shapes that the operators take, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the packet view: destination by event type, port by k modulo 8.
DESTINATIONS = {"click": "192.168.1.100", "error": "8.8.8.8", "purchase": "10.0.0.5", "signup": "224.0.0.251", "view": "239.255.255.250"}
PORTS = [80, 443, 502, 1883, 5353, 1900, 43893, 22]
TCP_PORTS = [80, 443, 502, 1883, 22]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as packets: capture_id, idx, ts_us, ts, src, dst, proto, src_port, dst_port, port, size, payload, direction, kind."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    dst = F.coalesce(*[F.when(F.col("event_type") == t, F.lit(ip)) for t, ip in DESTINATIONS.items()])
    port = F.element_at(F.array(*map(F.lit, PORTS)), k % len(PORTS) + 1)
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts AS TIMESTAMP_NTZ))")
    return e.select(
        (F.col("user_id") % 8).alias("capture_id"), F.col("event_id").alias("idx"), us.alias("ts_us"), (us / 1e6).alias("ts"), F.concat(F.lit("10.0.0."), (F.col("user_id") % 250).cast("string")).alias("src"), dst.alias("dst"),
        F.when(port.isin(TCP_PORTS), 6).otherwise(17).alias("proto"), (1024 + F.col("user_id") % 50000).cast("int").alias("src_port"), port.alias("dst_port"), port.alias("port"), (40 + F.floor(F.col("value") * 10) % 1460).cast("int").alias("size"), F.col("props").alias("payload"),
        F.when(F.col("event_id") % 2 == 0, "up").otherwise("down").alias("direction"), F.col("event_type").alias("kind"), k.alias("k"), "value",
    )


P = """p AS (SELECT user_id % 8 AS capture_id, event_id AS idx, epoch_us(ts) AS ts_us, epoch_us(ts) / 1000000.0::DOUBLE AS ts, '10.0.0.' || (user_id % 250) AS src,
  CASE event_type WHEN 'click' THEN '192.168.1.100' WHEN 'error' THEN '8.8.8.8' WHEN 'purchase' THEN '10.0.0.5' WHEN 'signup' THEN '224.0.0.251' WHEN 'view' THEN '239.255.255.250' END AS dst,
  CASE WHEN port IN (80, 443, 502, 1883, 22) THEN 6 ELSE 17 END AS proto, CAST(1024 + user_id % 50000 AS INTEGER) AS src_port, port AS dst_port, port, CAST(40 + CAST(floor(value * 10) AS BIGINT) % 1460 AS INTEGER) AS size, props AS payload,
  CASE WHEN event_id % 2 = 0 THEN 'up' ELSE 'down' END AS direction, event_type AS kind, k, value
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k, [80, 443, 502, 1883, 5353, 1900, 43893, 22][CAST(json_extract(props, '$.k') AS INTEGER) % 8 + 1] AS port FROM events))"""


def actions(spark: SparkSession, sf_dir: str, size: int = 6) -> DataFrame:
    """Events as action steps: seq_id (user and each `size` of the user's events in time order), pos from 0, action."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_type", (F.row_number().over(order) - 1).alias("n"))
    return e.select(F.concat_ws("-", F.col("user_id").cast("string"), F.floor(F.col("n") / size).cast("string")).alias("seq_id"), (F.col("n") % size).alias("pos"), F.col("event_type").alias("action"))


A = """a AS (SELECT user_id || '-' || (n // 6) AS seq_id, CAST(n % 6 AS INTEGER) AS pos, event_type AS action FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events)),
s AS (SELECT seq_id, list(action ORDER BY pos) AS seq FROM a GROUP BY seq_id)"""


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of documents, pages and conversations as payloads: origin, id, text."""
    docs = table(spark, sf_dir, "documents").select(F.lit("document").alias("origin"), F.col("doc_id").cast("string").alias("id"), "text")
    pages = table(spark, sf_dir, "pages").select(F.lit("page").alias("origin"), F.col("page_id").cast("string").alias("id"), F.col("html").alias("text"))
    talks = table(spark, sf_dir, "conversations").select(F.lit("turn").alias("origin"), F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text")
    return docs.unionByName(pages).unionByName(talks)


L = """l AS (SELECT 'document' AS origin, CAST(doc_id AS VARCHAR) AS id, text FROM documents UNION ALL SELECT 'page', CAST(page_id AS VARCHAR), html FROM pages UNION ALL SELECT 'turn', conv_id || '-' || turn, text FROM conversations)"""


def with_sql(*parts: str) -> str:
    """The opening of a statement over views: with_sql(P, A)."""
    return "WITH " + ",\n".join(parts)
