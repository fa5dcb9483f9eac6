"""Capture files (classic pcap) as frame rows, and the headers of frames as Columns."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Magic numbers of classic pcap files: byte order and fractions of a second in a time stamp.
MAGICS = {b"\xd4\xc3\xb2\xa1": ("<", 1_000), b"\xa1\xb2\xc3\xd4": (">", 1_000), b"\x4d\x3c\xb2\xa1": ("<", 1), b"\xa1\xb2\x3c\x4d": (">", 1)}

FRAMES = "capture_id string, idx long, ts_us long, orig_len long, frame binary, status string"


def frames_of(content: bytes) -> Iterator[tuple[int, int, int, bytes | None, str]]:
    """(number from 1, microseconds, original length, bytes, status) of each record; a truncated record ends the file with a row of that status."""
    magic = MAGICS.get(bytes(content[:4]))
    if magic is None or len(content) < 24:
        yield 0, 0, 0, None, "bad"
        return
    order, nanos = magic
    record, at, n = struct.Struct(order + "IIII"), 24, 0
    while at < len(content):
        n += 1
        if at + 16 > len(content):
            yield n, 0, 0, None, "truncated"
            return
        seconds, fraction, kept, length = record.unpack_from(content, at)
        if at + 16 + kept > len(content):
            yield n, 0, 0, None, "truncated"
            return
        yield n, seconds * 1_000_000 + fraction * nanos // 1_000, length, bytes(content[at + 16 : at + 16 + kept]), "ok"
        at += 16 + kept


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["capture_id", "idx", "ts_us", "orig_len", "frame", "status"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            rows: list[tuple] = []
            for row in frames_of(memoryview(content.as_buffer()) if content.is_valid else b""):
                rows.append((path, *row))
                if len(rows) == 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def decode_captures(files: DataFrame) -> DataFrame:
    """Frame rows of a table (path, content); a file is read in one task, its frames are numbered before any filter."""
    return files.select(F.col("path").cast("string").alias("path"), "content").mapInArrow(_decode, FRAMES)


def read_captures(spark: SparkSession, folder: str) -> DataFrame:
    """Frame rows of all *.pcap files below a folder."""
    return decode_captures(spark.read.format("binaryFile").option("pathGlobFilter", "*.pcap").option("recursiveFileLookup", "true").load(folder))


def capture_label(path: Column) -> Column:
    """The name of a capture's folder."""
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


def capture_counters(frames: DataFrame) -> DataFrame:
    """Per capture: frames, bad and truncated records, frames with a VLAN tag."""
    return frames.groupBy("capture_id").agg(F.count_if(F.col("status") == "ok").alias("frames"), F.count_if(F.col("status") == "bad").alias("bad"), F.count_if(F.col("status") == "truncated").alias("truncated"), F.count_if(F.hex(F.substring("frame", 13, 2)) == "8100").alias("vlan"))


def unsigned(data: Column, at: Column | int, n: int) -> Column:
    """n bytes from a 1-based place as a big-endian number; null past the end."""
    at = F.lit(at) if isinstance(at, int) else at
    own = F.substring(data, at, F.lit(n))
    return F.when(F.octet_length(own) == n, F.conv(F.hex(own), 16, 10).cast("long"))


def unsigned_little(data: Column, at: int, n: int) -> Column:
    return sum((unsigned(data, at + i, 1) * (1 << (8 * i)) for i in range(1, n)), unsigned(data, at, 1))


def decode_headers(frames: DataFrame) -> DataFrame:
    """Adds Ethernet, VLAN, IPv4, TCP and UDP fields; nulls where a frame has none. ip_payload keeps the transport header, payload doesn't."""
    f = F.col("frame")
    vlan = F.hex(F.substring(f, 13, 2)) == "8100"
    out = frames.withColumn("_ip", F.when(vlan, 19).otherwise(15)).withColumn("ethertype", unsigned(f, F.col("_ip") - 2, 2))
    ip = F.col("_ip")
    first = unsigned(f, ip, 1)
    out = out.withColumn("_v4", (F.col("ethertype") == 0x0800) & (F.shiftright(first, 4) == 4))
    own = lambda c: F.when(F.col("_v4"), c)
    address = lambda at: own(F.concat_ws(".", *[unsigned(f, ip + at + i, 1).cast("string") for i in range(4)]))
    out = out.withColumns({"_ihl": own(first.bitwiseAND(F.lit(15)) * 4), "ip_len": own(unsigned(f, ip + 2, 2)), "proto": own(unsigned(f, ip + 9, 1)), "src": address(12), "dst": address(16)})
    out = out.withColumn("_l4", (ip + F.col("_ihl")).cast("int"))
    l4, ports = F.col("_l4"), F.col("proto").isin(6, 17)
    head = F.when(F.col("proto") == 6, F.shiftright(unsigned(f, l4 + 12, 1), 4) * 4).when(F.col("proto") == 17, 8)
    rest = lambda at: F.substring(f, at.cast("int"), F.greatest(F.col("_ip") + F.col("ip_len") - at, F.lit(0)).cast("int"))
    out = out.withColumns({"src_port": F.when(ports, unsigned(f, l4, 2)).cast("int"), "dst_port": F.when(ports, unsigned(f, l4 + 2, 2)).cast("int"), "tcp_flags": F.when(F.col("proto") == 6, unsigned(f, l4 + 13, 1)).cast("int"), "ip_payload": own(rest(l4)), "payload": F.when(ports, rest(l4 + head))})
    return out.withColumn("port", F.coalesce(F.when(ports, F.col("dst_port")), F.lit(0))).drop("_ip", "_v4", "_ihl", "_l4")


def protocol(df_payload: Column, proto: Column, src_port: Column, dst_port: Column) -> Column:
    """Name of the protocol by ports and the payload's first bytes."""
    either = lambda *p: src_port.isin(*p) | dst_port.isin(*p)
    text = F.make_valid_utf8(F.substring(df_payload, 1, 16).cast("string"))
    http = text.rlike(r"^(GET|POST|PUT|DELETE|HEAD|OPTIONS|PATCH|HTTP/)")
    tls = F.hex(F.substring(df_payload, 1, 2)).rlike("^(14|15|16|17|18)03$")
    return F.when(either(80, 8080) & http, "http").when(either(443) & tls, "tls").when(either(53), "dns").when(either(1883), "mqtt").when(either(502), "modbus").when(http, "http").when(tls, "tls").when(proto == 6, "tcp").when(proto == 17, "udp").otherwise("unknown")


def fixed_layout(payload: Column, fields: list[tuple[str, str, int]]) -> Column:
    """A struct of (name, kind, length) fields one after the other; null from the first that doesn't fit. Kinds: int, str, bytes."""
    out, at = [], 1
    for name, kind, n in fields:
        raw = F.when(F.octet_length(payload) >= at + n - 1, F.substring(payload, at, n))
        out.append({"int": F.conv(F.hex(raw), 16, 10).cast("long"), "str": F.rtrim(F.translate(F.make_valid_utf8(raw.cast("string")), "\0", "")), "bytes": raw}[kind].alias(name))
        at += n
    return F.struct(*out)


def http_fields(payload: Column) -> Column:
    """method, path, version, headers (the last of equal names counts) and body of an HTTP message."""
    text = F.make_valid_utf8(payload.cast("string"))
    head, body = F.substring_index(text, "\r\n\r\n", 1), F.when(text.contains("\r\n\r\n"), F.regexp_extract(text, r"(?s)\r\n\r\n(.*)$", 1))
    lines = F.split(head, "\r\n")
    first = F.split(F.get(lines, F.lit(0)), " ")
    pairs = F.transform(F.filter(F.slice(lines, F.lit(2), F.greatest(F.size(lines), F.lit(0))), lambda x: x.contains(":")), lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.trim(F.regexp_extract(x, "^[^:]*:(.*)$", 1)).alias("v")))
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["k"] == x["k"]))
    return F.struct(F.get(first, F.lit(0)).alias("method"), F.get(first, F.lit(1)).alias("path"), F.get(first, F.lit(2)).alias("version"), F.map_from_entries(last).alias("headers"), body.alias("body"))


def tls_fields(payload: Column) -> Column:
    return F.struct(unsigned(payload, 1, 1).alias("type"), unsigned(payload, 2, 2).alias("version"), unsigned(payload, 4, 2).alias("length"))


def modbus_fields(payload: Column) -> Column:
    return F.struct(unsigned(payload, 1, 2).alias("transaction"), unsigned(payload, 3, 2).alias("protocol_id"), unsigned(payload, 5, 2).alias("length"), unsigned(payload, 7, 1).alias("unit"), unsigned(payload, 8, 1).alias("function"))


def mqtt_fields(payload: Column) -> Column:
    """Type and flags of the first byte, and the length in up to four bytes of 7 bits."""
    b = [unsigned(payload, i, 1) for i in range(2, 6)]
    total, more = b[0].bitwiseAND(F.lit(127)), b[0] >= 128
    for i in range(1, 4):
        total, more = total + F.when(more, b[i].bitwiseAND(F.lit(127)) * (1 << (7 * i))).otherwise(0), more & (b[i] >= 128)
    return F.struct(F.shiftright(unsigned(payload, 1, 1), 4).alias("type"), unsigned(payload, 1, 1).bitwiseAND(F.lit(15)).alias("flags"), total.alias("length"))


def dns_header(payload: Column) -> Column:
    flags = unsigned(payload, 3, 2)
    return F.struct(unsigned(payload, 1, 2).alias("id"), F.shiftright(flags, 15).alias("qr"), F.shiftright(flags, 11).bitwiseAND(F.lit(15)).alias("opcode"), unsigned(payload, 5, 2).alias("questions"), unsigned(payload, 7, 2).alias("answers"))


def dns_question(payload: Column) -> Column:
    """name, type and class of the first question: labels of a length byte and that many bytes, up to a length of 0; null without one.

    A name holds at most 127 labels; a label that the payload cuts off ends it.
    """
    start = F.struct(F.lit(13).alias("at"), F.array().cast("array<string>").alias("labels"), F.lit(True).alias("on"))
    size = lambda s: F.coalesce(unsigned(payload, s["at"], 1), F.lit(0)).cast("int")
    more = lambda s: s["on"] & (size(s) > 0) & (size(s) < 64)

    def step(s: Column, _: Column) -> Column:
        label = F.make_valid_utf8(F.substring(payload, s["at"] + 1, size(s)).cast("string"))
        return F.when(more(s), F.struct((s["at"] + 1 + size(s)).alias("at"), F.concat(s["labels"], F.array(label)).alias("labels"), F.lit(True).alias("on"))).otherwise(F.struct(s["at"].alias("at"), s["labels"].alias("labels"), F.lit(False).alias("on")))

    end = F.aggregate(F.sequence(F.lit(1), F.lit(127)), start, step)
    found = F.struct(F.array_join(end["labels"], ".").alias("name"), unsigned(payload, end["at"] + 1, 2).alias("type"), unsigned(payload, end["at"] + 3, 2).alias("class"))
    return F.when(unsigned(payload, 5, 2) > 0, found)


# Lengths of valid control payloads by message type, and their subtypes.
CONTROL_LENGTHS = {1: (52, 212), 2: (108,), 3: (108,), 4: (16,), 5: (60,), 6: (380,)}
CONTROL_SUBTYPES = (9,)
CONTROL_HEADER = 12


def control_type(payload: Column) -> Column:
    """The message type of a control payload: its first byte."""
    return unsigned(payload, 1, 1)


def control_status(payload: Column) -> Column:
    """ok, or why a control payload isn't valid.

    Tests in order: no payload (not_udp), a payload below the header's 12 bytes (payload_short), the type and subtype bytes, the
    little-endian number in bytes 5 to 8, which must be the bytes after the header (data_len_mismatch), and the type's lengths.
    """
    kind, n = control_type(payload), F.octet_length(payload)
    usual = F.coalesce(*[F.when(kind == k, n.isin(*v)) for k, v in CONTROL_LENGTHS.items()])
    return (
        F.when(payload.isNull(), "not_udp").when(n < CONTROL_HEADER, "payload_short").when(~kind.isin(*CONTROL_LENGTHS), "invalid_msg_type").when(~unsigned(payload, 2, 1).isin(*CONTROL_SUBTYPES), "invalid_sub_type")
        .when(unsigned_little(payload, 5, 4) != n - CONTROL_HEADER, "data_len_mismatch").when(~usual, "unexpected_payload_len").otherwise("ok")
    )
