"""Addresses, ports and services as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Service names of well-known ports.
SERVICES = {
    20: "FTP data", 21: "FTP control", 22: "SSH", 23: "Telnet", 25: "SMTP", 53: "DNS", 80: "HTTP", 110: "POP3", 123: "NTP", 143: "IMAP", 443: "HTTPS", 445: "SMB", 502: "Modbus/TCP",
    554: "RTSP", 1883: "MQTT", 4840: "OPC UA", 5672: "AMQP", 5900: "VNC", 6379: "Redis", 7400: "DDS/RTPS", 7401: "DDS/RTPS", 7402: "DDS/RTPS", 8080: "HTTP alternate", 8883: "MQTT over TLS",
    9090: "ROS bridge/WebSocket", 11311: "ROS master",
}

# Private-use IPv4 ranges of the IANA special-purpose registry, as first address and prefix length.
PRIVATE = ["0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4"]
NOT_PRIVATE = ["192.0.0.9/32", "192.0.0.10/32"]


def ip_to_long(ip: Column) -> Column:
    """IPv4 text to a number; null unless it is four parts of 0 to 255."""
    parts = F.split(ip, r"\.")
    ok = ip.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$")
    value = sum((F.get(parts, i).cast("long") * (1 << (24 - 8 * i)) for i in range(1, 4)), F.get(parts, 0).cast("long") * (1 << 24))
    return F.when(ok, value)


def long_to_ip(n: Column) -> Column:
    return F.concat_ws(".", *[F.shiftright(n, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)])


def _span(block: str) -> tuple[int, int]:
    address, bits = block.split("/")
    first = sum(int(x) << s for x, s in zip(address.split("."), (24, 16, 8, 0), strict=True))
    return first, first + (1 << (32 - int(bits))) - 1


def ip_scope(ip: Column) -> Column:
    """private, multicast, public, or invalid, tested in this order; loopback and link-local ranges are private ones."""
    n = ip_to_long(ip)
    inside = lambda block: n.between(*_span(block))
    private, open_ = F.lit(False), F.lit(False)
    for block in PRIVATE:
        private = private | inside(block)
    for block in NOT_PRIVATE:
        open_ = open_ | inside(block)
    return F.when(n.isNull(), "invalid").when(private & ~open_, "private").when(inside("224.0.0.0/4"), "multicast").otherwise("public")


def service_name(port: Column) -> Column:
    """Name of a port, `unknown` for others and for ports up to 0."""
    names = F.create_map(*[x for k, v in SERVICES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.when(port > 0, F.try_element_at(names, port.cast("int"))), F.lit("unknown"))


def ip_bucket(ip: Column) -> Column:
    """A bucket below 10000 that is the same in every process: 32 bits of the MD5."""
    return (F.conv(F.substring(F.md5(ip.cast("binary")), 1, 8), 16, 10).cast("long") % 10000).cast("int")


def location(*parts: Column) -> Column:
    """The parts that aren't blank or '-', joined by spaces; '-' if none."""
    text = F.concat_ws(" ", *[F.when(~F.trim(p).isin("", "-"), F.trim(p)) for p in parts])
    return F.when(text == "", "-").otherwise(text)


def lenient_double(value: Column) -> Column:
    return F.coalesce(F.trim(value).try_cast("double"), F.lit(0.0))


def lenient_int(value: Column) -> Column:
    """Whole part of a number given as text; 0 for blank and other texts."""
    number = F.trim(value).try_cast("double")
    return F.coalesce(F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number)), F.lit(0)).cast("long")
