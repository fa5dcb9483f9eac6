"""Features of payload bytes and texts: byte features in one vectorised pass, the rest as Columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that text features flag.
KEYWORDS = ["select", "union", "script", "exec", "system", "cmd", "powershell", "bash"]

# TCP flags and HTTP methods in the order of their feature columns.
TCP_FLAGS = ["U", "A", "P", "R", "S", "F"]
HTTP_METHODS = ["GET", "POST", "PUT", "DELETE", "HEAD", "OPTIONS", "PATCH"]

#: Features of the bytes; all 0 for an empty payload.
BYTE_FEATURES = ["length", "log_length", "mean", "std", "min", "max", "median", "unique", "entropy", "null_ratio", "printable_ratio", "ascii_ratio", "frequency_std", "frequency_skew", "zero_runs", "full_runs", "longest_run"]


def _byte_features(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """features x rows, from the counts of each row's byte values and from its runs of equal bytes."""
    n = end - begin
    row = np.repeat(np.arange(len(n)), n)
    own = np.concatenate([data[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)] or [data[:0]]).astype(np.int64)
    counts = np.bincount(row * 256 + own, minlength=256 * len(n)).reshape(-1, 256)
    some, values = np.maximum(n, 1), np.arange(256)
    mean = counts @ values / some
    below = np.cumsum(counts, axis=1)
    middle = [(below > np.maximum(at, 0)[:, None]).argmax(axis=1) for at in ((n - 1) // 2, n // 2)]
    share = counts / some[:, None]
    std = np.sqrt(np.maximum(counts @ values**2 / some - mean**2, 0))
    off = share - np.minimum(n, 1)[:, None] / 256
    spread = np.sqrt((off**2).mean(axis=1))
    entropy = -np.where(share > 0, share * np.log2(np.where(share > 0, share, 1)), 0).sum(axis=1)
    new = np.r_[True, (own[1:] != own[:-1]) | (row[1:] != row[:-1])][: len(own)]
    first = np.flatnonzero(new)
    runs, at, what = np.diff(np.r_[first, len(own)]), row[first], own[first]
    longest = np.zeros(len(n))
    np.maximum.at(longest, at, runs)
    of = lambda value: np.bincount(at[what == value], minlength=len(n))
    seen = counts > 0
    out = [n, np.log(n + 1), mean, std, seen.argmax(axis=1), np.where(n > 0, 255 - seen[:, ::-1].argmax(axis=1), 0), np.where(n > 0, (middle[0] + middle[1]) / 2, 0), seen.sum(axis=1), entropy, share[:, 0], share[:, 32:127].sum(axis=1), share[:, :128].sum(axis=1), spread, np.where(spread > 0, (off**3).mean(axis=1) / np.where(spread > 0, spread, 1) ** 3, 0), of(0), of(255), longest]
    return np.stack([np.asarray(x, dtype=np.float64) for x in out])


def byte_features(payload: Column) -> Column:
    """A struct of BYTE_FEATURES (doubles) of a binary or text column; null is empty. zero_runs and full_runs count runs of bytes 0 and 255."""

    @F.arrow_udf(", ".join(f"{c} double" for c in BYTE_FEATURES))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            column = column.fill_null(b"")
            _, offsets, raw = column.buffers()
            offsets = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, dtype=np.int64)
            data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
            parts, lo = [np.zeros((len(BYTE_FEATURES), 0))], 0
            while lo < len(column):  # a few megabytes at a time, or one payload
                hi = max(lo + 1, min(len(column), lo + 2048, int(np.searchsorted(offsets, offsets[lo] + (4 << 20)))))
                parts.append(_byte_features(data, offsets[lo:hi], offsets[lo + 1 : hi + 1]))
                lo = hi
            yield pa.StructArray.from_arrays([pa.array(x) for x in np.concatenate(parts, axis=1)], names=BYTE_FEATURES)

    return run(F.coalesce(payload.cast("binary"), F.unhex(F.lit(""))))


def coerced(payload: Column, kind: str) -> tuple[Column, Column]:
    """The bytes and the text of a payload given as binary, text or an array of byte values; bytes that aren't UTF-8 are left out of the text."""
    if kind == "string":
        return payload.cast("binary"), payload
    raw = payload if kind == "binary" else F.unhex(F.array_join(F.transform(payload, lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")), ""))
    # Invalid sequences become the replacement mark, which is then left out; a text from an array of values is empty.
    text = F.translate(F.make_valid_utf8(raw.cast("string")), "\ufffd", "") if kind == "binary" else F.lit("")
    return raw, F.coalesce(text, F.lit(""))


def protocol_features(protocol: Column, fields: dict[str, Column]) -> dict[str, Column]:
    """Columns of all protocols, 0 where a row is of another one: ports, numbers of the header, TCP flags and HTTP methods one by one, headers.

    fields: src_port, dst_port, seq, ack, window, flags (text), request_line, headers (map), body, and numbers by their feature's name.
    """
    get = lambda k: F.coalesce(fields[k].cast("double"), F.lit(0.0)) if k in fields else F.lit(0.0)
    of = lambda name, c: F.when(protocol == name, c).otherwise(0.0)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    text = lambda k: F.coalesce(fields[k], F.lit("")) if k in fields else F.lit("")
    headers = fields.get("headers", F.lit(None).cast("map<string,string>"))
    out = {f"tcp_{a}": of("tcp", get(b)) for a, b in (("sport", "src_port"), ("dport", "dst_port"), ("seq", "seq"), ("ack", "ack"), ("window", "window"))}
    out |= {f"tcp_flag_{k.lower()}": of("tcp", flag(text("flags").contains(k))) for k in TCP_FLAGS}
    out |= {"udp_sport": of("udp", get("src_port")), "udp_dport": of("udp", get("dst_port"))}
    out |= {f"http_method_{k.lower()}": of("http", flag(text("request_line").startswith(k))) for k in HTTP_METHODS}
    has = lambda k: flag(F.map_contains_key(headers, k))
    out |= {"http_header_count": of("http", F.coalesce(F.size(F.map_keys(headers)), F.lit(0)).cast("double")), "http_content_length": of("http", F.coalesce(F.try_element_at(headers, F.lit("Content-Length")).try_cast("double"), F.lit(0.0))), "http_body_len": of("http", F.length(text("body")).cast("double")), "http_has_user_agent": of("http", has("User-Agent")), "http_has_referer": of("http", has("Referer")), "http_has_cookie": of("http", has("Cookie"))}
    for name, parts in (("dns", ("id", "qr", "opcode", "query_count", "answer_count")), ("tls", ("content_type", "version", "length")), ("mqtt", ("msg_type", "flags", "remaining_len")), ("modbus", ("function", "unit_id")), ("can", ("id", "dlc"))):
        out |= {f"{name}_{k}": of(name, get(f"{name}_{k}")) for k in parts}
    known = protocol.isin("tcp", "udp", "http", "dns", "tls", "mqtt", "modbus", "can")
    return out | {"protocol_unknown": (~F.coalesce(known, F.lit(False))).cast("double")}


def byte_array(payload: Column) -> Column:
    """The bytes as numbers from 0 to 255; empty for null."""
    pairs = F.regexp_extract_all(F.hex(F.coalesce(payload.cast("binary"), F.unhex(F.lit("")))), F.lit("(..)"), F.lit(1))
    return F.transform(pairs, lambda x: F.conv(x, 16, 10).cast("int"))


def byte_entropy(payload: Column) -> Column:
    """Shannon entropy in bits of the bytes; 0 for none."""
    return byte_features(payload)["entropy"]


def byte_statistics(payload: Column) -> dict[str, Column]:
    """Length, moments, order statistics and shares of the bytes."""
    own = byte_features(payload)
    return {c: own[c] for c in ("length", "log_length", "mean", "std", "min", "max", "median", "unique", "null_ratio", "printable_ratio", "ascii_ratio")}


def gram_counts(text: Column, n: int) -> Column:
    """A struct: how many n-grams of characters (n up to 3) a text has, and how many different ones; 0 for null."""

    @F.arrow_udf("ngrams double, distinct double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            many, different = np.zeros(len(column)), np.zeros(len(column))
            for i, item in enumerate(column):
                points = np.frombuffer((item.as_py() or "").encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
                if len(points) >= n:
                    keys = points[: len(points) - n + 1].copy()
                    for j in range(1, n):
                        keys = (keys << np.uint64(21)) | points[j : len(points) - n + 1 + j]
                    many[i], different[i] = len(keys), len(np.unique(keys))
            yield pa.StructArray.from_arrays([pa.array(many), pa.array(different)], names=["ngrams", "distinct"])

    return run(F.coalesce(text, F.lit("")))


def text_statistics(text: Column, gram: int = 3) -> dict[str, Column]:
    """Length, words, shares of character classes, character n-grams and keyword flags."""
    n, low = F.length(text), F.lower(text)
    ratio = lambda c: F.when(n > 0, c / n).otherwise(0.0)
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    grams = gram_counts(text, gram)
    out = {
        "length": n.cast("double"), "words": F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).cast("double"), "upper_ratio": ratio(count(r"[A-Z]")), "lower_ratio": ratio(count(r"[a-z]")), "digit_ratio": ratio(count(r"[0-9]")), "special_ratio": ratio(count(r"[^A-Za-z0-9\s]")),
        "ngrams": grams["ngrams"], "distinct_ngrams": grams["distinct"],
    }
    return out | {f"has_{w}": low.contains(w).cast("int") for w in KEYWORDS}


def frequency_moments(payload: Column) -> dict[str, Column]:
    """Population standard deviation and skew of the 256 byte frequencies, zero cells included."""
    own = byte_features(payload)
    return {"frequency_std": own["frequency_std"], "frequency_skew": own["frequency_skew"]}


def longest_run(payload: Column) -> Column:
    """Largest number of equal bytes in a row; 0 for empty."""
    return byte_features(payload)["longest_run"].cast("int")


def feature_row(raw: Column, text: Column, protocol: Column, fields: dict[str, Column]) -> dict[str, Column]:
    """The whole feature row of a payload: bytes, protocol, text and byte distribution, all doubles, under one name each."""
    own = byte_features(raw)
    out = {f"byte_{c}": own[c] for c in BYTE_FEATURES if c != "longest_run"}
    out |= protocol_features(protocol, fields)
    return out | {f"text_{k}": F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in text_statistics(F.coalesce(text, F.lit("")), 2).items()}


# Threat levels and their names for readers.
LEVEL_NAMES = {"SAFE": "正常", "LOW": "低风险异常", "MEDIUM": "可疑载荷", "HIGH": "高危载荷", "CRITICAL": "严重载荷"}


def level_name(level: Column) -> Column:
    """The name of a threat level in any case, SAFE for null; unknown ones in capitals."""
    own = F.upper(F.coalesce(level, F.lit("SAFE")))
    return F.coalesce(*[F.when(own == k, F.lit(v)) for k, v in LEVEL_NAMES.items()], own)


def percent(share: Column) -> Column:
    """A share as percent; null is 0."""
    return F.coalesce(share.cast("double"), F.lit(0.0)) * 100.0


def hex_head(payload: Column, n: int = 20) -> Column:
    return F.lower(F.hex(F.substring(payload.cast("binary"), 1, n)))


def hex_pairs(payload: Column, length: int) -> Column:
    """The first `length` bytes, padded with zeros, as hex pairs with spaces between."""
    padded = F.rpad(F.lower(F.hex(F.substring(payload.cast("binary"), 1, length))), 2 * length, "0")
    return F.regexp_replace(padded, "(..)(?!$)", "$1 ")


def byte_tokens(payload: Column, length: int = 512) -> dict[str, Column]:
    """Ids 4, byte + 6 (255 at most), 5, then zeros up to length; mask and positions."""
    own = F.slice(F.transform(byte_array(payload), lambda x: F.least(x + 6, F.lit(255))), 1, length - 2)
    ids = F.concat(F.array(F.lit(4)), own, F.array(F.lit(5)))
    n = F.size(own) + 2
    return {"ids": F.concat(ids, F.array_repeat(F.lit(0), length - n)), "mask": F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), length - n)), "positions": F.sequence(F.lit(0), F.lit(length - 1))}


def hex_chunks(payload: Column, size: int = 4) -> Column:
    """Hex of each `size` bytes."""
    return F.regexp_extract_all(F.lower(F.hex(payload.cast("binary"))), F.lit(f"(.{{1,{2 * size}}})"), F.lit(1))
