"""Scalar functions as column expressions."""

from __future__ import annotations

import hashlib
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_us(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp's wall-clock reading, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def epoch_s(ts: Column) -> Column:
    return F.floor(epoch_us(ts) / 1_000_000).cast("long")


def batch_floor(t: Column, width: int) -> Column:
    return t - t % width


def cast_prefix_int(s: Column) -> Column:
    """The leading whole number of a text, 0 for anything else."""
    return F.coalesce(F.regexp_extract(s, r"^\s*([+-]?\d+)", 1).try_cast("long"), F.lit(0).cast("long"))


def as_uint8(x: Column, compat_signed: bool = False) -> Column:
    """Truncate to eight bits. compat_signed reads 200 as -56, as an old client does."""
    low = F.pmod(x.cast("long"), F.lit(256))
    return F.when(low > 127, low - 256).otherwise(low) if compat_signed else low


def lenient_decimal(s: Column) -> Column:
    """An optional minus, digits and a fraction; no exponent; what follows is ignored."""
    return F.coalesce(F.regexp_extract(s, r"^(-?\d*\.?\d*)", 1).try_cast("double"), F.lit(0.0))


def sanitize(s: Column) -> Column:
    return F.translate(s, "<>", "[]")


def metric_name(s: Column) -> Column:
    return F.translate(s, ":|@", "___")


def ipv6(s: Column) -> Column:
    return F.translate(s, "_", ":")


def size_bytes(s: Column) -> Column:
    """'12K', '3 MB', '1.5G' to bytes, by powers of 1024; null if it is no size."""
    n = F.regexp_extract(s, r"(?i)^\s*([0-9]+(?:\.[0-9]+)?)\s*([KMGTP]?)I?B?\s*$", 1).try_cast("double")
    unit = F.upper(F.regexp_extract(s, r"(?i)^\s*([0-9]+(?:\.[0-9]+)?)\s*([KMGTP]?)I?B?\s*$", 2))
    power = F.when(unit == "K", 1).when(unit == "M", 2).when(unit == "G", 3).when(unit == "T", 4).when(unit == "P", 5).otherwise(0)
    return F.floor(n * F.pow(F.lit(1024.0), power)).cast("long")


def uri_escape(s: Column, keep_slash: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(F.url_encode(s), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))
    return F.replace(out, F.lit("%2F"), F.lit("/")) if keep_slash else out


def uri_unescape(s: Column) -> Column:
    """A plus stays a plus; a text with an encoded zero byte, or a broken escape, is null."""
    return F.when(~F.contains(s, F.lit("%00")), F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))))


def query_map(s: Column) -> Column:
    return F.str_to_map(s, F.lit("&"), F.lit("="))


def param_int(params: Column, name: str, default: int) -> Column:
    return F.coalesce(F.try_element_at(params, F.lit(name)).try_cast("long"), F.lit(default).cast("long"))


def range_header(h: Column, size: Column) -> Column:
    """An HTTP Range of one or more parts to an array of (start, end): ends are cut to the size, parts that begin beyond it go."""
    parts = F.split(F.regexp_replace(h, r"^bytes=", ""), ",")

    def one(p: Column) -> Column:
        a = F.regexp_extract(p, r"^\s*(\d*)\s*-\s*(\d*)\s*$", 1)
        b = F.regexp_extract(p, r"^\s*(\d*)\s*-\s*(\d*)\s*$", 2)
        tail = (a == "") & (b != "")
        start = F.when(tail, F.greatest(size - b.try_cast("long"), F.lit(0))).otherwise(a.try_cast("long"))
        end = F.when(tail | (b == ""), size - 1).otherwise(F.least(b.try_cast("long"), size - 1))
        return F.struct(start.alias("start"), end.alias("end"))

    return F.filter(F.transform(parts, one), lambda r: r["start"].isNotNull() & (r["start"] < size) & (r["start"] <= r["end"]))


def used_factor(replicas: Column, ec_on: Column, ec_mode: Column) -> Column:
    """Space used for each stored byte: the replica count, or (k + m) / k when erasure coding is on."""
    k, m = F.shiftright(ec_mode, 8).bitwiseAND(255), ec_mode.bitwiseAND(255)
    return F.when(ec_on & (ec_mode != 0) & (k > 0), (k + m) / k).otherwise(replicas.cast("double"))


def chunk_split(text: Column, size: int) -> Column:
    """A text's chunks of ``size`` characters, the last one shorter."""
    n = F.ceil(F.length(text) / size).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * size + 1, F.lit(size)))


def epoch_autodetect(t: Column) -> Column:
    """Seconds, or milliseconds if over 9999999999, as a UTC text."""
    s = F.when(t > 9_999_999_999, F.floor(t / 1000)).otherwise(t).cast("long")
    return F.date_format(F.timestamp_add("SECOND", s, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")), "yyyy-MM-dd HH:mm:ss")


def normalised_latency(delta: Column, size: Column, unit: int) -> Column:
    return F.floor(delta / F.ceil(size / unit)).cast("long")


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def is_part_name(key: Column) -> Column:
    """Keys of multipart pieces begin with the byte EF."""
    return F.hex(F.encode(key, "utf-8")).startswith("EF")


def bucket_of_host(host: Column, path: Column, domain: str) -> Column:
    """Bucket from a subdomain of ``domain``, else the path's first part."""
    sub = F.when(host.endswith("." + domain), F.regexp_replace(host, "\\." + domain.replace(".", "\\.") + "$", ""))
    return F.coalesce(sub, F.nullif(F.split_part(F.regexp_replace(path, "^/+", ""), F.lit("/"), F.lit(1)), F.lit("")))


def split_at(s: Column, terminator: str) -> list[Column]:
    """What stands before the first terminator, and what stands after it; without one the whole text and null."""
    at = F.position(F.lit(terminator), s)
    return [F.when(at > 0, F.substring(s, F.lit(1), at - 1)).otherwise(s), F.when(at > 0, F.substring(s, at + len(terminator), F.length(s)))]


def composed_name(*parts: Column) -> Column:
    """Parts of a metric name, cleaned and joined by dots; nulls are left out."""
    return F.concat_ws(".", *map(metric_name, parts))


def to_base64(b: Column) -> Column:
    """Without line breaks, which Spark puts after every 76 characters."""
    return F.replace(F.base64(b), F.lit("\r\n"), F.lit(""))


def from_base64(s: Column) -> Column:
    """Null if it is not base64."""
    return F.try_to_binary(s, F.lit("base64"))


def from_hex(s: Column) -> Column:
    """Null if it is not hexadecimal."""
    return F.unhex(s)


def bit_is_set(x: Column, k: Column) -> Column:
    return F.getbit(x, k) == 1


def set_bit(x: Column, k: int) -> Column:
    return x.bitwiseOR(F.lit(1 << k).cast("long"))


def clear_bit(x: Column, k: int) -> Column:
    return x.bitwiseAND(F.lit(~(1 << k)).cast("long"))


def bits_set(x: Column) -> Column:
    return F.bit_count(x)


def is_zero_block(b: Column) -> Column:
    """Whether a block of bytes holds only zeros."""
    return F.length(F.ltrim(F.hex(b), F.lit("0"))) == 0


def sorted_params(params: Column) -> Column:
    """A map's entries in order of their keys, as name=value joined by &."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(params)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "&")


_CRC32C = 0x82F63B78  # fixed value: the reversed Castagnoli polynomial


def crc32c(b: Column) -> Column:
    """CRC-32C of bytes, unsigned; not built in, so Arrow batches."""
    table = []
    for k in range(256):
        for _ in range(8):
            k = k >> 1 ^ (_CRC32C if k & 1 else 0)
        table.append(k)

    @F.pandas_udf("long")
    def digest(values: pd.Series) -> pd.Series:
        def one(v):
            c = 0xFFFFFFFF
            for x in v:
                c = table[(c ^ x) & 255] ^ c >> 8
            return c ^ 0xFFFFFFFF

        return values.map(lambda v: None if v is None else one(v))

    return digest(b)


def compression_ratio(b: Column) -> Column:
    """Bytes after compression over bytes before (1 for none), for choosing whether to store compressed; Arrow batches."""

    @F.pandas_udf("double")
    def ratio(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else len(zlib.compress(v, 1)) / len(v) if v else 1.0)

    return ratio(b)


def hex_id(b: Column) -> Column:
    return F.upper(F.hex(b))


def blake2b_256(c: Column) -> Column:
    """BLAKE2b with 32 bytes, lower-case hexadecimal; not built in, so Arrow batches."""

    @F.pandas_udf("string")
    def digest(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else hashlib.blake2b(v if isinstance(v, bytes) else str(v).encode(), digest_size=32).hexdigest())

    return digest(c)
