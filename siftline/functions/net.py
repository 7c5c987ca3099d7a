"""Scalar functions on addresses, protocols, days and statistics, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IPV4 = r"^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$"
IPV6 = r"^[0-9A-Fa-f:]*:[0-9A-Fa-f:]*:[0-9A-Fa-f:.]*$"


def protocol_name(value: Column, variant: str = "generic") -> Column:
    """Names of protocol numbers; any other value in upper case. The query variant knows
    no number of ICMP."""
    numbers = {"17": "UDP", "6": "TCP"} | ({} if variant == "query" else {"1": "ICMP"})
    out = F.upper(value)
    for number, name in numbers.items():
        out = F.when(value == number, name).otherwise(out)
    return out


def u16(value: Column) -> Column:
    """An unsigned 16-bit number, else null."""
    number = F.when(value.rlike(r"^\+?[0-9]{1,10}$"), value.cast("long"))
    return F.when(number <= 65535, number.cast("int"))


def is_ip(value: Column) -> Column:
    return value.rlike(IPV4) | value.rlike(IPV6)


def ipv4_number(value: Column) -> Column:
    """The address as a number, null if it is no IPv4 address."""
    p = F.split(value, r"\.")
    part = lambda i: F.get(p, F.lit(i)).try_cast("long")
    return F.when(value.rlike(IPV4), part(0) * 16777216 + part(1) * 65536 + part(2) * 256 + part(3))


def cidr_bounds(cidr: Column) -> tuple[Column, Column]:
    """First and last address of a network; null for a bare address."""
    address = ipv4_number(F.split_part(cidr, F.lit("/"), F.lit(1)))
    bits = F.when(cidr.contains("/"), F.split_part(cidr, F.lit("/"), F.lit(2)).try_cast("int"))
    size = F.when(bits.between(0, 32), F.pow(F.lit(2.0), 32 - bits).cast("long"))
    low = address - F.pmod(address, size)
    return low, low + size - 1


#: fixed values: IPv4 ranges that are not public
NOT_PUBLIC = [
    ("0.0.0.0", "0.255.255.255"),
    ("10.0.0.0", "10.255.255.255"),
    ("100.64.0.0", "100.127.255.255"),
    ("127.0.0.0", "127.255.255.255"),
    ("169.254.0.0", "169.254.255.255"),
    ("172.16.0.0", "172.31.255.255"),
    ("192.168.0.0", "192.168.255.255"),
    ("224.0.0.0", "255.255.255.255"),
]


def number_of(text: str) -> int:
    a, b, c, d = map(int, text.split("."))
    return a << 24 | b << 16 | c << 8 | d


def is_public(number: Column) -> Column:
    """Whether an IPv4 number is a public address."""
    inside = F.lit(False)
    for low, high in NOT_PUBLIC:
        inside = inside | number.between(number_of(low), number_of(high))
    return number.isNotNull() & ~inside


def region_parts(region: Column) -> tuple[Column, Column, Column, Column]:
    """(region, province, city, isp) of ``country|..|isp``: parts of 0 or nothing are
    null, a last two-letter code is dropped, the region joins what is left."""
    parts = F.split(region, r"\|")
    last = F.element_at(parts, -1)
    parts = F.when(last.rlike("^[A-Z]{2}$"), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    clean = F.transform(parts, lambda p: F.when(~F.trim(p).isin("", "0"), F.trim(p)))
    joined = F.array_join(F.array_compact(clean), "|")
    return F.when(joined != "", joined), F.get(clean, F.lit(1)), F.get(clean, F.lit(2)), F.get(clean, F.size(clean) - 1)


def is_foreign(region: Column) -> Column:
    """Whether a region text is known and neither China nor a local network."""
    return F.coalesce(region, F.lit("")).rlike(r"\S") & ~region.rlike("(?i)中国|china|内网|局域网|lan|未知|unknown|保留")


def day_of(value: Column) -> Column:
    """A date from text whose digits are yyyymmdd, else null."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    return F.when(F.length(digits) == 8, F.to_date(F.try_to_timestamp(digits, F.lit("yyyyMMdd"))))


def flexible_time(value: Column) -> Column:
    """RFC 3339, ``yyyy-MM-dd`` or ``yyyy-MM-dd HH:mm:ss``, else null."""
    return F.coalesce(
        F.try_to_timestamp(value, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]XXX")),
        F.try_to_timestamp(value, F.lit("yyyy-MM-dd HH:mm:ss")),
        F.try_to_timestamp(value, F.lit("yyyy-MM-dd")),
    )


def wilson_lower_bound(wins: Column, samples: Column, z: float = 1.96) -> Column:
    """Lower bound of the win rate, 0 without samples."""
    n, p = samples.cast("double"), wins.cast("double") / samples
    centre = p + z * z / (2 * n)
    margin = z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)
    bound = (centre - margin) / (1 + z * z / n)
    return F.when(samples > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), bound))).otherwise(0.0)


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df`` as a local table that joins broadcast, where it has at most ``most`` rows:
    what reads it neither shuffles nor computes it again. A larger one stays as it is."""
    rows = df.limit(most + 1).toArrow()
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if rows.num_rows <= most else df


def byte_size(n: Column) -> Column:
    """A size for people: B, KB, MB or GB, halves rounded up, no signs between thousands;
    null counts as 0."""
    n = F.coalesce(n, F.lit(0))
    number = lambda x: F.translate(F.format_number(F.round(x, 1), 1), ",", "")
    out = F.concat(number(n / 1024**3), F.lit(" GB"))
    for limit, unit in ((1024**3, "MB"), (1024**2, "KB"), (1024, "B")):
        scale = limit // 1024
        text = F.concat(n.cast("long").cast("string") if unit == "B" else number(n / scale), F.lit(f" {unit}"))
        out = F.when(n < limit, text).otherwise(out)
    return out


def short_hash(value: Column, length: int = 12) -> Column:
    return F.substring(value, 1, length)
