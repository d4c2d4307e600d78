"""Addresses against special-purpose ranges."""

from __future__ import annotations

import ipaddress

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Special-purpose ranges and their names.
RANGES = [
    ("127.0.0.0/8", "loopback"), ("169.254.0.0/16", "link-local"), ("10.0.0.0/8", "private-a"), ("172.16.0.0/12", "private-b"), ("192.168.0.0/16", "private-c"),
    ("100.64.0.0/10", "cgnat"), ("0.0.0.0/8", "this-network"), ("192.0.0.0/24", "ietf-protocol"), ("192.0.2.0/24", "test-net-1"), ("198.51.100.0/24", "test-net-2"),
    ("203.0.113.0/24", "test-net-3"), ("198.18.0.0/15", "benchmarking"), ("192.88.99.0/24", "6to4-relay"), ("224.0.0.0/4", "multicast"), ("240.0.0.0/4", "reserved"),
    ("255.255.255.255/32", "broadcast"), ("::1/128", "loopback"), ("::/128", "unspecified"), ("fc00::/7", "unique-local"), ("fe80::/10", "link-local"),
    ("ff00::/8", "multicast"), ("2001:db8::/32", "documentation"), ("2001::/32", "teredo"), ("2002::/16", "6to4"), ("100::/64", "discard-only"),
    ("2001:20::/28", "orchid-v2"), ("2001:10::/28", "orchid"), ("5f00::/16", "segment-routing"),
]


def range_table(spark: SparkSession) -> DataFrame:
    """(name, prefix, low, high): version 4 ranges as whole numbers."""
    nets = [(ipaddress.ip_network(cidr), name) for cidr, name in RANGES]
    rows = [(name, n.prefixlen, int(n.network_address), int(n.broadcast_address)) for n, name in nets if n.version == 4]
    return spark.createDataFrame(rows, "name string, prefix int, low long, high long")


def classify_addresses(df: DataFrame, ip_col: str) -> DataFrame:
    """Df with range_name: the most specific range of an address, 'public' outside all, 'invalid' if it is none.

    Whatever is not written as an address is, to the letter, is invalid: spaces, leading zeros, colons too many.

    The list of ranges is fixed and short, so it is an expression. Version 6 addresses are compared by their
    32 hexadecimal digits. Those that carry a version 4 address, mapped or for NAT64, have its range, and
    'embedded-ipv4' where it would be public: an address has one notation.
    """
    given = F.lower(F.col(ip_col))
    # A zone says where a link-local address holds, and nothing of its range.
    text = F.when(given.contains(":"), F.regexp_replace(given, r"%[0-9a-z.:\-]+$", "")).otherwise(given)
    # Octets have one spelling: no leading zeros.
    dotted = F.regexp_extract(text, r"(?:^|:)((?:(?:0|[1-9][0-9]{0,2})\.){3}(?:0|[1-9][0-9]{0,2}))$", 1)
    octets = F.transform(F.split(dotted, r"\."), lambda o: o.try_cast("long"))
    four_sound = (dotted != "") & F.forall(octets, lambda o: o.between(0, 255))
    low = F.aggregate(octets, F.lit(0).cast("long"), lambda total, o: total * 256 + F.coalesce(o, F.lit(0)))
    # The dotted end of a version 6 address is its last two groups.
    tail = F.lpad(F.lower(F.hex(low)), 8, "0")
    six_text = F.when(text.contains(":") & four_sound, F.concat(F.regexp_replace(text, r"[0-9.]+$", ""), F.substring(tail, 1, 4), F.lit(":"), F.substring(tail, 5, 4))).otherwise(text)
    # Groups between single colons, and one gap at most, which stands for one group at least.
    some = "[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,7}"
    sound = six_text.contains(":") & six_text.rlike(f"^(?:{some})?(?:::(?:{some})?)?$")
    halves = F.split(six_text, "::")
    groups = lambda part: F.filter(F.split(part, ":"), lambda g: g != "")
    has_gap = F.size(halves) == 2
    left, right = groups(halves[0]), F.when(has_gap, groups(F.get(halves, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    told = F.size(left) + F.size(right)
    every = F.concat(left, F.array_repeat(F.lit("0"), F.when(has_gap, F.greatest(F.lit(8) - told, F.lit(0))).otherwise(0)), right)
    digits = F.array_join(F.transform(every, lambda g: F.lpad(g, 4, "0")), "")
    is_v6 = sound & F.when(has_gap, told <= 7).otherwise(told == 8)
    settled = df.withColumn("v6 ", F.when(is_v6, digits)).withColumn("v4 ", F.when(text.contains(":"), None).when(four_sound & (dotted == text), low))
    inside = F.col("v6 ").startswith("0" * 20 + "ffff") | F.col("v6 ").startswith("0064ff9b" + "0" * 8)
    number = F.when(inside, F.conv(F.substring("v6 ", 25, 8), 16, 10).cast("long")).otherwise(F.col("v4 "))
    four, six = F.lit(None).cast("string"), F.lit(None).cast("string")
    for net, name in sorted(((ipaddress.ip_network(c), n) for c, n in RANGES), key=lambda r: -r[0].prefixlen):
        if net.version == 4:
            four = F.coalesce(four, F.when(F.col("number ").between(int(net.network_address), int(net.broadcast_address)), name))
        else:
            first, last = f"{int(net.network_address):032x}", f"{int(net.broadcast_address):032x}"
            six = F.coalesce(six, F.when((F.col("v6 ") >= first) & (F.col("v6 ") <= last), name))
    verdict = F.when(F.col("inside "), F.coalesce(four, F.lit("embedded-ipv4"))).when(F.col("number ").isNotNull(), F.coalesce(four, F.lit("public"))).when(F.col("v6 ").isNotNull(), F.coalesce(six, F.lit("public")))
    ruled = settled.withColumns({"number ": number, "inside ": inside}).withColumn("range_name", F.coalesce(verdict, F.lit("invalid")))
    return ruled.drop("v6 ", "v4 ", "number ", "inside ")
