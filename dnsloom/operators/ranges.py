"""Addresses in networks, as an equi join on prefixes.

An address is a family digit and hexadecimal digits (8 for v4, 32 for v6). A
network of p bits fixes its first p // 4 digits, so it goes under that prefix; an
address goes under each of its prefixes of the lengths that the networks use.
Both meet by prefix, and the network's bounds decide. A prefix of k digits holds
at most fifteen networks of 4 k to 4 k + 3 bits and no others, so the candidates
of an address are bounded by the lengths in use, whatever the number of networks.
Networks that fix fewer than two digits go under all two-digit prefixes they hold.

There is no literal per network in the plan and no join on the family: Spark may
broadcast a small table of networks and shuffles both sides of a large one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dnsloom.functions.network import ipv4_number, ipv6_hex

#: Digits that every prefix has at least (without the family).
LEAST = 2


def address_key(ip: Column) -> Column:
    """4 or 6 and the address in hexadecimal digits; null for what is no address."""
    quads = F.forall(F.split(ip, r"\."), lambda x: x.try_cast("int") <= 255)
    v4 = F.when(ipv4_number(ip).isNotNull() & quads, F.concat(F.lit("4"), F.lpad(F.lower(F.hex(ipv4_number(ip))), 8, "0")))
    # At most one "::", which stands for a group at least; eight groups otherwise.
    groups = F.regexp_count(ip, F.lit("[0-9A-Fa-f]+"))
    shape = ip.rlike(r"^([0-9A-Fa-f]{1,4}(:[0-9A-Fa-f]{1,4})*)?(::([0-9A-Fa-f]{1,4}(:[0-9A-Fa-f]{1,4})*)?)?$")
    whole = shape & F.when(F.contains(ip, F.lit("::")), groups <= 7).otherwise(groups == 8)
    return F.coalesce(v4, F.when(whole, F.concat(F.lit("6"), ipv6_hex(ip))))


def parse_networks(networks: DataFrame, column: str = "cidr") -> DataFrame:
    """``networks`` with lo and hi (address keys) and bits. Host bits are cleared; what is no network (address, slash, length) is skipped."""
    parts = F.split(F.trim(column), "/")
    key, bits = address_key(F.get(parts, F.lit(0))), F.get(parts, F.lit(1)).try_cast("int")
    sound = (F.size(parts) == 2) & F.get(parts, F.lit(1)).rlike(r"^\d{1,3}$") & (bits <= F.when(F.substring("_key", 1, 1) == "4", 32).otherwise(128))
    rows = networks.withColumn("_key", key).filter(F.col("_key").isNotNull() & sound).withColumn("bits", bits)
    wide, fixed, rest = F.length("_key"), F.floor(F.col("bits") / 4).cast("int"), F.col("bits") % 4
    head = F.substring(F.col("_key"), F.lit(1), fixed + 1)
    digit = F.conv(F.substring(F.col("_key"), fixed + 2, F.lit(1)), 16, 10).cast("int")
    free = F.element_at(F.array(*[F.lit(x) for x in (15, 7, 3, 1)]), rest + 1)
    hexed = lambda n: F.lower(F.hex(n))
    end = lambda n, fill: F.when(fixed + 1 < wide, F.concat(head, F.rpad(hexed(n), wide - fixed - 1, fill))).otherwise(head)
    lo, hi = end(digit.bitwiseAND(F.lit(15) - free), F.lit("0")), end(digit.bitwiseOR(free), F.lit("f"))
    return rows.withColumn("lo", lo).withColumn("hi", hi).drop("_key")


def network_table(spark, networks: Sequence[str]) -> DataFrame:
    """A few networks given as texts, parsed."""
    return parse_networks(spark.createDataFrame([(n,) for n in networks], "cidr string"))


def prefixed(parsed: DataFrame) -> DataFrame:
    """Parsed networks under their prefixes (column prefix, family digit included)."""
    fixed = F.floor(F.col("bits") / 4).cast("int")
    number = lambda c: F.conv(F.substring(c, 2, LEAST), 16, 10).cast("int")
    every = F.transform(F.sequence(number("lo"), number("hi")), lambda n: F.concat(F.substring("lo", 1, 1), F.lpad(F.lower(F.hex(n)), LEAST, "0")))
    return parsed.withColumn("prefix", F.explode(F.when(fixed >= LEAST, F.array(F.substring(F.col("lo"), F.lit(1), fixed + 1))).otherwise(every)))


def within(addresses: DataFrame, parsed: DataFrame, column: str = "ip") -> DataFrame:
    """The distinct addresses of ``column`` with every network that holds them: ip and the columns of ``parsed``."""
    under = prefixed(parsed)
    lengths = sorted(r[0] for r in under.select(F.length("prefix")).distinct().collect())  # 63 at most: two families of up to 31
    keyed = addresses.select(F.col(column).alias("ip")).distinct().withColumn("_key", address_key(F.col("ip"))).filter("_key is not null")
    prefixes = F.filter(F.array(*[F.substring("_key", 1, n) for n in lengths]).cast("array<string>"), lambda p: p.isNotNull())
    # A v4 key shorter than a length would come up again under itself.
    spread = keyed.withColumn("prefix", F.explode(F.array_distinct(prefixes)))
    return spread.join(under, "prefix").filter(F.col("_key").between(F.col("lo"), F.col("hi"))).select("ip", *parsed.columns)


def inside(rows: DataFrame, parsed: DataFrame, column: str) -> DataFrame:
    """``rows`` whose address lies in a network."""
    return rows.join(within(rows, parsed, column).select(F.col("ip").alias(column)).distinct(), column, "left_semi").select(*rows.columns)


def outside(rows: DataFrame, parsed: DataFrame, column: str) -> DataFrame:
    """``rows`` whose address lies in no network; what is no address lies in none."""
    return rows.join(within(rows, parsed, column).select(F.col("ip").alias(column)).distinct(), column, "left_anti").select(*rows.columns)
