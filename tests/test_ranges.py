"""Addresses in networks against the standard library, nested and of every length; the plan's join."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from dnsloom.operators import extras, ranges

rng = random.Random(2)


def holds(ip, cidr):
    try:
        return ipaddress.ip_address(ip) in ipaddress.ip_network(cidr, strict=False) if "/" in cidr else False
    except ValueError:
        return False


V4 = [".".join(str(rng.choice([0, 1, 10, 93, 127, 128, 203, 255])) for _ in range(4)) for _ in range(80)]
V6 = [str(ipaddress.ip_address(rng.choice([0x20010DB8, 0x20010DB9, 0xFD000000, 0, 0xFFFFFFFF]) << 96 | rng.choice([0, 1, 1 << 64, 255 << 56, (1 << 96) - 1]))) for _ in range(40)]
ODD = ["", "junk", "256.1.1.1", "1.2.3", "1:2", "1:2:3:4:5:6:7:8:9", "1::2::3", ":::", None, "2001:DB8::1", "0:0:0:0:0:0:0:1"]
NETS = [f"{rng.choice(V4)}/{p}" for p in range(33) for _ in range(3)] + [f"{rng.choice(V6)}/{p}" for p in range(129) for _ in range(2)]
NETS += ["bad/99", "1.2.3.4", "1.2.3.4/33", "::/129", "1.2.3.4/", "/8", "1.2.3.4/-1", "2001:db8::/32/1", "not-a-cidr", NETS[0], None]


def test_every_address_meets_all_its_networks(spark):
    nets = ranges.parse_networks(spark.createDataFrame([(n, i) for i, n in enumerate(NETS)], "cidr string, asn int"))
    some = spark.createDataFrame([(x,) for x in V4 + V6 + ODD + V4[:9]], "ip string")
    got = sorted((r.ip, r.asn) for r in ranges.within(some, nets).collect())
    every = {x for x in V4 + V6 + ODD if x}
    assert got == sorted((ip, k) for ip in every for k, n in enumerate(NETS) if n and holds(ip, n))


@pytest.mark.parametrize(
    "cidr, inside, outside",
    [
        ("203.0.113.0/24", ["203.0.113.1", "203.0.113.255"], ["203.0.112.255", "203.0.114.0"]),
        ("1.2.3.4/32", ["1.2.3.4"], ["1.2.3.5"]),
        ("0.0.0.0/0", ["0.0.0.0", "255.255.255.255"], ["::1"]),
        ("2001:db8::/32", ["2001:db8::1", "2001:db8:ffff::1"], ["2001:db9::1", "2002:db8::1"]),
        ("::1/128", ["::1"], ["::2", "0.0.0.1"]),
        ("1.2.3.4", [], ["1.2.3.4"]),
        ("2001:db8::/129", [], ["2001:db8::"]),
    ],
)
def test_known_cases(spark, cidr, inside, outside):
    rows = spark.createDataFrame([(x, 1) for x in inside + outside], "client_ip string, n int")
    table = ranges.network_table(spark, [cidr])
    assert sorted(r.client_ip for r in ranges.inside(rows, table, "client_ip").collect()) == sorted(inside)
    assert sorted(r.client_ip for r in extras.client_acl(rows, table).collect()) == sorted(outside)


def test_empty_tables(spark):
    rows = spark.createDataFrame([("1.2.3.4",)], "ip string")
    none = ranges.network_table(spark, [])
    assert ranges.within(rows, none).count() == 0 and ranges.outside(rows, none, "ip").count() == 1
    assert ranges.within(rows.limit(0), ranges.network_table(spark, ["1.0.0.0/8"])).count() == 0


def test_join_goes_by_prefix(spark):
    """Thousands of networks: an equi join by prefix, no literal per network, no nested loop."""
    nets = spark.range(3000).select(F.concat(F.lit("10."), (F.col("id") / 250).cast("int").cast("string"), F.lit("."), (F.col("id") % 250).cast("string"), F.lit(".0/24")).alias("cidr"))
    rows = spark.range(1000).select(F.concat(F.lit("10.1.2."), (F.col("id") % 256).cast("string")).alias("ip"))
    found = ranges.within(rows, ranges.parse_networks(nets))
    plan = found._jdf.queryExecution().explainString(found._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "prefix" in plan and "10.1.2.0/24" not in plan
    assert found.count() == 256
