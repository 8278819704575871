"""IP addresses and networks as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ipv4_number(ip: Column) -> Column:
    """The address as a long; null unless it has four decimal parts."""
    p = F.split(ip, r"\.")
    part = lambda i: F.get(p, F.lit(i)).cast("long")
    return F.when(ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), part(0) * 16777216 + part(1) * 65536 + part(2) * 256 + part(3))


def ipv6_hex(ip: Column) -> Column:
    """32 hexadecimal digits; null unless the text has a colon. A trailing dotted quad is not expanded."""
    halves = F.split(F.lower(ip), "::")
    groups = lambda h: F.filter(F.split(F.coalesce(h, F.lit("")), ":"), lambda g: g != "")
    pad = lambda a: F.array_join(F.transform(a, lambda g: F.lpad(g, 4, "0")), "")
    left, right = groups(F.get(halves, F.lit(0))), groups(F.get(halves, F.lit(1)))
    middle = F.repeat(F.lit("0000"), F.greatest(8 - F.size(left) - F.size(right), F.lit(0)))
    return F.when(F.contains(ip, F.lit(":")), F.concat(pad(left), middle, pad(right)))


def is_private_ip(ip: Column) -> Column:
    """v4: this-network, private, loopback, shared, link-local; v6: loopback, unique-local, link-local. What is no address is not private."""
    p = F.split(ip, r"\.")
    a, b = F.get(p, F.lit(0)).try_cast("int"), F.get(p, F.lit(1)).try_cast("int")
    sound = ipv4_number(ip).isNotNull() & F.forall(p, lambda x: x.try_cast("int") <= 255)
    v4 = sound & (a.isin(0, 10, 127) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)))
    h = ipv6_hex(ip)
    v6 = (h == "0" * 31 + "1") | h.rlike("^f[cd]") | h.rlike("^fe[89ab]")
    return F.coalesce(F.when(F.contains(ip, F.lit(":")), v6).otherwise(v4), F.lit(False))


def format_ip(raw: Column) -> Column:
    """16 bytes as canonical text: dotted for a mapped or four-byte v4 address, else eight groups."""
    h = F.lower(F.hex(raw))
    quad = lambda at: F.concat_ws(".", *[F.conv(F.substr(h, F.lit(at + 2 * i), F.lit(2)), 16, 10) for i in range(4)])
    mapped = h.startswith("0" * 20 + "ffff")
    short = F.substr(h, F.lit(9), F.lit(24)) == "0" * 24
    groups = F.concat_ws(":", *[F.substr(h, F.lit(1 + 4 * i), F.lit(4)) for i in range(8)])
    return F.when(mapped, quad(25)).when(short & (h != "0" * 32), quad(1)).otherwise(groups)
