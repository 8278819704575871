"""Labels and formats of events, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dnsloom.config import BLOCKED_CLASS, REASONS


def hms(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss")


def bucket_label(ts: Column, seconds: int) -> Column:
    """Days by date, minutes to the second, others by hour and minute."""
    return F.date_format(ts, {86400: "yyyy-MM-dd", 60: "HH:mm:ss"}.get(seconds, "HH:mm"))


def has_bit(flags: Column, bit: int) -> Column:
    return F.coalesce(flags.bitwiseAND(F.lit(1 << bit)) != 0, F.lit(False))


def _named(flags: Column, place: int) -> Column:
    return F.array_compact(F.array(*[F.when(has_bit(flags, r[0]), F.lit(r[place])) for r in REASONS]))


def flag_labels(flags: Column) -> Column:
    """Upper-case names in bit order."""
    return _named(flags, 1)


def flags_label(action: Column, flags: Column) -> Column:
    """Such as Blocked:Blacklist+AbpRule; the bare action without bits."""
    head = F.when(action == "HighlySuspicious", "HighlySusp").otherwise(action)
    bits = F.array_join(_named(flags, 2), "+")
    return F.when(action.isin(*BLOCKED_CLASS) & (bits != ""), F.concat(head, F.lit(":"), bits)).otherwise(head)


def log_line(action: Column, flags: Column, client: Column, domain: Column) -> Column:
    """A line of the event log; null for what is not logged."""
    head = F.when(action == "Blocked", "[BLOCK]").when(action == "HighlySuspicious", "[SUSPICIOUS:HIGH]").when(action == "Suspicious", "[SUSPICIOUS]")
    bits = F.array_join(_named(flags, 3), "+")
    tail = F.when(bits != "", F.concat(F.lit(" ("), bits, F.lit(")"))).otherwise("")
    return F.concat(head, F.lit(" "), client, F.lit(" -> "), F.coalesce(domain, F.lit("<unknown>")), tail)


def hash_hex(h: Column) -> Column:
    """A 64-bit hash as 16 hexadecimal digits."""
    return F.lpad(F.lower(F.hex(h)), 16, "0")
