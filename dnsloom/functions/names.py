"""Domain names as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from dnsloom.config import EngineConfig


def normalize_domain(d: Column) -> Column:
    """Lower case, without trailing dots."""
    return F.lower(F.regexp_replace(d, r"\.+$", ""))


def labels(d: Column) -> Column:
    return F.split(d, r"\.")


def depth(d: Column) -> Column:
    """Number of dots."""
    return F.length(d) - F.length(F.replace(d, F.lit("."), F.lit("")))


def sld(d: Column) -> Column:
    """The label before the last; null below two labels."""
    p = labels(d)
    return F.when(F.size(p) >= 2, F.element_at(p, -2))


def tld(d: Column) -> Column:
    return F.lower(F.element_at(labels(d), -1))


def ancestors(d: Column) -> Column:
    """All strict parents, longest first, down to the last label; empty for a single label."""
    p = labels(d)
    n = F.size(p)
    return F.when(n > 1, F.transform(F.sequence(F.lit(2), n), lambda i: F.array_join(F.slice(p, i, n), "."))).otherwise(F.array().cast("array<string>"))


def valid_name(d: Column) -> Column:
    """Labels of 1 to 63 bytes, 253 bytes at most; one trailing dot is allowed."""
    bare = F.regexp_replace(d, r"\.$", "")
    return (F.length(bare) > 0) & (F.octet_length(bare) <= 253) & ~F.exists(labels(bare), lambda x: ~F.octet_length(x).between(1, 63)) & ~bare.rlike(r"\s")


def structure_invalid(d: Column, cfg: EngineConfig) -> Column:
    bad = (F.octet_length(d) > cfg.max_domain_bytes) | (depth(d) > cfg.max_dots)
    return bad | (F.octet_length(d) != F.length(d)) if cfg.force_ascii else bad


def has_idn(d: Column) -> Column:
    """A punycode label or a character beyond ASCII."""
    return d.rlike(r"(^|\.)xn--") | (F.octet_length(d) != F.length(d))


def illegal_idn(d: Column, cfg: EngineConfig) -> Column:
    return has_idn(d) if cfg.block_idn else F.lit(False)


def clean_tlds(tlds: Sequence[str]) -> list[str]:
    return sorted({t.lstrip(".").lower() for t in tlds})


def suspicious_tld(d: Column, tlds: Sequence[str]) -> Column:
    """Last label in the set; an empty set means every one."""
    return tld(d).isin(clean_tlds(tlds)) if tlds else F.lit(True)


def forbidden_qtype(q: Column, cfg: EngineConfig) -> Column:
    return q.isin(list(cfg.forbidden_qtypes)) if cfg.qtype_enabled else F.lit(False)


def registrable(d: Column) -> Column:
    """The last two labels."""
    p = labels(d)
    return F.array_join(F.slice(p, F.greatest(F.size(p) - 1, F.lit(1)), 2), ".")


def in_scripts(d: Column, scripts: Sequence[str]) -> Column:
    """Whether every character is ASCII or of an allowed script: latin, western_european."""
    #: Unicode ranges.
    ranges = {"latin": r"\x{00C0}-\x{024F}\x{1E00}-\x{1EFF}", "western_european": r"\x{00C0}-\x{00FF}\x{0152}\x{0153}"}
    allowed = "".join(ranges[s] for s in scripts)
    return d.rlike(rf"^[\x00-\x7F{allowed}]*$")
