"""Thresholds and lists of the analytics, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    """Everything a verdict depends on besides the tables. Values are closed over as literals."""

    max_domain_bytes: int = 128
    max_dots: int = 5
    force_ascii: bool = False
    block_idn: bool = True
    forbidden_qtypes: tuple[int, ...] = (10, 13, 255)
    pipeline: tuple[str, ...] = ("whitelist", "hot_cache", "static_block", "suffix_match", "heuristics", "upstream")
    excluded_tlds: tuple[str, ...] = (".xyz", "top")
    keywords: tuple[str, ...] = ("casino", "bet")
    suspicious_tlds: tuple[str, ...] = (".biz", "xyz")
    strict_keywords: bool = True
    lexical_enabled: bool = True
    blocked_networks: tuple[str, ...] = ("203.0.113.0/24", "2001:db8::/32", "bad/99")
    dga_min_bytes: int = 8
    entropy_threshold: float = 4.0
    consonant_ratio: float = 0.6
    consonant_run: int = 5
    qtype_enabled: bool = True
    dga_enabled: bool = True
    low_ttl_enabled: bool = True
    rebinding_enabled: bool = True
    asn_enabled: bool = True
    entropy_fast: bool = True
    ngram_threshold: float = -4.0
    ngram_languages: tuple[str, ...] = ("en", "fr", "de")
    use_ngram: bool = False
    long_domain_bytes: int = 60
    deep_dots: int = 5
    max_answers: int = 10
    low_ttl: int = 10
    long_txt_bytes: int = 128
    block_at: int = 10
    high_at: int = 7
    suspicious_at: int = 4
    log_suspicious: bool = True


#: Bit, flag name, short label, name in log lines.
REASONS = (
    (0, "STATIC_BLACKLIST", "Blacklist", "static_blacklist"),
    (1, "ABP_RULE", "AbpRule", "abp_rule"),
    (2, "HIGH_ENTROPY", "HighEntropy", "high_entropy"),
    (3, "LEXICAL_ANALYSIS", "Lexical", "lexical_analysis"),
    (4, "BANNED_KEYWORD", "Keyword", "banned_keyword"),
    (5, "INVALID_STRUCTURE", "Structure", "invalid_structure"),
    (6, "SUSPICIOUS_IDN", "Idn", "suspicious_idn"),
    (7, "NRD_LIST", "Nrd", "nrd_list"),
    (8, "TLD_EXCLUDED", "Tld", "tld_excluded"),
    (9, "SUSPICIOUS", "Suspicious", "suspicious"),
    (10, "CNAME_CLOAKING", "CnameCloaking", "cname_cloaking"),
    (11, "FORBIDDEN_QTYPE", "Qtype", "forbidden_qtype"),
    (12, "DNS_REBINDING", "Rebinding", "dns_rebinding"),
    (13, "LOW_TTL", "LowTtl", "low_ttl"),
    (14, "ASN_BLOCKED", "Asn", "asn_blocked"),
)
BIT = {name: bit for bit, name, _, _ in REASONS}
#: Rule flags.
WHITELIST, WILDCARD, REGEX, NRD = 1, 2, 4, 32
#: Actions of an event.
ACTIONS = ("Allowed", "Proxied", "Blocked", "Suspicious", "HighlySuspicious")
BLOCKED_CLASS = ("Blocked", "Suspicious", "HighlySuspicious")
