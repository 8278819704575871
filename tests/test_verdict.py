"""Scores, resolution and verdicts on hand-made queries."""

from pyspark.sql import functions as F

from dnsloom.config import EngineConfig
from dnsloom.operators import events as ev
from dnsloom.operators import rules, score
from dnsloom.plans.verdict import verdict
from dnsloom.sources import lists
from dnsloom.sources.tables import stored
from tests.test_lists import ROWS

CFG = EngineConfig()


def run(spark, names, answers=()):
    parsed = stored(rules.parse_lines(spark.createDataFrame(ROWS, lists.LINES)).unionByName(rules.tld_exclude_rules(spark, CFG.excluded_tlds)), "t")
    compiled = stored(rules.consolidate_exact(parsed).unionByName(parsed.filter("kind in ('suffix', 'glob', 'regex')")), "t")
    rows = [(i, "10.0.0.1", d, q) for i, (d, q) in enumerate(names)]
    queries = spark.createDataFrame(rows, "event_id long, client_ip string, domain string, qtype int").selectExpr("*", "timestamp'2024-01-01' as ts")
    a = spark.createDataFrame(list(answers), "event_id long, rtype string, rdata string, ttl int")
    return {r.event_id: r for r in verdict(queries, a, compiled, CFG).collect()}


def test_order_of_reasons(spark):
    got = run(spark, [("one.example", 255), ("one.example.", 1), ("ADS7.tracker.net", 1), ("a.b.c.d.e.f.g", 1), ("xn--a.trusted.example.org", 1), ("play-casino.q.biz", 1), ("a1b2c3d4e5f6g7h8i9j0.com", 1), ("bcdfghjkl.com", 1), ("plain.top", 1)])
    assert [got[i].reason for i in range(9)] == ["FORBIDDEN_QTYPE", "STATIC_BLACKLIST", "ABP_RULE", "INVALID_STRUCTURE", "SUSPICIOUS_IDN", "BANNED_KEYWORD", "HIGH_ENTROPY", "LEXICAL_ANALYSIS", "ABP_RULE"]
    assert got[2].detail == "wildcard" and all(r.action == "Blocked" for r in got.values())


def test_answers_raise_the_score(spark):
    many = [(4, "A", f"8.8.4.{i}", 60) for i in range(11)]
    got = run(
        spark,
        [("trusted.example.org", 1), ("calm.com", 1), ("calm.com", 1), ("calm.com", 1), ("calm.com", 1), ("fresh-domain.example", 1)],
        [(0, "A", "192.168.0.1", 60), (1, "A", "8.8.8.8", 9), (2, "CNAME", "One.Example.", 60), (3, "TXT", "A" * 129, 5), *many, (5, "A", "8.8.8.8", 60)],
    )
    assert (got[0].action, got[0].reasons, got[0].pass_action) == ("Blocked", "DNS_REBINDING", "Allowed")
    assert (got[1].action, got[1].total) == ("Proxied", 2)
    assert (got[2].action, got[2].reasons) == ("Blocked", "CNAME_CLOAKING")
    assert (got[3].action, got[3].total, got[3].reasons) == ("Suspicious", 5, "LOW_TTL,INVALID_STRUCTURE")
    assert (got[4].total, got[4].reasons) == (2, "INVALID_STRUCTURE")
    assert got[5].reason == "STATIC_BLACKLIST"


def test_points_and_reasons_of_domains(spark):
    """Worked by hand: long name 3, five dots 3, suspicious TLD 3 or 10 with a keyword, IDN 6, entropy 4, consonants 3."""
    long_name = "a" * 61 + ".com"
    want = {
        "example.com": (0, ""),
        long_name: (3, "INVALID_STRUCTURE"),
        "a.b.c.d.e.com": (3, "INVALID_STRUCTURE"),
        "quiet.biz": (3, "TLD_EXCLUDED"),
        "play-casino.biz": (10, "BANNED_KEYWORD"),
        "xn--pple-43d.com": (6, "SUSPICIOUS_IDN"),
        "bcdfghjkl.com": (3, "LEXICAL_ANALYSIS"),
        "a1b2c3d4e5f6g7h8i9j0.com": (4, "HIGH_ENTROPY"),
        "q.xz.com": (0, ""),
        "bcdfghjkl.biz": (6, "TLD_EXCLUDED,LEXICAL_ANALYSIS"),
    }
    d = spark.createDataFrame([(x,) for x in want], "domain string")
    s = d.select("domain", score.domain_score(F.col("domain"), F.lit(False), CFG).alias("s")).collect()
    got = {r.domain: (r.s.total, ",".join(r.s.reasons)) for r in s}
    for name in ("example.com", long_name, "a.b.c.d.e.com", "quiet.biz", "play-casino.biz", "bcdfghjkl.com", "q.xz.com", "bcdfghjkl.biz"):
        assert got[name] == want[name], name
    assert got["xn--pple-43d.com"][1].startswith("SUSPICIOUS_IDN") and got["xn--pple-43d.com"][0] >= 6
    assert got["a1b2c3d4e5f6g7h8i9j0.com"][1].startswith("HIGH_ENTROPY")
    fresh = d.filter("domain = 'example.com'").select(score.domain_score(F.col("domain"), F.lit(True), CFG).alias("s")).first().s
    assert (fresh.total, fresh.reasons) == (5, ["NRD_LIST"])


def test_first_reason_gives_the_flag(spark):
    got = run(spark, [("calm.com", 1)], [(0, "TXT", "A" * 129, 60), *[(0, "A", f"8.8.4.{i}", 60) for i in range(11)]])[0]
    assert (got.action, got.total, got.reasons, got.flags) == ("Suspicious", 5, "INVALID_STRUCTURE,INVALID_STRUCTURE", 1 << 5)


def test_counters_ties_and_empty(spark):
    e = spark.createDataFrame([(1, "c", "d", "Blocked", 0b101), (2, "c", "d", "Allowed", None)], "event_id long, client_ip string, domain string, action string, flags int").selectExpr("*", "timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,event_id*4000) as ts")
    assert ev.top_filter(e).first().flag == "HIGH_ENTROPY"
    assert tuple(ev.monitor_counters(e).first()) == (2, 1, 0, 1)
    assert ev.timeline_dense(e).count() == 2
    empty = e.limit(0)
    assert ev.timeline_dense(empty).count() == 0 and ev.top_filter(empty).count() == 0 and ev.timeline_maxima(empty).first().dense_rows == 0
    assert ev.search_events(e, limit=0).count() == 0


def test_bad_address_is_an_error(spark):
    import pytest

    e = spark.createDataFrame([], "event_id long, ts timestamp, client_ip string, domain string, action string, flags int")
    with pytest.raises(ValueError):
        ev.search_events(e, client="nonsense!")


def test_search_asks_for_all_flags(spark):
    rows = [(i, "c", "d", "Blocked", f) for i, f in enumerate([0, 0b001, 0b100, 0b101, 0b111, None])]
    e = spark.createDataFrame(rows, "event_id long, client_ip string, domain string, action string, flags int").selectExpr("*", "timestamp'2024-01-01' as ts")
    found = lambda f: sorted(r.event_id for r in ev.search_events(e, flags=f).collect())
    assert found(0b101) == [3, 4] and found(0) == [0, 1, 2, 3, 4] and found(0b100) == [2, 3, 4]
    assert ev.search_events(e, action="blocked").count() == 0 and ev.search_events(e, action="Blocked").count() == 6


A, TXT, C = "A", "TXT", "CNAME"
#: Answers (type, data, ttl), what differs from the defaults, points and reasons: cases known from the rules' own description.
ANSWERS = [
    ([(A, "1.2.3.4", 300)], {}, 0, []),
    ([(A, f"1.2.3.{i}", 300) for i in range(10)], {}, 0, []),
    ([(A, f"1.2.3.{i}", 300) for i in range(11)], {}, 2, ["INVALID_STRUCTURE"]),
    ([(TXT, "x" * 128, 300)], {}, 0, []),
    ([(TXT, "x" * 129, 300)], {}, 3, ["INVALID_STRUCTURE"]),
    ([(TXT, "x" * 200, 300), (TXT, "y" * 200, 300)], {}, 3, ["INVALID_STRUCTURE"]),
    ([*[(A, f"1.2.3.{i}", 300) for i in range(11)], (TXT, "x" * 200, 300)], {}, 5, ["INVALID_STRUCTURE", "INVALID_STRUCTURE"]),
    ([(C, "cdn.clean.net", 300)], {}, 0, []),
    ([(C, "one.example", 300)], {}, 10, ["CNAME_CLOAKING"]),
    ([(C, "deep.tracker.net", 300)], {}, 10, ["CNAME_CLOAKING"]),
    ([(C, "cdn.clean.net", 300), (C, "One.Example.", 300)], {}, 10, ["CNAME_CLOAKING"]),
    ([(A, "10.0.0.1", 300)], {}, 10, ["DNS_REBINDING"]),
    ([(A, "127.0.0.1", 300)], {}, 10, ["DNS_REBINDING"]),
    ([("AAAA", "fd00::1", 300)], {}, 10, ["DNS_REBINDING"]),
    ([(A, "8.8.8.8", 300), ("AAAA", "2606:4700::1", 300)], {}, 0, []),
    ([(A, "10.0.0.1", 300)], {"rebinding_enabled": False}, 0, []),
    ([(A, "1.2.3.4", 9)], {}, 2, ["LOW_TTL"]),
    ([(A, "1.2.3.4", 10)], {}, 0, []),
    ([(A, "1.2.3.4", 0)], {}, 2, ["LOW_TTL"]),
    ([(A, "1.2.3.4", None)], {}, 0, []),
    ([(A, "1.2.3.4", 5)], {"low_ttl_enabled": False}, 0, []),
    ([(A, "1.2.3.4", 30)], {"low_ttl": 60}, 2, ["LOW_TTL"]),
    ([(A, "1.2.3.4", 300), ("NS", "x", 3)], {}, 2, ["LOW_TTL"]),
    ([(A, "203.0.113.42", 300)], {}, 10, ["ASN_BLOCKED"]),
    ([("AAAA", "2001:db8::cafe", 300)], {}, 10, ["ASN_BLOCKED"]),
    ([(A, "203.0.114.1", 300)], {}, 0, []),
    ([(A, "203.0.113.42", 300)], {"asn_enabled": False}, 0, []),
    ([(A, "203.0.113.42", 300)], {"blocked_networks": ()}, 0, []),
    ([(A, "198.51.100.7", 300)], {"blocked_networks": ("203.0.113.0/24", "198.51.100.0/24")}, 10, ["ASN_BLOCKED"]),
    ([(A, "10.0.0.1", 300), (A, "203.0.113.42", 300), (C, "one.example", 300)], {}, 10, ["DNS_REBINDING"]),
    ([(A, "10.0.0.1", 5), (TXT, "x" * 200, 5)], {}, 15, ["LOW_TTL", "INVALID_STRUCTURE", "DNS_REBINDING"]),
]


def test_answer_points(spark):
    from dataclasses import replace

    from dnsloom.operators import ranges
    from dnsloom.plans.verdict import inspected_events

    parsed = stored(rules.parse_lines(spark.createDataFrame(ROWS, lists.LINES)), "t")
    compiled = stored(rules.consolidate_exact(parsed).unionByName(parsed.filter("kind in ('suffix', 'glob', 'regex')")), "t")
    for change in {tuple(sorted(c.items())) for _, c, _, _ in ANSWERS}:
        cfg = replace(CFG, **dict(change))
        own = {i: x for i, x in enumerate(ANSWERS) if tuple(sorted(x[1].items())) == change}
        a = spark.createDataFrame([(i, *r) for i, (records, *_) in own.items() for r in records], "event_id long, rtype string, rdata string, ttl int")
        seen = inspected_events(a, compiled, ranges.network_table(spark, cfg.blocked_networks), cfg)
        got = {r.event_id: (r.s.total, r.s.reasons) for r in seen.select("event_id", score.answer_score(score.nothing(), cfg).alias("s")).collect()}
        assert got == {i: (total, reasons) for i, (_, _, total, reasons) in own.items()}, change


def test_switches(spark):
    from dataclasses import replace

    from dnsloom.functions import lexical, names

    d = spark.createDataFrame([("bcdfghjkl.com", 255), ("a1b2c3d4e5f6g7h8i9j0.com", 1)], "d string, q int")
    off = replace(CFG, dga_enabled=False, qtype_enabled=False)
    assert [tuple(r) for r in d.select(lexical.dga_reason(F.col("d"), off), names.forbidden_qtype(F.col("q"), off), score.domain_score(F.col("d"), F.lit(False), off)["total"]).collect()] == [(None, False, 0)] * 2
    assert [tuple(r) for r in d.select(lexical.dga_reason(F.col("d"), CFG), names.forbidden_qtype(F.col("q"), CFG)).collect()] == [("LEXICAL_ANALYSIS", True), ("HIGH_ENTROPY", False)]
    loose = replace(CFG, strict_keywords=False)
    k = spark.createDataFrame([("mycasinoapp.biz",), ("alphabet.biz",), ("mycasinoapp.com",)], "d string")
    assert [r[0] for r in k.select(lexical.banned_keyword(F.col("d"), loose)).collect()] == ["casino", "bet", None]


def test_talker_filters(spark):
    t = spark.createDataFrame([("10.0.0.1", "printer.local"), ("10.0.0.12", ""), ("10.0.1.1", None), ("9.1.1.1", "Printer")], "client_ip string, hostname string")
    got = lambda **f: sorted(r.client_ip for r in ev.talker_filter(t, **f).collect())
    assert got(text="10.0.0.1") == ["10.0.0.1", "10.0.0.12"] and got(text="rinter") == ["10.0.0.1", "9.1.1.1"] and got(text="Printer") == ["9.1.1.1"]
    assert got(client="10.0.0.1") == ["10.0.0.1"] and got(hostname="printer.local") == ["10.0.0.1"] and got(hostname="") == ["10.0.0.12"]
