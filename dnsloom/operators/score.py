"""Suspicion scores of domains and answers: ordered signals folded until a threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dnsloom.config import BIT, EngineConfig
from dnsloom.functions.lexical import banned_keyword, generated
from dnsloom.functions.names import depth, has_idn, normalize_domain, suspicious_tld
from dnsloom.functions.network import is_private_ip

Signal = tuple[Column, Column, str]
_REASON = "struct<points:int,reason:string>"


def signals(rows: list[Signal]) -> Column:
    """The signals that hold, in order: array of (points, reason)."""
    return F.array_compact(F.array(*[F.when(F.coalesce(hit, F.lit(False)), F.struct(points.cast("int").alias("points"), F.lit(reason).alias("reason"))) for hit, points, reason in rows]))


def fold(start: Column, found: Column, threshold: int, stops: tuple[str, ...] = ()) -> Column:
    """Adds signals to (total, reasons) in order; after an add at or above ``threshold``, or of a reason in ``stops``, the rest is ignored. 255 at most."""
    zero = F.struct(start["total"].cast("int").alias("total"), start["reasons"].cast("array<string>").alias("reasons"), F.lit(False).alias("stop"))

    def step(acc, x):
        total = F.least(acc["total"] + x["points"], F.lit(255)).cast("int")
        halt = (total >= threshold) | x["reason"].isin(*stops) if stops else total >= threshold
        added = F.struct(total.alias("total"), F.concat(acc["reasons"], F.array(x["reason"])).alias("reasons"), halt.alias("stop"))
        return F.when(acc["stop"], acc).otherwise(added)

    # Not wrapped in another struct: the optimiser would then work the fold out once per field.
    return F.aggregate(found, zero, step)


def nothing() -> Column:
    return F.struct(F.lit(0).alias("total"), F.array().cast("array<string>").alias("reasons"), F.lit(False).alias("stop"))


def domain_score(d: Column, is_nrd: Column, cfg: EngineConfig, signs: Column | None = None, keyword: Column | None = None) -> Column:
    """(total, reasons) of a domain by its own looks and the newly-registered list. ``signs`` (``lexical.generated``) and ``keyword``
    as columns, where they are there already."""
    signs = generated(d, cfg) if signs is None else signs
    odd_tld = suspicious_tld(d, cfg.suspicious_tlds) if cfg.suspicious_tlds and cfg.lexical_enabled and cfg.keywords else F.lit(False)
    keyword = (banned_keyword(d, cfg) if keyword is None else keyword).isNotNull()
    rows = [
        (F.octet_length(d) > cfg.long_domain_bytes, F.lit(3), "INVALID_STRUCTURE"),
        (depth(d) >= cfg.deep_dots, F.lit(3), "INVALID_STRUCTURE"),
        (odd_tld & keyword, F.lit(10), "BANNED_KEYWORD"),
        (odd_tld & ~keyword, F.lit(3), "TLD_EXCLUDED"),
        (has_idn(d), F.lit(6), "SUSPICIOUS_IDN"),
        (is_nrd, F.lit(5), "NRD_LIST"),
        (signs["high_entropy"], F.lit(4), "HIGH_ENTROPY"),
        (signs["consonants"], F.lit(3), "LEXICAL_ANALYSIS"),
    ]
    return fold(nothing(), signals(rows), cfg.block_at)


def inspected(answers: DataFrame) -> DataFrame:
    """Long answers (event_id, rtype, rdata, ttl) as a row per event: a, aaaa, txt, cname, min_ttl over all records. Names lose case and trailing dots."""
    pick = lambda t, v=F.col("rdata"): F.array_sort(F.collect_list(F.when(F.col("rtype") == t, v)))
    return answers.groupBy("event_id").agg(
        pick("A").alias("a"), pick("AAAA").alias("aaaa"), pick("TXT").alias("txt"), pick("CNAME", normalize_domain(F.col("rdata"))).alias("cname"), F.min("ttl").alias("min_ttl")
    )


def answer_facts(answers: DataFrame, cloaked: DataFrame, listed: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Long answers as a row per event: n_answers, min_ttl over all records, long_txt, private, listed, cloaked.

    ``cloaked``: names (rdata) that hide a blocked one; ``listed``: addresses (rdata) in blocked networks. What depends on a
    record's value alone is worked out once per distinct value, and an event's records are added up once.
    """
    no = F.lit(None).cast("boolean")
    addresses = answers.filter("rtype in ('A', 'AAAA')").select("rdata").distinct()
    marks = addresses.join(listed.select("rdata", F.lit(True).alias("listed")), "rdata", "left").select(F.lit("ip").alias("kind"), "rdata", is_private_ip(F.col("rdata")).alias("private"), "listed", no.alias("cloaked"))
    marks = marks.unionByName(cloaked.select(F.lit("name").alias("kind"), "rdata", no.alias("private"), no.alias("listed"), F.lit(True).alias("cloaked")))
    kind = F.when(F.col("rtype").isin("A", "AAAA"), "ip").when(F.col("rtype") == "CNAME", "name")
    j = answers.withColumn("kind", kind).join(marks, ["kind", "rdata"], "left")
    any_ = lambda c: F.coalesce(F.max(c), F.lit(False))
    return j.groupBy("event_id").agg(
        F.count_if(F.col("rtype").isin("A", "AAAA", "TXT", "CNAME") & F.col("rdata").isNotNull()).alias("n_answers"),
        F.min("ttl").alias("min_ttl"),
        any_((F.col("rtype") == "TXT") & (F.octet_length("rdata") > cfg.long_txt_bytes)).alias("long_txt"),
        *[any_(c).alias(c) for c in ("private", "listed", "cloaked")],
    )


def answer_signals(cfg: EngineConfig) -> list[Signal]:
    """Of ``answer_facts``, in order; rebinding, networks and cloaking end the fold. Some can be switched off."""
    return [
        (F.col("n_answers") > cfg.max_answers, F.lit(2), "INVALID_STRUCTURE"),
        ((F.col("min_ttl") < cfg.low_ttl) & F.lit(cfg.low_ttl_enabled), F.lit(2), "LOW_TTL"),
        (F.col("long_txt"), F.lit(3), "INVALID_STRUCTURE"),
        (F.col("private") & F.lit(cfg.rebinding_enabled), F.lit(10), "DNS_REBINDING"),
        (F.col("listed") & F.lit(cfg.asn_enabled), F.lit(10), "ASN_BLOCKED"),
        (F.col("cloaked"), F.lit(10), "CNAME_CLOAKING"),
    ]


ENDS = ("DNS_REBINDING", "ASN_BLOCKED", "CNAME_CLOAKING")


def answer_score(start: Column, cfg: EngineConfig) -> Column:
    """The score of a domain with its answer's signals on top. The first answer signal always counts."""
    return fold(start, signals(answer_signals(cfg)), cfg.block_at, ENDS)


def reason_bit(reason: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for name, bit in BIT.items() for x in (name, bit)]), reason)


def classify(score: Column, pass_action: Column, cfg: EngineConfig) -> Column:
    """(action, flags): flags is the bit of the first reason, SUSPICIOUS without one; null flags when the query passes."""
    total = score["total"]
    action = F.when(total >= cfg.block_at, "Blocked").when(total >= cfg.high_at, "HighlySuspicious")
    if cfg.log_suspicious:
        action = action.when(total >= cfg.suspicious_at, "Suspicious")
    bit = F.when(F.size(score["reasons"]) > 0, reason_bit(F.get(score["reasons"], F.lit(0)))).otherwise(BIT["SUSPICIOUS"])
    flags = F.when(action.isNotNull(), F.expr("1").cast("int") * F.pow(F.lit(2), bit).cast("int"))
    return F.struct(F.coalesce(action, pass_action).alias("action"), flags.cast("int").alias("flags"))
