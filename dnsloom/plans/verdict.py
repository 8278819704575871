"""From a table of queries, their answers and compiled rules to explained verdicts.

Everything that depends on the name alone is worked out once per distinct
domain, then joined back to the queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dnsloom.config import BIT, WHITELIST, WILDCARD, EngineConfig
from dnsloom.functions.lexical import banned_keyword, dga_reason, generated, ngram_verdicts
from dnsloom.functions.names import ancestors, forbidden_qtype, illegal_idn, normalize_domain, sld, structure_invalid
from dnsloom.operators.match import matches
from dnsloom.operators.ranges import network_table, within
from dnsloom.operators.score import answer_facts, answer_score, classify, domain_score, nothing


def domain_facts(domains: DataFrame, rules: DataFrame, cfg: EngineConfig, model: DataFrame | None = None) -> DataFrame:
    """Per distinct domain: rule hits, heuristics and score. ``model`` (as ``lexical.ngram_train`` makes it) is asked where ``cfg`` says so."""
    d, passes = F.col("domain"), None
    facts = matches(domains, rules)
    if cfg.use_ngram:
        if model is None:
            raise ValueError("use_ngram needs a language model")
        facts = facts.withColumn("sld", sld(d)).join(ngram_verdicts(facts.select("domain"), model, cfg), "sld", "left")
        passes = F.coalesce("ngram_pass", F.lit(True))  # labels that are too short are not judged
    return (
        facts.withColumns({"keyword": banned_keyword(d, cfg), "signs": generated(d, cfg)})  # used twice below, worked out once
        .withColumn("structure_invalid", structure_invalid(d, cfg))
        .withColumn("illegal_idn", illegal_idn(d, cfg))
        .withColumn("dga", dga_reason(d, cfg, passes, F.col("signs")))
        .withColumn("score", domain_score(d, F.col("is_nrd"), cfg, F.col("signs"), F.col("keyword")))
    )


def _action(action: str, reason: str | None = None, detail: Column | None = None, source: Column | None = None) -> Column:
    text = lambda c: (c if c is not None else F.lit(None)).cast("string")
    return F.struct(F.lit(action).alias("action"), F.lit(reason).cast("string").alias("reason"), text(detail).alias("detail"), text(source).alias("source"))


def resolution(cfg: EngineConfig) -> Column:
    """(action, reason, detail, source: the list whose rule decided) of the first step that decides. Structure and IDN come before the configured steps; the end is the upstream server."""
    steps = {
        "whitelist": [(F.col("whitelisted"), _action("Allow"))],
        "hot_cache": [],
        "static_block": [(F.col("static_blocked"), _action("Block", "STATIC_BLACKLIST", F.lit("blocklist"), F.col("rule_source")))],
        "suffix_match": [(F.col(f"{k}_blocked"), _action("Block", "ABP_RULE", F.lit(v), F.col(f"{k}_source"))) for k, v in (("suffix", "wildcard"), ("glob", "glob"), ("regex", "regex"))],
        "heuristics": [(F.col("keyword").isNotNull(), _action("Block", "BANNED_KEYWORD", F.col("keyword"))), (F.col("dga") == "HIGH_ENTROPY", _action("Block", "HIGH_ENTROPY")), (F.col("dga").isNotNull(), _action("Block", "LEXICAL_ANALYSIS"))],
        "upstream": [(F.lit(True), _action("ProxyToUpstream"))],
    }
    chain = F.when(F.col("structure_invalid"), _action("Block", "INVALID_STRUCTURE")).when(F.col("illegal_idn"), _action("Block", "SUSPICIOUS_IDN"))
    for name in cfg.pipeline:
        for hit, out in steps[name]:
            chain = chain.when(hit, out)
    return chain.otherwise(_action("ProxyToUpstream"))


def resolve(queries: DataFrame, rules: DataFrame, cfg: EngineConfig, model: DataFrame | None = None) -> DataFrame:
    """``queries`` (with domain) plus resolution (action, reason, detail), score, facts of the domain."""
    normal = queries.withColumn("domain", normalize_domain(F.col("domain")))
    facts = domain_facts(normal.select("domain"), rules, cfg, model).withColumn("resolution", resolution(cfg))
    return normal.join(facts, "domain", "left")


def cloaked_names(answers: DataFrame, rules: DataFrame) -> DataFrame:
    """rdata of the CNAME records whose target is blocked by an exact or suffix rule; each distinct target is looked up once."""
    targets = answers.filter("rtype = 'CNAME'").select("rdata").distinct().withColumn("domain", normalize_domain(F.col("rdata")))
    black = rules.filter(F.col("flags").bitwiseAND(WHITELIST) == 0)
    exact = black.filter("kind = 'exact'").select(F.col("value").alias("domain"))
    wild = black.filter((F.col("kind") == "suffix") & (F.col("flags").bitwiseAND(WILDCARD) != 0)).select(F.col("value").alias("domain")).distinct()
    direct = targets.join(exact, "domain", "left_semi").select("rdata")
    above = targets.select("rdata", F.explode(ancestors(F.col("domain"))).alias("domain")).join(wild, "domain", "left_semi").select("rdata")
    return direct.unionByName(above).distinct()


def inspected_events(answers: DataFrame, rules: DataFrame, networks: DataFrame, cfg: EngineConfig) -> DataFrame:
    """A row per event with what its answers say."""
    addresses = answers.filter("rtype in ('A', 'AAAA')").select("rdata")
    listed = within(addresses, networks, "rdata").select(F.col("ip").alias("rdata")).distinct()
    return answer_facts(answers, cloaked_names(answers, rules), listed, cfg)


def verdict(queries: DataFrame, answers: DataFrame, rules: DataFrame, cfg: EngineConfig, networks: DataFrame | None = None, model: DataFrame | None = None) -> DataFrame:
    """Per query: event_id, ts, client_ip, domain, qtype, action, reason, detail, flags, total, reasons, pass_action.

    A forbidden query type blocks first, a resolution that blocks keeps its
    reason, and what passes is scored with its answer: an allow-listed query may
    still be blocked by score. ``answer_status``: ok (an answer is there),
    unparsed (classified by the domain's score alone), error (passes as it is);
    a query without answers counts as unparsed unless it says otherwise.
    ``networks``: blocked ones as ``ranges.parse_networks`` gives them, of any number; else those of ``cfg``.
    """
    resolved = resolve(queries, rules, cfg, model)
    seen = inspected_events(answers, rules, networks if networks is not None else network_table(answers.sparkSession, cfg.blocked_networks), cfg)
    j = resolved.join(seen, "event_id", "left")
    if "answer_status" not in queries.columns:
        j = j.withColumn("answer_status", F.when(F.col("n_answers").isNull(), "unparsed").otherwise("ok"))
    passed = F.when(F.col("resolution.action") == "Allow", "Allowed").otherwise("Proxied")
    start = F.coalesce(F.col("score"), nothing())
    total = F.when((F.col("answer_status") == "ok") & F.col("n_answers").isNotNull(), answer_score(start, cfg)).otherwise(start)
    j = j.withColumn("pass_action", passed).withColumn("final", total)
    j = j.withColumn("classified", F.when(F.col("answer_status") == "error", F.struct(F.col("pass_action").alias("action"), F.lit(None).cast("int").alias("flags"))).otherwise(classify(F.col("final"), F.col("pass_action"), cfg)))
    bad_type, blocks = forbidden_qtype(F.col("qtype"), cfg), F.col("resolution.action") == "Block"
    bits = F.create_map(*[F.lit(x) for name, bit in BIT.items() for x in (name, 1 << bit)])
    return j.select(
        "event_id",
        "ts",
        "client_ip",
        "domain",
        "qtype",
        F.when(bad_type | blocks, "Blocked").otherwise(F.col("classified.action")).alias("action"),
        F.when(bad_type, "FORBIDDEN_QTYPE").when(blocks, F.col("resolution.reason")).otherwise(F.when(F.col("classified.flags").isNotNull(), F.get("final.reasons", F.lit(0)))).alias("reason"),
        F.when(bad_type, F.col("qtype").cast("string")).when(blocks, F.col("resolution.detail")).alias("detail"),
        F.when(bad_type, F.lit(1 << BIT["FORBIDDEN_QTYPE"])).when(blocks, F.element_at(bits, F.col("resolution.reason"))).otherwise(F.col("classified.flags")).cast("int").alias("flags"),
        F.when(bad_type | blocks, F.lit(None)).otherwise(F.col("final.total")).cast("int").alias("total"),
        F.when(bad_type | blocks, F.lit(None)).otherwise(F.array_join("final.reasons", ",")).alias("reasons"),
        F.when(bad_type | blocks, F.lit(None).cast("string")).otherwise(F.col("pass_action")).alias("pass_action"),
        F.when(~bad_type & blocks, F.col("resolution.source")).alias("rule_source"),
    )
