"""Filter lists to rule tables, and rule tables to blocklists of several formats.

``parse_lines`` works on one line at a time, so it needs no shuffle; pruning
and consolidation shuffle by domain.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dnsloom.config import NRD, REGEX, WHITELIST, WILDCARD
from dnsloom.functions.names import ancestors, clean_tlds, depth, valid_name

_BROWSER = r"##|#@#|#\$#|#%#|#\^#|#\?#"
ROLE_FLAG = {"white": WHITELIST, "nrd": NRD, "black": 0}


def clean_lines(lines: DataFrame) -> DataFrame:
    """Trimmed lines without blanks and comments."""
    text = F.trim(F.regexp_replace("line", r"^\s+|\s+$", ""))
    return lines.withColumn("line", text).filter((F.col("line") != "") & ~F.col("line").startswith("!") & ~F.col("line").startswith("#"))


def is_browser(line: Column) -> Column:
    return line.rlike(_BROWSER)


def detect_format(line: Column) -> Column:
    slash = line.startswith("/") & (F.length(line) > 2) & (F.locate("/", line, 2) > 0)
    return (
        F.when(line.rlike("^(server|address)=/"), "dnsmasq")
        .when(line.startswith("0.0.0.0 ") | line.startswith("127.0.0.1 ") | line.startswith(":: "), "hosts")
        .when(line.startswith("||") | line.startswith("@@||"), "abp")
        .when(slash, "abp")
        .when(~line.contains(" ") & ~line.contains("/"), "plain")
        .otherwise("unknown")
    )


def _abp(line: Column) -> dict[str, Column]:
    """Flag and value of an ad-block line: options cut off, then regex, wildcard, anchored or bare."""
    white = line.startswith("@@")
    bare = F.regexp_replace(line, "^@@", "")
    whole_regex = bare.rlike(r"^/.+/$")
    text = F.when(whole_regex, bare).otherwise(F.regexp_replace(bare, r"\$.*$", ""))
    regex = text.rlike(r"^/.+/$")
    wild = ~regex & text.contains("*")
    value = F.when(regex, F.regexp_replace(text, "^/|/$", "")).when(wild, text).when(text.startswith("||"), F.regexp_extract(text, r"^\|\|([^\^]*)", 1)).otherwise(text)
    flags = F.when(white, WHITELIST).otherwise(0).bitwiseOR(F.when(regex, REGEX).when(wild, WILDCARD).otherwise(0))
    return {"value": value, "flags": flags}


def compiles(pattern: Column) -> Column:
    """Whether a pattern is one that ``rlike`` takes."""
    return F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), pattern).isNotNull()


def parse_lines(lines: DataFrame) -> DataFrame:
    """source, role, load_order, line_no, format, kind, value, flags, depth of every rule; kind "rejected" where a line yields none
    or a pattern that does not compile.

    kind: exact, suffix, glob, regex, browser, rejected. Suffix rules keep the
    base domain. Allow-listed globs and suffixes never block (see ``match``).
    """
    d = clean_lines(lines).withColumn("format", F.when(is_browser(F.col("line")), "browser").otherwise(detect_format(F.col("line"))))
    line, fmt, abp = F.col("line"), F.col("format"), _abp(F.col("line"))
    raw = (
        F.when(fmt == "hosts", F.get(F.split(line, r"\s+"), F.lit(1)))
        .when(fmt == "dnsmasq", F.get(F.split(line, "/"), F.lit(1)))
        .when(fmt.isin("plain", "browser"), line)
        .when(fmt == "abp", abp["value"])
    )
    role = F.lit(0)
    for name, flag in ROLE_FLAG.items():
        role = F.when(F.col("role") == name, flag).otherwise(role)
    flags = role.bitwiseOR(F.when(fmt == "abp", abp["flags"]).otherwise(0)).cast("int")
    d = d.withColumn("raw", raw).withColumn("flags", flags)
    stripped = F.regexp_replace(F.regexp_replace("raw", r"^\|\|", ""), r"\^.*$", "")
    glob = F.exists(F.split(stripped, r"\."), lambda s: s.contains("*") & (s != "*"))
    wild = F.col("flags").bitwiseAND(WILDCARD) != 0
    needs_name = fmt.isin("hosts", "plain")
    kind = (
        F.when(fmt == "browser", "browser")
        .when(F.col("raw").isNull() | (F.col("raw") == "") | (needs_name & ~valid_name(F.col("raw"))), "rejected")
        .when(F.col("flags").bitwiseAND(REGEX) != 0, F.when(compiles(F.col("raw")), "regex").otherwise("rejected"))
        .when(wild, F.when(glob, "glob").otherwise("suffix"))
        .otherwise("exact")
    )
    d = d.withColumn("kind", F.coalesce(kind, F.lit("rejected")))
    value = F.when(F.col("kind") == "glob", stripped).when(F.col("kind") == "suffix", F.regexp_replace(stripped, r"^(\*\.)+", "")).when(F.col("kind") == "rejected", line).otherwise(F.col("raw"))
    return d.select("source", "role", "load_order", "line_no", "format", "kind", value.alias("value"), "flags").withColumn("depth", depth(F.col("value")).cast("int"))


def domain_hash(value: Column) -> Column:
    return F.xxhash64(value)


def tld_exclude_rules(spark, tlds: Sequence[str]) -> DataFrame:
    """A suffix rule per excluded TLD, in the shape of ``parse_lines``; loaded last."""
    names = F.explode(F.array(*[F.lit(t) for t in clean_tlds(tlds)]).cast("array<string>"))
    return spark.range(1).select(
        F.lit("config").alias("source"), F.lit("black").alias("role"), F.lit(2**30).alias("load_order"), F.lit(0).cast("long").alias("line_no"), F.lit("config").alias("format"), F.lit("suffix").alias("kind"), names.alias("value"), F.lit(WILDCARD).alias("flags"), F.lit(0).alias("depth")
    )


def prune_redundant(rules: DataFrame, *, order_free: bool = False) -> DataFrame:
    """Without rules that an earlier exact rule on a strict parent makes redundant (allow-list rules stay).

    Every rule's parents are looked up among exact rules by name; the earliest
    position per name is enough, so the looked-up side has a row per domain.
    """
    at = F.struct("load_order", "line_no")
    numbered = rules.withColumn("_id", F.struct("source", "load_order", "line_no"))
    exact = rules.filter("kind = 'exact'").groupBy(F.col("value").alias("_parent")).agg(F.min(at).alias("_first"))
    name = F.when(F.col("kind") == "regex", F.replace("value", F.lit("\\."), F.lit("."))).otherwise(F.col("value"))
    open_ = numbered.filter((F.col("flags").bitwiseAND(WHITELIST) == 0) & ~F.col("kind").isin("browser", "rejected"))
    up = open_.select("_id", at.alias("_at"), F.explode(ancestors(name)).alias("_parent")).join(exact, "_parent")
    gone = up if order_free else up.filter(F.col("_first") < F.col("_at"))
    return numbered.join(gone.select("_id").distinct(), "_id", "left_anti").drop("_id")


def consolidate_exact(rules: DataFrame, *, whitelist_wins: bool = False) -> DataFrame:
    """One exact rule per domain: the last one loaded (or an allow-list rule, if any)."""
    first = [F.desc(F.col("flags").bitwiseAND(WHITELIST))] if whitelist_wins else []
    last = Window.partitionBy("value").orderBy(*first, F.desc("load_order"), F.desc("line_no"), "source")
    return rules.filter("kind = 'exact'").withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")


def dedup_patterns(rules: DataFrame, kind: str = "glob") -> DataFrame:
    """The distinct values of a kind of rule, sorted."""
    return rules.filter(F.col("kind") == kind).select("value").distinct().orderBy("value")


def source_stats(rules: DataFrame) -> DataFrame:
    return rules.groupBy("source", "format", "kind").agg(F.count(F.lit(1)).alias("n"))


def classify_rules(parsed: DataFrame) -> DataFrame:
    """rule_type (domain, wildcard, regex, whitelist, browser) and value, with the place in the load order."""
    f = F.col("flags")
    abp = F.col("format") == "abp"
    kind = (
        F.when(F.col("kind") == "browser", "browser")
        .when(abp & (f.bitwiseAND(WHITELIST) != 0), "whitelist")
        .when(F.col("kind") == "regex", "regex")
        .when(F.col("kind").isin("glob", "suffix"), "wildcard")
        .otherwise("domain")
    )
    value = F.when(F.col("kind") == "suffix", F.concat(F.lit("*."), F.col("value"))).otherwise(F.col("value"))
    return parsed.filter("kind <> 'rejected'").select(kind.alias("rule_type"), value.alias("value"), "load_order", "line_no", "source")


def split_dedup_sort(opt_rules: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(network, browser, whitelist): network rules one per value, the first loaded; browser rules distinct; both sorted; the whitelist as it is."""
    first = Window.partitionBy("value").orderBy("load_order", "line_no", "source", "rule_type")
    network = opt_rules.filter(F.col("rule_type").isin("domain", "wildcard", "regex")).withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    browser = opt_rules.filter("rule_type = 'browser'").select("rule_type", "value").distinct()
    return network.select("rule_type", "value").orderBy("value"), browser.orderBy("value"), opt_rules.filter("rule_type = 'whitelist'").select("rule_type", "value")


def rendered(target: str) -> Column:
    """A rule's line for a target (plain, pihole, hosts, dnsmasq, unbound, adguard); null where the target has none."""
    v, base = F.col("value"), F.regexp_replace("value", r"^\*\.", "")
    line = {
        "plain": lambda x, wild: x,
        "pihole": lambda x, wild: x,
        "hosts": lambda x, wild: F.concat(F.lit("0.0.0.0 "), x),
        "dnsmasq": lambda x, wild: F.concat(F.lit("address=/." if wild else "address=/"), x, F.lit("/#")),
        "unbound": lambda x, wild: F.concat(F.lit('local-zone: "'), x, F.lit('." always_nxdomain')),
        "adguard": lambda x, wild: F.concat(F.lit("||"), x, F.lit("^")),
    }[target]
    out = F.when(F.col("rule_type") == "domain", line(v, False)).when(F.col("rule_type") == "wildcard", line(base, True))
    if target == "adguard":
        out = out.when(F.col("rule_type") == "regex", F.concat(F.lit("/"), v, F.lit("/"))).when(F.col("rule_type") == "whitelist", F.concat(F.lit("@@||"), v, F.lit("^")))
    return out


def format_rules(opt_rules: DataFrame, target: str) -> DataFrame:
    return opt_rules.select(rendered(target).alias("line")).filter("line is not null")


def network_list(opt_rules: DataFrame, target: str, *, separate_whitelist: bool = False) -> DataFrame:
    """The lines of a target's blocklist, sorted; for AdGuard the allow-list follows unless it is kept apart."""
    network, _, white = split_dedup_sort(opt_rules)
    lines = format_rules(network, target)
    if target == "adguard" and not separate_whitelist:
        lines = lines.unionByName(format_rules(white, target))
    return lines.orderBy("line")
