"""Rule matches per domain: exact, suffix, glob, regex and allow-list.

DNS traffic repeats itself, so everything is worked out once per distinct
domain; callers join the result back. Parents are exploded and joined by name;
rules meet domains in equi joins, so Spark may broadcast a small rule table or
shuffle both sides of large ones.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dnsloom.config import NRD, WHITELIST, WILDCARD
from dnsloom.functions.names import ancestors
from dnsloom.sources.tables import stored

#: Patterns joined into one alternation, patterns of a part of it when a hit is traced, and patterns that are written into the plan as literals at most.
POOL, PART, LITERAL = 1000, 32, 20_000
#: Back-references, named groups, open quotes and comments.
ALONE = r"\\[1-9kQ]|\(\?<[A-Za-z]|\(\?[A-Za-z-]*x"


def glob_to_regex(pattern: Column) -> Column:
    """Anchored regex of a glob: a star stays inside a label; a first label of one star takes any number of labels."""
    deep = pattern.startswith("*.")
    body = F.regexp_replace(pattern, r"^\*\.", "")
    escaped = F.regexp_replace(body, r"([.\\+?()\[\]{}|^$])", r"\\$1")
    return F.concat(F.lit("^"), F.when(deep, r"([^.]+\.)+").otherwise(""), F.regexp_replace(escaped, r"\*", "[^.]*"), F.lit("$"))


def exact_hits(domains: DataFrame, rules: DataFrame) -> DataFrame:
    """domain, flags and source of the consolidated exact rule of domains that have one."""
    exact = rules.filter("kind = 'exact'").select(F.col("value").alias("domain"), "flags", "source")
    return domains.join(exact, "domain")


def glob_rules(hits: DataFrame, rules: DataFrame) -> DataFrame:
    """domain, rule: every blocking glob of domains that some glob matches."""
    last = lambda c: F.element_at(F.split(c, r"\."), -1)
    globs = rules.filter((F.col("kind") == "glob") & (F.col("flags").bitwiseAND(WHITELIST) == 0)).groupBy("value").agg(F.min(_place()).alias("rule"))
    free = last(F.col("value")).contains("*")
    globs = globs.select(glob_to_regex(F.col("value")).alias("pattern"), F.explode(F.when(free, _every_share()).otherwise(F.array(last(F.col("value"))))).alias("key"), "rule")
    # Globs with a starred last label are tried on every domain that is hit.
    return _traced(hits.select("domain", F.explode(F.array(last(F.col("domain")), _share())).alias("key")), globs)


def regex_rules(hits: DataFrame, rules: DataFrame) -> DataFrame:
    """domain, rule: every blocking regex of domains in which some regex finds a match."""
    pool = rules.filter((F.col("kind") == "regex") & (F.col("flags").bitwiseAND(WHITELIST) == 0)).groupBy(F.col("value").alias("pattern")).agg(F.min(_place()).alias("rule"))
    gram = mandatory_trigram(F.col("pattern"))
    pool = pool.select("pattern", F.explode(F.when(gram.isNull(), _every_share()).otherwise(F.array(gram))).alias("key"), "rule")
    return _traced(hits.select("domain", F.explode(F.array_union(F.array_distinct(_trigrams()), F.array(_share()))).alias("key")), pool)


#: Shares that domains are dealt to where patterns without a key meet all of them.
SHARES = 64


def _share() -> Column:
    return F.concat(F.lit("*"), F.pmod(F.xxhash64("domain"), F.lit(SHARES)).cast("string"))


def _every_share() -> Column:
    return F.array(*[F.lit(f"*{i}") for i in range(SHARES)])


def _trigrams() -> Column:
    """The runs of three characters of a domain; none where it is shorter."""
    runs = F.transform(F.sequence(F.lit(1), F.length("domain") - 2), lambda i: F.substr(F.col("domain"), i, F.lit(3)))
    return F.when(F.length("domain") > 2, runs).otherwise(F.array().cast("array<string>"))


def _traced(hits: DataFrame, patterns: DataFrame) -> DataFrame:
    """domain and rule of every pattern (columns key, pattern, rule) that matches a domain of the same key: by parts of ``PART``
    patterns first, one by one in the parts that match. Only domains that match something come here."""
    at = F.row_number().over(Window.partitionBy("key").orderBy("pattern"))
    dealt = patterns.withColumn("part", F.when(F.col("pattern").rlike(ALONE), -at).otherwise(F.floor(at / PART)).cast("int"))
    dealt = dealt.withColumn("wrapped", F.when(F.col("part") < 0, F.col("pattern")).otherwise(F.concat(F.lit("(?:"), F.col("pattern"), F.lit(")"))))
    parts = dealt.groupBy("key", "part").agg(F.array_join(F.collect_list("wrapped"), "|").alias("any_of"))
    near = hits.join(parts, "key").filter("domain rlike any_of").select("domain", "key", "part")
    return near.join(dealt.select("key", "part", "pattern", "rule"), ["key", "part"]).filter("domain rlike pattern").select("domain", "rule")


def _parents(domains: DataFrame) -> DataFrame:
    return domains.select("domain", F.explode(ancestors(F.col("domain"))).alias("parent"))


def parent_hits(domains: DataFrame, rules: DataFrame) -> DataFrame:
    """Domains with a wildcard rule on a strict parent, a row per such parent: whether it allows, and the first rule that blocks."""
    wild = rules.filter((F.col("kind").isin("suffix", "exact")) & (F.col("flags").bitwiseAND(WILDCARD) != 0))
    white = F.col("flags").bitwiseAND(WHITELIST)
    wild = wild.groupBy(F.col("value").alias("parent")).agg((F.max(white) > 0).alias("allows"), F.min(F.when(white == 0, _place())).alias("rule"))
    return _parents(domains).join(wild, "parent").select("domain", "allows", "rule")


def _place() -> Column:
    """A rule's place in load order, with its source: the least of several is the rule loaded first."""
    return F.struct("load_order", "line_no", "source")


def glob_hits(domains: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct domains that a blocking glob matches. Globs with a plain last label meet domains of that label only, as one
    alternation per label (or per ``POOL`` of them); domains go by label, so a pattern is compiled once for many."""
    globs = rules.filter((F.col("kind") == "glob") & (F.col("flags").bitwiseAND(WHITELIST) == 0)).select("value").distinct()
    last = lambda c: F.element_at(F.split(c, r"\."), -1)
    globs = globs.select(glob_to_regex(F.col("value")).alias("pattern"), last(F.col("value")).alias("last"))
    keyed = domains.withColumn("last", last(F.col("domain")))
    own = globs.filter(~F.col("last").contains("*")).withColumn("slice", F.floor(F.row_number().over(Window.partitionBy("last").orderBy("pattern")) / POOL))
    own = own.groupBy("last", "slice").agg(F.array_join(F.collect_list("pattern"), "|").alias("any_of"))
    plain = keyed.sortWithinPartitions("last").join(own, "last").filter("domain rlike any_of").select("domain")
    starred = globs.filter(F.col("last").contains("*")).select("pattern")
    return plain.unionByName(_pool_hits(domains, starred)).distinct()


def regex_hits(domains: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct domains in which a blocking regex finds a match.

    Up to ``POOL`` of them meet all domains as one alternation. Of more, a regex that cannot match without some three letters in a row meets only the domains that hold them, by an equi join on
    the trigram; the others meet all domains, as one alternation. A domain comes up once for each such regex of its trigrams.
    """
    pool = rules.filter((F.col("kind") == "regex") & (F.col("flags").bitwiseAND(WHITELIST) == 0)).select(F.col("value").alias("pattern")).distinct()
    if pool.count() <= POOL:
        return _pool_hits(domains, pool)
    keyed = pool.withColumn("gram", mandatory_trigram(F.col("pattern")))
    own = keyed.filter("gram is not null").withColumn("slice", F.floor(F.row_number().over(Window.partitionBy("gram").orderBy("pattern")) / POOL))
    own = own.withColumn("alone", F.when(F.col("pattern").rlike(ALONE), F.col("pattern")))
    joined = F.array_join(F.transform(F.collect_list("pattern"), lambda p: F.concat(F.lit("(?:"), p, F.lit(")"))), "|")
    own = own.groupBy("gram", "slice", "alone").agg(F.coalesce("alone", joined).alias("any_of"))
    spread = domains.select("domain", F.explode(F.array_distinct(_trigrams())).alias("gram"))
    near = spread.join(own, "gram").filter("domain rlike any_of").select("domain")
    return near.unionByName(_pool_hits(domains, keyed.filter("gram is null").select("pattern"))).distinct()


#: What makes it unsure that a literal stands in every match: choices, groups, classes, options and quotes.
UNSURE = r"[|()\[\]]|\\[QEpPxucN0-9k]|\(\?"


def mandatory_trigram(pattern: Column) -> Column:
    """Three letters or digits in a row that every match of the regex holds, or null. Only regexes without choices, groups and
    classes are read; a letter that may be left out or repeated ends the run before it."""
    plain = F.regexp_replace(pattern, r"\\[dDwWsSbBAzZGnrtfaehHvVRX]", " ")
    # What is quantified may be missing: it goes with its quantifier. A dot, an anchor and any sign stands for itself at best.
    fixed = F.regexp_replace(plain, r"(\\.|.)(\{[^}]*\}|[*?+])[?+]?", " ")
    runs = F.regexp_extract_all(F.regexp_replace(fixed, r"\\.", " "), F.lit("([a-z0-9]{3,})"), F.lit(1))
    return F.when(~pattern.rlike(UNSURE) & (F.size(runs) > 0), F.substring(F.array_max(F.transform(runs, lambda r: F.struct(F.length(r).alias("n"), r.alias("r"))))["r"], 1, 3))


def _pool_hits(domains: DataFrame, pool: DataFrame) -> DataFrame:
    """A pool without a key meets every domain; it goes in slices of a bounded number of patterns, joined into one alternation each.

    Patterns that others would change, or that would change others (``ALONE``), stay by themselves. Up to ``LITERAL``
    patterns are literals of a filter, compiled once per task; a larger pool is a table that domains meet in a join.
    """
    listed = [r[0] for r in pool.distinct().orderBy("pattern").limit(LITERAL + 1).collect()]
    if len(listed) <= LITERAL:
        alone = [p for p in listed if re.search(ALONE, p)]
        rest = [f"(?:{p})" for p in listed if not re.search(ALONE, p)]
        every = alone + ["|".join(rest[i : i + POOL]) for i in range(0, len(rest), POOL)]
        return domains.select("domain").filter(reduce(lambda a, p: a | F.col("domain").rlike(p), every, F.lit(False)))
    slices = pool.distinct().withColumn("slice", F.pmod(F.xxhash64("pattern"), F.lit(max(1, -(-pool.count() // POOL)))))
    slices = slices.withColumn("own", F.when(F.col("pattern").rlike(ALONE), F.col("pattern")))
    together = F.array_join(F.transform(F.collect_list("pattern"), lambda p: F.concat(F.lit("(?:"), p, F.lit(")"))), "|")
    joined = slices.groupBy("slice", "own").agg(F.coalesce("own", together).alias("any_of"))
    return domains.join(joined, F.expr("domain rlike any_of"), "left_semi").select("domain")


def matches(domains: DataFrame, rules: DataFrame, *, match_parents: bool = False) -> DataFrame:
    """Per distinct domain: rule_flags, whitelisted, static_blocked, is_nrd, suffix_blocked, glob_blocked, regex_blocked, and
    rule_source, suffix_source, glob_source, regex_source: the lists that the exact rule and the first blocking rule of each kind came from.

    An exact rule decides about the allow-list by itself; only without one are
    the parents asked. ``match_parents`` lets a static block on a parent hold
    for its children too.
    """
    distinct = stored(domains.select("domain").distinct(), "domains")
    tag = lambda df, kind: df.withColumn("hit", F.lit(kind))
    globbed, matched = stored(glob_hits(distinct, rules), "hits"), stored(regex_hits(distinct, rules), "hits")
    parts = [tag(exact_hits(distinct, rules), "exact"), tag(parent_hits(distinct, rules), "suffix"), tag(glob_rules(globbed, rules), "glob"), tag(regex_rules(matched, rules), "regex")]
    if match_parents:
        exact = rules.filter((F.col("kind") == "exact") & (F.col("flags").bitwiseAND(WHITELIST) == 0)).select(F.col("value").alias("parent")).distinct()
        parts.append(tag(_parents(distinct).join(exact, "parent", "left_semi").select("domain"), "above"))
    # All hits of a domain in one aggregation, and one join back to the domains.
    first = lambda kind: F.min(F.when(F.col("hit") == kind, F.col("rule")))
    found = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).groupBy("domain").agg(
        F.max("flags").alias("rule_flags"),
        F.max("source").alias("rule_source"),
        F.max("allows").alias("allows"),
        *[first(kind).alias(kind) for kind in ("suffix", "glob", "regex")],
        F.max(F.col("hit") == "above").alias("above"),
    )
    d = distinct.join(found, "domain", "left")
    f, yes = F.col("rule_flags"), lambda c: F.coalesce(F.col(c), F.lit(False))
    return d.select(
        "domain",
        "rule_flags",
        "rule_source",
        F.when(f.isNotNull(), f.bitwiseAND(WHITELIST) != 0).otherwise(yes("allows")).alias("whitelisted"),
        (F.coalesce(f.bitwiseAND(WHITELIST) == 0, F.lit(False)) | yes("above")).alias("static_blocked"),
        F.coalesce(f.bitwiseAND(NRD) != 0, F.lit(False)).alias("is_nrd"),
        *[F.col(kind).isNotNull().alias(f"{kind}_blocked") for kind in ("suffix", "glob", "regex")],
        *[F.col(kind)["source"].alias(f"{kind}_source") for kind in ("suffix", "glob", "regex")],
    )
