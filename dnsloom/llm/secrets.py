"""Secret scans behind a trigram inverted index, in DataFrame functions only.

Each rule's regex is taken apart (on the driver) into a Boolean query over
trigrams: alternatives are OR, what must occur together is AND, and parts
without a fixed text ask for nothing. The index holds, for the trigrams that
rules ask for, a posting per text that contains them. Postings are intersected
by rule, and only texts that satisfy a rule's query are searched with its regex.
A rule whose query is empty (no mandatory trigram) scans every text.

Texts are keyed by a 64-bit hash, so copies share postings; a collision of
hashes costs a needless search, never a missing one.

Null text: empty, no spans. Repeated rows and ids: a row each. Empty tables
give empty results. Positions are code points, the end is exclusive. Ties: spans
of several rules at one start come in the order of the rules; within a rule
matches never overlap. Very long texts are searched whole. Other columns are not
read, so their names cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dnsloom.llm.common import scratch, settle


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


#: The contract's patterns (letters of the first in either case), then what this library adds.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]{14,}", 0, 18, True),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16, True),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
)

#: A Boolean query: alternatives, each a set of trigrams that must all occur. One empty alternative: anything.
Query = frozenset[frozenset[str]]
ANY: Query = frozenset([frozenset()])
_MOST = 64


def _both(a: Query, b: Query) -> Query:
    return frozenset(x | y for x in a for y in b) if len(a) * len(b) <= _MOST else min(a, b, key=len)


def _grams(texts: set[str]) -> Query:
    return frozenset(frozenset(t[i : i + 3] for i in range(len(t) - 2)) for t in texts)


def trigram_query(pattern: str) -> Query:
    """What every match of ``pattern`` contains, in lower-case trigrams."""

    def walk(items) -> tuple[Query, set[str] | None]:
        """The query of a sequence, and all its texts if they are few."""
        query, texts, whole = ANY, {""}, True
        for op, arg in items:
            own: set[str] | None = None
            asked = ANY
            name = str(op)
            if name == "LITERAL":
                own = {chr(arg).lower()}
            elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg) and len(arg) <= 6:
                own = {chr(a).lower() for _, a in arg}
            elif name == "SUBPATTERN":
                asked, own = walk(arg[3])
            elif name == "BRANCH":
                parts = [walk(x) for x in arg[1]]
                asked = frozenset().union(*(q if t is None else _grams(t) for q, t in parts))
                own = None if any(t is None for _, t in parts) else set().union(*(t for _, t in parts))
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
                low, high, sub = arg
                q, t = walk(sub)
                if high == 1 and low == 0 and t is not None:
                    own = t | {""}
                elif low:
                    asked = q if t is None else _grams(t)
            if own is not None and len(own) * len(texts) <= _MOST:
                texts = {a + b for a in texts for b in own}
            else:
                query = _both(_both(query, _grams(texts)), asked if own is None else _grams(own))
                texts, whole = {""}, False
        return (ANY, texts) if whole else (_both(query, _grams(texts)), None)

    query, texts = walk(re._parser.parse(pattern))
    query = query if texts is None else _grams(texts)
    return frozenset(a for a in query if not any(b < a for b in query))


def trigram_index(texts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Postings (gram, tid) of the trigrams that ``rules`` ask for; ``texts`` has tid and text. Sorted, so a gram's postings lie together in each file."""
    grams = sorted({g for r in rules for a in trigram_query(r.pattern) for g in a})
    folded = texts.select("tid", F.lower("text").alias("_low"))
    present = F.array_compact(F.array(*[F.when(F.contains("_low", F.lit(g)), F.lit(g)) for g in grams])) if grams else F.array().cast("array<string>")
    return settle(folded.select(F.explode(present).alias("gram"), "tid").distinct().sortWithinPartitions("gram"), "postings")


def candidates(postings: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """tid and the kinds of rules whose queries its postings satisfy, for rules that ask for something."""
    asked = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) != ANY}
    if not asked:
        return postings.select("tid", F.array().cast("array<string>").alias("kinds")).limit(0)
    grams = sorted({g for q in asked.values() for a in q for g in a})
    bit = {g: i for i, g in enumerate(grams)}
    word = lambda i: F.bit_or(F.when(F.col("bit").between(63 * i, 63 * i + 62), F.expr(f"shiftleft(1L, bit - {63 * i})")).otherwise(F.lit(0)).cast("long")).alias(f"w{i}")
    words = len(grams) // 63 + 1
    number = F.element_at(F.create_map(*[F.lit(x) for g, i in bit.items() for x in (g, i)]), F.col("gram"))
    found = postings.withColumn("bit", number).groupBy("tid").agg(*[word(i) for i in range(words)])

    def holds(alternative) -> Column:
        masks = [sum(1 << (bit[g] - 63 * i) for g in alternative if bit[g] // 63 == i) for i in range(words)]
        return reduce(lambda a, b: a & b, [(F.col(f"w{i}").bitwiseAND(F.lit(m)) == F.lit(m)) for i, m in enumerate(masks) if m])

    hits = F.array_compact(F.array(*[F.when(reduce(lambda a, b: a | b, [holds(a) for a in q]), F.lit(k)) for k, q in asked.items()]))
    return found.select("tid", hits.alias("kinds")).filter(F.size("kinds") > 0)


def _spans(rule: Rule, order: int) -> Column:
    """array<struct<start, order, end>> of a rule from its columns: matches, their lengths that count, and the texts between."""
    m, g, p = (F.col(f"_{x}_{rule.kind}") for x in "mgp")
    row = F.arrays_zip(F.transform(F.slice(p, 1, F.size(m)), F.length).alias("gap"), F.transform(m, F.length).alias("size"), F.transform(g, F.length).alias("counts"))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,ord:int,end:int>>").alias("out"))

    def step(acc, x):
        start = acc["at"] + x["gap"]
        end = start + x["size"]
        span = F.struct(start.alias("start"), F.lit(order).alias("ord"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(x["counts"] >= rule.least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.when(F.size(m) > 0, F.aggregate(row, empty, step)["out"]).otherwise(F.array().cast("array<struct<start:int,ord:int,end:int>>"))


def find_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, and an array of spans (start, ord: the rule's place in ``rules``, end) for each rule, named by kind."""
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("tid", F.xxhash64("text"))
    satisfied = settle(candidates(trigram_index(texts, rules), rules), "candidates")
    joined = texts.join(satisfied, "tid", "left")
    none = F.array().cast("array<string>")
    for r in rules:
        scan = F.lit(True) if trigram_query(r.pattern) == ANY else F.coalesce(F.array_contains("kinds", r.kind), F.lit(False))
        joined = joined.withColumn(f"_m_{r.kind}", F.when(scan, F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))).otherwise(none))
    for r in rules:
        some = F.size(f"_m_{r.kind}") > 0
        joined = joined.withColumn(f"_p_{r.kind}", F.when(some, F.split("text", r.pattern, -1)).otherwise(none))
        counted = F.col(f"_m_{r.kind}") if not r.group else F.when(some, F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group))).otherwise(none)
        joined = joined.withColumn(f"_g_{r.kind}", counted)
    return joined.select(F.col("id").alias(id_col), *[_spans(r, i).alias(r.kind) for i, r in enumerate(rules)])


def written(rules: Sequence[Rule], kinds: Sequence[str]) -> Column:
    """kind:start:end of the spans of ``kinds``, by start, then kind as listed, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    spans = F.array_sort(F.concat(*[F.col(k) for k in kinds]))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["ord"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4_secrets(spark, sf_dir: str) -> DataFrame:
    with scratch(spark):
        found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
        base = [r.kind for r in RULES if r.base]
        digest = found.select(
            "doc_id",
            *[F.size(k).cast("long").alias(f"n_{k}") for k in base],
            F.sha2(written(RULES, base), 256).alias("base_sha256"),
            written(RULES, [r.kind for r in RULES]).alias("spans"),
        )
        return settle(digest, "secrets", keep=True)


_SQL_PATTERNS = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
)
OP4_SQL = (
    "WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), x AS ("
    + " UNION ALL ".join(f"SELECT rid, '{k}' AS kind, {i} AS ord, {least} AS least, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {g}) AS g, string_split_regex(t, '{p}') AS p FROM d WHERE regexp_matches(t, '{p}')" for i, (k, p, g, least) in enumerate(_SQL_PATTERNS))
    + """), s AS (SELECT rid, kind, ord, least, length(g[i]) AS counts, length(m[i]) AS size,
  list_sum(list_transform(p[1:i], lambda a: length(a)))::BIGINT + coalesce(list_sum(list_transform(m[1:i-1], lambda a: length(a))), 0)::BIGINT AS start
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM x)),
k AS (SELECT rid, kind, ord, kind || ':' || start || ':' || (start + size) AS span, start FROM s WHERE counts >= least),
a AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(span, ',' ORDER BY start, ord) FILTER (ord < 3) AS base, string_agg(span, ',' ORDER BY start, ord) AS spans FROM k GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (rid)"""
)
