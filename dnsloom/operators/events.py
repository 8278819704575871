"""Analytics of the event log: counters, rankings, talkers, timelines, searches.

Events: event_id, ts, client_ip, domain, action, flags (null without a
reason). Every ranking has a second key, so results do not depend on order.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dnsloom.config import ACTIONS, BLOCKED_CLASS, REASONS
from dnsloom.functions.labels import flag_labels, flags_label, hash_hex, hms


def is_blocked() -> Column:
    return F.col("action").isin(*BLOCKED_CLASS)


def _count(cond: Column) -> Column:
    return F.count_if(cond)


def _has(bit: int) -> Column:
    return F.coalesce(F.col("flags").bitwiseAND(1 << bit) != 0, F.lit(False))


def enrich_events(events: DataFrame, domain_map: DataFrame, *, fallback: bool = True) -> DataFrame:
    """Events with the domain of their hash; unknown hashes as #hex, or null."""
    known = domain_map.select("domain_hash", F.col("domain").alias("_name"))
    joined = events.drop("domain").join(known, "domain_hash", "left")
    name = F.coalesce("_name", F.concat(F.lit("#"), hash_hex(F.col("domain_hash")))) if fallback else F.col("_name")
    return joined.withColumn("domain", name).drop("_name")


def monitor_counters(events: DataFrame) -> DataFrame:
    return events.agg(F.count(F.lit(1)).alias("total"), _count(F.col("action") == "Allowed").alias("allowed"), _count(F.col("action") == "Proxied").alias("proxied"), _count(is_blocked()).alias("blocked"))


def proxy_counters(verdicts: DataFrame) -> DataFrame:
    """Suspicious queries count under the action they passed with."""
    own = F.when(F.col("action").isin("Suspicious", "HighlySuspicious"), F.col("pass_action")).otherwise(F.col("action"))
    return verdicts.withColumn("_a", own).agg(F.count(F.lit(1)).alias("total"), _count(F.col("_a") == "Blocked").alias("blocked"), _count(F.col("_a") == "Allowed").alias("allowed"), _count(F.col("_a") == "Proxied").alias("proxied"))


def rolling_window(events: DataFrame, seconds: int = 3600) -> DataFrame:
    """Events at most so much older than the newest."""
    newest = events.agg(F.max("ts").alias("_max"))
    return events.crossJoin(newest).filter(F.col("ts") >= F.col("_max") - F.make_interval(secs=F.lit(seconds))).drop("_max")


def top_values(events: DataFrame, column: str, n: int = 10) -> DataFrame:
    return events.groupBy(column).agg(F.count(F.lit(1)).alias("hits")).orderBy(F.desc("hits"), column).limit(n)


def event_records(events: DataFrame) -> DataFrame:
    return events.select("event_id", "ts", "domain", "client_ip", "action", "flags", F.array_join(flag_labels(F.col("flags")), ",").alias("flags_labels"))


def search_events(
    events: DataFrame, *, since=None, until=None, client: str | None = None, action: str | None = None, flags: int | None = None, domain: str | None = None, limit: int | None = 200
) -> DataFrame:
    """Newest first; filters combine. ``action``: its exact name; ``flags``: all of these bits (unknown ones are left out; events without flags never match); ``domain``: part of the name or of its hexadecimal hash, in either case. 1000 rows at most."""
    tests = []
    if since is not None:
        tests.append(F.col("ts") >= F.lit(since))
    if until is not None:
        tests.append(F.col("ts") <= F.lit(until))
    if client is not None:
        if not all(c in "0123456789abcdefABCDEF.:" for c in client) or not client:
            raise ValueError(f"not an IP address: {client}")
        tests.append(F.col("client_ip") == client)
    if action is not None:
        tests.append(F.col("action") == action)
    if flags is not None:
        required = flags & sum(1 << b for b, *_ in REASONS)
        tests.append(F.col("flags").isNotNull() & (F.col("flags").bitwiseAND(required) == required))
    if domain is not None:
        name = F.contains(F.lower("domain"), F.lit(domain.lower()))
        tests.append(name | F.contains(hash_hex(F.col("domain_hash")), F.lit(domain.lower())) if "domain_hash" in events.columns else name)
    kept = events.filter(reduce(lambda a, b: a & b, tests)) if tests else events
    return event_records(kept).orderBy(F.desc("ts"), F.desc("event_id")).limit(min(200 if limit is None else limit, 1000))


def _exploded_bits(events: DataFrame) -> DataFrame:
    bits = F.array_compact(F.array(*[F.when(_has(b), F.lit(b)) for b, *_ in REASONS]))
    return events.select(F.explode(bits).alias("bit"))


def bit_name(bit: Column, place: int = 1) -> Column:
    return F.element_at(F.array(*[F.lit(r[place]) for r in REASONS]), bit + 1)


def flag_distribution(events: DataFrame, n: int = 8) -> DataFrame:
    """Flags by hits, with their share of all flag hits in per cent."""
    hits = _exploded_bits(events).groupBy("bit").agg(F.count(F.lit(1)).alias("hits"))
    share = F.round(100 * F.col("hits") / F.sum("hits").over(Window.partitionBy()), 6)
    return hits.withColumn("pct", share).withColumn("flag", bit_name(F.col("bit"))).orderBy(F.desc("hits"), "bit").limit(n).select("flag", "hits", "pct")


def top_filter(events: DataFrame) -> DataFrame:
    """The flag with most hits (of equals the highest bit) and its share of blocked events; no row without flags."""
    counts = events.agg(_count(is_blocked()).alias("n"), *[_count(_has(b)).alias(f"b{b}") for b, *_ in REASONS])
    best = F.array_max(F.array(*[F.struct(F.col(f"b{b}").alias("hits"), F.lit(b).alias("bit")) for b, *_ in REASONS]))
    row = counts.select("n", best.alias("x")).filter("x.hits > 0")
    return row.select(bit_name(F.col("x.bit")).alias("flag"), F.col("x.hits").alias("hits"), F.round(F.when(F.col("n") > 0, 100 * F.col("x.hits") / F.col("n")).otherwise(0.0), 6).alias("pct"))


def global_stats(events: DataFrame) -> DataFrame:
    span = F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))
    a = events.agg(F.count_distinct("client_ip").alias("clients"), F.count(F.lit(1)).alias("total"), _count(is_blocked()).alias("blocked"), span.alias("_us"))
    pct = F.when(F.col("total") > 0, F.round(100 * F.col("blocked") / F.col("total"), 6)).otherwise(0.0)
    qps = F.when(F.col("_us") >= 1000, F.round(F.col("total") / (F.col("_us") / 1e6), 6)).otherwise(0.0)
    return a.select("clients", "total", "blocked", pct.alias("blocked_pct"), qps.alias("avg_qps"))


def _newest(events: DataFrame, n: int) -> DataFrame:
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)


def recent_domains(events: DataFrame, n: int = 50) -> DataFrame:
    return _newest(events, n).select("event_id", "domain")


def live_feed(events: DataFrame, n: int = 50) -> DataFrame:
    return _newest(events, n).select("event_id", hms(F.col("ts")).alias("time"), "client_ip", "domain", flags_label(F.col("action"), F.col("flags")).alias("label"))


def query_log(events: DataFrame, *, keep: int = 1000, newest_first: bool = True, skip: int = 0, take: int = 100, client_prefix: str | None = None, mask: int | None = None) -> DataFrame:
    """A page of the last ``keep`` events; filters apply inside them."""
    kept = _newest(events, keep)
    if client_prefix is not None:
        kept = kept.filter(F.col("client_ip").startswith(client_prefix))
    if mask is not None:
        kept = kept.filter(F.coalesce(F.col("flags").bitwiseAND(mask) != 0, F.lit(False)))
    way = (F.desc if newest_first else F.asc)
    page = kept.orderBy(way("ts"), way("event_id")).offset(skip).limit(take)
    return page.select("event_id", "ts", "client_ip", "domain", flags_label(F.col("action"), F.col("flags")).alias("label"))


def talkers(events: DataFrame) -> DataFrame:
    """Per client: first and last seen, total, a count per action and per flag. One aggregation, combined on the map side."""
    return events.groupBy("client_ip").agg(
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
        F.count(F.lit(1)).alias("total"),
        *[_count(F.col("action") == a).alias(f"n_{a.lower()}") for a in ACTIONS],
        F.array(*[_count(_has(b)) for b, *_ in REASONS]).alias("flag_hits"),
    )


def talker_rows(talked: DataFrame, client_names: DataFrame) -> DataFrame:
    """Talkers with percentages per action, the top flag (of equals the highest bit) and a display name."""
    names = client_names.select("client_ip", F.col("hostname"))
    best = F.array_max(F.transform("flag_hits", lambda n, i: F.struct(n.alias("hits"), i.alias("bit"))))
    pct = lambda c: F.round(100 * c / F.col("total"), 6)
    j = talked.join(names, "client_ip", "left").withColumn("_best", best)
    return j.select(
        "client_ip",
        F.when(F.coalesce("hostname", F.lit("")) != "", F.col("hostname")).otherwise(F.col("client_ip")).alias("display_name"),
        "hostname",
        "first_seen",
        "last_seen",
        "total",
        *[pct(F.col(f"n_{a.lower()}")).alias(f"pct_{a.lower()}") for a in ACTIONS],
        pct(F.col("n_blocked") + F.col("n_suspicious") + F.col("n_highlysuspicious")).alias("blocked_pct"),
        F.when(F.col("_best.hits") > 0, bit_name(F.col("_best.bit"))).alias("top_flag"),
        F.when(F.col("_best.hits") > 0, F.col("_best.hits")).alias("top_flag_hits"),
    )


def talker_filter(rows: DataFrame, *, text: str | None = None, client: str | None = None, hostname: str | None = None) -> DataFrame:
    """By text (prefix of the address or part of the host name), exact client, or exact host name."""
    if text is not None:
        rows = rows.filter(F.col("client_ip").startswith(text) | F.coalesce(F.contains("hostname", F.lit(text)), F.lit(False)))
    if client is not None:
        rows = rows.filter(F.col("client_ip") == client)
    if hostname is not None:
        rows = rows.filter(F.col("hostname") == hostname)
    return rows


#: Sort keys of talkers.
TALKER_ORDER = {"requests": ("total", True), "last_seen": ("last_seen", True), "first_seen": ("first_seen", False), "blocked": ("blocked_pct", True)}


def talker_page(rows: DataFrame, by: str = "requests", skip: int = 0, take: int = 20) -> DataFrame:
    column, down = TALKER_ORDER[by]
    return rows.orderBy(F.desc(column) if down else F.asc(column), "client_ip").offset(skip).limit(take)


def talker_cap(talked: DataFrame, most: int = 500) -> DataFrame:
    """The clients seen last."""
    return talked.orderBy(F.desc("last_seen"), "client_ip").limit(most)


#: Widths of timeline buckets in seconds.
ZOOMS = (60, 900, 1800, 3600, 86400)


def bucket(ts: Column, seconds: int) -> Column:
    """The bucket's begin, as seconds since the epoch."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / 1000000 / seconds).cast("long") * seconds


def timeline(events: DataFrame, seconds: int = 3600) -> DataFrame:
    """Per bucket: a count per action, total, distinct clients."""
    return events.groupBy(bucket(F.col("ts"), seconds).alias("bucket")).agg(*[_count(F.col("action") == a).alias(a.lower()) for a in ACTIONS], F.count(F.lit(1)).alias("total"), F.count_distinct("client_ip").alias("clients"))


def timeline_dense(events: DataFrame, seconds: int = 3600, most: int = 256) -> DataFrame:
    """Buckets from first to last with gaps filled; the oldest ``most`` rows."""
    t = timeline(events, seconds)
    ends = t.agg(F.min("bucket").alias("a"), F.max("bucket").alias("b")).filter("a is not null")
    grid = ends.select(F.explode(F.sequence("a", F.least("b", F.col("a") + (most - 1) * seconds), F.lit(seconds).cast("long"))).alias("bucket"))
    filled = grid.join(t, "bucket", "left")
    return filled.select("bucket", *[F.coalesce(c, F.lit(0)).alias(c) for c in t.columns if c != "bucket"]).orderBy("bucket").limit(most)


def timeline_page(t: DataFrame, newest_first: bool = True, skip: int = 0, take: int = 50) -> DataFrame:
    return t.orderBy(F.desc("bucket") if newest_first else F.asc("bucket")).offset(skip).limit(take)


def timeline_maxima(events: DataFrame, seconds: int = 3600, most: int = 256) -> DataFrame:
    """Largest total and number of clients, rows of the dense timeline, buckets with events."""
    t = timeline(events, seconds)
    rows = F.when(F.max("bucket").isNotNull(), F.least(((F.max("bucket") - F.min("bucket")) / seconds + 1).cast("long"), F.lit(most).cast("long")))
    return t.agg(F.max("total").alias("max_total"), F.max("clients").alias("max_clients"), F.coalesce(rows, F.lit(0).cast("long")).alias("dense_rows"), F.count(F.lit(1)).alias("active_buckets"))


def forward_lines(events: DataFrame, template: str, actions: Sequence[str] = ()) -> DataFrame:
    """A line per event of the actions (none: all): placeholders {timestamp}, {client_ip}, {action}, {domain} replaced in that order."""
    kept = events.filter(F.col("action").isin(list(actions))) if actions else events
    line = F.lit(template)
    for name, value in (("timestamp", F.unix_seconds(F.col("ts").cast("timestamp")).cast("string")), ("client_ip", F.col("client_ip")), ("action", F.col("action")), ("domain", F.coalesce("domain", F.lit("<unknown>")))):
        line = F.replace(line, F.lit("{" + name + "}"), value)
    return kept.select("event_id", line.alias("line"))


def forward_json(events: DataFrame, actions: Sequence[str] = ()) -> DataFrame:
    kept = events.filter(F.col("action").isin(list(actions))) if actions else events
    body = F.struct(F.unix_seconds(F.col("ts").cast("timestamp")).alias("timestamp"), "client_ip", "action", "domain")
    return kept.select("event_id", F.to_json(body).alias("line"))
