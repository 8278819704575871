"""Detections and reports beyond the verdict: hunting, tunnels, retention, list audits, beacons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dnsloom.config import BLOCKED_CLASS
from dnsloom.functions.lexical import entropy_fast
from dnsloom.functions.names import clean_tlds, depth, labels, registrable, sld, tld
from dnsloom.operators.events import search_events
from dnsloom.operators.ranges import outside


def is_blocked() -> Column:
    return F.col("action").isin(*BLOCKED_CLASS)

def _epoch() -> Column:
    return F.unix_seconds(F.col("ts").cast("timestamp"))


def nxdomain_hunting(events: DataFrame, *, least: int = 15, seconds: int = 60, chunk: int = 3600) -> DataFrame:
    """Clients with ``least`` failed names within ``seconds``, and the most they had. ``events`` are the failures.

    Failures are counted per client and second, and a client's seconds are dealt to chunks of time of ``chunk`` seconds (or
    ``seconds``, if more); what a chunk needs from the one before is copied to it. So no task holds a whole client.
    """
    width = max(seconds, chunk)
    own, next_ = F.floor(F.col("_t") / width), F.floor((F.col("_t") + seconds - 1) / width)
    per = events.groupBy("client_ip", _epoch().alias("_t")).agg(F.count(F.lit(1)).alias("_k"))
    dealt = per.withColumn("_c", F.explode(F.array_distinct(F.array(own, next_))))
    recent = Window.partitionBy("client_ip", "_c").orderBy("_t").rangeBetween(-(seconds - 1), 0)
    most = dealt.withColumn("_n", F.sum("_k").over(recent)).filter(F.col("_c") == own)
    return most.groupBy("client_ip").agg(F.max("_n").alias("most")).filter(F.col("most") >= least)


def tunneling(queries: DataFrame, *, most_names: int = 50, long_label: int = 60, seconds: int = 60) -> DataFrame:
    """Per client, registrable name and minute: distinct names, and whether one has a very long label; rows over either limit."""
    long_ = F.exists(labels(F.col("domain")), lambda x: F.octet_length(x) > long_label)
    at = F.floor(_epoch() / seconds).cast("long") * seconds
    g = queries.groupBy("client_ip", registrable(F.col("domain")).alias("zone"), at.alias("bucket")).agg(F.count_distinct("domain").alias("names"), F.max(long_).alias("long_label"))
    return g.filter((F.col("names") > most_names) | F.col("long_label"))


def txt_entropy(answers: DataFrame, threshold: float = 4.5) -> DataFrame:
    t = answers.filter("rtype = 'TXT'").select("event_id", F.round(entropy_fast(F.col("rdata")), 6).alias("entropy"))
    return t.groupBy("event_id").agg(F.max("entropy").alias("entropy"), F.max(F.col("entropy") > threshold).alias("suspicious"))


def tld_allow_only(queries: DataFrame, tlds: Sequence[str]) -> DataFrame:
    """Queries that an allow-list of TLDs turns away."""
    return queries.filter(~tld(F.col("domain")).isin(clean_tlds(tlds)))


def client_acl(queries: DataFrame, networks: DataFrame) -> DataFrame:
    """Queries of clients outside all of the parsed networks."""
    return outside(queries, networks, "client_ip")


def hourly_rollup(events: DataFrame) -> DataFrame:
    """What is kept when events expire: counts per hour, client and action."""
    hour = F.floor(_epoch() / 3600).cast("long") * 3600
    return events.groupBy(hour.alias("hour"), "client_ip", "action").agg(F.count(F.lit(1)).alias("n"))


def within_retention(events: DataFrame, hours: int = 72) -> DataFrame:
    newest = events.agg(F.max("ts").alias("_max"))
    return events.crossJoin(newest).filter(F.col("ts") >= F.col("_max") - F.make_interval(hours=F.lit(hours))).drop("_max")


def list_collision(rules: DataFrame) -> DataFrame:
    """Domains that two sources or more list."""
    g = rules.filter("kind = 'exact'").groupBy(F.col("value").alias("domain")).agg(F.count_distinct("source").alias("sources"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("listed_by"))
    return g.filter("sources >= 2")


def list_overlap(rules: DataFrame) -> DataFrame:
    """Pairs of sources and how many domains both list. Sources per domain are few; pairs are made per domain."""
    g = rules.filter("kind = 'exact'").groupBy("value").agg(F.array_sort(F.collect_set("source")).alias("s")).filter("size(s) > 1")
    a = g.select("s", F.posexplode("s").alias("i", "a"))
    pairs = a.select("a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("domains"))


def source_effectiveness(verdicts: DataFrame) -> DataFrame:
    """Blocks of every kind of rule (exact, wildcard, glob, regex) by the list that the first such rule came from."""
    ruled = verdicts.filter("reason in ('STATIC_BLACKLIST', 'ABP_RULE')")
    return ruled.groupBy(F.col("detail").alias("kind"), F.col("rule_source").alias("source")).agg(F.count(F.lit(1)).alias("blocks"), F.count_distinct("domain").alias("domains"))


def tld_trends(events: DataFrame) -> DataFrame:
    return events.groupBy(tld(F.col("domain")).alias("tld")).agg(F.count(F.lit(1)).alias("n"), F.count_if(is_blocked()).alias("blocked"))


def top_words(events: DataFrame, n: int = 50, *, least: int = 3) -> DataFrame:
    """Words (letter runs of ``least`` or more) of blocked names by blocked events; each distinct name is split once."""
    per = events.filter(is_blocked()).groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    found = per.select("n", F.explode(F.regexp_extract_all(F.lower("domain"), F.lit(f"([a-z]{{{least},}})"), F.lit(1))).alias("word"))
    return found.groupBy("word").agg(F.sum("n").alias("hits")).orderBy(F.desc("hits"), "word").limit(n)


def write_events(events: DataFrame, path: str, *, files_a_day: int = 16) -> None:
    """The event log as a table partitioned by day. A day's clients are dealt to ``files_a_day`` files, each sorted by client and
    time and with Bloom filters of clients and domains, so a search opens few files and few row groups of them."""
    parts = max(int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")), files_a_day)  # a number, so that small parts are not joined again
    dealt = events.withColumn("day", F.to_date("ts")).repartition(parts, "day", F.pmod(F.xxhash64("client_ip"), F.lit(files_a_day)))
    writer = dealt.sortWithinPartitions("day", "client_ip", "ts").write.mode("append").partitionBy("day")
    for column in ("client_ip", "domain"):
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.parquet(path)


def search_store(spark, path: str, *, since=None, until=None, **filters) -> DataFrame:
    """``events.search_events`` over a table of ``write_events``: days outside of ``since`` and ``until`` are not listed, and files and
    row groups that cannot hold the client or the time are not read."""
    log = spark.read.parquet(path)
    if since is not None:
        log = log.filter(F.col("day") >= F.to_date(F.lit(since)))
    if until is not None:
        log = log.filter(F.col("day") <= F.to_date(F.lit(until)))
    return search_events(log, since=since, until=until, **filters)


def refresh_rollup(spark, log: str, rollup: str, arrived: DataFrame) -> None:
    """Works out anew the hourly rollup of the hours that ``arrived`` events fall in, from the whole log of those hours, and puts
    it in the place of what was there. Running it again changes nothing; other hours are not touched. Hours of days that the
    log no longer has stay as they are, late events or not."""
    hour = (F.floor(_epoch() / 3600) * 3600).cast("long")
    wanted = arrived.select(F.to_date("ts").alias("day"), hour.alias("hour")).distinct()
    some = spark.read.parquet(log).withColumn("hour", hour).join(F.broadcast(wanted), ["day", "hour"], "left_semi")  # a row per hour
    made = some.groupBy("day", "hour", "client_ip", "action").agg(F.count(F.lit(1)).alias("n"))
    made.repartition("day", "hour").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "hour").parquet(rollup)


def expire(spark, path: str, *, hours: int = 72, newest=None) -> list[str]:
    """Deletes days of a table partitioned by day that end over ``hours`` before ``newest`` (else its newest ``ts``); the rows of a day go at once. Returns the days."""
    log = spark.read.parquet(path)
    newest = newest if newest is not None else log.agg(F.max("ts")).first()[0]
    if newest is None:
        return []
    days = log.select("day").distinct().filter(F.date_add("day", 1).cast("timestamp") <= F.lit(newest).cast("timestamp") - F.make_interval(hours=F.lit(hours)))
    gone = sorted(str(r[0]) for r in days.collect())  # a row per day
    for day in gone:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/day={day}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return gone


def structure_stats(events: DataFrame) -> DataFrame:
    return events.groupBy(depth(F.col("domain")).alias("dots"), (F.floor(F.octet_length("domain") / 10) * 10).cast("long").alias("bytes_from")).agg(F.count(F.lit(1)).alias("n"))


def dga_audit(events: DataFrame) -> DataFrame:
    """Mean entropy of second-level labels, blocked against the rest; worked out once per distinct domain."""
    per = events.groupBy("domain", is_blocked().alias("is_blocked")).agg(F.count(F.lit(1)).alias("n")).withColumn("e", F.round(entropy_fast(sld(F.col("domain"))), 6)).filter("e is not null")
    return per.groupBy("is_blocked").agg(F.sum("n").alias("n"), F.round(F.sum(F.col("n") * F.col("e")) / F.sum("n"), 6).alias("mean_entropy"))


def typosquat(domains: DataFrame, brands: DataFrame, most: int = 2) -> DataFrame:
    """Distinct second-level labels within ``most`` edits of a brand and unlike it.

    A brand is cut into ``most`` + 1 segments of nearly equal length. So many edits leave one of them whole, and it is at
    most ``most`` places away in the name. Names and brands meet by the brand's length, the segment's number and its text;
    the distance decides.
    """
    parts = most + 1
    short = lambda size: parts - size % parts  # noqa: E731  so many segments are a letter shorter than the rest
    start = lambda size, i: i * F.floor(size / parts) + F.greatest(i - short(size), F.lit(0))
    width = lambda size, i: (F.floor(size / parts) + F.when(i >= short(size), 1).otherwise(0)).cast("int")
    numbers = F.array(*[F.lit(i) for i in range(parts)])
    size, seg = F.col("size"), F.col("seg")
    b = brands.select("brand").distinct().filter("brand <> ''").withColumn("size", F.length("brand")).withColumn("seg", F.explode(numbers))
    b = b.withColumn("text", F.substr("brand", (start(size, seg) + 1).cast("int"), width(size, seg)))
    names = domains.select(sld(F.col("domain")).alias("name")).filter("name <> ''").distinct()
    n = names.withColumn("size", F.explode(F.sequence(F.greatest(F.length("name") - most, F.lit(1)), F.length("name") + most))).withColumn("seg", F.explode(numbers))
    places = F.sequence(F.greatest(start(size, seg) - most, F.lit(0)).cast("int"), (start(size, seg) + most).cast("int"))
    texts = F.transform(F.filter(places, lambda p: p + width(size, seg) <= F.length("name")), lambda p: F.substr(F.col("name"), p + 1, width(size, seg)))
    n = n.withColumn("text", F.explode(F.array_distinct(texts)))
    pairs = n.join(b, ["size", "seg", "text"]).select("name", "brand").distinct().withColumn("edits", F.levenshtein("name", "brand", most))
    return pairs.filter(F.col("edits").between(1, most)).select("name", "brand", "edits")


def breakdown(table: DataFrame, column: str) -> DataFrame:
    return table.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def blocks_by_client(events: DataFrame) -> DataFrame:
    return events.filter(is_blocked()).groupBy("client_ip").agg(F.count(F.lit(1)).alias("n"))


def beaconing(events: DataFrame, *, least: int = 5, most_spread: float = 0.5) -> DataFrame:
    """Client and domain pairs asked for at regular gaps: number of gaps, mean, spread over mean."""
    order = Window.partitionBy("client_ip", "domain").orderBy("_t", "event_id")
    gaps = events.withColumn("_t", _epoch()).withColumn("gap", F.col("_t") - F.lag("_t").over(order)).filter("gap is not null")
    g = gaps.groupBy("client_ip", "domain").agg(F.count("gap").alias("gaps"), F.avg("gap").alias("_m"), F.stddev_pop("gap").alias("_s")).filter((F.col("gaps") >= least) & (F.col("_m") > 0))
    return g.select("client_ip", "domain", "gaps", F.round("_m", 4).alias("mean_gap"), F.round(F.col("_s") / F.col("_m"), 4).alias("spread")).filter(F.col("spread") <= most_spread)


def decayed_counts(events: DataFrame, half_life_hours: float = 24.0) -> DataFrame:
    """Per domain, events weighted by age against the newest: half after ``half_life_hours``."""
    newest = events.agg(F.max(_epoch()).alias("_max"))
    age = (F.col("_max") - _epoch()) / 3600.0
    return events.crossJoin(newest).groupBy("domain").agg(F.round(F.sum(F.pow(F.lit(0.5), age / half_life_hours)), 6).alias("weight"))


def log_strategy(events: DataFrame, anonymous: DataFrame, silent: DataFrame) -> DataFrame:
    """Events without those of silent domains; clients of anonymous domains are blanked."""
    kept = events.join(silent.select("domain").distinct(), "domain", "left_anti")
    marked = kept.join(anonymous.select("domain").distinct().withColumn("_anon", F.lit(True)), "domain", "left")
    return marked.withColumn("client_ip", F.when(F.col("_anon"), F.lit(None)).otherwise(F.col("client_ip"))).drop("_anon")
