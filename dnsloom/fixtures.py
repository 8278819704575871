"""DNS tables derived from the test tables: queries, events, answers, list lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = """
SELECT e.event_id, e.ts,
 concat('10.0.', CAST(user_id div 256 AS STRING), '.', CAST(user_id % 256 AS STRING)) AS client_ip,
 CASE e.event_id % 10
  WHEN 0 THEN concat(substr(m,1,12), translate(substr(m,13,12),'0123456789abcdef','ghijklmnopqrstuv'), '.com')
  WHEN 1 THEN concat('play-casino.', substr(m,1,6), '.biz')
  WHEN 2 THEN concat('xn--', substr(m,1,6), '.', h.host)
  WHEN 3 THEN concat(substr(m,1,8), '.a.b.c.d.', h.host)
  WHEN 4 THEN concat('ads', CAST(k AS STRING), '.tracker.net')
  WHEN 5 THEN concat(translate(substr(m,1,10),'0123456789','bcdfghjklm'), '.xyz')
  ELSE h.host END AS domain,
 CASE event_type WHEN 'view' THEN 'Allowed' WHEN 'click' THEN 'Proxied'
  WHEN 'error' THEN 'Blocked' WHEN 'signup' THEN 'Suspicious' ELSE 'HighlySuspicious' END AS action,
 CASE WHEN event_type IN ('view','click') THEN NULL ELSE CAST((k*331) % 32768 AS INT) END AS flags,
 CASE k % 7 WHEN 0 THEN 10 WHEN 1 THEN 16 WHEN 2 THEN 28 WHEN 3 THEN 255 ELSE 1 END AS qtype,
 CAST(floor(value) AS INT) AS ttl, k
FROM (SELECT *, event_id % (SELECT count(*) FROM {p}) AS page_key FROM {e}) e JOIN {h} h ON h.page_id = e.page_key
"""


def base(spark, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """An event per row of ``events``, with a domain of one of ten kinds. Events may be a stream."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet") if events is None else events
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    e = e.selectExpr("event_id", "ts", "user_id", "event_type", "value", "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k", "md5(CAST(event_id AS STRING)) AS m")
    h = pages.selectExpr("page_id", "regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host")
    return spark.sql(BASE, e=e, p=pages, h=h)


def dns_queries(spark, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).select("event_id", "ts", "client_ip", "domain", "qtype")


def dns_events(spark, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).select("event_id", "ts", "client_ip", "domain", "action", "flags")


def _records() -> Column:
    """All answer records of an event of ``base``: array of rtype, rdata, ttl."""
    k = F.col("k")
    with_k = lambda head: F.concat(F.lit(head), k.cast("string"))
    one = lambda rtype, rdata, ttl=F.col("ttl"): F.struct(F.lit(rtype).alias("rtype"), rdata.alias("rdata"), ttl.alias("ttl"))
    a = F.when(k % 11 == 0, with_k("192.168.1.")).when(k % 11 == 1, with_k("203.0.113.")).otherwise(with_k("93.184.216."))
    txt = F.concat(F.repeat(F.lit("A"), k * 2), F.substr(F.md5(F.col("event_id").cast("string")), F.lit(1), k % 33))
    some = F.array(
        F.when(F.col("qtype") == 1, one("A", a)),
        F.when(F.col("qtype") == 28, one("AAAA", F.when(k % 5 == 0, "fd00::1").otherwise("2606:4700::1111"))),
        F.when(k % 13 == 0, one("CNAME", F.when(k % 3 == 0, "Pixel.Tracker.net").otherwise("cdn.clean.example"), F.col("ttl") + 5)),
        F.when(F.col("qtype") == 16, one("TXT", txt)),
    )
    many = F.when(k % 17 == 0, F.transform(F.sequence(F.lit(1), F.lit(12)), lambda x: one("A", F.concat(F.lit("93.184.217."), x.cast("string")))))
    return F.concat(F.array_compact(some), F.coalesce(many, F.array().cast("array<struct<rtype:string,rdata:string,ttl:int>>")))


def dns_answers(spark, sf_dir: str) -> DataFrame:
    """Answers in long form: event_id, rtype, rdata, ttl. All records of an event from one pass over the events."""
    return base(spark, sf_dir).select("event_id", F.explode(_records()).alias("x")).select("event_id", "x.*")


def dns_responses(spark, sf_dir: str) -> DataFrame:
    """Responses to events: event_id, ts, answers (array of rtype, rdata, ttl; may be empty). A second later, or a minute for one
    in eleven, which is too late; one in seven has none. From one pass over the events, without a shuffle."""
    at = F.col("ts").cast("timestamp") + F.make_interval(secs=F.when(F.col("event_id") % 11 == 5, 60).otherwise(1))
    return base(spark, sf_dir).filter("event_id % 7 <> 3").select("event_id", at.alias("ts"), _records().alias("answers"))


#: Twelve kinds of list lines by page; {S} is the dialect's text type.
LINES = """
SELECT concat('s', CAST(page_id % 5 AS {S})) AS source,
 CASE page_id % 5 WHEN 0 THEN 'white' WHEN 1 THEN 'nrd' ELSE 'black' END AS role,
 CAST(page_id % 5 AS INT) AS load_order, CAST(page_id AS BIGINT) AS line_no,
 CASE page_id % 12
  WHEN 0 THEN concat('0.0.0.0 ', host)
  WHEN 1 THEN concat('127.0.0.1 ads', CAST(page_id % 100 AS {S}), '.tracker.net')
  WHEN 2 THEN concat('server=/', host, '/')
  WHEN 3 THEN concat('address=/', substr(md5(CAST(page_id AS {S})), 1, 3), '.', host, '/127.0.0.1')
  WHEN 4 THEN concat('||', host, '^$third-party')
  WHEN 5 THEN concat('  ', host, ' ')
  WHEN 6 THEN concat('||*.', substr(md5(CAST(page_id AS {S})), 1, 2), '.', host, '^')
  WHEN 7 THEN concat('@@||', host, '^$document')
  WHEN 8 THEN concat(host, '##.ad')
  WHEN 9 THEN concat('# ', host)
  WHEN 10 THEN concat('||ads', CAST(page_id % 10 AS {S}), '*.tracker.net^')
  ELSE concat('/^play-casino\\.', substr(md5(CAST(page_id AS {S})), 1, 1), '/') END AS line
"""


def list_lines(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").selectExpr("page_id", "regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host")
    return spark.sql(LINES.replace("{S}", "STRING").replace("\\", "\\\\") + " FROM {h}", h=pages)


#: A network per page: nested and neighbouring v4 ones of 8 to 32 bits, v6 ones of 20 to 47, client ranges, and what is none. {S} is the dialect's text type.
NETWORKS = """
SELECT page_id, CASE page_id % 8
  WHEN 0 THEN concat('93.184.216.', CAST(page_id % 101 AS {S}), '/32')
  WHEN 1 THEN concat('93.184.217.', CAST(page_id % 16 AS {S}), '/', CAST(28 + page_id % 5 AS {S}))
  WHEN 2 THEN concat('93.', CAST(180 + page_id % 8 AS {S}), '.216.77/', CAST(8 + page_id % 17 AS {S}))
  WHEN 3 THEN concat('10.0.0.', CAST(page_id % 256 AS {S}), '/', CAST(26 + page_id % 7 AS {S}))
  WHEN 4 THEN concat('2606:47', lpad(CAST(page_id % 3 AS {S}), 2, '0'), '::/', CAST(20 + page_id % 28 AS {S}))
  WHEN 5 THEN concat('fd', lpad(CAST(page_id % 4 AS {S}), 2, '0'), '::/', CAST(6 + page_id % 9 AS {S}))
  WHEN 6 THEN concat('203.0.113.0/', CAST(page_id % 40 AS {S}))
  ELSE concat('203.0.', CAST(page_id % 300 AS {S}), '.0') END AS cidr
"""


def networks(spark, sf_dir: str) -> DataFrame:
    return spark.sql(NETWORKS.replace("{S}", "STRING") + " FROM {p}", p=spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id"))


def client_names(spark, sf_dir: str) -> DataFrame:
    """Host names of the clients whose address ends in an even number; every fifth of them empty."""
    last = F.element_at(F.split("client_ip", r"\."), -1).cast("int")
    clients = base(spark, sf_dir).select("client_ip").distinct().withColumn("_n", last).filter("_n % 2 = 0")
    return clients.select("client_ip", F.when(F.col("_n") % 10 == 0, "").otherwise(F.concat(F.lit("host-"), F.col("_n").cast("string"), F.lit(".local"))).alias("hostname"))


def frames(spark, sf_dir: str) -> DataFrame:
    """Telemetry frames of the events and of their domains: event_id, frame."""
    b = base(spark, sf_dir)
    little = lambda n, width: F.array_join(F.reverse(F.regexp_extract_all(F.lpad(F.hex(n), 2 * width, "0"), F.lit("(..)"), F.lit(1))), "")
    code = F.when(F.col("action") == "Allowed", 0).when(F.col("action") == "Proxied", 1).when(F.col("action") == "Blocked", 2).when(F.col("action") == "Suspicious", 3).otherwise(4)
    octets = F.split("client_ip", r"\.")
    two = lambda a, b: F.concat(F.lit("fd00" + "0" * 12), F.lpad(F.hex(a.cast("long")), 12, "0"), F.lpad(F.hex(b.cast("long")), 4, "0"))
    quad = F.concat(F.lit("00000000000000000000ffff"), F.array_join(F.transform(octets, lambda o: F.lpad(F.hex(o.cast("long")), 2, "0")), ""))
    # From user 65,536 on a client's third number is no octet: such a client goes under a v6 address that holds its last two numbers.
    ip = F.when(octets[2].cast("long") > 255, two(octets[2], octets[3])).otherwise(quad)
    h = F.xxhash64("domain")
    body = F.concat(F.lit("01"), little(F.unix_seconds(F.col("ts").cast("timestamp")), 8), little(h, 8), ip, F.lpad(F.hex(code.cast("long")), 2, "0"), F.when(code >= 2, little(F.coalesce("flags", F.lit(0)).cast("long"), 2)).otherwise(""))
    event = b.select("event_id", body.alias("body"))
    named = b.groupBy("domain").agg(F.min("event_id").alias("event_id")).select("event_id", F.concat(F.lit("00"), little(h, 8), little(F.octet_length("domain").cast("long"), 2), F.hex("domain")).alias("body"))
    size = (F.length("body") / 2).cast("long")
    return event.unionByName(named).select("event_id", F.unhex(F.concat(little(size, 2), F.col("body"))).alias("frame"))


def framed_client(ip: Column) -> Column:
    """The client's name in the derived tables from the address in its frames."""
    digits = F.replace(ip, F.lit(":"), F.lit(""))
    number = lambda at, n: F.conv(F.substr(digits, F.lit(at), F.lit(n)), 16, 10)
    return F.when(ip.startswith("fd00:"), F.concat_ws(".", F.lit("10.0"), number(17, 12), number(29, 4))).otherwise(ip)


def archives(spark, sf_dir: str) -> DataFrame:
    """Archives of about a thousand frames: archive, content. One in three ends in a torn frame, one in three in bytes that are none."""
    f = frames(spark, sf_dir).withColumn("archive", F.floor(F.col("event_id") / 500).cast("long"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", F.hex("frame").alias("x")))), lambda s: s["x"]), "")
    tail = F.when(F.col("archive") % 3 == 0, "C80001AABB").when(F.col("archive") % 3 == 1, "030007AABB020009CC04000811").otherwise("")
    return f.groupBy("archive").agg(text.alias("t")).select("archive", F.unhex(F.concat("t", tail)).alias("content"))


def words(spark, sf_dir: str) -> DataFrame:
    """Distinct words of the documents as names below .example, with letters beyond ASCII."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([a-z\x{00DF}-\x{00FF}]{4,})"), F.lit(1))).alias("w"))
    return found.distinct().select(F.concat("w", F.lit(".example")).alias("domain"))
