"""DuckDB SQL for the registered queries: the same tables derived from the same inputs."""

from __future__ import annotations

from dnsloom.config import ACTIONS, BIT, REASONS
from dnsloom.fixtures import LINES, NETWORKS
from dnsloom.operators.events import ZOOMS

_H = "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages"
BASE = f"""
n AS (SELECT count(*) AS n FROM pages), h AS ({_H}),
e AS (SELECT event_id, ts, user_id, event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k, md5(CAST(event_id AS VARCHAR)) AS m FROM events),
base AS (SELECT e.event_id, e.ts,
 concat('10.0.', CAST(user_id // 256 AS VARCHAR), '.', CAST(user_id % 256 AS VARCHAR)) AS client_ip,
 CASE e.event_id % 10
  WHEN 0 THEN concat(substr(m,1,12), translate(substr(m,13,12),'0123456789abcdef','ghijklmnopqrstuv'), '.com')
  WHEN 1 THEN concat('play-casino.', substr(m,1,6), '.biz')
  WHEN 2 THEN concat('xn--', substr(m,1,6), '.', h.host)
  WHEN 3 THEN concat(substr(m,1,8), '.a.b.c.d.', h.host)
  WHEN 4 THEN concat('ads', CAST(k AS VARCHAR), '.tracker.net')
  WHEN 5 THEN concat(translate(substr(m,1,10),'0123456789','bcdfghjklm'), '.xyz')
  ELSE h.host END AS domain,
 CASE event_type WHEN 'view' THEN 'Allowed' WHEN 'click' THEN 'Proxied' WHEN 'error' THEN 'Blocked' WHEN 'signup' THEN 'Suspicious' ELSE 'HighlySuspicious' END AS action,
 CASE WHEN event_type IN ('view','click') THEN NULL ELSE CAST((k*331) % 32768 AS INT) END AS flags,
 CASE k % 7 WHEN 0 THEN 10 WHEN 1 THEN 16 WHEN 2 THEN 28 WHEN 3 THEN 255 ELSE 1 END AS qtype,
 CAST(floor(value) AS INT) AS ttl, k, CAST(floor(epoch(e.ts)) AS BIGINT) AS t,
 event_type NOT IN ('view','click') AS bad
FROM e CROSS JOIN n JOIN h ON h.page_id = e.event_id % n.n)"""
ANSWERS = """
answers AS (
SELECT event_id, 'A' AS rtype, CASE k % 11 WHEN 0 THEN concat('192.168.1.', k) WHEN 1 THEN concat('203.0.113.', k) ELSE concat('93.184.216.', k) END AS rdata, ttl FROM base WHERE qtype = 1
UNION ALL SELECT event_id, 'AAAA', CASE k % 5 WHEN 0 THEN 'fd00::1' ELSE '2606:4700::1111' END, ttl FROM base WHERE qtype = 28
UNION ALL SELECT event_id, 'CNAME', CASE k % 3 WHEN 0 THEN 'Pixel.Tracker.net' ELSE 'cdn.clean.example' END, ttl + 5 FROM base WHERE k % 13 = 0
UNION ALL SELECT event_id, 'TXT', concat(repeat('A', k * 2), substr(md5(CAST(event_id AS VARCHAR)), 1, k % 33)), ttl FROM base WHERE qtype = 16
UNION ALL SELECT event_id, 'A', concat('93.184.217.', x), ttl FROM base CROSS JOIN (SELECT unnest(generate_series(1,12)) AS x) s WHERE k % 17 = 0)"""
_FLAG_NAME = "[" + ",".join(f"'{r[1]}'" for r in REASONS) + "]"
_SHORT = "[" + ",".join(f"'{r[2]}'" for r in REASONS) + "]"
_LOG = "[" + ",".join(f"'{r[3]}'" for r in REASONS) + "]"


def _bits(names: str) -> str:
    return f"list_transform(list_filter(range(15), lambda b: (flags >> b) & 1 = 1), lambda b: ({names})[b + 1])"


def _pct(a: str, b: str = "total") -> str:
    return f"round(100.0::DOUBLE * {a} / {b}, 6)"


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts) + " "


_COUNTS = ", ".join(f"count(*) FILTER (action = '{a}') AS {a.lower()}" for a in ACTIONS)


def _timeline(seconds: int) -> str:
    return f"tl AS (SELECT (t // {seconds}) * {seconds} AS bucket, {_COUNTS}, count(*) AS total, count(DISTINCT client_ip) AS clients FROM base GROUP BY 1)"


_TL = "bucket, allowed, proxied, blocked, suspicious, highlysuspicious, total, clients"
_LABEL = f"CASE WHEN bad AND len({_bits(_SHORT)}) > 0 THEN (CASE action WHEN 'HighlySuspicious' THEN 'HighlySusp' ELSE action END) || ':' || array_to_string({_bits(_SHORT)}, '+') ELSE (CASE action WHEN 'HighlySuspicious' THEN 'HighlySusp' ELSE action END) END"
_HITS = "[" + ",".join(f"count(*) FILTER ((flags >> {b}) & 1 = 1)" for b in range(15)) + "]"
TALK = "talk AS (SELECT client_ip, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS total, " + ", ".join(f"count(*) FILTER (action = '{a}') AS n_{a.lower()}" for a in ACTIONS) + f", {_HITS} AS hits FROM base GROUP BY client_ip)"
NAMES = "cn AS (SELECT DISTINCT client_ip, CASE WHEN o % 10 = 0 THEN '' ELSE concat('host-', o, '.local') END AS hostname FROM (SELECT client_ip, CAST(split_part(client_ip, '.', 4) AS INT) AS o FROM base) WHERE o % 2 = 0)"
ROWS = f"""rws AS (SELECT talk.client_ip, CASE WHEN coalesce(hostname, '') <> '' THEN hostname ELSE talk.client_ip END AS display_name, hostname, first_seen, last_seen, total,
 {", ".join(f"{_pct(f'n_{a.lower()}')} AS pct_{a.lower()}" for a in ACTIONS)}, {_pct('(n_blocked + n_suspicious + n_highlysuspicious)')} AS blocked_pct,
 CASE WHEN list_max(hits) > 0 THEN {_FLAG_NAME}[list_max(list_filter(range(1, 16), lambda b: hits[b] = list_max(hits)))] END AS top_flag, CASE WHEN list_max(hits) > 0 THEN list_max(hits) END AS top_flag_hits
 FROM talk LEFT JOIN cn ON cn.client_ip = talk.client_ip)"""
DOMAINS = "dom AS (SELECT DISTINCT domain, string_split(domain, '.') AS p FROM base)"
_SLD = "CASE WHEN len(p) >= 2 THEN p[-2] END"


def _entropy(s: str) -> str:
    return f"CASE WHEN strlen({s}) > 0 THEN (-list_sum(list_transform(list_distinct(string_split({s}, '')), lambda c: (length({s}) - length(replace({s}, c, ''))) / strlen({s})::DOUBLE * log2((length({s}) - length(replace({s}, c, ''))) / strlen({s})::DOUBLE)))) ELSE 0.0 END"


_RATIO = "CASE WHEN length(regexp_replace(s, '[^a-z]', '', 'g')) > 0 THEN length(regexp_replace(s, '[^b-df-hj-np-tv-z]', '', 'g')) / length(regexp_replace(s, '[^a-z]', '', 'g'))::DOUBLE ELSE 0.0 END"
_RUN = "coalesce(list_max(list_transform(regexp_extract_all(s, '[b-df-hj-np-tv-z]+'), lambda x: length(x))), 0)"
_KEYWORD = "CASE WHEN lower(p[-1]) IN ('biz', 'xyz') THEN nullif(regexp_extract(regexp_replace(lower(domain), '([.-])', '\\1\\1', 'g'), '(^|[.-])(bet|casino)([.-]|$)', 2), '') END"
FEATURES = f"""ft AS (SELECT domain, p, s, e, r, c, strlen(s) >= 4 AND (r > 0.6 OR c > 5) AS cs, {_KEYWORD} AS keyword FROM (SELECT *, CASE WHEN s IS NULL THEN NULL ELSE {_RATIO} END AS r, CASE WHEN s IS NULL THEN NULL ELSE {_RUN} END AS c, CASE WHEN s IS NULL THEN NULL ELSE {_entropy('s')} END AS e FROM (SELECT *, {_SLD} AS s FROM dom))),
fd AS (SELECT *, CASE WHEN strlen(s) >= 8 THEN CASE WHEN e > 4.0 + 1e-9 THEN 'HIGH_ENTROPY' WHEN cs THEN 'LEXICAL_ANALYSIS' END END AS dga FROM ft)"""
_L = LINES.replace("{S}", "VARCHAR").replace("\\\\.", "\\.")
LISTS = f"""
ll AS ({_L} FROM ({_H})),
cl AS (SELECT source, role, load_order, line_no, trim(line) AS line FROM ll WHERE trim(line) <> '' AND trim(line)[1] NOT IN ('#', '!')),
fm AS (SELECT *, CASE WHEN regexp_matches(line, '##|#@#|#\\$#|#%#|#\\^#|#\\?#') THEN 'browser' WHEN regexp_matches(line, '^(server|address)=/') THEN 'dnsmasq'
  WHEN line LIKE '0.0.0.0 %' OR line LIKE '127.0.0.1 %' OR line LIKE ':: %' THEN 'hosts' WHEN line LIKE '||%' OR line LIKE '@@||%' THEN 'abp' WHEN line LIKE '/_%/%' THEN 'abp'
  WHEN line NOT LIKE '% %' AND line NOT LIKE '%/%' THEN 'plain' ELSE 'unknown' END AS format FROM cl),
ab AS (SELECT *, line LIKE '@@%' AS white, CASE WHEN regexp_matches(regexp_replace(line, '^@@', ''), '^/.+/$') THEN regexp_replace(line, '^@@', '') ELSE regexp_replace(regexp_replace(line, '^@@', ''), '\\$.*$', '') END AS x FROM fm),
pr AS (SELECT source, role, load_order, line_no, format, line,
  CASE format WHEN 'hosts' THEN string_split_regex(line, '\\s+')[2] WHEN 'dnsmasq' THEN string_split(line, '/')[2] WHEN 'plain' THEN line WHEN 'browser' THEN line
   WHEN 'abp' THEN CASE WHEN regexp_matches(x, '^/.+/$') THEN x[2:-2] WHEN contains(x, '*') THEN x WHEN x LIKE '||%' THEN regexp_extract(x, '^\\|\\|([^\\^]*)', 1) ELSE x END END AS raw,
  (CASE role WHEN 'white' THEN 1 WHEN 'nrd' THEN 32 ELSE 0 END) | (CASE WHEN format = 'abp' THEN (CASE WHEN white THEN 1 ELSE 0 END) | (CASE WHEN regexp_matches(x, '^/.+/$') THEN 4 WHEN contains(x, '*') THEN 2 ELSE 0 END) ELSE 0 END) AS flags FROM ab),
kd AS (SELECT *, regexp_replace(regexp_replace(raw, '^\\|\\|', ''), '\\^.*$', '') AS st FROM pr),
kk AS (SELECT *, CASE WHEN format = 'browser' THEN 'browser' WHEN raw IS NULL OR raw = '' THEN 'rejected' WHEN flags & 4 <> 0 THEN 'regex' WHEN flags & 2 <> 0 THEN CASE WHEN len(list_filter(string_split(st, '.'), lambda q: contains(q, '*') AND q <> '*')) > 0 THEN 'glob' ELSE 'suffix' END ELSE 'exact' END AS kind FROM kd),
rl AS (SELECT source, role, load_order, line_no, format, kind, CASE kind WHEN 'glob' THEN st WHEN 'suffix' THEN regexp_replace(st, '^(\\*\\.)+', '') WHEN 'rejected' THEN line ELSE raw END AS value, flags::INTEGER AS flags FROM kk),
xr AS (SELECT value, flags, load_order, line_no, source FROM rl WHERE kind = 'exact' QUALIFY row_number() OVER (PARTITION BY value ORDER BY load_order DESC, line_no DESC, source) = 1),
op AS (SELECT CASE WHEN kind = 'browser' THEN 'browser' WHEN format = 'abp' AND flags & 1 <> 0 THEN 'whitelist' WHEN kind = 'regex' THEN 'regex' WHEN kind IN ('glob', 'suffix') THEN 'wildcard' ELSE 'domain' END AS rule_type,
  CASE WHEN kind = 'suffix' THEN '*.' || value ELSE value END AS value, load_order, line_no, source FROM rl WHERE kind <> 'rejected'),
nw AS (SELECT rule_type, value FROM op WHERE rule_type IN ('domain', 'wildcard', 'regex') QUALIFY row_number() OVER (PARTITION BY value ORDER BY load_order, line_no, source, rule_type) = 1)"""
#: Matches per distinct domain: xf exact flags, pw / pb parents that allow / block, g glob, x regex.
MATCH = """
sw AS (SELECT value, flags, load_order, line_no, source FROM rl WHERE kind = 'suffix' UNION ALL SELECT unnest(['xyz', 'top']), 2, 1073741824, 0, 'config'),
up AS (SELECT domain, array_to_string(p[i:], '.') AS parent FROM (SELECT domain, p, unnest(range(2, len(p) + 1)) AS i FROM dom WHERE len(p) > 1)),
pf AS (SELECT domain, bool_or(sw.flags & 1 <> 0) AS pw, bool_or(sw.flags & 1 = 0) AS pb, arg_min(source, (load_order, line_no, source)) FILTER (sw.flags & 1 = 0) AS suffix_source FROM up JOIN sw ON sw.value = up.parent GROUP BY domain),
gl AS (SELECT load_order, line_no, source, '^' || CASE WHEN value LIKE '*.%' THEN '([^.]+\\.)+' ELSE '' END || replace(replace(regexp_replace(value, '^\\*\\.', ''), '.', '\\.'), '*', '[^.]*') || '$' AS pattern FROM rl WHERE kind = 'glob' AND flags & 1 = 0),
gh AS (SELECT domain, arg_min(source, (load_order, line_no, source)) AS glob_source FROM dom JOIN gl ON regexp_matches(domain, pattern) GROUP BY domain),
rh AS (SELECT domain, arg_min(source, (load_order, line_no, source)) AS regex_source FROM dom JOIN (SELECT value, load_order, line_no, source FROM rl WHERE kind = 'regex' AND flags & 1 = 0) r ON regexp_matches(domain, value) GROUP BY domain),
mt AS (SELECT dom.domain, dom.p, xr.flags AS rule_flags, xr.source AS rule_source, CASE WHEN xr.flags IS NOT NULL THEN xr.flags & 1 <> 0 ELSE coalesce(pw, false) END AS whitelisted,
  coalesce(xr.flags & 1 = 0, false) AS static_blocked, coalesce(xr.flags & 32 <> 0, false) AS is_nrd, coalesce(pb, false) AS suffix_blocked, gh.domain IS NOT NULL AS glob_blocked, rh.domain IS NOT NULL AS regex_blocked, suffix_source, glob_source, regex_source
  FROM dom LEFT JOIN xr ON xr.value = dom.domain LEFT JOIN pf ON pf.domain = dom.domain LEFT JOIN gh ON gh.domain = dom.domain LEFT JOIN rh ON rh.domain = dom.domain)"""
_IDN = "(regexp_matches(domain, '(^|\\.)xn--') OR strlen(domain) <> length(domain))"


def _fold(source: str, key: str, start: str, stops: str, threshold: int = 10) -> str:
    """CTEs that add the rows of ``source`` (key, o, points, reason) in order until a stop: a signal counts if none before it stopped."""
    return f"""
fa AS (SELECT s.*, {start} + sum(points) OVER (PARTITION BY s.{key} ORDER BY o) AS run FROM {source} s),
fb AS (SELECT *, coalesce(max(CASE WHEN run >= {threshold} OR reason IN ({stops}) THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS halted FROM fa),
fc AS (SELECT {key}, least(255, sum(points))::INTEGER AS added, string_agg(reason, ',' ORDER BY o) AS reasons FROM fb WHERE halted = 0 GROUP BY {key})"""


SIGNALS = f"""
sg AS (SELECT domain, o, points, reason FROM (
 SELECT m.domain, unnest([1, 2, 3, 4, 5, 6, 7]) AS o,
  unnest([strlen(m.domain) > 60, len(m.p) - 1 >= 5, lower(m.p[-1]) IN ('biz', 'xyz'), {_IDN.replace('domain', 'm.domain')}, is_nrd, coalesce(strlen(s) >= 8 AND e > 4.0 + 1e-9, false), coalesce(strlen(s) >= 8 AND cs, false)]) AS hit,
  unnest([3, 3, CASE WHEN keyword IS NOT NULL THEN 10 ELSE 3 END, 6, 5, 4, 3]) AS points,
  unnest(['INVALID_STRUCTURE', 'INVALID_STRUCTURE', CASE WHEN keyword IS NOT NULL THEN 'BANNED_KEYWORD' ELSE 'TLD_EXCLUDED' END, 'SUSPICIOUS_IDN', 'NRD_LIST', 'HIGH_ENTROPY', 'LEXICAL_ANALYSIS']) AS reason
 FROM mt m JOIN fd ON fd.domain = m.domain) WHERE hit)"""
DSCORE = SIGNALS + "," + _fold("sg", "domain", "0", "''").replace("fa AS", "da AS").replace("FROM fa", "FROM da").replace("fb AS", "db AS").replace("FROM fb", "FROM db").replace("fc AS", "dc AS") + ", ds AS (SELECT mt.domain, coalesce(added, 0) AS total, coalesce(reasons, '') AS reasons FROM mt LEFT JOIN dc ON dc.domain = mt.domain)"
CLOAK = """
ct AS (SELECT event_id, regexp_replace(lower(rdata), '\\.+$', '') AS domain FROM answers WHERE rtype = 'CNAME'),
ck AS (SELECT DISTINCT event_id FROM ct WHERE domain IN (SELECT value FROM xr WHERE flags & 1 = 0)
  OR len(list_filter(range(2, len(string_split(domain, '.')) + 1), lambda i: array_to_string(string_split(domain, '.')[i:], '.') IN ('xyz', 'top'))) > 0
  OR EXISTS (SELECT 1 FROM sw WHERE flags & 1 = 0 AND domain LIKE '%.' || value))"""
_PRIVATE = "(CASE WHEN contains(rdata, ':') THEN regexp_matches(rdata, '^(::1$|f[cd]|fe[89ab])') ELSE regexp_matches(rdata, '^(0|10|127)\\.') OR regexp_matches(rdata, '^100\\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\\.') OR rdata LIKE '169.254.%' OR regexp_matches(rdata, '^172\\.(1[6-9]|2[0-9]|3[01])\\.') OR rdata LIKE '192.168.%' END)"
_NET = "(rdata LIKE '203.0.113.%' OR lower(rdata) LIKE '2001:db8:%' OR lower(rdata) LIKE '2001:0db8:%')"
INSPECT = f"""
ins AS (SELECT event_id, count(*) FILTER (rtype IN ('A', 'AAAA', 'TXT', 'CNAME')) AS n, min(ttl) AS min_ttl, coalesce(bool_or(strlen(rdata) > 128) FILTER (rtype = 'TXT'), false) AS long_txt,
  coalesce(bool_or({_PRIVATE}) FILTER (rtype IN ('A', 'AAAA')), false) AS priv, coalesce(bool_or({_NET}) FILTER (rtype IN ('A', 'AAAA')), false) AS net FROM answers GROUP BY event_id),
ag AS (SELECT event_id, o, points, reason FROM (SELECT i.event_id, unnest([1, 2, 3, 4, 5, 6]) AS o, unnest([n > 10, min_ttl < 10, long_txt, priv, net, ck.event_id IS NOT NULL]) AS hit, unnest([2, 2, 3, 10, 10, 10]) AS points,
  unnest(['INVALID_STRUCTURE', 'LOW_TTL', 'INVALID_STRUCTURE', 'DNS_REBINDING', 'ASN_BLOCKED', 'CNAME_CLOAKING']) AS reason FROM ins i LEFT JOIN ck ON ck.event_id = i.event_id) WHERE hit)"""
_STOPS = "'DNS_REBINDING', 'ASN_BLOCKED', 'CNAME_CLOAKING'"
RESOLVE = f"""
rs AS (SELECT mt.domain, whitelisted, CASE WHEN static_blocked THEN mt.rule_source WHEN suffix_blocked THEN suffix_source WHEN glob_blocked THEN glob_source ELSE regex_source END AS rule_source,
 CASE WHEN strlen(mt.domain) > 128 OR len(mt.p) - 1 > 5 THEN 'INVALID_STRUCTURE' WHEN {_IDN.replace('domain', 'mt.domain')} THEN 'SUSPICIOUS_IDN' WHEN whitelisted THEN NULL WHEN static_blocked THEN 'STATIC_BLACKLIST'
  WHEN suffix_blocked OR glob_blocked OR regex_blocked THEN 'ABP_RULE' WHEN keyword IS NOT NULL THEN 'BANNED_KEYWORD' ELSE dga END AS reason,
 CASE WHEN strlen(mt.domain) > 128 OR len(mt.p) - 1 > 5 OR {_IDN.replace('domain', 'mt.domain')} OR whitelisted THEN NULL WHEN static_blocked THEN 'blocklist' WHEN suffix_blocked THEN 'wildcard' WHEN glob_blocked THEN 'glob' WHEN regex_blocked THEN 'regex' ELSE keyword END AS detail
 FROM mt JOIN fd ON fd.domain = mt.domain)"""
_BITS = "CASE r WHEN " + " WHEN ".join(f"'{name}' THEN {1 << bit}" for name, bit in BIT.items()) + " END"
VERDICT = f"""
q0 AS (SELECT b.event_id, b.domain, b.client_ip, b.ts, b.qtype, rs.reason AS rr, rs.detail AS rd, rs.whitelisted, rs.rule_source, ds.total AS t0, ds.reasons AS r0, fc.added, fc.reasons AS r1, ins.event_id IS NOT NULL AS seen
  FROM base b JOIN rs ON rs.domain = b.domain JOIN ds ON ds.domain = b.domain LEFT JOIN ins ON ins.event_id = b.event_id LEFT JOIN fc ON fc.event_id = b.event_id),
q1 AS (SELECT *, qtype IN (10, 13, 255) AS bt, rr IS NOT NULL AS bl, CASE WHEN rr IS NULL AND whitelisted THEN 'Allowed' ELSE 'Proxied' END AS pa,
  least(255, t0 + coalesce(added, 0)) AS tot, concat_ws(',', nullif(r0, ''), r1) AS rea FROM q0),
q2 AS (SELECT *, CASE WHEN tot >= 10 THEN 'Blocked' WHEN tot >= 7 THEN 'HighlySuspicious' WHEN tot >= 4 THEN 'Suspicious' END AS ca, string_split(rea, ',')[1] AS r FROM q1),
vd AS (SELECT event_id, domain, client_ip, rule_source, CASE WHEN bt OR bl THEN 'Blocked' ELSE coalesce(ca, pa) END AS action, CASE WHEN bt THEN 'FORBIDDEN_QTYPE' WHEN bl THEN rr WHEN ca IS NOT NULL THEN nullif(r, '') END AS reason,
  CASE WHEN bt THEN qtype::VARCHAR WHEN bl THEN rd END AS detail, (CASE WHEN bt THEN 2048 WHEN bl THEN {_BITS.replace(" r ", " rr ", 1)} WHEN ca IS NOT NULL THEN coalesce({_BITS}, 512) END)::INTEGER AS flags,
  (CASE WHEN NOT bt AND NOT bl THEN tot END)::INTEGER AS total, CASE WHEN NOT bt AND NOT bl THEN rea END AS reasons, CASE WHEN NOT bt AND NOT bl THEN pa END AS pass_action FROM q2)"""
def _quad(x: str) -> str:
    """The 32 bits of a v4 address as text."""
    return "(" + " || ".join(f"right(bin(CAST(split_part({x}, '.', {i}) AS INT) + 256), 8)" for i in range(1, 5)) + ")"


def _hex(head: str, tail: str = "''") -> str:
    """The 128 bits of a v6 address as text, from its first and last hexadecimal digits."""
    digit = f"substr(rpad({head}, (32 - length({tail}))::INT, '0') || {tail}, i, 1)"
    return f"array_to_string(list_transform(range(1, 33), lambda i: right(bin(('0x' || {digit})::INT + 16), 4)), '')"


#: A network holds an address if their first bits agree.
RANGES = f"""SELECT ip, page_id, cidr FROM (
 SELECT ip, CASE WHEN ip = 'fd00::1' THEN {_hex("'fd00'", "'0001'")} WHEN contains(ip, ':') THEN {_hex("'26064700'", "'1111'")} ELSE {_quad("ip")} END AS b
 FROM (SELECT rdata AS ip FROM answers WHERE rtype IN ('A', 'AAAA') UNION SELECT client_ip FROM base)) a
JOIN (SELECT page_id, cidr, len, CASE WHEN contains(net, ':') THEN {_hex("replace(net, ':', '')")} ELSE {_quad("net")} END AS nb, contains(net, ':') AS six
 FROM (SELECT page_id, cidr, split_part(cidr, '/', 1) AS net, TRY_CAST(nullif(split_part(cidr, '/', 2), '') AS INT) AS len FROM ({NETWORKS.replace("{S}", "VARCHAR")} FROM pages)) WHERE len <= CASE WHEN contains(net, ':') THEN 128 ELSE 32 END) n
ON contains(ip, ':') = six AND b[1:len] = nb[1:len]"""
TALKER_DAYS = """
ph AS (SELECT client_ip, CASE WHEN day(ts) <= 10 THEN 1 WHEN day(ts) <= 20 THEN 2 ELSE 3 END AS ph, min(ts) AS f, max(ts) AS l, count(*) AS n, count(*) FILTER (bad) AS b FROM base GROUP BY ALL),
mm AS (SELECT ph, max(l) AS m FROM ph GROUP BY ph),
nx AS (SELECT p.*, lag(l) OVER (PARTITION BY client_ip ORDER BY ph) AS pl, (SELECT max(m) FROM mm WHERE mm.ph < p.ph) AS pm FROM ph p),
ss AS (SELECT *, sum(CASE WHEN pl IS NULL OR pl + INTERVAL 1 DAY <= pm THEN 1 ELSE 0 END) OVER (PARTITION BY client_ip ORDER BY ph) AS sid FROM nx)"""
WORDS = "wd AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z\\x{00DF}-\\x{00FF}]{4,}')) AS w FROM documents)"
#: Entropy of a word's bytes.
_BYTES = "(SELECT -sum(n / strlen(w)::DOUBLE * log2(n / strlen(w)::DOUBLE)) FROM (SELECT count(*) AS n FROM (SELECT unnest(range(strlen(w))) AS i) GROUP BY substr(hex(encode(w)), (2 * i + 1)::BIGINT, 2)))"


def _mode(e: str) -> str:
    return f"CASE WHEN strlen(s) >= 8 THEN CASE WHEN {e} > 4.0 + 1e-9 THEN 'HIGH_ENTROPY' WHEN r > 0.6 OR c > 5 THEN 'LEXICAL_ANALYSIS' END END"


#: With responses that never come or come too late.
_ANSWERED = (BASE, ANSWERS.replace("answers AS (", "answers AS (SELECT * FROM (") + " WHERE event_id % 7 <> 3 AND event_id % 11 <> 5)", LISTS, DOMAINS, FEATURES, MATCH, DSCORE, CLOAK, INSPECT)
_ALL = (BASE, ANSWERS, LISTS, DOMAINS, FEATURES, MATCH, DSCORE, CLOAK, INSPECT)


def _ngrams(n: int, floor: float) -> str:
    return f"""wd AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents),
gr AS (SELECT lang, substr(w, i, {n}) AS gram, count(*) AS c FROM (SELECT lang, w, unnest(range(1, length(w) - {n} + 2)) AS i FROM wd WHERE length(w) >= {n}) GROUP BY ALL),
md AS (SELECT lang, {n} AS n, gram, greatest(log2(c / (sum(c) OVER (PARTITION BY lang, substr(gram, 1, {n - 1})))::DOUBLE), {floor}::DOUBLE) AS logp FROM gr)"""


def _scores(n: int, runs: str, missing: float) -> str:
    return f"""nm AS (SELECT DISTINCT {_SLD} AS name FROM dom WHERE strlen({_SLD}) >= 8), wr AS (SELECT name, {runs} AS w FROM nm),
ng AS (SELECT name, substr(w, i, {n}) AS gram FROM (SELECT name, w, unnest(range(1, length(w) - {n} + 2)) AS i FROM wr WHERE length(w) >= {n})), lg AS (SELECT DISTINCT lang FROM md),
sc AS (SELECT name, lg.lang, avg(coalesce(logp, {missing}::DOUBLE)) AS score FROM ng CROSS JOIN lg LEFT JOIN md ON md.gram = ng.gram AND md.lang = lg.lang GROUP BY ALL)"""


def _list(target: str) -> str:
    v, b = "value", "regexp_replace(value, '^\\*\\.', '')"
    line = {"plain": lambda x, w: x, "pihole": lambda x, w: x, "hosts": lambda x, w: f"'0.0.0.0 ' || {x}", "dnsmasq": lambda x, w: f"'address=/{'.' if w else ''}' || {x} || '/#'", "unbound": lambda x, w: f"'local-zone: \"' || {x} || '.\" always_nxdomain'", "adguard": lambda x, w: f"'||' || {x} || '^'"}[target]
    out = _with(LISTS) + f"SELECT CASE rule_type WHEN 'domain' THEN {line(v, False)} WHEN 'wildcard' THEN {line(b, True)}" + (" WHEN 'regex' THEN '/' || value || '/'" if target == "adguard" else "") + " END AS line FROM nw WHERE "
    out += "true" if target == "adguard" else "rule_type <> 'regex'"
    return out + (" UNION ALL SELECT '@@||' || value || '^' FROM op WHERE rule_type = 'whitelist'" if target == "adguard" else "")


def oracle_sql() -> dict[str, str]:
    b = _with(BASE)
    newest = "ORDER BY ts DESC, event_id DESC"
    rec = f"event_id, ts, domain, client_ip, action, flags, coalesce(array_to_string({_bits(_FLAG_NAME)}, ','), '') AS flags_labels"
    bad = "count(*) FILTER (bad)"
    counters = f"count(*) AS total, count(*) FILTER (action = 'Allowed') AS allowed, count(*) FILTER (action = 'Proxied') AS proxied, {bad} AS blocked"
    flagged = "SELECT unnest(list_filter(range(15), lambda b: (flags >> b) & 1 = 1)) AS bit FROM base WHERE flags IS NOT NULL"
    q = {
        "timeline_1h": _with(BASE, _timeline(3600)) + f"SELECT {_TL} FROM tl",
        "timeline_1m": _with(BASE, _timeline(60)) + f"SELECT {_TL} FROM tl",
        "timeline_1d": _with(BASE, _timeline(86400)) + f"SELECT {_TL} FROM tl",
        "timeline_dense": _with(BASE, _timeline(3600)) + "SELECT g.bucket, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in _TL.split(", ")[1:]) + " FROM (SELECT unnest(range(a, b + 1, 3600)) AS bucket FROM (SELECT min(bucket) AS a, max(bucket) AS b FROM tl)) g LEFT JOIN tl ON tl.bucket = g.bucket ORDER BY g.bucket LIMIT 256",
        "timeline_page": _with(BASE, _timeline(3600)) + f"SELECT {_TL} FROM tl ORDER BY bucket DESC LIMIT 20 OFFSET 10",
        "timeline_maxima": _with(BASE, _timeline(3600)) + "SELECT max(total) AS max_total, max(clients) AS max_clients, least((max(bucket) - min(bucket)) // 3600 + 1, 256) AS dense_rows, count(*) AS active_buckets FROM tl",
        "monitor_counters": b + f"SELECT {counters} FROM base",
        "proxy_counters": _with(*_ALL, _fold("ag", "event_id", "(SELECT t0.total FROM base bb JOIN ds t0 ON t0.domain = bb.domain WHERE bb.event_id = s.event_id)", _STOPS), RESOLVE, VERDICT)
        + "SELECT count(*) AS total, count(*) FILTER (a = 'Blocked') AS blocked, count(*) FILTER (a = 'Allowed') AS allowed, count(*) FILTER (a = 'Proxied') AS proxied FROM (SELECT CASE WHEN action IN ('Suspicious', 'HighlySuspicious') THEN pass_action ELSE action END AS a FROM vd)",
        "rolling_window": b + f"SELECT {counters} FROM base WHERE ts >= (SELECT max(ts) FROM base) - INTERVAL 6 HOUR",
        "top_domains": b + "SELECT domain, count(*) AS hits FROM base GROUP BY domain ORDER BY hits DESC, domain LIMIT 20",
        "top_clients": b + "SELECT client_ip, count(*) AS hits FROM base GROUP BY client_ip ORDER BY hits DESC, client_ip LIMIT 20",
        "event_records": b + f"SELECT {rec} FROM base",
        "search_events": b + f"SELECT {rec} FROM base WHERE action = 'Blocked' AND flags & 22 = 22 AND contains(lower(domain), 'example') {newest} LIMIT 1000",
        "flag_distribution": b + f"SELECT {_FLAG_NAME}[bit + 1] AS flag, hits, round(100.0::DOUBLE * hits / sum(hits) OVER (), 6) AS pct FROM (SELECT bit, count(*) AS hits FROM ({flagged}) GROUP BY bit) ORDER BY hits DESC, bit LIMIT 8",
        "top_filter": b + f"SELECT {_FLAG_NAME}[bit + 1] AS flag, hits, {_pct('hits', 'n')} AS pct FROM (SELECT bit, count(*) AS hits, (SELECT {bad} FROM base) AS n FROM ({flagged}) GROUP BY bit) ORDER BY hits DESC, bit DESC LIMIT 1",
        "global_stats": b + f"SELECT count(DISTINCT client_ip) AS clients, count(*) AS total, {bad} AS blocked, {_pct(bad, 'count(*)')} AS blocked_pct, round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6::DOUBLE), 6) AS avg_qps FROM base",
        "recent_domains": b + f"SELECT event_id, domain FROM base {newest} LIMIT 50",
        "live_feed": b + f"SELECT event_id, strftime(ts, '%H:%M:%S') AS time, client_ip, domain, {_LABEL} AS label FROM base {newest} LIMIT 50",
        "query_log": b + f"SELECT event_id, ts, client_ip, domain, {_LABEL} AS label FROM (SELECT * FROM base {newest} LIMIT 1000) WHERE client_ip LIKE '10.0.0.1%' AND flags & 3855 <> 0 {newest} LIMIT 50 OFFSET 20",
        "talkers": _with(BASE, TALK) + "SELECT * EXCLUDE hits, array_to_string(hits, ',') AS flag_hits FROM talk",
        "talker_rows": _with(BASE, TALK, NAMES, ROWS) + "SELECT * FROM rws",
        "talker_page": _with(BASE, TALK, NAMES, ROWS) + "SELECT client_ip, display_name, blocked_pct FROM rws WHERE client_ip LIKE 'host-%' OR hostname LIKE '%host-%' ORDER BY blocked_pct DESC, client_ip LIMIT 20 OFFSET 5",
        "talker_cap": _with(BASE, TALK) + "SELECT client_ip, last_seen, total FROM talk ORDER BY last_seen DESC, client_ip LIMIT 50",
        "enrich_events": b + "SELECT event_id, client_ip, CASE WHEN domain LIKE '%.com' OR domain LIKE '%.net' THEN domain END AS domain FROM base",
        "labels": b + f"SELECT event_id, strftime(ts, '%H:%M:%S') AS hms, strftime(ts, '%H:%M:%S') AS label_60, strftime(ts, '%H:%M') AS label_3600, strftime(ts, '%Y-%m-%d') AS label_86400, coalesce(array_to_string({_bits(_FLAG_NAME)}, ','), '') AS flag_labels, {_LABEL} AS label, CASE WHEN bad THEN CASE action WHEN 'Blocked' THEN '[BLOCK] ' WHEN 'Suspicious' THEN '[SUSPICIOUS] ' ELSE '[SUSPICIOUS:HIGH] ' END || client_ip || ' -> ' || domain || CASE WHEN len({_bits(_LOG)}) > 0 THEN ' (' || array_to_string({_bits(_LOG)}, '+') || ')' ELSE '' END END AS log_line FROM base",
        "forward_lines": b + "SELECT event_id, t || ' [' || action || '] ' || client_ip || ' ' || domain AS line FROM base WHERE action IN ('Blocked', 'Suspicious')",
        "forward_json": b + """SELECT event_id, '{"timestamp":' || t || ',"client_ip":"' || client_ip || '","action":"' || action || '","domain":"' || domain || '"}' AS line FROM base""",
        "decode_frames": b + "SELECT domain, client_ip, action, flags, count(*) AS n, min(t) AS first FROM base GROUP BY ALL",
        "name_features": _with(BASE, DOMAINS) + f"SELECT domain, (len(p) - 1)::INTEGER AS dots, {_SLD} AS sld, array_to_string(p[greatest(len(p) - 1, 1):], '.') AS zone, coalesce(array_to_string(list_transform(range(2, len(p) + 1), lambda i: array_to_string(p[i:], '.')), ','), '') AS ancestors, strlen(domain) BETWEEN 1 AND 253 AND len(list_filter(p, lambda x: strlen(x) NOT BETWEEN 1 AND 63)) = 0 AS valid, strlen(domain) > 128 OR len(p) - 1 > 5 AS structure_invalid, {_IDN} AS illegal_idn, lower(p[-1]) IN ('biz', 'xyz') AS suspicious_tld FROM dom",
        "dga_features": _with(BASE, DOMAINS, FEATURES) + "SELECT domain, round(e, 6) AS entropy_fast, round(e, 6) AS entropy_full, round(r, 6) AS consonant_ratio, c::INTEGER AS consonant_run, cs AS consonant_suspicious, keyword, dga FROM fd",
        "ngram_model": _with(_ngrams(2, -6.5)) + "SELECT lang, n, gram, round(logp, 6) AS logp FROM md",
        "ngram_scores": _with(BASE, DOMAINS, _ngrams(2, -6.5), _scores(2, "unnest(regexp_extract_all(lower(name), '[a-z]+'))", -6.5)) + "SELECT name, lang, round(score, 6) AS score, max(score) OVER (PARTITION BY name) >= -4.0 AS passes FROM sc",
        "ngram_scores_external": _with(BASE, DOMAINS, _ngrams(3, -12.0), _scores(3, "regexp_replace(lower(name), '[^a-z]', '', 'g')", -10.0)) + "SELECT name, lang, round(score, 6) AS score FROM sc",
        "parse_lists": _with(LISTS) + "SELECT source, line_no, format, kind, value, flags, (length(value) - length(replace(value, '.', '')))::INTEGER AS depth FROM rl",
        "prune_redundant": _with(LISTS) + "SELECT source, line_no, kind, value, flags FROM rl WHERE NOT (flags & 1 = 0 AND kind NOT IN ('browser', 'rejected') AND EXISTS (SELECT 1 FROM rl x WHERE x.kind = 'exact' AND (x.load_order, x.line_no) < (rl.load_order, rl.line_no) AND (CASE WHEN rl.kind = 'regex' THEN replace(rl.value, '\\.', '.') ELSE rl.value END) LIKE '%.' || x.value))",
        "consolidate_exact": _with(LISTS) + "SELECT value, flags, load_order, line_no FROM xr",
        "dedup_globs": _with(LISTS) + "SELECT DISTINCT value FROM rl WHERE kind = 'glob'",
        "source_stats": _with(LISTS) + "SELECT source, format, kind, count(*) AS n FROM rl GROUP BY ALL",
        "classify_rules": _with(LISTS) + "SELECT rule_type, value, line_no FROM op",
        **{f"list_{t}": _list(t) for t in ("plain", "pihole", "hosts", "dnsmasq", "unbound", "adguard")},
        "browser_rules": _with(LISTS) + "SELECT DISTINCT rule_type, value FROM op WHERE rule_type = 'browser'",
        "rule_matches": _with(BASE, LISTS, DOMAINS, MATCH) + "SELECT * EXCLUDE (p, rule_source) FROM mt",
        "domain_scores": _with(BASE, LISTS, DOMAINS, FEATURES, MATCH, DSCORE) + "SELECT domain, total::INTEGER AS total, reasons FROM ds",
        "answer_inspection": _with(BASE, ANSWERS) + "SELECT event_id, " + ", ".join(f"coalesce(string_agg({v}, ',' ORDER BY {v}) FILTER (rtype = '{t}'), '') AS {t.lower()}" for t, v in (("A", "rdata"), ("AAAA", "rdata"), ("CNAME", "regexp_replace(lower(rdata), '\\.+$', '')"))) + ", count(*) FILTER (rtype = 'TXT') AS n_txt, min(ttl) AS min_ttl FROM answers GROUP BY event_id",
        "answer_scores": _with(*_ALL, _fold("ag", "event_id", "0", _STOPS)) + "SELECT ins.event_id, min_ttl, coalesce(added, 0)::INTEGER AS total, coalesce(reasons, '') AS reasons FROM ins LEFT JOIN fc ON fc.event_id = ins.event_id",
        "ip_checks": _with(BASE, ANSWERS) + f"SELECT DISTINCT rdata AS ip, {_PRIVATE} AS private, {_NET} AS blocked_network FROM answers WHERE rtype IN ('A', 'AAAA')",
        "asn_hits": _with(BASE, ANSWERS) + RANGES,
        "resolve": _with(BASE, LISTS, DOMAINS, FEATURES, MATCH, RESOLVE) + "SELECT event_id, CASE WHEN reason IS NOT NULL THEN 'Block' WHEN whitelisted THEN 'Allow' ELSE 'ProxyToUpstream' END AS action, reason, detail FROM base JOIN rs ON rs.domain = base.domain",
        "verdict": _with(*_ALL, _fold("ag", "event_id", "(SELECT t0.total FROM base bb JOIN ds t0 ON t0.domain = bb.domain WHERE bb.event_id = s.event_id)", _STOPS), RESOLVE, VERDICT) + "SELECT event_id, domain, action, reason, detail, flags, total, reasons, pass_action FROM vd",
        "source_effectiveness": _with(*_ALL, _fold("ag", "event_id", "(SELECT t0.total FROM base bb JOIN ds t0 ON t0.domain = bb.domain WHERE bb.event_id = s.event_id)", _STOPS), RESOLVE, VERDICT) + "SELECT detail AS kind, rule_source AS source, count(*) AS blocks, count(DISTINCT domain) AS domains FROM vd WHERE reason IN ('STATIC_BLACKLIST', 'ABP_RULE') GROUP BY ALL",
        "nxdomain_hunting": b + "SELECT client_ip, max(n) AS most FROM (SELECT client_ip, count(*) OVER (PARTITION BY client_ip ORDER BY t RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) AS n FROM base WHERE action <> 'Allowed') GROUP BY client_ip HAVING max(n) >= 4",
        "tunneling": b + "SELECT * FROM (SELECT client_ip, array_to_string(p[greatest(len(p) - 1, 1):], '.') AS zone, (t // 86400) * 86400 AS bucket, count(DISTINCT domain) AS names, bool_or(len(list_filter(p, lambda x: strlen(x) > 60)) > 0) AS long_label FROM (SELECT *, string_split(domain, '.') AS p FROM base) GROUP BY ALL) WHERE names > 5 OR long_label",
        "txt_entropy": _with(BASE, ANSWERS) + f"SELECT event_id, max(round(e, 6)) AS entropy, max(round(e, 6)) > 1.5 AS suspicious FROM (SELECT event_id, {_entropy('rdata')} AS e FROM answers WHERE rtype = 'TXT') GROUP BY event_id",
        "tld_allow_only": b + "SELECT event_id, domain FROM base WHERE lower(string_split(domain, '.')[-1]) NOT IN ('com', 'net', 'example')",
        "client_acl": b + "SELECT event_id, client_ip FROM base WHERE NOT (client_ip LIKE '10.0.0.%' AND (CAST(split_part(client_ip, '.', 4) AS INT) < 64 OR client_ip IN ('10.0.0.200', '10.0.0.130', '10.0.0.131')))",
        "smart_idn": "SELECT doc_id, regexp_matches(text, '^[\\x00-\\x7F\\x{00C0}-\\x{024F}\\x{1E00}-\\x{1EFF}]*$') AS latin, regexp_matches(text, '^[\\x00-\\x7F\\x{00C0}-\\x{00FF}\\x{0152}\\x{0153}]*$') AS western FROM documents",
        "hourly_rollup": b + "SELECT (t // 3600) * 3600 AS hour, client_ip, action, count(*) AS n FROM base GROUP BY ALL",
        "within_retention": b + f"SELECT {counters} FROM base WHERE ts >= (SELECT max(ts) FROM base) - INTERVAL 72 HOUR",
        "list_collision": _with(LISTS) + "SELECT value AS domain, count(DISTINCT source) AS sources, string_agg(DISTINCT source, ',' ORDER BY source) AS listed_by FROM rl WHERE kind = 'exact' GROUP BY value HAVING count(DISTINCT source) >= 2",
        "list_overlap": _with(LISTS) + "SELECT x.source AS a, y.source AS b, count(DISTINCT x.value) AS domains FROM rl x JOIN rl y ON x.value = y.value AND x.source < y.source WHERE x.kind = 'exact' AND y.kind = 'exact' GROUP BY 1, 2",
        "tld_trends": b + f"SELECT lower(string_split(domain, '.')[-1]) AS tld, count(*) AS n, {bad} AS blocked FROM base GROUP BY 1",
        "structure_stats": b + "SELECT length(domain) - length(replace(domain, '.', '')) AS dots, (strlen(domain) // 10 * 10)::BIGINT AS bytes_from, count(*) AS n FROM base GROUP BY ALL",
        "dga_audit": _with(BASE, DOMAINS, FEATURES) + "SELECT bad AS is_blocked, count(*) AS n, round(sum(round(e, 6)) / count(*), 6) AS mean_entropy FROM base JOIN fd ON fd.domain = base.domain WHERE e IS NOT NULL GROUP BY bad",
        "typosquat": _with(BASE, DOMAINS) + "SELECT name, brand, levenshtein(name, brand) AS edits FROM (SELECT DISTINCT p[1] AS name FROM dom) JOIN (SELECT DISTINCT p[1] AS brand FROM dom WHERE domain LIKE 'ads%.tracker.net') ON abs(length(name) - length(brand)) <= 1 WHERE levenshtein(name, brand) = 1",
        "qtype_breakdown": b + "SELECT qtype, count(*) AS n FROM base GROUP BY qtype",
        "blocks_by_client": b + "SELECT client_ip, count(*) AS n FROM base WHERE bad GROUP BY client_ip",
        "beaconing": b + "SELECT client_ip, domain, gaps, round(m, 4) AS mean_gap, round(s / m, 4) AS spread FROM (SELECT client_ip, domain, count(gap) AS gaps, avg(gap) AS m, stddev_pop(gap) AS s FROM (SELECT client_ip, domain, t - lag(t) OVER (PARTITION BY client_ip, domain ORDER BY t, event_id) AS gap FROM base) WHERE gap IS NOT NULL GROUP BY ALL) WHERE gaps >= 3 AND m > 0 AND round(s / m, 4) <= 1.0",
        "decayed_counts": b + "SELECT domain, round(sum(power(0.5::DOUBLE, (((SELECT max(t) FROM base) - t) / 3600.0::DOUBLE) / 24.0::DOUBLE)), 6) AS weight FROM base GROUP BY domain",
        "log_strategy": b + "SELECT event_id, CASE WHEN domain LIKE '%.biz' THEN NULL ELSE client_ip END AS client_ip, domain FROM base WHERE domain NOT LIKE '%.xyz'",
        "stream_timeline": _with(BASE, _timeline(3600)) + "SELECT bucket, allowed, proxied, blocked, suspicious, highlysuspicious, total FROM tl",
        "stream_announce": b + "SELECT DISTINCT domain FROM base",
        "stream_rolling": b + f"SELECT w AS begin, {counters} FROM (SELECT *, unnest([(t // 1800) * 1800, (t // 1800) * 1800 - 1800]) AS w FROM base) GROUP BY w",
        "stream_forward": b + "SELECT event_id, t || ' ' || client_ip || ' ' || action || ' ' || domain AS line FROM base WHERE action IN ('Blocked', 'HighlySuspicious')",
        "stream_top_domains": b + "SELECT domain, count(*) AS hits FROM base GROUP BY domain ORDER BY hits DESC, domain LIMIT 20",
        "read_lists": _with(LISTS) + "SELECT load_order, row_number() OVER (PARTITION BY source ORDER BY line_no) AS line_no, line FROM ll",
        "read_nrd": _with(LISTS) + "SELECT 'nrd' AS role, row_number() OVER (ORDER BY line_no) AS line_no, line FROM ll WHERE load_order = 1",
        "domain_maps": _with(LISTS) + "SELECT DISTINCT value AS domain, true AS sound FROM rl WHERE kind = 'exact'",
        "browser_file": _with(LISTS) + "SELECT value AS line FROM rl WHERE kind = 'browser'",
        "lexical_hits": _with(BASE, DOMAINS, FEATURES) + "SELECT domain, lower(p[-1]) AS tld, keyword FROM ft WHERE lower(p[-1]) IN ('biz', 'xyz')",
        "ngram_scores_2": _with(BASE, DOMAINS, _ngrams(2, -12.0), _scores(2, "regexp_replace(lower(name), '[^a-z]', '', 'g')", -10.0)) + "SELECT name, lang, round(score, 6) AS score FROM sc",
        "ngram_scores_4": _with(BASE, DOMAINS, _ngrams(4, -12.0), _scores(4, "regexp_replace(lower(name), '[^a-z]', '', 'g')", -10.0)) + "SELECT name, lang, round(score, 6) AS score FROM sc",
        "top_words": b + "SELECT word, count(*) AS hits FROM (SELECT unnest(regexp_extract_all(lower(domain), '[a-z]{3,}')) AS word FROM base WHERE bad) GROUP BY word ORDER BY hits DESC, word LIMIT 50",
        "retention": b + "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(DISTINCT client_ip) AS clients FROM base GROUP BY 1 HAVING min(date_trunc('day', ts)) + INTERVAL 1 DAY > (SELECT max(ts) FROM base) - INTERVAL 72 HOUR",
        "stream_json": b + f"SELECT event_id, domain, client_ip, action, flags, coalesce(array_to_string({_bits(_FLAG_NAME)}, ','), '') AS flags_labels FROM base",
        "stream_refresh": b + "SELECT event_id, CASE WHEN domain LIKE '%.com' THEN CASE WHEN event_id % 3 = 2 THEN upper(domain) ELSE domain END WHEN domain LIKE '%.net' AND event_id % 3 > 0 THEN domain END AS domain FROM base",
        "stream_verdict": _with(*_ANSWERED, _fold("ag", "event_id", "(SELECT t0.total FROM base bb JOIN ds t0 ON t0.domain = bb.domain WHERE bb.event_id = s.event_id)", _STOPS), RESOLVE, VERDICT) + "SELECT event_id, action, reason, flags, total FROM vd",
        "stream_talkers": _with(BASE, TALK) + "SELECT client_ip, floor(epoch(first_seen))::BIGINT AS first, floor(epoch(last_seen))::BIGINT AS last, total, concat_ws(',', " + ", ".join(f"n_{a.lower()}" for a in ACTIONS) + ") AS actions, array_to_string(hits, ',') AS flag_hits, n_blocked + n_suspicious + n_highlysuspicious AS blocked FROM talk",
        "stream_late": b + "SELECT (t // 3600) * 3600 AS bucket, count(*) AS total FROM base WHERE event_id % 2 = 0 OR make_timestamp(((t // 3600) * 3600 + 3600) * 1000000) > (SELECT max(ts) FILTER (event_id % 2 = 0) FROM base) - INTERVAL 10 MINUTE GROUP BY 1",
        "decode_archives": b + "SELECT domain, client_ip, action, flags, count(*) AS n, min(t) AS first FROM base GROUP BY ALL UNION ALL SELECT NULL, NULL, CASE WHEN a % 3 = 0 THEN 'torn' ELSE 'misaligned' END, NULL, count(*), NULL FROM (SELECT DISTINCT event_id // 500 AS a FROM base) WHERE a % 3 < 2 GROUP BY 3",
        "stream_talkers_expiry": _with(BASE, TALKER_DAYS) + "SELECT client_ip, floor(epoch(min(f)))::BIGINT AS first, floor(epoch(max(l)))::BIGINT AS last, sum(n)::BIGINT AS total, sum(b)::BIGINT AS blocked, max(l) + INTERVAL 1 DAY <= (SELECT max(m) FROM mm) AS expired FROM ss GROUP BY client_ip, sid",
        "stream_heavy_hitters": b + "SELECT domain, count(*) AS hits FROM base GROUP BY domain ORDER BY hits DESC, domain LIMIT 20",
        "stream_delivered": b + "SELECT t || ' ' || client_ip || ' ' || action || ' ' || domain AS line FROM base WHERE action IN ('Blocked', 'Suspicious')",
        "timeline_sketch": b + " UNION ALL ".join(f"SELECT {z} AS zoom, (t // {z}) * {z} AS bucket, {_COUNTS}, count(*) AS total, count(DISTINCT client_ip) AS clients FROM base GROUP BY 2" for z in ZOOMS),
        "retention_tiers": b + ", ".join(["SELECT 'hour' AS tier", "(t // 3600) * 3600 AS at", "client_ip", "action", "count(*) AS n FROM base WHERE date_trunc('day', ts) + INTERVAL 1 DAY > (SELECT max(ts) FROM base) - INTERVAL 240 HOUR GROUP BY ALL"]) + " UNION ALL SELECT 'event', (t // 86400) * 86400, NULL, NULL, count(*) FROM base WHERE date_trunc('day', ts) + INTERVAL 1 DAY > (SELECT max(ts) FROM base) - INTERVAL 72 HOUR GROUP BY 2",
        "search_store": b + f"SELECT {rec} FROM base WHERE ts BETWEEN TIMESTAMP '2024-01-10 06:00:00' AND TIMESTAMP '2024-01-12 18:00:00' AND client_ip = '10.0.0.7' {newest} LIMIT 1000",
        "typosquat_2": _with(BASE, DOMAINS) + "SELECT name, brand, levenshtein(name, brand) AS edits FROM (SELECT DISTINCT p[1] AS name FROM dom) JOIN (SELECT DISTINCT p[1] AS brand FROM dom WHERE domain LIKE 'ads%.tracker.net') ON abs(length(name) - length(brand)) <= 2 WHERE levenshtein(name, brand) BETWEEN 1 AND 2",
        "verdict_ngram": _with(BASE, LISTS, DOMAINS, FEATURES, MATCH, _ngrams(2, -6.5), _scores(2, "unnest(regexp_extract_all(lower(name), '[a-z]+'))", -6.5), "np AS (SELECT name, max(score) >= -4.0 AS ok FROM sc WHERE lang IN ('en', 'fr', 'de') GROUP BY name)", RESOLVE.replace("ELSE dga END AS reason", "WHEN dga IS NULL AND strlen(s) >= 8 AND NOT coalesce(np.ok, false) THEN 'LEXICAL_ANALYSIS' ELSE dga END AS reason").replace("fd.domain = mt.domain)", "fd.domain = mt.domain LEFT JOIN np ON np.name = fd.s)"))
        + "SELECT event_id, CASE WHEN reason IS NOT NULL THEN 'Block' WHEN whitelisted THEN 'Allow' ELSE 'ProxyToUpstream' END AS action, reason, detail FROM base JOIN rs ON rs.domain = base.domain",
        "verdict_status": _with(*_ALL, _fold("ag", "event_id", "(SELECT t0.total FROM base bb JOIN ds t0 ON t0.domain = bb.domain WHERE bb.event_id = s.event_id)", _STOPS), RESOLVE, VERDICT.replace("fc.added, fc.reasons AS r1", "CASE WHEN b.event_id % 3 = 0 THEN fc.added END AS added, CASE WHEN b.event_id % 3 = 0 THEN fc.reasons END AS r1").replace("CASE WHEN tot >= 10", "CASE WHEN event_id % 3 = 2 THEN NULL WHEN tot >= 10"))
        + "SELECT event_id, action, reason, flags, total, reasons, pass_action FROM vd",
        "entropy_modes": _with(WORDS) + f"SELECT w || '.example' AS domain, round(fast, 6) AS fast, round(slow, 6) AS full, {_mode('fast')} AS dga_fast, {_mode('slow')} AS dga_full FROM (SELECT w, w AS s, {_RATIO.replace(' s,', ' w,').replace('(s,', '(w,')} AS r, {_RUN.replace('(s,', '(w,')} AS c, {_entropy('w')} AS slow, {_BYTES} AS fast FROM wd)",
        "idn_names": _with(WORDS) + "SELECT domain, regexp_matches(domain, '^[\\x00-\\x7F\\x{00C0}-\\x{024F}\\x{1E00}-\\x{1EFF}]*$') AS latin, regexp_matches(domain, '^[\\x00-\\x7F\\x{00C0}-\\x{00FF}\\x{0152}\\x{0153}]*$') AS western, strlen(domain) <> length(domain) OR regexp_matches(domain, '(^|\\.)xn--') AS illegal FROM (SELECT ['', 'ő', 'ж', '例'][(length(w) + 8) % 4 + 1] || w || '.example' AS domain FROM wd)",
        "stream_flags": b + f"SELECT {_FLAG_NAME}[bit + 1] AS flag, count(*) AS hits FROM ({flagged}) GROUP BY bit",
    }
    return q
