"""Archives, versions, delivery, sketches, tiers, provenance, hunting, typosquats and the event store on made cases."""

import math
import random
import re
from collections import Counter
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from dnsloom.config import EngineConfig
from dnsloom.functions import lexical
from dnsloom.operators import extras, match, rules
from dnsloom.plans import verdict as vd
from dnsloom.sources import dimensions, frames, lists, versions
from dnsloom.sources.tables import stored
from dnsloom.streaming import sinks, streams

rng = random.Random(8)
CFG = EngineConfig()


def framed(kind, payload):
    body = bytes([kind]) + payload
    return len(body).to_bytes(2, "little") + body


MAPPING = framed(0, (7).to_bytes(8, "little") + (5).to_bytes(2, "little") + b"a.com")
EVENT = framed(1, (1_700_000_000).to_bytes(8, "little") + (7).to_bytes(8, "little") + bytes(10) + b"\xff\xff\x0a\x00\x00\x01" + b"\x00")
ODD = framed(9, b"??")


def test_archives_are_split_and_rests_set_aside(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(frames, "HELD", 3)
    parts = {
        "a": (MAPPING + EVENT * 9 + ODD + EVENT, 12, None),
        "b": (EVENT * 2 + EVENT[:20], 2, "torn"),
        "c": (EVENT + b"\x01", 1, "torn"),
        "d": (EVENT + ODD + b"\x02\x00\x08?" * 3, 1, "misaligned"),
        "e": (EVENT + b"\x00\x00" + EVENT, 3, None),  # an empty frame between sound ones
        "f": (ODD, 1, None),
        "g": (b"", 0, None),
    }
    for name, (content, _, _) in parts.items():
        (tmp_path / name).write_bytes(content)
    good, rest = frames.split_archives(frames.read_archives(spark, str(tmp_path)))
    assert spark.read.format("binaryFile").load(str(tmp_path)).rdd.getNumPartitions() > 1
    got = Counter(r.archive[-1] for r in good.collect())
    assert got == {k: n for k, (_, n, _) in parts.items() if n}
    assert {r.archive[-1]: r.fault for r in rest.collect()} == {k: f for k, (_, _, f) in parts.items() if f}
    for r in good.collect():
        assert parts[r.archive[-1]][0][r.at : r.at + len(r.frame)] == r.frame
    mappings, events, odd = frames.decode_frames(good.select("archive", "frame"))
    assert mappings.count() == 1 and {r.client_ip for r in events.collect()} == {"10.0.0.1"} and odd.count() == 3  # of a, e and f
    none = spark.createDataFrame([("x", None)], "archive string, content binary")
    assert [x.count() for x in frames.split_archives(none)] == [0, 0]


def test_versions_commit_pin_and_forget(spark, tmp_path):
    root = str(tmp_path / "map")
    t = lambda *rows: spark.createDataFrame(rows, "domain_hash long, domain string")
    assert versions.newest(spark, root) is None and versions.pinned(spark, root, "r", 0) is None
    assert versions.publish(t((1, "a"), (2, "b")), root) == 0
    assert versions.pinned(spark, root, "r", 0) == 0
    assert versions.publish(t((2, "B"), (3, "c")), root, merge_with=dimensions.merge_domain_map) == 1
    assert sorted(map(tuple, versions.read(spark, root, 1).collect())) == [(1, "a"), (2, "B"), (3, "c")]
    t((9, "z")).write.parquet(f"{root}/data/v=2")  # a writer died before its commit
    assert versions.newest(spark, root) == 1 and versions.pinned(spark, root, "r", 1) == 1
    assert versions.pinned(spark, root, "r", 0) == 0  # a batch that is run again
    assert versions.publish(t((5, "e")), root) == 2 and [r.domain for r in versions.read(spark, root, 2).collect()] == ["e"]
    assert versions.forget(spark, root, keep=1) == [0, 1] and versions.forget(spark, root, keep=1) == []
    assert versions.read(spark, root, 2).count() == 1


def _lines(spark, folder):
    return spark.readStream.schema("line string").parquet(folder)


def _undo_last_commit(folder):
    commits = [p for p in (folder / "commits").iterdir() if p.name.isdigit()]
    last = max(commits, key=lambda p: int(p.name))
    last.unlink()
    for crc in (folder / "commits").glob(f".{last.name}.crc"):
        crc.unlink()


def test_a_batch_that_is_run_again_delivers_nothing_twice(spark, tmp_path):
    source, out = str(tmp_path / "in"), tmp_path / "posts"
    out.mkdir()

    def post(key, lines):
        """A receiver that fails once, and keeps what it gets by key."""
        import os
        import uuid

        flag = out / "failed"
        held = list(lines)
        if not flag.exists():
            flag.touch()
            raise OSError("not now")
        with open(out / f"{key.replace('/', '-')}.{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(held))
        os.sync()

    def run():
        sinks.deliver_with(_lines(spark, source), post, str(tmp_path / "noted"), str(tmp_path / "c"))

    spark.range(40).select(F.concat(F.lit("x"), "id").alias("line")).repartition(3).write.parquet(source)
    with pytest.raises(Exception, match="not now"):
        run()
    run()
    spark.range(40, 50).select(F.concat(F.lit("x"), "id").alias("line")).write.mode("append").parquet(source)
    run()
    _undo_last_commit(tmp_path / "c")
    run()
    files = [p for p in out.iterdir() if p.name != "failed"]
    by_key = {p.name.split(".")[0]: p.read_text().split("\n") for p in files}
    assert sorted(x for v in by_key.values() for x in v) == sorted(f"x{i}" for i in range(50))
    lines = str(tmp_path / "lines")
    for again in (False, True):
        if again:
            _undo_last_commit(tmp_path / "d")
        sinks.deliver_lines(_lines(spark, source), lines, str(tmp_path / "d"))
        assert sorted(r.line for r in sinks.read_delivered(spark, lines).collect()) == sorted(f"x{i}" for i in range(50))


def _events(spark, rows):
    """(id, second, client, domain, action)"""
    t = spark.createDataFrame(rows, "event_id long, s long, client_ip string, domain string, action string")
    return t.select("event_id", F.timestamp_seconds("s").alias("ts"), "client_ip", "domain", "action", F.lit(None).cast("int").alias("flags"))


def test_bounded_top_is_close_and_its_state_small(spark, tmp_path):
    names = [f"d{min(int(rng.expovariate(0.01)), 5000)}" for _ in range(20_000)] + ["hot"] * 5000 + [f"once{i}" for i in range(15_000)]
    true = Counter(names)
    _events(spark, [(i, i, "c", d, "Allowed") for i, d in enumerate(names)]).repartition(4).write.parquet(str(tmp_path / "e"))
    s = spark.readStream.schema("event_id long, ts timestamp, client_ip string, domain string, action string, flags int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e"))
    sketches = stored(sinks.drain(spark, streams.heavy_hitters_stream(s, "domain", tracked=256, parts=4), "complete"), "t")
    assert sketches.count() == 4
    got = {r.domain: r.hits for r in streams.top_of(sketches, 20, "domain", tracked=256).collect()}
    bound = 3.5 / 256 * len(names)
    assert "hot" in got and all(abs(n - true[d]) <= bound for d, n in got.items())
    assert streams.top_of(sketches, 1, "domain", tracked=256).first().domain == "hot"
    roomy = sinks.drain(spark, streams.heavy_hitters_stream(s, "domain", tracked=32_768, parts=4), "complete")
    want = sorted(true.items(), key=lambda x: (-x[1], x[0]))[:50]
    assert [tuple(r) for r in streams.top_of(roomy, 50, "domain", tracked=32_768).collect()] == want


def test_united_client_sketches_are_close(spark, tmp_path):
    rows = [(i, rng.randrange(6 * 3600), f"c{rng.randrange(9000)}", "d", "Allowed") for i in range(30_000)]
    _events(spark, [*rows, (-1, 10**7, "end", "d", "Allowed")]).coalesce(1).write.parquet(str(tmp_path / "e"))
    s = spark.readStream.schema("event_id long, ts timestamp, client_ip string, domain string, action string, flags int").parquet(str(tmp_path / "e"))
    minutes = sinks.drain(spark, streams.sketched_minutes(s), "append")
    for zoom in (60, 3600, 86400):
        exact, total = {}, Counter()
        for _, t, c, _, _ in rows:
            exact.setdefault(t // zoom * zoom, set()).add(c)
            total[t // zoom * zoom] += 1
        got = {r.bucket: (r.clients, r.total) for r in streams.rolled_up(minutes, zoom).collect()}
        assert {k: n for k, (_, n) in got.items()} == total
        assert all(abs(c - len(exact[k])) <= max(2, 0.03 * len(exact[k])) for k, (c, _) in got.items())


def test_an_hour_worked_out_again_changes_nothing_else(spark, tmp_path):
    log, roll = str(tmp_path / "log"), str(tmp_path / "roll")
    first = _events(spark, [(i, 1800 * i, f"c{i % 3}", "d", "Allowed") for i in range(96)])
    extras.write_events(first, log, files_a_day=2)
    extras.refresh_rollup(spark, log, roll, first)
    read = lambda: Counter({(r.hour, r.client_ip): r.n for r in spark.read.parquet(roll).collect()})
    before = read()
    assert sum(before.values()) == 96
    extras.refresh_rollup(spark, log, roll, first.limit(5))
    assert read() == before
    late = _events(spark, [(200, 10, "c0", "d", "Allowed"), (201, 90_000, "c9", "d", "Allowed")])
    extras.write_events(late, log)
    extras.refresh_rollup(spark, log, roll, late)
    assert read() - before == {(0, "c0"): 1, (90_000, "c9"): 1}
    assert extras.expire(spark, log, hours=1) == ["1970-01-01"] and read() - before == {(0, "c0"): 1, (90_000, "c9"): 1}
    extras.refresh_rollup(spark, log, roll, late)  # the first day is gone from the log: its hours stay
    assert sum(read().values()) == 98


def test_windows_of_failures_across_chunks(spark):
    rows = [(i, rng.randrange(2000), rng.choice("abc") if i % 3 else "hot", "d", "Blocked") for i in range(900)]
    for seconds, chunk in ((60, 100), (7, 7), (500, 50)):
        want = {}
        for c in {"a", "b", "c", "hot"}:
            at = [t for _, t, x, _, _ in rows if x == c]
            want[c] = max(sum(t - seconds < u <= t for u in at) for t in at)
        got = {r.client_ip: r.most for r in extras.nxdomain_hunting(_events(spark, rows), least=1, seconds=seconds, chunk=chunk).collect()}
        assert got == want
    assert extras.nxdomain_hunting(_events(spark, rows).limit(0)).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("most", [1, 2])
def test_typosquats_against_all_pairs(spark, most):
    brands = ["google", "aa", "x", "paypal", "facebook", "googles", "ñandu"]
    names = {"".join(rng.choice("gole") for _ in range(rng.randrange(1, 9))) for _ in range(150)} | set(brands)
    for b in brands:
        for _ in range(25):
            w = list(b)
            for _ in range(rng.randrange(1, 4)):
                i = rng.randrange(len(w) + 1)
                w[i : i + rng.randrange(2)] = rng.choice(["", "g", "x", "ñ"])
            names.add("".join(w))
    names.discard("")
    d = spark.createDataFrame([(f"{n}.com",) for n in names] + [("nodot",), (None,)], "domain string")
    got = {(r.name, r.brand): r.edits for r in extras.typosquat(d, spark.createDataFrame([(b,) for b in brands], "brand string"), most).collect()}
    assert got == {(n, b): e for n in names for b in brands if 1 <= (e := edits(n, b)) <= most}


def test_typosquats_join_by_segments(spark):
    d = spark.createDataFrame([("gogle.com",)], "domain string")
    plan = extras.typosquat(d, spark.createDataFrame([("google",)], "brand string"), 2)._jdf.queryExecution().toString()
    assert "seg#" in plan and "text#" in plan and "NestedLoop" not in plan


LIST = [
    ("s1", "black", 1, 1, "one.com"), ("s2", "black", 2, 1, "one.com"),
    ("s2", "black", 2, 2, "||*.wild.com^"), ("s3", "black", 3, 1, "||*.wild.com^"),
    ("s1", "black", 1, 2, "||ads*.net^"), ("s3", "black", 3, 2, "||a*.net^"), ("s2", "black", 2, 3, "||ads*.*^"),
    ("s3", "black", 3, 3, "/^track/"), ("s2", "black", 2, 4, r"/(k)\1/"), ("s1", "white", 0, 1, "@@||ok.com^"),
]


def test_every_block_names_its_list(spark, monkeypatch):
    monkeypatch.setattr(match, "PART", 2)
    more = [("s9", "black", 9, i, f"||zz{i}*.net^") for i in range(9)] + [("s9", "black", 9, 20 + i, f"/never{i}/") for i in range(9)]
    parsed = stored(rules.parse_lines(spark.createDataFrame(LIST + more, lists.LINES)), "t")
    compiled = stored(rules.consolidate_exact(parsed).unionByName(parsed.filter("kind in ('suffix', 'glob', 'regex')")), "t")
    want = {"one.com": "s2", "a.wild.com": "s2", "ads1.net": "s1", "abc.net": "s3", "zz3.net": "s9", "ads.org": "s2", "tracker.io": "s3", "bookkeeper.io": "s2", "never4.io": "s9", "ok.com": None, "plain.io": None}
    q = spark.createDataFrame([(i, d, 1) for i, d in enumerate(want)], "event_id long, domain string, qtype int").selectExpr("*", "timestamp'2024-01-01' as ts", "'c' as client_ip")
    a = spark.createDataFrame([], "event_id long, rtype string, rdata string, ttl int")
    assert {r.domain: r.rule_source for r in vd.verdict(q, a, compiled, CFG).collect()} == want
    ruled = extras.source_effectiveness(vd.verdict(q, a, compiled, CFG)).collect()
    assert {(r.kind, r.source): r.blocks for r in ruled} == {("blocklist", "s2"): 1, ("wildcard", "s2"): 1, ("glob", "s1"): 1, ("glob", "s3"): 1, ("glob", "s9"): 1, ("glob", "s2"): 1, ("regex", "s3"): 1, ("regex", "s2"): 1, ("regex", "s9"): 1}


@pytest.mark.parametrize(
    "pattern, gram",
    [("^track", "tra"), (r"ads\.net$", "net"), (r"a.bcd", "bcd"), ("abc?d", None), ("xabc?", "xab"), ("ab+cde", "cde"), ("ab{2}cd", None), ("(abc)", None), ("abc|def", None), ("[abc]def", None), (r"ab\.cd", None), (r"\bfoo\d", "foo"), ("ABC", None), (r"\x61bcd", None), ("a*", None), ("", None), ("^play-casino\\.3", "cas")],
)
def test_letters_that_every_match_holds(spark, pattern, gram):
    got = spark.createDataFrame([(pattern,)], "p string").select(match.mandatory_trigram(F.col("p"))).first()[0]
    assert got == gram


@pytest.mark.parametrize("pool", [1000, 5])
def test_regexes_by_trigram_and_by_alternation_agree(spark, pool, monkeypatch):
    monkeypatch.setattr(match, "POOL", pool)
    letters = "abcx.1-"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    patterns = ["".join(rng.choice(["a", "b", "c", "ab", "abc", "xa", r"\.", ".", "b?", "c+", "1{2}", "^", "$", r"\d", r"\w*"]) for _ in range(rng.randrange(1, 7))) for _ in range(120)]
    patterns = [p for p in patterns if not re.search(r"\^.*\^|\$.|[\^$][?+{*]", p)]
    names = {word(rng.randrange(1, 12)) for _ in range(300)}
    table = spark.createDataFrame([("regex", 0, p) for p in patterns], "kind string, flags int, value string")
    for some in (patterns, patterns[:1], []):
        t = table.filter(F.col("value").isin(some)) if some else table.limit(0)
        got = {r.domain for r in match.regex_hits(spark.createDataFrame([(n,) for n in names], "domain string"), t).collect()}
        assert got == {n for n in names if any(re.search(p, n) for p in some)}


def test_language_models_come_last(spark):
    model = lexical.ngram_train(spark.createDataFrame([("banana banana" * 20, "en"), ("qxqx", "xx")], "text string, lang string"))
    d = spark.createDataFrame([("banananana.com",), ("qaxaqaxaqa.com",), ("12345678.com",), ("short.com",), ("a1b2c3d4e5f6g7h8i9j0.com",), ("nodot",)], "domain string")
    none = spark.createDataFrame([], lists.LINES)
    compiled = stored(rules.parse_lines(none), "t")
    cfg = replace(CFG, use_ngram=True, ngram_languages=("en", "zz"))
    reasons = lambda c, m: {r.domain: r.dga for r in vd.domain_facts(d, compiled, c, m).collect()}
    assert reasons(cfg, model) == {"banananana.com": None, "qaxaqaxaqa.com": "LEXICAL_ANALYSIS", "12345678.com": "LEXICAL_ANALYSIS", "short.com": None, "a1b2c3d4e5f6g7h8i9j0.com": "HIGH_ENTROPY", "nodot": None}
    assert reasons(replace(cfg, ngram_languages=("zz",)), model)["qaxaqaxaqa.com"] is None  # no known language: all pass
    assert reasons(CFG, None)["12345678.com"] is None
    with pytest.raises(ValueError):
        vd.domain_facts(d, compiled, cfg)


def test_entropy_of_bytes_or_characters(spark):
    """Characters over bytes: two letters of two bytes each give 2 * (1/4 * 2) bits."""
    t = spark.createDataFrame([("ñü",), ("google",), ("",)], "s string")
    got = [(round(r[0], 6), round(r[1], 6)) for r in t.select(lexical.entropy(F.col("s"), CFG), lexical.entropy(F.col("s"), replace(CFG, entropy_fast=False))).collect()]
    byte = lambda b: -sum(n / len(b) * math.log2(n / len(b)) for n in Counter(b).values())
    assert got[0] == (round(byte("ñü".encode()), 6), 1.0) and got[1] == (1.918296, 1.918296) and got[2] == (0.0, 0.0)


def test_answer_states(spark):
    compiled = stored(rules.parse_lines(spark.createDataFrame([], lists.LINES)), "t")
    states = ["ok", "unparsed", "error"]
    q = spark.createDataFrame([(i, "bcdfghjkl.biz", 1, s) for i, s in enumerate(states)] + [(3, "bcdfghjkl.biz", 255, "error")], "event_id long, domain string, qtype int, answer_status string").selectExpr("*", "timestamp'2024-01-01' as ts", "'c' as client_ip")
    a = spark.createDataFrame([(i, "A", "10.0.0.1", 60) for i in range(4)], "event_id long, rtype string, rdata string, ttl int")
    got = {r.event_id: (r.action, r.reason, r.total) for r in vd.verdict(q, a, compiled, replace(CFG, pipeline=("whitelist", "upstream"))).collect()}
    assert got == {0: ("Blocked", "TLD_EXCLUDED", 16), 1: ("Suspicious", "TLD_EXCLUDED", 6), 2: ("Proxied", None, 6), 3: ("Blocked", "FORBIDDEN_QTYPE", None)}


def test_a_search_opens_few_days_and_files(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [(i, 600 * i, f"10.0.0.{i % 50}", f"d{i % 97}.com", "Blocked") for i in range(3000)]
    extras.write_events(_events(spark, rows), path, files_a_day=8)
    import datetime as dt

    at = lambda s: dt.datetime.fromtimestamp(s, dt.UTC).replace(tzinfo=None)
    found = extras.search_store(spark, path, since=at(600 * 500), until=at(600 * 900), client="10.0.0.7", limit=1000)
    assert {r.event_id for r in found.collect()} == {i for i, _, c, _, _ in rows if 500 <= i <= 900 and c == "10.0.0.7"}
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = extras.search_store(spark, path, since=at(600 * 500), until=at(600 * 900), client="10.0.0.7")._jdf.queryExecution().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert re.search(r"PartitionFilters: \[[^\]]*day#", plan) and "EqualTo(client_ip,10.0.0.7)" in plan
    # Row groups without the client are left out: the scan gives out less than the table.
    scan = spark.read.parquet(path).filter("client_ip = '10.0.0.7'")
    scan.collect()
    nodes, todo = [], [scan._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        nodes.append(p)
        todo += [p.children().apply(i) for i in range(p.children().size())]
        if p.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(p.executedPlan())
    read = [n.metrics().apply("numOutputRows").value() for n in nodes if n.nodeName().startswith("Scan")]
    assert read and 60 <= max(read) < 1500
