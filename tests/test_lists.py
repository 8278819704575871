"""From list lines to rules, and to blocklists; reading and writing of lists, frames and maps."""

from pyspark.sql import functions as F

from dnsloom.operators import match, rules
from dnsloom.sources import dimensions, lists
from dnsloom.sources.frames import decode_frames

ROWS = [
    ("w", "white", 1, 1, "safe.example"),
    ("w", "white", 1, 2, "@@||trusted.example.org^$document"),
    ("n", "nrd", 2, 1, "fresh-domain.example"),
    ("b1", "black", 3, 1, "# comment"),
    ("b1", "black", 3, 2, "! comment"),
    ("b1", "black", 3, 3, "   "),
    ("b1", "black", 3, 4, "0.0.0.0 ads.one.example"),
    ("b1", "black", 3, 5, "127.0.0.1 one.example"),
    ("b1", "black", 3, 6, ":: six.example"),
    ("b1", "black", 3, 7, "deep.ads.one.example"),
    ("b1", "black", 3, 8, "server=/two.example/"),
    ("b1", "black", 3, 9, "address=/three.example/127.0.0.1"),
    ("b1", "black", 3, 10, "server=//"),
    ("b2", "black", 4, 1, "||four.example^$third-party"),
    ("b2", "black", 4, 2, "||*.tracker.net^"),
    ("b2", "black", 4, 3, "||ads*.tracker.net^"),
    ("b2", "black", 4, 4, r"/^ads[0-9]+\.tracker\./"),
    ("b2", "black", 4, 5, "some random text"),
    ("b2", "black", 4, 6, "safe.example"),
    ("b2", "black", 4, 7, "site.example##.ad"),
]


def parsed(spark, rows=ROWS):
    return rules.parse_lines(spark.createDataFrame(rows, lists.LINES))


def test_parse(spark):
    got = {(r.kind, r.value) for r in parsed(spark).collect()}
    assert {("exact", d) for d in ("safe.example", "trusted.example.org", "ads.one.example", "one.example", "six.example", "two.example", "three.example", "four.example")} <= got
    assert ("suffix", "tracker.net") in got and ("glob", "ads*.tracker.net") in got and ("regex", r"^ads[0-9]+\.tracker\.") in got
    assert ("browser", "site.example##.ad") in got and ("rejected", "some random text") in got and ("rejected", "server=//") in got
    assert parsed(spark, []).count() == 0


def test_prune_and_consolidate(spark):
    gone = {r.value for r in parsed(spark).collect()} - {r.value for r in rules.prune_redundant(parsed(spark)).collect()}
    assert gone == {"deep.ads.one.example"}
    free = {r.value for r in rules.prune_redundant(parsed(spark), order_free=True).collect()}
    assert "ads.one.example" not in free
    last = {r.value: r.source for r in rules.consolidate_exact(parsed(spark)).collect()}
    assert last["safe.example"] == "b2"
    assert {r.value: r.source for r in rules.consolidate_exact(parsed(spark), whitelist_wins=True).collect()}["safe.example"] == "w"


def test_lists_of_one_file_name(spark, tmp_path):
    for i, folder in enumerate(["a b", "c%d", "e"]):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "hosts.txt").write_text("".join(f"{i}-{j}\n" for j in range(5)))
    paths = [str(tmp_path / "e" / "hosts.txt"), str(tmp_path / "a b" / "hosts.txt"), str(tmp_path / "c%d")]
    got = lists.read_lists(spark, paths, first_order=7).collect()
    assert sorted((r.load_order, r.line_no, r.line) for r in got) == sorted((7 + k, j + 1, f"{i}-{j}") for k, i in enumerate((2, 0, 1)) for j in range(5))


def test_pools_of_both_kinds_agree(spark, monkeypatch):
    d = spark.createDataFrame([(x,) for x in ("ads1.x.net", "b.x.net", "aa.q", "zz.q", "m.io")], "domain string")
    r = spark.createDataFrame([("regex", p, 4) for p in (r"^ads[0-9]+\.", r"(.)\1\.q$", "io$")] + [("glob", g, 2) for g in ("b*.x.net", "*z.q", "m.*")], "kind string, value string, flags int")
    want = [{"ads1.x.net", "aa.q", "zz.q", "m.io"}, {"b.x.net", "zz.q", "m.io"}]
    for most in (20_000, 0):
        monkeypatch.setattr(match, "LITERAL", most)
        assert [{x.domain for x in f(d, r).collect()} for f in (match.regex_hits, match.glob_hits)] == want


def test_outputs(spark, tmp_path):
    opt = rules.classify_rules(parsed(spark))
    lines = [r.line for r in rules.network_list(opt, "adguard").collect()]
    assert "||tracker.net^" in lines and "@@||trusted.example.org^" in lines and r"/^ads[0-9]+\.tracker\./" in lines
    plain = [r.line for r in rules.network_list(opt, "unbound").collect()]
    assert plain == sorted(plain) and 'local-zone: "one.example." always_nxdomain' in plain
    lists.write_lines(rules.network_list(opt, "hosts"), str(tmp_path / "out"), single_file=True)
    back = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert "0.0.0.0 one.example" in back
    lists.write_browser_rules(parsed(spark), str(tmp_path / "browser"))
    assert [r.value for r in spark.read.text(str(tmp_path / "browser")).collect()] == ["site.example##.ad"]


def test_read_lists(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one.example\n\xff.example\n")
    (tmp_path / "b.txt").write_text("two.example\n")
    got = lists.read_lists(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")]).orderBy("load_order", "line_no").collect()
    assert [(r.load_order, r.line_no, r.line) for r in got] == [(0, 1, "one.example"), (0, 2, "�.example"), (1, 1, "two.example")]
    assert lists.read_nrd(spark, "").count() == 0


def test_globs(spark):
    d = spark.createDataFrame([(x,) for x in ("ads1.tracker.net", "x.ads1.tracker.net", "tracker.net", "a.b.deep.org", "deep.org")], "domain string")
    g = spark.createDataFrame([("glob", "ads*.tracker.net", 0), ("glob", "*.de*p.org", 0), ("glob", "t*.net", 1)], "kind string, value string, flags int")
    assert {r.domain for r in match.glob_hits(d, g).collect()} == {"ads1.tracker.net", "a.b.deep.org"}


def test_frames(spark):
    event = bytes([1]) + (1700000000).to_bytes(8, "little") + (2**63 + 5).to_bytes(8, "little") + bytes(10) + b"\xff\xff" + bytes([10, 0, 0, 7]) + bytes([2]) + (0x8003).to_bytes(2, "little")
    name = bytes([0]) + (2**63 + 5).to_bytes(8, "little") + (11).to_bytes(2, "little") + b"example.com"
    frame = lambda b: bytearray(len(b).to_bytes(2, "little") + b)
    short = frame(event[:30])
    d = spark.createDataFrame([(frame(event),), (frame(name),), (short,), (bytearray(b"\x01"),), (None,)], "frame binary")
    maps, events, bad = decode_frames(d)
    assert maps.first().domain == "example.com" and len(frame(name)) == 24 and len(frame(event)) == 38
    e = events.first()
    assert (e.client_ip, e.action, e.flags, e.domain_hash) == ("10.0.0.7", "Blocked", 3, 5 - 2**63) and e.domain_hash == maps.first().domain_hash
    assert events.count() == 1 and maps.count() == 1 and bad.count() == 3


def test_domain_map(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "domain_hash long, domain string")
    new = spark.createDataFrame([(2, "c")], "domain_hash long, domain string")
    assert {tuple(r) for r in dimensions.merge_domain_map(old, new).collect()} == {(1, "a"), (2, "c")}
    assert dimensions.domain_map(spark.createDataFrame([("x",), ("x",)], "domain string")).select(F.count("*")).first()[0] == 1


def test_malformed_patterns_are_rejected(spark):
    bad = [("b3", "black", 5, 1, "/(unclosed/"), ("b3", "black", 5, 2, r"/^(a|b)x\1\.org$/"), ("b3", "black", 5, 3, r"/^\Qq.org/"), ("b3", "black", 5, 4, r"/(?<n>z)\.com$/"), ("b3", "black", 5, 5, r"/(?<n>y)\.com$/")]
    p = parsed(spark, ROWS + bad)
    assert {r.value for r in p.filter("source = 'b3' and kind = 'rejected'").collect()} == {"/(unclosed/"}
    d = spark.createDataFrame([(x,) for x in ("ads1.tracker.com", "axa.org", "axb.org", "q.org", "z.com", "y.com", "one.example")], "domain string")
    compiled = rules.consolidate_exact(p).unionByName(p.filter("kind in ('suffix', 'glob', 'regex')"))
    got = {r.domain: (r.regex_blocked, r.static_blocked) for r in match.matches(d, compiled).collect()}
    assert {k for k, v in got.items() if v[0]} == {"ads1.tracker.com", "axa.org", "q.org", "z.com", "y.com"} and got["one.example"][1]
