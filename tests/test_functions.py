"""Names, signs of generated names, addresses, labels."""

import pytest
from pyspark.sql import functions as F

from dnsloom.config import EngineConfig
from dnsloom.functions import labels, lexical, names, network

CFG = EngineConfig()


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize("s, want", [("google", 1.918296), ("facebook", 2.75), ("", 0.0), ("aaaa", 0.0), ("a1b2c3d4e5f6g7h8", 4.0), ("a1b2c3d4e5f6g7h8i9j0", 4.321928)])
def test_entropy(spark, s, want):
    assert one(spark, s, lexical.entropy_fast) == pytest.approx(want, abs=1e-6)


def test_entropy_of_sixteen_letters_is_not_above_four(spark):
    assert one(spark, "abcdefghijklmnop.com", lambda c: lexical.dga_reason(c, CFG)) != "HIGH_ENTROPY"


@pytest.mark.parametrize("s, ratio, run", [("google", 0.5, 2), ("strngth", 1.0, 7), ("aeiou", 0.0, 0), ("1234", 0.0, 0), ("xyz", 1.0, 3)])
def test_consonants(spark, s, ratio, run):
    assert one(spark, s, lexical.consonant_ratio) == pytest.approx(ratio)
    assert one(spark, s, lexical.max_consonant_run) == run


def test_ancestors_and_second_level(spark):
    assert one(spark, "deep.sub.example.com", names.ancestors) == ["sub.example.com", "example.com", "com"]
    assert one(spark, "com", names.ancestors) == []
    assert one(spark, "com", names.sld) is None
    assert one(spark, "a.b.co.uk", names.sld) == "co"
    assert one(spark, "WWW.Example.COM..", names.normalize_domain) == "www.example.com"


@pytest.mark.parametrize("n, bad", [(128, False), (129, True)])
def test_structure_by_bytes(spark, n, bad):
    assert one(spark, "a" * n, lambda c: names.structure_invalid(c, CFG)) is bad


def test_structure_by_dots(spark):
    assert [one(spark, ".".join("a" * n), lambda c: names.structure_invalid(c, CFG)) for n in (5, 6, 7)] == [False, False, True]


@pytest.mark.parametrize("d, hit", [("play-casino.x.biz", "casino"), ("www.casino.xyz", "casino"), ("www.casino.com", None), ("casinon-les-bains.biz", None), ("mycasinoapp.biz", None), ("bet-casino.biz", "bet")])
def test_keywords(spark, d, hit):
    assert one(spark, d, lambda c: lexical.banned_keyword(c, CFG)) == hit


@pytest.mark.parametrize("ip, private", [("10.1.2.3", True), ("172.31.0.1", True), ("172.32.0.1", False), ("100.64.0.1", True), ("100.128.0.1", False), ("8.8.8.8", False), ("::1", True), ("fd00::1", True), ("febf::1", True), ("2606:4700::1111", False), (None, False), ("junk", False)])
def test_private(spark, ip, private):
    assert one(spark, ip, network.is_private_ip) is private


def test_ipv6_text(spark):
    assert one(spark, "2001:db8::cafe", network.ipv6_hex) == "20010db800000000000000000000cafe"
    assert one(spark, "::", network.ipv6_hex) == "0" * 32


def test_labels(spark):
    row = spark.createDataFrame([("Blocked", 3), ("HighlySuspicious", 0), ("Allowed", None)], "a string, f int")
    got = [r[0] for r in row.select(labels.flags_label(F.col("a"), F.col("f"))).collect()]
    assert got == ["Blocked:Blacklist+AbpRule", "HighlySusp", "Allowed"]


def test_ngrams(spark):
    corpus = spark.createDataFrame([("abab aba", "x"), (None, "x"), ("", "y")], "text string, lang string")
    model = lexical.ngram_train(corpus)
    assert {(r.gram, round(r.logp, 4)) for r in model.collect()} == {("ab", 0.0), ("ba", 0.0)}
    d = spark.createDataFrame([("ab1ba",), ("zz",), ("1",)], "name string")
    assert {r.name: r.score for r in lexical.ngram_score(d, model).collect()} == {"ab1ba": 0.0, "zz": -6.5}
