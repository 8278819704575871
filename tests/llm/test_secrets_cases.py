"""Secrets: every rule, ties, repeats, long texts and clashing names against Python's regexes."""

import re

import pytest

from dnsloom.llm import secrets

PY = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
]
TEXTS = [
    None, "", "nothing here", "ñé Token = 'abcdefABCDEF1234' and token:short", "AKIA" + "Q" * 14 + " AKIA" + "Q" * 13,
    "-----BEGIN RSA PRIVATE KEY-----\nx\n-----BEGIN PRIVATE KEY----------BEGIN  KEY-----",
    "ghp_" + "a1B2" * 9 + " ghx_" + "a" * 40 + " gho_" + "0" * 35 + " ghs_" + "f" * 40,
    "api_key=" + "0123456789abcdef" * 2,  # two rules overlap
    "secret=AKIA" + "ABCDEFGHIJKLMNOP" + "\n" + "deadbeefdeadbeef", "words " * 200_000 + "passwd: correcthorsebattery" + " ghp_" + "Z" * 36,
]


def spans(text):
    found = []
    for k, (kind, pattern, group, least) in enumerate(PY):
        found += [(m.start(), k, m.end(), kind) for m in re.finditer(pattern, text or "") if len(m.group(group)) >= least]
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found))


@pytest.mark.parametrize("names", ["doc_id long, text string", "doc_id long, text string, tid string, kinds int, id string, gram int"])
def test_every_rule_against_plain_search(spark, names):
    wide = names.count(",") > 1
    rows = [(i, t, *(("x", 1, "y", 2) if wide else ())) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame([*rows, rows[6], rows[6]], names)
    got = sorted((r.doc_id, r.spans) for r in secrets.find_secrets(docs).select("doc_id", secrets.written(secrets.RULES, [r.kind for r in secrets.RULES]).alias("spans")).collect())
    assert got == sorted((i, spans(TEXTS[i])) for i in [*range(len(TEXTS)), 6, 6])
