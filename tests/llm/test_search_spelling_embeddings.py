"""Lexical search, spelling variants and embedding near-dedup against plain Python; scratch folders."""

import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from dnsloom.llm import common, embdedup, lexsearch, spelling

rng = random.Random(11)
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
VOCAB = ["de", "la", "Ärger", "straße", "x1", "ナ", "alpha", "beta", "gamma", "ÉCOLE", "10", "b c"]
DOCS = [None, "", "  \n", "de de DE", "la", "la", "x1-x1_x1", "Ärger ärger ÄRGER", "b c,ナ", *[" ".join(rng.choice(VOCAB) for _ in range(n)) for n in (3, 9, 30, 30, 200)], "gamma " * 50_000 + "beta"]
ITEMS = [(1, "de LA, la!"), (2, None), (3, ""), (4, "unknown words only"), (5, "Straße école ÉCOLE 10 gamma"), (5, "beta"), (None, "ナ b c"), (7, " ".join(VOCAB))]
DOC = "doc_id long, text string, id string, row string, score long"
ITEM = "item_id long, text string, terms string, rank int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 4 else None, t, "x", "y", 1) for i, t in enumerate(DOCS)]
    return spark.createDataFrame([*rows, rows[10]], DOC).repartition(3)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(i, t, "x", 9) for i, t in ITEMS], ITEM)


def ranked(docs, items, limit):
    held = [(r.doc_id, Counter(TERM.findall(r.text.translate(AZ)))) for r in docs.collect() if r.text]
    held = [(i, c) for i, c in held if c]
    whole, words = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = Counter()
    for r in items.collect():
        terms = set(TERM.findall((r.text or "").translate(AZ)))
        scored = []
        for i, c in held:
            m = 100 - 50 + (50 * sum(c.values()) * whole) // words
            s = sum(math.floor(1000 * math.log((2 * whole + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if s > 0:
                scored.append((-s, i is None, i))
        for k, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:limit]):
            out[r.item_id, k + 1, i, -s] += 1
    return out


@pytest.mark.parametrize("block_bytes", [None, 20])
def test_search_against_plain_ranking(docs, items, block_bytes, monkeypatch):
    monkeypatch.setattr(lexsearch, "CHUNK", 4)
    monkeypatch.setattr(lexsearch, "MERGED", 5)
    for limit in (3, 50):
        got = Counter(map(tuple, lexsearch.search(docs, items, limit, block_bytes=block_bytes).select("item_id", "rank", "doc_id", "score").collect()))
        assert got == ranked(docs, items, limit)


def test_search_of_empty_tables(docs, items):
    assert lexsearch.search(docs.limit(0), items).count() == 0
    assert lexsearch.search(docs, items.limit(0)).count() == 0
    assert lexsearch.search(docs, items.filter("text is null")).count() == 0


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(rows, least, often, ratio, every):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(AZ)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run
            counts[word] += len(word) >= least
    counts = {w: n for w, n in counts.items() if n >= often}
    by = {w: [] for w in counts}
    for a, b in combinations(counts, 2):
        if near(a, b):
            by[a].append(b)
            by[b].append(a)
    form = {}
    for w, others in by.items():
        best = min(others, key=lambda o: (-counts[o], o.encode()), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = Counter()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out[w, form[w], root, n, len(by[w]), counts[form[w]] if form[w] else None] += 1
    return out


@pytest.fixture(scope="module")
def texts(spark):
    base = ["señorita", "straßen", "abcdef", "aaaaaa", "ÀBCDEFG", "looooong", "w" * 70]
    letters = "abéz"

    def typo(w):
        k, i = rng.randrange(3), rng.randrange(len(w))
        return w[:i] + rng.choice(letters) + w[i + (k == 0) :] if k < 2 else w[:i] + w[i + 1 :]

    rows = []
    for i in range(60):
        words = [rng.choice(base) for _ in range(30)] + [typo(rng.choice(base)) for _ in range(6)] + [typo(typo(rng.choice(base)))]
        rows.append((i if i % 9 else None, rng.choice([" ", "-", "\n"]).join(words).replace("abc", rng.choice(["abc", "ABC"])), 0, "x"))
    rows += [(None, None, 0, "x"), (61, "", 0, "x"), (62, " 12 ", 0, "x"), (63, "abcdef " * 200 + "abcdeg " * 30 + "abcdfg " * 5, 0, "x"), rows[3]]
    return spark.createDataFrame(rows, "doc_id long, text string, n long, word string").repartition(4)


@pytest.mark.parametrize("few", [False, True])
def test_variants_against_all_pairs(spark, texts, few, monkeypatch):
    if few:  # several parts of each filter, several passes, partial counts, long texts by pieces
        for name, value in (("PART_WORDS", 2), ("SENT", 16), ("CELLS", 20), ("LONG", 100)):
            monkeypatch.setattr(spelling, name, value)
    for least, often, every in ((6, 5, 199), (5, 1, 2)):
        if few and least == 5:
            continue
        with common.scratch(spark):
            got = Counter(map(tuple, spelling.group_variants(texts, least=least, often=often, every=every).select("word", "form", "root", "n", "n_near", "form_n").collect()))
        assert got == variants([(r.doc_id, r.text) for r in texts.collect()], least, often, 5, every)
    assert spelling.group_variants(texts.limit(0)).count() == 0


def test_filters_admit_their_keys_and_few_others():
    key = common.mix64(np.arange(20_000, dtype=np.uint64))
    blocks = spelling.bloom(key[:10_000])
    assert spelling.admits(blocks, key[:10_000]).all() and spelling.admits(blocks, key[10_000:]).mean() < 0.03


def grouped(rows, threshold):
    good = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i in range(len(rows))}
    units = {i: np.array(rows[i][1]) / max(map(abs, rows[i][1])) for i in good}
    for a, b in combinations(good, 2):
        x, y = units[a], units[b]
        if len(x) == len(y) and x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= threshold:
            links[a].add(b)
            links[b].add(a)
    out = Counter()
    for i, (vec_id, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        low = min(ids) if ids else None
        out[vec_id, len(links[i]), low, vec_id == low] += 1
    return out


@pytest.mark.parametrize("kind", ["float", "double"])
def test_embeddings_against_all_pairs(spark, kind):
    r = np.random.default_rng(3)
    f = lambda v: [float(np.float32(x)) for x in v]
    centre = r.normal(size=40)
    rows = [(i, f(r.normal(size=40))) for i in range(60)]
    rows += [(100 + i, f(centre + 0.14 * r.normal(size=40))) for i in range(120)]  # cosines on both sides of the threshold
    rows += [(300 + i, f(r.normal(size=5) * [3, 1, 0.2, 0.1, 0.1])) for i in range(60)]
    rows += [(400, rows[0][1]), (401, rows[0][1]), (401, rows[1][1]), (3, f(r.normal(size=40))), (None, rows[2][1]), (None, f(r.normal(size=40))), (402, [x * 1e-30 for x in rows[4][1]])]
    rows += [(500, None), (501, []), (502, [0.0] * 40), (503, [None] + [1.0] * 39), (504, [float("nan")] * 40), (505, [float("inf")] + [1.0] * 39), (506, [1.0]), (507, [2.0]), (508, [-1.0])]
    t = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, n long, v string")
    rows = [(x.vec_id, x.embedding) for x in t.collect()]
    with common.scratch(spark):
        got = Counter(map(tuple, embdedup.near_groups(t, block=16).select("vec_id", "n_links", "component_id", "kept").collect()))
        assert got == grouped(rows, 0.95)
    assert embdedup.near_groups(t.limit(0)).count() == 0
    nothing = embdedup.near_groups(t.filter("vec_id in (500, 501)")).collect()
    assert sorted((x.vec_id, x.n_links, x.component_id, x.kept) for x in nothing) == [(500, 0, 500, True), (501, 0, 501, True)]


def test_long_vectors_are_rotated_by_slices(spark):
    r = np.random.default_rng(4)
    base = r.normal(size=(12, 600))
    rows = [(i, (base[i % 12] + 0.2 * r.normal(size=600)).tolist()) for i in range(40)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    with common.scratch(spark):
        assert Counter(map(tuple, embdedup.near_groups(t).collect())) == grouped(rows, 0.95)


def test_a_pair_at_the_threshold_is_judged_in_doubles():
    turn = embdedup.Rotation([np.eye(2)])
    c = 0.95
    x = np.array([[1.0, 0.0]])
    y = np.array([[c + 1e-12, math.sqrt(1 - (c + 1e-12) ** 2)], [c - 1e-12, math.sqrt(1 - (c - 1e-12) ** 2)]])
    block = lambda v: embdedup.Block(np.arange(len(v)).tobytes(), np.ones(len(v), np.int64).tobytes(), v.tobytes(), "float64", turn)
    pairs = [(a, b) for r, s in embdedup.linked(block(x), block(y), c, False) for a, b in zip(r.tolist(), s.tolist(), strict=True)]
    assert pairs == [(0, 0)]


def test_two_interleaved_scratches_keep_their_tables(spark):
    a = common.scratch(spark)
    a.__enter__()
    first = common.settle(spark.range(5), "t")
    from contextvars import copy_context

    other = copy_context()
    b = other.run(common.scratch, spark)
    other.run(b.__enter__)
    second = other.run(common.settle, spark.range(7), "t")
    mine = common.settle(spark.range(9), "t")  # the first goes on while the second is open
    other.run(b.__exit__, None, None, None)
    assert first.count() == 5 and mine.count() == 9
    with pytest.raises(Exception):
        second.count()
    a.__exit__(None, None, None)


def test_results_alone_outlive_a_query(spark):
    from pathlib import Path

    from dnsloom.llm import queries

    folders = lambda: {p.name for p in Path(common.shared_dir(spark)).iterdir() if p.is_dir()}
    for name in ("op1_nearest_neighbours", "op4_secrets", "op5_mixing", "op7_decontamination", "op11_lexical_search", "op12_spelling_variants", "op13_embedding_dedup"):
        before = folders()
        assert queries.queries()[name](spark, "/root/testdata/sf0.001").count()
        left = folders() - before
        assert len(left) == 1 and not left.pop().startswith("work-"), name


def test_unused_columns_do_not_clash(spark):
    t = spark.createDataFrame([(0, [1.0, 2.0], 5)], "vec_id long, embedding array<double>, component_id long")
    assert embdedup.near_groups(t).select(F.sum("n_links")).first()[0] == 0
