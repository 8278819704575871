"""Whole results against plain Python: the pipeline stage by stage, scores of the line field, the token files' layout."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from dnsloom.llm import jaccard, quality, tokens
from dnsloom.llm.decontam import words_of

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def passage(n, seed):
    r = np.random.default_rng(seed)
    return " ".join("".join(r.choice(list("abcdefghij"), 6)) for _ in range(n))


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """The smallest tables, with nulls, empties, repeats, null ids and near copies on top."""
    folder = tmp_path_factory.mktemp("small")
    base = passage(120, 3)
    near = base.split()
    near[60] = "other"
    rows = [(9001, None), (9002, ""), (9003, " \n "), (9004, base), (9004, base), (9005, " ".join(near)), (None, base), (None, passage(50, 4)), (None, passage(50, 4)), (9007, passage(3000, 5)), (9008, "é" * 40)]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    more = spark.createDataFrame([(i, t, "en", None if i == 9004 else "s", 0) for i, t in rows], DOCS)
    docs.unionByName(more).withColumn("extra", F.lit(1)).write.parquet(f"{folder}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{folder}/{t}.parquet")
    return str(folder)


def one_of_each(docs, n=5):
    sets = []
    for r in docs:
        w = (r.text or "").lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 5 * len(x & sets[j]) >= 4 * len(x | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i, r in enumerate(docs):
        groups.setdefault((find(i), None) if sets[i] else (i, "bare"), []).append(r)
    return [min(g, key=lambda r: (r.doc_id is None, r.doc_id or 0)) for g in groups.values()]


def clean(docs, items):
    windows = set()
    for t in items:
        w = words_of((t or "").encode())
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} if w else set()
    sizes = {len(w) for w in windows}
    kept = []
    for r in docs:
        w = words_of((r.text or "").encode())
        hit = {j for n in sizes for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for j in range(i, i + n)}
        if not hit or 20 * len(hit) < len(w):
            kept.append(r)
    return kept


def mixed(docs):
    size = {id(r): len((r.text or "").encode().split()) for r in docs}
    names = sorted({r.source for r in docs}, key=lambda s: (s is None, s or ""))
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(names)}
    total = {s: sum(size[id(r)] for r in docs if r.source == s) for s in names}
    whole, full = 1.5 * sum(total.values()), set()
    while True:
        rest = [s for s in names if s not in full]
        level = (whole - sum(2.0 * total[s] for s in full)) / sum(weight[s] for s in rest) if rest else 0
        more = {s for s in rest if 2.0 * total[s] / weight[s] <= level}
        if not more:
            break
        full |= more
    out = []
    for s in names:
        target = 2.0 * total[s] if s in full else level * weight[s]
        rate = target / total[s] if total[s] else 0.0
        u = int(hashlib.md5(((s or "") + "#offset").encode()).hexdigest()[:8], 16) / 4294967296.0
        h = lambda r: hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()
        mine = sorted((r for r in docs if r.source == s), key=lambda r: (size[id(r)], h(r), r.doc_id if r.doc_id is not None else -1))
        for k, r in enumerate(mine, 1):
            out += [r] * (math.floor(rate * k + u) - math.floor(rate * (k - 1) + u))
    return out


def test_pipeline_against_brute_force(spark, small):
    from tokenizers import Tokenizer

    rows = lambda df: df.select(*cp.DOCUMENT).collect()
    plain = lambda docs: Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    scores = Counter()
    field = quality.fit(docs, spark.read.parquet(f"{small}/labels.parquet"))
    good = quality.score(docs.withColumn("row", F.monotonically_increasing_id()), field, id_col="row").filter("score >= 0.7")
    want = rows(docs.withColumn("row", F.monotonically_increasing_id()).join(good, "row"))
    assert 20 < len(want) < docs.count() and not scores
    seen = docs.select(*cp.DOCUMENT)
    items = [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    for (name, stage), brute in zip(cp.STAGES[:-1], (None, one_of_each, lambda d: clean(d, items), mixed), strict=True):
        want = brute(want) if brute else want
        seen = stage(spark, seen, small)
        assert seen.columns == list(cp.DOCUMENT), name
        assert plain(rows(seen)) == plain(want), name
    tok = Tokenizer.from_file(tokens.default_tokenizer())
    start, expected = 0, []
    for r in sorted(want, key=lambda r: (r.doc_id is not None, r.doc_id or 0, (r.text or "").encode())):
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        expected.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = cp.run(spark, small).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert Counter(tuple(r) for r in got) == Counter(expected)


def test_stages_on_empty_and_clashing_tables(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumn("size", F.lit("mine")).withColumn("id", F.lit(7)).withColumn("key", F.lit("k"))
    for name, stage in cp.STAGES[:-1]:
        assert stage(spark, docs.limit(0), small).count() == 0, name
        out = stage(spark, docs, small)
        assert out.columns == docs.columns and {(r["size"], r.id, r.key) for r in out.select("size", "id", "key").collect()} == {("mine", 7, "k")}, name


def test_one_row_of_equal_ids_stays(spark):
    a, b = passage(60, 8), passage(60, 9)
    d = spark.createDataFrame([(1, a), (1, a), (1, b), (2, b), (None, a), (3, None), (3, None)], "doc_id long, text string")
    got = Counter((r.doc_id, r.text) for r in jaccard.keep_one(d).collect())
    assert got == Counter([(1, a), (1, b), (3, None), (3, None)])


def test_scores_against_enumeration(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    field = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    got, seen = {r.doc_id: r.score for r in quality.score(docs, field).collect()}, 0
    for r in docs.filter("text is not null").collect():
        raw = np.frombuffer(r.text.encode(), np.uint8)
        x, n, first = quality.line_features(raw, np.array([0, len(raw)]))
        if len(x) > 9:
            continue
        unary = quality.with_neighbours(x, first) / field.spread @ field.weights
        weight = {s: np.exp(sum(u for u, y in zip(unary, s) if y) + sum(field.chain[p, q] for p, q in zip(s, s[1:]))) for s in np.ndindex(*[2] * len(x))}
        total = sum(weight.values())
        good = [sum(w for s, w in weight.items() if s[i]) / total for i in range(len(x))]
        assert got[r.doc_id] == pytest.approx(float(np.average(good, weights=n)), abs=1e-9)
        seen += 1
    assert seen > 20


def test_layout_of_token_files(spark, small, tmp_path):
    import pyarrow.parquet as pq

    docs = spark.read.parquet(f"{small}/documents.parquet")
    path = tokens.write_token_ids(docs, str(tmp_path / "t"), file_bytes=50_000)
    files = sorted((tmp_path / "t" / "rows").glob("*.parquet"))
    bounds = []
    for f in files:
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            cols = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            assert "DELTA_BINARY_PACKED" in cols["doc_id"].encodings and "RLE_DICTIONARY" in cols["ids.list.element"].encodings
            assert cols["doc_id"].has_column_index and cols["doc_id"].has_offset_index and cols["ids.list.element"].has_offset_index
            stats = cols["doc_id"].statistics
            if stats.has_min_max:
                bounds.append((stats.min, stats.max))
    assert len(files) >= 12 and all(a[1] <= b[0] for a, b in zip(sorted(bounds), sorted(bounds)[1:]))
    plan = tokens.read_token_ids(spark, path, ("doc_id", "n_tokens")).filter("doc_id = 5")._jdf.queryExecution().toString()
    assert "ids" not in plan.split("ReadSchema")[1].split("\n")[0] and "EqualTo(doc_id,5)" in plan
    back = {(r.doc_id, r.n_tokens, r.ids_crc32) for r in tokens.digest(spark, path).filter("doc_id is not null").collect()}
    rows = tokens.read_token_ids(spark, path).filter("doc_id is not null").collect()
    assert back == {(r.doc_id, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in rows}


def test_suffix_query_against_brute_force_at_200_bytes(spark):
    """The registered query on the smallest tables, whole texts, at its production length."""
    import hashlib
    from collections import Counter

    import xxhash

    from dnsloom.llm import suffixdedup

    length, where = 200, "/root/testdata/sf0.001"
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{where}/documents.parquet").select("doc_id", "text").collect()}
    windows = {i: [xxhash.xxh3_128_intdigest(t[a : a + length]) for a in range(len(t) - length + 1)] for i, t in docs.items()}
    seen = Counter(h for w in windows.values() for h in w)
    want = set()
    for i, text in docs.items():
        gone = bytearray(len(text))
        for a, h in enumerate(windows[i]):
            if seen[h] > 1:
                gone[a : a + length] = b"\1" * length
        kept = bytes(c for c, g in zip(text, gone, strict=True) if not g)
        spans = sum(1 for a in range(len(gone)) if gone[a] and (a == 0 or not gone[a - 1]))
        want.add((i, len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    got = [tuple(r) for r in suffixdedup.op3_suffix_dedup(spark, where).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert len(got) == len(docs) and set(got) == want
    assert sum(r[2] for r in got) > 0
