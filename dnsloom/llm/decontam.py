"""Benchmark decontamination with suffix arrays over the training text.

Every portion of documents is a shard. Its words become ids of the benchmark's
vocabulary (0: a word that no item has), and its suffixes, cut to the window
length, are sorted into a suffix array; suffixes whose first words no benchmark
window begins with are left out, as no search can end at them. Every benchmark
suffix is then looked up by binary search in every shard, which gives its
verbatim occurrences; matches on one diagonal join into the longest ones.

The benchmark side is sent to the tasks in blocks of at most ``BLOCK_WORDS``
words; long items are cut into pieces that overlap by a window less one word.
A larger benchmark takes several passes over the documents, each with one
block, whose narrow finds are joined per document; nothing of it is left out.

Null or empty text: no words, never contaminated. Null or empty items have no
windows; the windows of an item without an id hit words but name no item.
Repeated rows and ids are judged one by one. A very long text is one shard.
Empty tables give empty results. Extra columns pass through ``decontaminate``
untouched, whatever their names (but ``_dc_row``, which it uses itself);
``scan`` returns the id and its own columns.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dnsloom.llm.common import flat_bytes, portions, scratch, settle

#: Words of the benchmark that one pass holds at most (21 bits name each of them), and words of a piece of an item.
BLOCK_WORDS, PIECE_WORDS = 1_000_000, 20_000
#: Bytes of a shard.
SHARD = 2 << 20
FOUND = "n_words long, n_hit long, items array<string>, matches array<struct<item_id: string, start: int, item_start: int, n_words: int>>"
_FOUND = [
    ("n_words", pa.int64()),
    ("n_hit", pa.int64()),
    ("items", pa.list_(pa.string())),
    ("matches", pa.list_(pa.struct([("item_id", pa.string()), ("start", pa.int32()), ("item_start", pa.int32()), ("n_words", pa.int32())]))),
]
#: Lower-cases A-Z; every other ASCII byte but letters and digits parts words.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def _pack(ids: np.ndarray) -> np.ndarray:
    """Rows of word ids as byte strings that sort like the rows: three words of 21 bits in each 8 bytes."""
    n, k = ids.shape
    wide = np.zeros((n, -(-k // 3) * 3), np.uint64)
    wide[:, :k] = ids
    packed = (wide[:, 0::3] << np.uint64(42)) | (wide[:, 1::3] << np.uint64(21)) | wide[:, 2::3]
    return np.ascontiguousarray(packed.astype(">u8")).view(f"S{packed.shape[1] * 8}").ravel()


class TestSuffixes:
    """The benchmark's suffixes that begin a window, ready for look-up. ``items``: (id, words, number of words before them in the item)."""

    def __init__(self, items: list[tuple[str | None, list[bytes], int]], window: int):
        self.window, self.vocab = window, {}
        number = self.vocab.setdefault
        rows, item, at, size = [], [], [], []
        known: dict[str | None, int] = {}
        for name, words, before in items:
            ids = [number(w, len(self.vocab) + 1) for w in words]
            if not ids:
                continue
            k = known.setdefault(name, len(known))
            n = min(window, len(ids))
            for j in range(len(ids) - n + 1):
                rows.append(ids[j : j + n] + [0] * (window - n))
                item.append(k)
                at.append(before + j)
                size.append(n)
        self.names = list(known)
        if len(self.vocab) >= 1 << 21:
            raise ValueError("a block of the benchmark has more words than 21 bits can name")
        grid = np.array(rows, np.int64).reshape(-1, window)
        self.item, self.at, self.size = (np.array(x, np.int64) for x in (item, at, size))
        self.low = _pack(grid)
        top = grid.copy()
        top[np.arange(window)[None, :] >= self.size[:, None]] = (1 << 21) - 1
        self.high = _pack(top)
        self.begins = np.zeros(1 << 22, bool)  # hashed first two words; one for items of a single word
        self.single = np.zeros(len(self.vocab) + 1, bool)
        if len(grid):
            second = grid[:, 1] if window > 1 else np.zeros(len(grid), np.int64)
            self.single[grid[self.size == 1, 0]] = True
            self.begins[self._two(grid[:, 0], second)[self.size > 1]] = True

    @staticmethod
    def _two(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * 40_503 + b * 2_654_435) & ((1 << 22) - 1)

    def occurrences(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(test suffix, position in ``ids``) of every verbatim occurrence. ``ids`` holds 0 between documents and after the last."""
        none = np.zeros(0, np.int64)
        if not len(self.low) or len(ids) < 2:
            return none, none
        first, second = ids[:-1].astype(np.int64), ids[1:].astype(np.int64)
        keep = self.begins[self._two(first, second)] & (second > 0) | self.single[first]
        starts = np.flatnonzero(keep & (first > 0))
        if not len(starts):
            return none, none
        padded = np.concatenate([ids, np.zeros(self.window, ids.dtype)])
        rows = padded[starts[:, None] + np.arange(self.window)[None, :]].astype(np.int64)
        rows[np.logical_or.accumulate(rows == 0, axis=1)] = 0
        keys = _pack(rows)
        suffix_array = np.argsort(keys, kind="stable")
        ordered = keys[suffix_array]
        lo, hi = np.searchsorted(ordered, self.low, "left"), np.searchsorted(ordered, self.high, "right")
        n = hi - lo
        test = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(test)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        return test, starts[suffix_array[place]]

    def longest(self, test: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences on one diagonal of one item, joined: item, first position, position in the item, words."""
        item, diagonal = self.item[test], pos - self.at[test]
        order = np.lexsort((pos, diagonal, item))
        item, diagonal, pos, size = item[order], diagonal[order], pos[order], self.size[test][order]
        new = np.ones(len(pos), bool)
        new[1:] = (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (pos[1:] != pos[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(pos)]]) - 1 if len(first) else first
        return item[first], pos[first], pos[first] - diagonal[first], pos[last] + size[last] - pos[first]


def _shards(tests: TestSuffixes, texts: pa.Array):
    """For each shard of ``texts``: its row range and per row n_words, n_hit, items, matches."""
    raw, at = flat_bytes(texts)
    data, get = raw.tobytes(), tests.vocab.get
    for a, b in portions(np.diff(at), SHARD):
        parts, sizes = [], []
        for i in range(a, b):
            w = words_of(data[at[i] : at[i + 1]])
            parts.append(np.fromiter(map(get, w, repeat(0)), np.int32, len(w)))
            parts.append(np.zeros(1, np.int32))
            sizes.append(len(w))
        ids = np.concatenate(parts)
        begin = np.concatenate([[0], np.cumsum(np.array(sizes) + 1)])
        test, pos = tests.occurrences(ids)
        cover = np.zeros(len(ids) + 1, np.int32)
        np.add.at(cover, pos, 1)
        np.add.at(cover, pos + tests.size[test], -1)
        hit = np.add.reduceat(np.cumsum(cover)[:-1] > 0, begin[:-1], dtype=np.int64)
        items, matches = [[] for _ in sizes], [[] for _ in sizes]
        if len(pos):
            for k, p, j, n in zip(*(x.tolist() for x in tests.longest(test, pos)), strict=True):
                row = int(np.searchsorted(begin, p, "right")) - 1
                matches[row].append({"item_id": tests.names[k], "start": p - int(begin[row]), "item_start": j, "n_words": n})
            items = [_named(found) for found in matches]
        yield a, b, sizes, hit.tolist(), items, matches


def _named(matches: list[dict]) -> list[str]:
    return sorted({m["item_id"] for m in matches if m["item_id"] is not None})


def _joined(matches: list[dict], window: int) -> list[dict]:
    """Matches of several blocks; those on one diagonal of one item that go on from each other become one."""
    out: list[dict] = []
    for m in sorted(matches, key=lambda m: (m["item_id"] is None, m["item_id"] or "", m["start"] - m["item_start"], m["start"])):
        last = out[-1] if out else None
        same = last and last["item_id"] == m["item_id"] and last["start"] - last["item_start"] == m["start"] - m["item_start"]
        if same and m["start"] <= last["start"] + last["n_words"] - window + 1:
            last["n_words"] = max(last["n_words"], m["start"] + m["n_words"] - last["start"])
        else:
            out.append(dict(m))
    return sorted(out, key=lambda m: (m["start"], m["item_id"] or ""))


def _pieces(window: int):
    step = max(1, PIECE_WORDS - window + 1)

    def run(batches):
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text.encode())
                cuts = range(0, max(1, len(words) - window + 1), step)
                cut = [words[a : a + PIECE_WORDS] for a in cuts]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(cut), pa.string()), pa.array([b" ".join(c) for c in cut], pa.binary()), pa.array(list(cuts), pa.int64()), pa.array([len(c) for c in cut], pa.int64())], ["item_id", "words", "before", "n"])

    return run


def _blocks(benchmark: DataFrame, window: int, id_col: str, text_col: str):
    """The benchmark's items in blocks of at most BLOCK_WORDS words (or one piece), one in memory at a time: (last one, items)."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).cast("string").alias("text")).filter("text is not null").distinct()
    cut = items.mapInArrow(_pieces(window), "item_id string, words binary, before long, n long").filter("n > 0")
    total = cut.agg(F.sum("n")).first()[0] or 0
    if total > BLOCK_WORDS:
        cut = settle(cut, "pieces")
    n = 1
    block = lambda: F.pmod(F.xxhash64("words", "before", "item_id"), F.lit(n))
    while total > BLOCK_WORDS:
        fullest = cut.groupBy(block().alias("b")).agg(F.sum("n").alias("words"), F.count(F.lit(1)).alias("pieces")).filter("pieces > 1").agg(F.max("words")).first()[0] or 0
        if n > 1 and fullest <= BLOCK_WORDS:
            break
        n *= 2
    for k in range(n):
        yield k == n - 1, [(r[0], bytes(r[1]).split(), r[2]) for r in (cut if n == 1 else cut.filter(block() == k)).collect()]


def scan(docs: DataFrame, benchmark: DataFrame, *, window: int = 13, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document: its id, n_words, n_hit (words inside occurrences), items (sorted), matches (longest verbatim, with word positions in the text and the item).

    Item ids that occur several times count once.
    """
    sc = docs.sparkSession.sparkContext
    table = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = table.schema["id"].dataType.simpleString()
    found = None
    for last, items in _blocks(benchmark, window, item_id, item_text):
        run = _scan_with(sc.broadcast(TestSuffixes(items, window)))
        if last and found is None:
            return table.mapInArrow(run, f"id {id_type}, {FOUND}").withColumnRenamed("id", id_col)
        if found is None:
            kept = settle(table.withColumn("_dc_row", F.monotonically_increasing_id()), "decontam")
            rows = kept.select(F.col("_dc_row").alias("id"), "text")
        some = rows.mapInArrow(run, f"id long, {FOUND}")
        # After the first block only rows with matches matter.
        some = settle(some if found is None else some.filter("n_hit > 0"), "decontam")
        found = some if found is None else found.unionByName(some)
    one = found.groupBy("id").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("matches")).alias("matches"))
    merged = kept.select(F.col("_dc_row"), F.col("id").alias("_dc_id")).join(one, F.col("_dc_row") == F.col("id")).select(F.col("_dc_id").alias("id"), "n_words", "matches")
    return merged.mapInArrow(_merge_with(window), f"id {id_type}, {FOUND}").withColumnRenamed("id", id_col)


def _scan_with(sent):
    def run(batches):
        tests = sent.value
        for batch in batches:
            for a, b, sizes, hit, items, matches in _shards(tests, batch.column("text")):
                cols = [batch.column("id").slice(a, b - a), *(pa.array(v, t) for v, (_, t) in zip((sizes, hit, items, matches), _FOUND, strict=True))]
                yield pa.RecordBatch.from_arrays(cols, ["id", *(n for n, _ in _FOUND)])

    return run


def _merge_with(window: int):
    def run(batches):
        for batch in batches:
            matches = [_joined(x, window) for x in batch.column("matches").to_pylist()]
            hit = [len({w for m in x for w in range(m["start"], m["start"] + m["n_words"])}) for x in matches]
            values = (batch.column("n_words").to_pylist(), hit, [_named(x) for x in matches], matches)
            cols = [batch.column("id"), *(pa.array(v, t) for v, (_, t) in zip(values, _FOUND, strict=True))]
            yield pa.RecordBatch.from_arrays(cols, ["id", *(n for n, _ in _FOUND)])

    return run


def contaminated() -> F.Column:
    """The contract's rule: at least a twentieth of a document's words are hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = 13, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without contaminated documents; no shuffle, all columns as they were."""
    blocks = _blocks(benchmark, window, item_id, item_text)
    last, items = next(blocks)
    if last:
        sent = docs.sparkSession.sparkContext.broadcast(TestSuffixes(items, window))
        return docs.mapInArrow(_keep_clean(sent, text_col), docs.schema)
    marked = docs.withColumn("_dc_row", F.monotonically_increasing_id())
    marked = settle(marked, "decontam")
    bad = scan(marked, benchmark, window=window, id_col="_dc_row", text_col=text_col, item_id=item_id, item_text=item_text).filter(contaminated())
    return marked.join(bad.select("_dc_row"), "_dc_row", "left_anti").drop("_dc_row")


def _keep_clean(sent, text_col: str):
    def run(batches):
        tests = sent.value
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for a, b, sizes, hit, _, _ in _shards(tests, batch.column(at)):
                keep = [not (h > 0 and 20 * h >= n) for h, n in zip(hit, sizes, strict=True)]
                yield batch.slice(a, b - a).filter(pa.array(keep, pa.bool_()))

    return run


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    with scratch(spark):
        digest = scan(docs, benchmark).select(
            "doc_id",
            "n_words",
            "n_hit",
            F.size("items").cast("long").alias("n_items"),
            F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
            contaminated().alias("contaminated"),
        )
        return settle(digest, "decontaminated", keep=True)


OP7_SQL = r"""
WITH dw AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(list_slice(w, j, j + least(len(w), 13) - 1), ' ') AS s
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS j FROM bw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
pos AS (SELECT rid, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s
        FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n)),
hit AS (SELECT rid, i, pos.n, item_id FROM pos JOIN win ON pos.n = win.n AND pos.s = win.s),
words AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS k FROM hit) GROUP BY rid),
its AS (SELECT rid, count(DISTINCT item_id::VARCHAR) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hit GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w)) AS contaminated
FROM dw LEFT JOIN words USING (rid) LEFT JOIN its USING (rid)
"""
