"""Ranked lexical search by an Aho-Corasick scan of the documents: no index of the documents is built.

The distinct terms of all items, each between two guards (blanks), make one
automaton that is broadcast. A document is folded so that whatever is no part
of a term becomes a blank; one walk over it then yields every occurrence of
every item term, neighbours that share a blank included, so term frequencies
come straight from the text. What a walk leaves is a row of term numbers and
frequencies. Document frequencies are counted from those rows, and a second,
light pass over the rows adds up scores: a term's output leads to the items that
hold it. Each task keeps the best documents of each item, and such lists are
merged by parts of the documents first, then per item.

Items are taken in blocks of about ``BLOCK_BYTES`` of terms (an item is never
divided), so the automaton that is broadcast is bounded whatever their number;
each block is a pass over the documents. N, L and n come from the first pass.

Null, empty and blank texts have no terms: such documents count nowhere and such
items get no rows. Long texts are walked whole; memory follows the number of item
terms, not the text. Ties go to the smaller id, null ids after all others.
Repeated document rows are documents of their own, as are repeated items (each
row of the items is answered under its id). Empty tables give an empty result.
Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import math
from collections import Counter

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dnsloom.llm.common import arrow_rows, scratch, settle, spread

#: Bytes of terms of the items whose automaton is broadcast at once.
BLOCK_BYTES = 4 << 20
#: Documents scored at once, and rows of partial lists that one merge takes.
CHUNK, MERGED = 512, 100_000
#: What no term holds, as blanks; A-Z in lower case. Bytes of 128 and more belong to characters of terms.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def fold(text: str) -> bytes:
    """The text's terms, with blanks for all else and one at both ends."""
    return b" " + text.encode().translate(FOLD) + b" "


def count_terms(folded: bytes) -> int:
    """Number of terms of a folded text."""
    raw = np.frombuffer(folded, np.uint8) != 32
    return int(np.count_nonzero(raw[1:] & ~raw[:-1]))


def automaton(terms: list[str]) -> ahocorasick.Automaton:
    """Finds each of ``terms`` (by its place in the list) where it stands between blanks."""
    made = ahocorasick.Automaton()
    made.add_word("\n", -1)  # in no folded text; an automaton needs a word
    for k, t in enumerate(terms):
        made.add_word(f" {t} ", k)
    made.make_automaton()
    return made


def _item_terms(batches):
    """The distinct terms of each item that has some, and their bytes."""
    for batch in batches:
        found = [sorted(set(fold(t).split(b" ")) - {b""}) for t in batch.column("text").to_pylist()]
        some = pa.array([i for i, f in enumerate(found) if f], pa.int64())
        lists = [[t.decode() for t in f] for f in found if f]
        size = [sum(map(len, f)) for f in found if f]
        cols = [batch.column("item").take(some), batch.column("row").take(some), pa.array(lists, pa.list_(pa.string())), pa.array(size, pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, ["item", "row", "terms", "size"])


def _scan(sent):
    """id, n (terms with repeats), and the item terms of each document that has terms."""

    def run(batches):
        found = sent.value
        for batch in batches:
            keep, n, terms, times = [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                folded = fold(text) if text else b""
                size = count_terms(folded) if text else 0
                if size:
                    hits = Counter(k for _, k in found.iter(folded.decode()))
                    keep.append(i)
                    n.append(size)
                    terms.append(list(hits.keys()))
                    times.append(list(hits.values()))
            cols = [batch.column("id").take(pa.array(keep, pa.int64())), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["id", "n", "terms", "times"])

    return run


class Scoring:
    """What scores depend on besides a document: weights of terms, the items of each term, N and L."""

    def __init__(self, items: list[list[int]], df: np.ndarray, documents: int, words: int):
        self.documents, self.words, self.items = documents, words, len(items)
        self.weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        pairs = np.array([(t, k) for k, terms in enumerate(items) for t in terms], np.int64).reshape(-1, 2)
        pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
        self.held_by = pairs[:, 1]
        self.begin = np.searchsorted(pairs[:, 0], np.arange(len(df) + 1))

    def scores(self, n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """Documents by items. ``n``: terms of each document; doc, term, tf: what the documents hold."""
        m = 100 - 50 + (50 * n * self.documents) // self.words
        gain = self.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
        first, count = self.begin[term], self.begin[term + 1] - self.begin[term]
        at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
        out = np.zeros(len(n) * self.items, np.int64)
        np.add.at(out, np.repeat(doc * self.items, count) + self.held_by[at], np.repeat(gain, count))
        return out.reshape(len(n), self.items)


def _best(sent, limit: int):
    """The ``limit`` best documents of each item in a task: item, id, score."""

    def run(batches):
        plan: Scoring = sent.value
        best = pd.DataFrame({"item": pd.Series(dtype="int64"), "id": pd.Series(dtype="Int64"), "score": pd.Series(dtype="int64")})
        floor = np.ones(plan.items, np.int64)  # a score below is in no list
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                lists = part.column("terms")
                doc = np.repeat(np.arange(len(part)), lists.value_lengths().to_numpy(zero_copy_only=False))
                flat = lambda c: c.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                made = plan.scores(part.column("n").to_numpy(zero_copy_only=False), doc, flat(lists), flat(part.column("times")))
                rows, items = np.nonzero(made >= floor)
                if len(rows):
                    ids = pd.array(part.column("id").take(pa.array(rows)).to_pylist(), dtype="Int64")
                    both = pd.concat([best, pd.DataFrame({"item": items, "id": ids, "score": made[rows, items]})])
                    both = both.sort_values(["item", "score", "id"], ascending=[True, False, True], na_position="last")
                    best = both[both.groupby("item").cumcount() < limit]
                    full = best.groupby("item")["score"].agg(["size", "min"])
                    full = full[full["size"] == limit]
                    floor[full.index.to_numpy()] = full["min"].to_numpy()
        yield best

    return run


def search(
    docs: DataFrame, items: DataFrame, limit: int = 50, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int | None = None
) -> DataFrame:
    """item_id, rank (from 1), doc id, score: each item's ``limit`` best documents with a score above 0.

    Document ids are taken as longs. Call it within ``scratch``, or delete its tables yourself.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    asked = items.select(F.col(item_id).alias("item"), F.col(item_text).cast("string").alias("text")).filter("text is not null").withColumn("row", F.monotonically_increasing_id())
    kind = asked.schema["item"].dataType.simpleString()
    table = settle(asked.mapInArrow(_item_terms, f"item {kind}, row long, terms array<string>, size long"), "items")
    blocks = spread(table.agg(F.sum("size")).first()[0] or 0, block_bytes or BLOCK_BYTES, 1)
    whole, tops = None, []
    for k in range(blocks):
        block = table.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == k).collect()
        names = sorted({t for r in block for t in r.terms})
        number = {t: i for i, t in enumerate(names)}
        sent = sc.broadcast(automaton(names))
        with arrow_rows(spark, 1000):
            held = settle(texts.mapInArrow(_scan(sent), "id long, n long, terms array<int>, times array<long>"), "held")
        sent.destroy()
        whole = whole or held.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(names), np.int64)
        for t, n in held.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row per term of the block
            df[t] = n
        sent = sc.broadcast(Scoring([[number[t] for t in r.terms] for r in block], df, *whole))
        best = settle(held.mapInArrow(_framed(_best(sent, limit)), "item int, id long, score long"), "best")
        sent.destroy()
        own = F.broadcast(spark.createDataFrame([(i, r.row, r.item) for i, r in enumerate(block)], f"item int, row long, item_id {kind}"))
        tops.append(best.join(own, "item").drop("item"))
    every = tops[0]
    for t in tops[1:]:
        every = every.unionByName(t)
    order = [F.desc("score"), F.asc_nulls_last("id")]
    part = F.pmod(F.xxhash64("id"), F.lit(spread(every.count(), MERGED)))
    first = every.withColumn("_r", F.row_number().over(Window.partitionBy("row", part).orderBy(*order))).filter(F.col("_r") <= limit)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(*order))).filter(F.col("rank") <= limit)
    return ranked.select("item_id", "rank", F.col("id").alias("doc_id"), "score")


def _framed(run):
    """``run`` yields frames; this hands on Arrow batches."""
    schema = pa.schema([("item", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])

    def arrow(batches):
        for frame in run(batches):
            yield pa.RecordBatch.from_pandas(frame, schema, preserve_index=False)

    return arrow


def op11_lexical_search(spark, sf_dir: str) -> DataFrame:
    with scratch(spark):
        found = search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
        return settle(found, "ranked", keep=True)


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS w FROM documents WHERE text IS NOT NULL),
n AS (SELECT rid, doc_id, len(w)::BIGINT AS n FROM d WHERE len(w) > 0),
g AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM n),
i AS (SELECT k, item_id, unnest(w) AS t FROM (SELECT row_number() OVER () AS k, item_id, list_distinct({_TERMS}) AS w FROM benchmark WHERE text IS NOT NULL)),
f AS (SELECT rid, t, count(*)::BIGINT AS tf FROM (SELECT rid, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM i) GROUP BY rid, t),
c AS (SELECT t, floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, g GROUP BY t, nn),
s AS (SELECT k, item_id, doc_id, rid, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * nn) // ll))))::BIGINT AS score
  FROM i JOIN f ON f.t = i.t JOIN c ON c.t = i.t JOIN n USING (rid), g GROUP BY k, item_id, doc_id, rid),
r AS (SELECT *, (row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id NULLS LAST))::INTEGER AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""
