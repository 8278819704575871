"""Substring de-duplication: words inside repeated windows are removed, found by level-wise doubling.

Windows repeated at one length alone are extended to twice that length. The
first level is the anchors of ``windows``: of all runs of eight words the ones
that stand for a window; those that occur once take every window they stand
for out of the race. Around the others, windows of 16 words are counted, then
32, then the target length; at each level a start whose window occurs once
is dropped, and a level with no survivors ends its group. Equal stretches
are one row by then, flagged as occurring several times, so copies are counted
once. The levels end at the target length.

Words are white-space words, unchanged. Word sequences are compared by 64-bit
hashes within groups of equal anchors. Null text: no words. Texts of fewer
words than the window lose nothing. A text that occurs in several rows loses
all its words if it has a window. Repeated rows and ids: a row each. Very long
texts are cut into overlapping segments that hold every window. Of k-grams with
one hash the first counts. Only the two columns named are read, so others may
have any name. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dnsloom.llm.common import flat_bytes, portions, scratch, settle, word_hashes
from dnsloom.llm.windows import PORTION, Tokens, cover, gram_hashes, repeated

WINDOW, FIRST = 35, 8


def _symbols(raw: np.ndarray, at: np.ndarray):
    words, begin, ends = word_hashes(raw, at)
    return words, begin, (raw, ends)


def _piece(state, a: int, b: int) -> bytes:
    raw, ends = state
    return raw[ends[a, 0] : ends[b - 1, 1]].tobytes()


WORDS = Tokens(symbols=_symbols, piece=_piece)


def levels(target: int, first: int = FIRST) -> list[int]:
    out, n = [], first
    while n * 2 < target:
        n *= 2
        out.append(n)
    return [*out, target]


def repeated_windows(pieces: list[bytes], several: np.ndarray, window: int = WINDOW) -> list[np.ndarray]:
    """For each piece (words, white space between), which of its windows occur several times among all of them (or in a piece that itself does)."""
    at = np.concatenate([[0], np.cumsum([len(p) + 1 for p in pieces])])
    words, begin, _ = word_hashes(np.frombuffer(b"\n".join(pieces) + b"\n", np.uint8), at)
    sizes = np.diff(begin)
    piece = np.repeat(np.arange(len(pieces)), np.maximum(sizes - window + 1, 0))
    offset = np.concatenate([[0], np.cumsum(np.maximum(sizes - window + 1, 0))])
    start = np.arange(offset[-1]) - offset[piece] + begin[piece]
    alive = np.arange(len(start))
    weight = 1 + several[piece].astype(np.int64)
    for n in levels(window):
        if not len(alive):
            break
        h = gram_hashes(words, n)[start[alive]]
        kinds, inverse = np.unique(h, return_inverse=True)
        alive = alive[np.bincount(inverse, weight[alive], len(kinds))[inverse] >= 2]
    mark = np.zeros(len(start), bool)
    mark[alive] = True
    return np.split(mark, offset[1:-1])


def _whole(batches):
    """tid, tid2, words and the digest of all words."""
    for batch in batches:
        raw, at = flat_bytes(batch.column("text"))
        count, digest = [], []
        data = raw.tobytes()
        for i in range(len(batch)):
            words = data[at[i] : at[i + 1]].translate(_BLANKS).split()
            count.append(len(words))
            digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tid"), batch.column("tid2"), pa.array(count, pa.int64()), pa.array(digest)], ["id", "tid", "tid2", "n_words", "whole"])


_BLANKS = bytes(32 if 9 <= c <= 13 else c for c in range(256))


def _digests(batches):
    for batch in batches:
        raw, at = flat_bytes(batch.column("text"))
        spans = batch.column("spans").to_pylist()
        for a, b in portions(np.diff(at), PORTION):
            data = raw[at[a] : at[b]].tobytes()
            removed, kept = [], []
            for i in range(a, b):
                words = data[at[i] - at[a] : at[i + 1] - at[a]].translate(_BLANKS).split()
                gone = cover(len(words), spans[i])
                removed.append(int(gone.sum()))
                kept.append(hashlib.sha256(b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("tid").slice(a, b - a), batch.column("tid2").slice(a, b - a), pa.array(removed, pa.int64()), pa.array(kept)], ["tid", "tid2", "n_removed", "kept_sha256"])


def strip_repeats(docs: DataFrame, window: int = WINDOW, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, n_removed, kept_sha256 (of the kept words joined by one space)."""
    with scratch(docs.sparkSession):
        id_type = docs.schema[id_col].dataType.simpleString()
        texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
        texts = texts.select("id", F.xxhash64("text").alias("tid"), "text", F.xxhash64(F.lit("copy"), "text").alias("tid2"))
        first = min(FIRST, window)
        spans, held = repeated(texts, WORDS, window, first, lambda p, s: repeated_windows(p, s, window))
        counts = texts.groupBy("tid", "tid2").agg(F.count(F.lit(1)).alias("rows"))
        digests = settle(held.join(spans, "tid").mapInArrow(_digests, "tid long, tid2 long, n_removed long, kept_sha256 string").dropDuplicates(["tid", "tid2"]).join(counts, ["tid", "tid2"], "full"), "digests")
        out = texts.mapInArrow(_whole, f"id {id_type}, tid long, tid2 long, n_words long, whole string").join(digests, ["tid", "tid2"])
        copy = (F.col("rows") > 1) & (F.col("n_words") >= window)
        return settle(
            out.select(
                F.col("id").alias(id_col),
                "n_words",
                F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
                F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
            ),
            "stripped",
            keep=True,
        )


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return strip_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT rid, j, md5(array_to_string(list_slice(w, j, j + 34), ' ')) AS h FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS j FROM d WHERE len(w) >= 35)),
r AS (SELECT rid, j FROM p WHERE h IN (SELECT h FROM p GROUP BY h HAVING count(*) > 1)),
g AS (SELECT DISTINCT rid, unnest(range(j, j + 35)) AS k FROM r),
x AS (SELECT rid, list(k) AS ks FROM g GROUP BY rid),
n AS (SELECT doc_id, d.rid, w, coalesce(ks, []) AS ks FROM d LEFT JOIN x ON x.rid = d.rid),
a AS (SELECT rid, k, w[k] AS word FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS k FROM d)),
kept AS (SELECT a.rid, string_agg(word, ' ' ORDER BY a.k) AS s FROM a ANTI JOIN g ON g.rid = a.rid AND g.k = a.k GROUP BY a.rid)
SELECT n.doc_id, len(n.w)::BIGINT AS n_words, len(n.ks)::BIGINT AS n_removed, sha256(coalesce(kept.s, '')) AS kept_sha256 FROM n LEFT JOIN kept ON kept.rid = n.rid
"""
