"""Suffix-array de-duplication: bytes inside repeated strings are removed.

Method: Burrows-Wheeler transforms of shards, merged by interleave refinement.
A shard's text (pieces around anchors that occur elsewhere, see ``windows``) is
read as strings over blocks of ``STRIDE`` bytes, one string per phase: the
symbol at a position is the block that begins there, the one before it in the
same string ends there. Any fixed order of symbols serves for repeats, so
symbols go by their hashes. A shard's suffixes are sorted once, and its
transform (the symbol before each suffix) is all that the merge sees: the
interleave of the shards, at first one after the other, is refined by passing
over it and dealing each suffix to the bucket of its preceding symbol, in
order. After h passes the suffixes of all shards stand in order of their
first h symbols, without having been compared; where a boundary first shows
tells the common prefix of neighbours. After L / STRIDE passes the intervals
without a boundary are the strings of L bytes that occur several times.

Blocks are compared by 64-bit hashes, seeded; copies of texts by 128 bits.
Null text: empty. Texts shorter than L lose nothing. A text that occurs in
several rows loses all its bytes if it has L or more. Repeated rows and ids:
a row each. Very long texts are cut into overlapping segments that hold every
window. Of k-grams with one hash the first counts, and equal suffixes of a shard
keep their places' order. Only the two columns named are read, so others may
have any name. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dnsloom.llm.common import flat_bytes, scratch, settle
from dnsloom.llm.windows import Tokens, cover, gram_hashes, repeated

LENGTH, ANCHOR = 200, 64
#: Bytes of a shard: what its sorts touch stays in a core's cache.
SHARD = 64 << 10
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)


def _symbols(raw: np.ndarray, at: np.ndarray):
    return _BYTE[raw], at, raw


BYTES = Tokens(symbols=_symbols, piece=lambda raw, a, b: raw[a:b].tobytes())


def stride_of(length: int) -> int:
    """The largest divisor of ``length`` up to 25."""
    return max(g for g in range(1, 26) if length % g == 0)


def _order(x: np.ndarray) -> np.ndarray:
    """Stable order of numbers from 0 to below 2^32: each is packed with its place, and the words are sorted as plain numbers."""
    packed = x.astype(np.uint64)
    packed <<= np.uint64(32)
    packed |= np.arange(len(x), dtype=np.uint64)
    packed.sort()
    packed &= np.uint64((1 << 32) - 1)
    return packed.view(np.int64)


def _ranks(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense ranks of numbers, or of tuples of them (compared by the first, then the next), and an order by these."""
    order = np.argsort(keys[0]) if len(keys) == 1 else _order(keys[-1])
    for key in keys[-2::-1]:
        order = order[_order(key[order])]
    new = np.zeros(len(order), bool)
    for key in keys:
        of = key[order]
        new[1:] |= of[1:] != of[:-1]
    rank = np.empty(len(order), np.int32)
    rank[order] = np.cumsum(new, dtype=np.int32)
    return rank, order


class Shard:
    """Suffixes of some pieces in order, and the transform: the symbol before each. END and START are 0."""

    def __init__(self, pieces: list[bytes], stride: int, depth: int):
        sizes = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        base = np.concatenate([[0], np.cumsum(sizes + 1)])  # a piece of n bytes has n + 1 positions
        total = int(base[-1])
        self.piece = np.repeat(np.arange(len(pieces)), sizes + 1)
        self.place = np.arange(total) - base[self.piece]
        last = base[1:][self.piece] - 1
        at = np.arange(total)
        h = gram_hashes(_BYTE[raw], stride) if len(raw) else np.zeros(0, np.uint64)
        symbol = np.zeros(total, np.uint64)
        whole = self.place + stride <= sizes[self.piece]
        symbol[whole] = h[(at - self.piece)[whole]] | np.uint64(1)
        before = np.zeros(total, np.uint64)
        inner = self.place >= stride
        before[inner] = symbol[at[inner] - stride]
        # Ranks of 1, 2, 4, ... symbols.
        (rank, order), have = _ranks(symbol), 1
        while have < depth:
            rank, order = _ranks(rank, rank[np.minimum(at + have * stride, last)])
            have *= 2
        self.suffix = order
        self.transform = before[order]


def merge(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Merges the shards' transforms: the shards' suffixes (numbered through) in order of their first ``depth`` symbols, and each one's common prefix with the one before, in symbols.
    Positions have 32 bits: what meets here is one Arrow batch, below 2^31 bytes."""
    sizes = np.array([len(s.suffix) for s in shards])
    total = int(sizes.sum())
    dense = _ranks(np.concatenate([s.transform for s in shards]))[0]
    start = 0  # the rank of START, which every piece has
    interleave = np.repeat(np.arange(len(shards)), sizes).astype(np.uint16)
    block = np.zeros(total, np.int32)
    common = np.full(total, depth, np.int32)
    if total:
        common[0] = 0
    index = np.arange(total, dtype=np.int32)
    for h in range(1, depth + 1):
        symbol = dense[index]
        order = _order(symbol)
        interleave, passed, behind = interleave[order], symbol[order], block[order]
        edge = np.zeros(total, bool)
        edge[1:] = (passed[1:] != passed[:-1]) | ((behind[1:] != behind[:-1]) & (passed[1:] != start))
        common[edge & (common == depth)] = h - 1
        block = np.cumsum(edge, dtype=np.int32)
        # The n-th suffix of a shard in the interleave is the n-th of the shard's own order.
        index = np.empty(total, np.int32)
        index[np.argsort(interleave, kind="stable")] = np.arange(total, dtype=np.int32)
    return index, common


def repeated_strings(pieces: list[bytes], several: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each piece, which of its strings of ``length`` bytes occur several times among all of them (or in a piece that itself does)."""
    stride = stride_of(length)
    depth = length // stride
    sizes = np.array([len(p) for p in pieces])
    shards, first, now = [], [0], 0
    for i, n in enumerate(sizes.tolist()):
        if now and now + n > SHARD:
            shards.append(Shard(pieces[first[-1] : i], stride, depth))
            first.append(i)
            now = 0
        now += n
    shards.append(Shard(pieces[first[-1] :], stride, depth))
    index, common = merge(shards, depth)
    piece = np.concatenate([s.piece[s.suffix] + f for s, f in zip(shards, first, strict=True)])[index]
    place = np.concatenate([s.place[s.suffix] for s in shards])[index]
    window = place + length <= sizes[piece]
    interval = np.cumsum(common < depth)
    weight = np.bincount(interval, np.where(window, 1 + several[piece].astype(np.int64), 0), interval[-1] + 1)
    hit = window & (weight[interval] >= 2)
    begin = np.concatenate([[0], np.cumsum(np.maximum(sizes - length + 1, 0))])
    mark = np.zeros(int(begin[-1]), bool)
    mark[begin[piece[hit]] + place[hit]] = True
    return np.split(mark, begin[1:-1])


def _digests(batches):
    for batch in batches:
        raw, at = flat_bytes(batch.column("text"))
        removed, runs, kept = [], [], []
        for i, spans in enumerate(batch.column("spans").to_pylist()):
            text = raw[at[i] : at[i + 1]]
            gone = cover(len(text), spans)
            removed.append(int(gone.sum()))
            runs.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
            kept.append(hashlib.sha256(text[~gone].tobytes()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("tid"), batch.column("tid2"), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept)], ["tid", "tid2", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(docs: DataFrame, length: int = LENGTH, *, anchor: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents: id, tid, text; spans by text: tid, spans of bytes; texts that may have some: tid, tid2, text). Copies of whole texts are not in the spans."""
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    texts = texts.select("id", F.xxhash64("text").alias("tid"), "text", F.xxhash64(F.lit("copy"), "text").alias("tid2"))
    k = anchor or max(1, min(ANCHOR, length // 3))
    spans, held = repeated(texts, BYTES, length, k, lambda p, s: repeated_strings(p, s, length))
    return texts, spans, held


def strip_repeats(docs: DataFrame, length: int = LENGTH, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256."""
    with scratch(docs.sparkSession):
        texts, spans, held = repeated_spans(docs, length, id_col=id_col, text_col=text_col)
        counts = texts.groupBy("tid", "tid2").agg(F.count(F.lit(1)).alias("rows"))
        digests = settle(held.join(spans, "tid").mapInArrow(_digests, "tid long, tid2 long, n_removed long, n_spans long, kept_sha256 string").dropDuplicates(["tid", "tid2"]).join(counts, ["tid", "tid2"], "full"), "digests")
        plain = texts.select("id", "tid", "tid2", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("whole"))
        out = plain.join(digests, ["tid", "tid2"])
        copy = (F.col("rows") > 1) & (F.col("n_bytes") >= length)
        return settle(
            out.select(
                F.col("id").alias(id_col),
                "n_bytes",
                F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
                F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
                F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
            ),
            "stripped",
            keep=True,
        )


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return strip_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
