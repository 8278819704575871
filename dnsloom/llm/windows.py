"""Repeated windows of tokens (bytes or words) over a whole corpus: the frame of both substring operators.

A window is L consecutive tokens of one text. Of the k-grams in a window the one
with the smallest hash (the first of equals) is its anchor; equal windows have
the same anchor at the same place, so only windows whose anchor's k-gram
occurs elsewhere can repeat. The steps:

1. anchors: every text's anchors (a few per cent of its positions) are written;
   k-grams that occur at two places survive.
2. pieces: around each surviving anchor, the stretch that its windows cover.
   Equal pieces become one row with a flag that it occurs several times.
3. kernel: all pieces of an anchor meet in one bucket, where the operator's
   own method finds which of their windows repeat. Where very many different
   pieces would meet, they are divided first: by the anchors that their windows
   have under other orders of the k-grams, four, then eight, and so on, until
   few enough meet. Equal windows have equal anchors under any order, so they
   still meet, and the same kernel decides on them.
4. what repeats goes back to the texts, as spans of tokens.

Texts are keyed by a 64-bit hash; copies are one text that occurs several
times, all of whose windows repeat, and their rows meet only when counted.
Copies are told by two hashes (128 bits), so no text goes for another's sake.

Rows of one anchor, or of one piece, may be a third of all: joins on them are
dealt by ``hot_join``, which spreads the rows of each hot key over several
parts and sends the key's one partner row to each of these.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dnsloom.llm.common import M64, flat_bytes, hot_join, mix64, portions, settle, spread

#: Bytes of text that are worked on at once (arrays of so many words stay in a core's cache), and tokens of a text that are hashed at once.
PORTION, SEGMENT = 256 << 10, 4 << 20
#: Bytes of pieces in a bucket, about; different pieces that meet under one key, beyond which they are divided.
BUCKET, MANY = 256 << 10, 4000
#: Orders of k-grams that divide such pieces, step by step; two windows that differ agree in all of them about never.
ORDERS = (4, 8, 16, 32, 64, 128, 256)
BASE = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.uint64((1 << 24) - 1)


def gram_hashes(sym: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k tokens from each position on (positions near the end hash what is left of them, unused). Lengths double."""
    out, have, power, size = None, 0, int(BASE), 1
    block = sym.astype(np.uint64)
    n = len(sym)
    while True:
        if k & size:
            if out is None:
                out = block.copy()
            else:  # what is gathered so far comes first, then this block
                shifted = np.zeros(n, np.uint64)
                shifted[: n - have] = block[have:]
                out = out * np.uint64(power) + shifted
            have += size
        if size * 2 > k:
            return mix64(out)
        nxt = block * np.uint64(power)
        nxt[: n - size] += block[size:]
        block, power, size = nxt, power * power & M64, size * 2


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """The smallest of the w values from each position on."""
    now, then = x.copy(), np.empty_like(x)
    steps = [1 << i for i in range(w.bit_length() - 1)]
    for size in [*steps, w - (1 << len(steps))]:
        if size:
            cut = max(0, len(x) - size)
            np.minimum(now[:cut], now[size:], out=then[:cut])
            then[cut:] = now[cut:]
            now, then = then, now
    return now


def _window_starts(begin: np.ndarray, length: int, n: int) -> np.ndarray:
    """Where the windows of texts begin, of n tokens in all."""
    step = np.zeros(n + 1, np.int32)
    long = np.diff(begin) >= length
    np.add.at(step, begin[:-1][long], 1)
    np.add.at(step, begin[1:][long] - length + 1, -1)
    return np.flatnonzero(np.cumsum(step[:-1]) > 0)


def anchors(sym: np.ndarray, begin: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts with one anchor: first start, last start, anchor's place, its k-gram's hash. ``begin``: where texts begin, and the end."""
    none = np.zeros(0, np.int64)
    starts = _window_starts(begin, length, len(sym))
    if not len(starts):
        return none, none, none, np.zeros(0, np.uint64)
    h = gram_hashes(sym, k)
    least = sliding_least((h & ~_PLACE) | np.arange(len(sym), dtype=np.uint64), length - k + 1)
    owner = (least[starts] & _PLACE).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(starts)]]) - 1
    return starts[first], starts[last], owner[first], h[owner[first]]


@dataclass(frozen=True)
class Tokens:
    """How a text is cut: ``symbols`` gives a hash per token of several texts and where each text's tokens begin;
    ``piece`` gives the bytes of tokens a to b of one text; ``again`` the symbols of such bytes."""

    symbols: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, object]]
    piece: Callable[[object, int, int], bytes]


def _segments(begin: np.ndarray, length: int):
    """Ranges of tokens of at most about SEGMENT that hold every window: (a, b, text starts within)."""
    for i, j in portions(np.diff(begin), SEGMENT):
        a, b = int(begin[i]), int(begin[j])
        if b - a <= SEGMENT:
            yield a, b, begin[i : j + 1] - a
        else:  # one text; others in the range are empty
            for at in range(a, b, SEGMENT):
                end = min(b, at + SEGMENT + length - 1)
                yield at, end, np.array([0, end - at])
                if end == b:
                    break


def _anchor_rows(cut: Tokens, length: int, k: int):
    def run(batches):
        for batch in batches:
            tid = batch.column(0).to_numpy()
            raw, at = flat_bytes(batch.column(1))
            for i, j in portions(np.diff(at), PORTION):
                sym, begin, _ = cut.symbols(raw[at[i] : at[j]], at[i : j + 1] - at[i])
                for a, b, inside in _segments(begin, length):
                    _, _, place, h = anchors(sym[a:b], inside, length, k)
                    place = place + a
                    row = np.searchsorted(begin, place, "right") - 1
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(tid[i:j][row]), pa.array((place - begin[row]).astype(np.int32))], ["h", "tid", "place"])

    return run


def _piece_rows(cut: Tokens, length: int, k: int):
    """From tid, text and the places of surviving anchors: h, tid, start, ph (hash of the piece), piece."""

    def run(batches):
        for batch in batches:
            tid, wanted = batch.column("tid").to_numpy(), batch.column("places")
            raw, at = flat_bytes(batch.column("text"))
            for i, j in portions(np.diff(at), PORTION):
                sym, begin, state = cut.symbols(raw[at[i] : at[j]], at[i : j + 1] - at[i])
                some = wanted.slice(i, j - i)
                base = np.repeat(begin[:-1], some.value_lengths().to_numpy(zero_copy_only=False))
                keep = np.zeros(len(sym) + 1, bool)
                at_most = base + some.flatten().to_numpy(zero_copy_only=False)
                keep[at_most[at_most < len(sym)]] = True
                for a, b, inside in _segments(begin, length):
                    lo, hi, place, h = anchors(sym[a:b], inside, length, k)
                    pick = keep[place + a]
                    lo, hi, h = lo[pick] + a, hi[pick] + a + length, h[pick]
                    row = np.searchsorted(begin, lo, "right") - 1
                    pieces = [cut.piece(state, x, y) for x, y in zip(lo.tolist(), hi.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h.view(np.int64)), pa.array(tid[i:j][row]), pa.array((lo - begin[row]).astype(np.int32)), pa.array(pieces, pa.binary())], ["h", "tid", "start", "piece"]
                    )

    return run


def repeated(texts: DataFrame, cut: Tokens, length: int, k: int, kernel: Callable[[list[bytes], np.ndarray], list[np.ndarray]]) -> tuple[DataFrame, DataFrame]:
    """Spans of repeated windows: (tid, spans array<struct<a: int, b: int>>), in tokens and not yet merged, and the texts they are in (tid, tid2, text).

    ``texts``: id, tid, text, tid2 (hashes of the text), one row per document. ``kernel`` gets the pieces
    of a bucket and whether each occurs several times, and returns for each piece
    which of its windows repeat.
    """
    found = settle(texts.select("tid", "text").mapInArrow(_anchor_rows(cut, length, k), "h long, tid long, place int"), "anchors")
    twice = found.groupBy("h").agg(F.min(F.xxhash64("tid", "place")).alias("lo"), F.max(F.xxhash64("tid", "place")).alias("hi"), F.count(F.lit(1)).alias("_n")).filter("lo < hi").select("h", "_n")
    places = hot_join(found, settle(twice, "twice"), ["h"]).groupBy("tid").agg(F.collect_set("place").alias("places"))
    # One row stands for all copies of a text.
    first = texts.groupBy("tid").agg(F.min("id").alias("id"))
    chosen = settle(places.join(first, "tid"), "places")
    held = settle(texts.alias("t").join(chosen.alias("c"), (F.col("t.tid") == F.col("c.tid")) & F.col("t.id").eqNullSafe(F.col("c.id"))).select("t.tid", "t.tid2", "t.text", "c.places"), "held")
    pieces = settle(held.mapInArrow(_piece_rows(cut, length, k), "h long, tid long, start int, piece binary").withColumn("ph", F.xxhash64("piece")), "pieces")

    loc = F.xxhash64("tid", "start")
    once = pieces.groupBy("h", "ph").agg(F.min(loc).alias("lo"), F.max(loc).alias("hi"), F.first("piece").alias("piece"), F.count(F.lit(1)).alias("_n")).select("h", "ph", (F.col("lo") < F.col("hi")).alias("several"), "piece", "_n")
    once = settle(once, "once")
    many = settle(once.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("piece")).alias("bytes")).filter(F.col("n") > MANY), "many")
    work = once.join(many, "h", "left_anti").select(F.col("h").alias("key"), "h", "ph", F.lit(0).alias("at"), "several", "piece")
    hot = not many.isEmpty()
    if hot:
        crowd = once.drop("_n").join(many.select("h"), "h").withColumn("key", F.col("h")).withColumn("at", F.lit(0))
        parts = settle(_divide(crowd, cut, length, k), "parts")
        # Equal stretches under one key are one row, as equal pieces are.
        merged = parts.groupBy("key", "wh").agg(F.min(F.xxhash64("ph", "at")).alias("lo"), F.max(F.xxhash64("ph", "at")).alias("hi"), F.max("several").alias("several"), F.first("piece").alias("piece"), F.count(F.lit(1)).alias("_n"))
        merged = settle(merged.select("key", "wh", (F.col("several") | (F.col("lo") < F.col("hi"))).alias("several"), "piece", "_n"), "merged")
        work = work.unionByName(merged.select("key", F.col("key").alias("h"), F.col("wh").alias("ph"), F.lit(-1).alias("at"), "several", "piece"))
    total = once.agg(F.sum(F.octet_length("piece"))).first()[0] or 0
    buckets = spread(total, BUCKET, 12)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        order = pdf["key"].to_numpy().argsort(kind="stable")
        pdf = pdf.iloc[order]
        marks = kernel(pdf["piece"].tolist(), pdf["several"].to_numpy())
        keep = [bool(m.any()) for m in marks]
        runs = [_runs(m) for m, yes in zip(marks, keep, strict=True) if yes]
        out = pdf.loc[keep, ["key", "h", "ph", "at"]]
        return out.assign(runs=pd.Series([r.ravel().tolist() for r in runs], index=out.index, dtype=object))

    dealt = work.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    solved = dealt.groupBy("bucket").applyInPandas(solve, "key long, h long, ph long, at int, runs array<int>")
    solved = settle(solved, "solved")
    marked = solved.filter("at = 0").select("h", "ph", F.lit(0).alias("shift"), "runs")
    if hot:
        again = hot_join(parts.select("key", "wh", "h", "ph", "at"), solved.filter("at = -1").select("key", F.col("ph").alias("wh"), "runs"), ["key", "wh"], merged.select("key", "wh", "_n"))
        marked = marked.unionByName(again.select("h", "ph", F.col("at").alias("shift"), "runs"))
    # A run's first and last window starts, within its piece, give a span of tokens of the text.
    spans = hot_join(pieces.select("h", "ph", "tid", "start"), marked, ["h", "ph"], once.select("h", "ph", "_n"))
    pair = F.transform(F.sequence(F.lit(0), F.size("runs") - 2, F.lit(2)), lambda i: F.struct((F.col("start") + F.col("shift") + F.get("runs", i)).alias("a"), (F.col("start") + F.col("shift") + F.get("runs", i + 1) + length).alias("b")))
    by_text = spans.select("tid", F.explode(pair).alias("span")).groupBy("tid").agg(F.collect_list("span").alias("spans"))
    return by_text, held.select("tid", "tid2", "text")


def _divide(crowd: DataFrame, cut: Tokens, length: int, k: int) -> DataFrame:
    """key, h, ph, at, several, piece, wh (hash of the piece) of the pieces' stretches, divided until at most MANY different ones share a key.
    Only what is still crowded goes on to the next step; what is after the last one stays whole and meets in one task."""
    done = None
    for step in range(len(ORDERS)):
        cut_up = crowd.select("key", "h", "ph", "at", "several", "piece").mapInArrow(_stretches(cut, length, k, step), "key long, h long, ph long, at int, several boolean, piece binary")
        now = settle(cut_up.withColumn("wh", F.xxhash64("piece")), "stretches")
        kinds = now.groupBy("key", "wh").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("_n"))
        kinds = settle(kinds, "kinds")
        if step + 1 == len(ORDERS) or kinds.filter(F.col("kinds") > MANY).isEmpty():
            return now if done is None else done.unionByName(now)
        told = settle(hot_join(now, kinds.drop("_n"), ["key"], kinds.select("key", "_n")), "told")
        calm = told.filter(F.col("kinds") <= MANY).drop("kinds")
        done = calm if done is None else done.unionByName(calm)
        crowd = told.filter(F.col("kinds") > MANY)


def _stretches(cut: Tokens, length: int, k: int, step: int):
    """Divides pieces into the stretches of windows that have one anchor under each of ``ORDERS[step]`` orders; these anchors enter the key."""

    def run(batches):
        salts = np.random.default_rng(step).integers(1, 1 << 63, ORDERS[step], dtype=np.uint64)
        for batch in batches:
            raw, at = flat_bytes(batch.column("piece"))
            for i, j in portions(np.diff(at), PORTION >> 3):
                sym, begin, state = cut.symbols(raw[at[i] : at[j]], at[i : j + 1] - at[i])
                starts = _window_starts(begin, length, len(sym))
                if not len(starts):
                    continue
                row = np.searchsorted(begin, starts, "right") - 1
                h, order = gram_hashes(sym, k), np.arange(len(sym), dtype=np.uint64)
                new = np.ones(len(starts), bool)
                new[1:] = starts[1:] != starts[:-1] + 1
                key = batch.column("key").slice(i, j - i).to_numpy().view(np.uint64)[row]
                for salt in salts:
                    owner = (sliding_least((mix64(h ^ salt) & ~_PLACE) | order, length - k + 1)[starts] & _PLACE).astype(np.int64)
                    new[1:] |= owner[1:] != owner[:-1]
                    key = mix64(key ^ h[owner])
                first = np.flatnonzero(new)
                lo, hi = starts[first], starts[np.concatenate([first[1:], [len(starts)]]) - 1] + length
                pieces = [cut.piece(state, x, y) for x, y in zip(lo.tolist(), hi.tolist(), strict=True)]
                of = pa.array(row[first])
                some = batch.slice(i, j - i)
                shift = some.column("at").to_numpy()[row[first]] + (lo - begin[row[first]])
                kept = [some.column(c).take(of) for c in ("h", "ph")]
                yield pa.RecordBatch.from_arrays([pa.array(key[first].view(np.int64)), *kept, pa.array(shift.astype(np.int32)), some.column("several").take(of), pa.array(pieces, pa.binary())], ["key", "h", "ph", "at", "several", "piece"])

    return run


def _runs(mark: np.ndarray) -> np.ndarray:
    """First and last index of each run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mark.astype(np.int8), [0]])))
    return edge.reshape(-1, 2) - np.array([0, 1])


def cover(n: int, spans: list) -> np.ndarray:
    """Which of n tokens the spans cover."""
    step = np.zeros(n + 1, np.int32)
    a = np.array([s["a"] for s in spans], np.int64)
    b = np.array([s["b"] for s in spans], np.int64)
    ok = (b <= n) & (a >= 0)
    np.add.at(step, a[ok], 1)
    np.add.at(step, b[ok], -1)
    return np.cumsum(step[:-1]) > 0
