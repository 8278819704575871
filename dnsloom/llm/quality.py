"""Document quality from a linear-chain conditional random field over lines.

A document is a chain of lines, each good or bad. A line's features come from
its own bytes and words and from those of the lines before and after it; the
chain adds how likely a state follows another. Forward-backward gives each
line's probability of being good, and a document's score is their mean weighted
by line length.

Only documents are labelled, so in fitting every line carries its document's
label. The model is fitted on at most ``fit_docs`` documents of each class (a
bounded sample in the order of a hash, documented as such), with all their
lines; scoring covers all texts. Labels, language, source and ids are never
features.

Empty and null texts are one empty line. A document with conflicting labels
counts as bad. Repeated rows are scored one by one; of several texts with one
id the least in order is fitted on. A score of exactly the threshold is good. Without labelled rows of
both classes every score is the share of good labels (1 without any). Extra
columns pass through ``keep_good`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dnsloom.llm.common import flat_bytes, portions, run_hashes

#: Documents of each class that fitting uses at most, and the threshold of ``predicted``.
FIT_DOCS, THRESHOLD = 1500, 0.7
PORTION = 512 << 10
_SHOUT = np.array([65 <= c <= 90 for c in range(256)])
_LETTER = np.array([65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in range(256)])
_DIGIT = np.array([48 <= c <= 57 for c in range(256)])
_SPACE = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])
_STOP = np.isin(np.arange(256), [ord(c) for c in ".,"])
_SIGN = ~(_LETTER | _DIGIT | _SPACE | _STOP)
_KIND = _SHOUT * 1 + _LETTER * 2 + _DIGIT * 4 + _SPACE * 8 + _SIGN * 16
OWN = ("shouted", "signs", "digits", "stops", "spaces", "long words", "short words", "sign words", "repeated words", "repeated lines", "length", "bare")


def _lines(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each line begins and ends, and each document's first line. Every document has a line."""
    cut = np.flatnonzero(raw == 10)
    cut = cut[~np.isin(cut, at[1:-1] - 1)] if len(at) > 2 else cut  # a last line break opens no line
    cut = cut[cut != len(raw) - 1]
    begin = np.sort(np.concatenate([at[:-1], cut + 1]), kind="stable")
    first = np.searchsorted(begin, at[:-1], "left")
    same = np.searchsorted(at[:-1], at[:-1], "left")  # empty documents begin where the next one does
    first = first + (np.arange(len(at) - 1) - same)
    end = np.concatenate([begin[1:], [len(raw)]])
    return begin, end, first


def _sums(x: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
    return (total[end] - total[begin]).astype(np.float64)


def line_features(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line (own ones), its length in bytes (1 at least), each document's first line."""
    begin, end, first = _lines(raw, at)
    n = np.maximum(end - begin, 1).astype(np.float64)
    kind = _KIND[raw].astype(np.uint8)
    count = {k: _sums((kind & bit) > 0, begin, end) for k, bit in (("shout", 1), ("letter", 2), ("digit", 4), ("space", 8), ("sign", 16))}
    stops = _sums(_STOP[raw], begin, end)
    # Words: runs of bytes that are not white space, never across lines or documents.
    solid = (kind & 8) == 0
    opens = solid.copy()
    opens[1:] &= ~solid[:-1]
    edge = begin[begin < len(raw)]
    opens[edge] |= solid[edge]
    w = np.flatnonzero(opens)
    word_of_line = np.searchsorted(w, begin, "left"), np.searchsorted(w, end, "left")
    words = np.maximum(word_of_line[1] - word_of_line[0], 1).astype(np.float64)
    line_of = np.repeat(np.arange(len(begin)), word_of_line[1] - word_of_line[0])
    if len(w):
        head = int(w[0])
        word, size = run_hashes(raw[head:], solid[head:], w - head)
        signs = np.add.reduceat((kind[head:] & 16) > 0, w - head, dtype=np.int32)
        again = np.zeros(len(w), bool)
        again[1:] = (word[1:] == word[:-1]) & (line_of[1:] == line_of[:-1])
        # Words that the line has already had: sorted by line and word.
        order = np.lexsort((word, line_of))
        seen = np.zeros(len(w), bool)
        seen[order[1:]] = (word[order[1:]] == word[order[:-1]]) & (line_of[order[1:]] == line_of[order[:-1]])
        per_line = lambda x: np.bincount(line_of, x, len(begin))
        long, short, signed, repeated = per_line(size > 12), per_line(size <= 3), per_line(signs > 0), per_line(again)
        line_hash = np.zeros(len(begin), np.uint64)
        np.add.at(line_hash, line_of, word * (np.arange(len(w)).astype(np.uint64) - word_of_line[0][line_of].astype(np.uint64) + np.uint64(1)))
        fresh = 1 - per_line(seen) / words
    else:
        long = short = signed = repeated = np.zeros(len(begin))
        line_hash, fresh = np.zeros(len(begin), np.uint64), np.ones(len(begin))
    doc = np.searchsorted(first, np.arange(len(begin)), "right") - 1
    order = np.lexsort((line_hash, doc))
    twin = np.zeros(len(begin), bool)
    if len(order) > 1:
        twin[order[1:]] = (line_hash[order[1:]] == line_hash[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    letters = np.maximum(count["letter"], 1)
    x = np.stack(
        [count["shout"] / letters, count["sign"] / n, count["digit"] / n, stops / n, count["space"] / n, long / words, short / words, signed / words, repeated / words + (1 - fresh), twin, np.log1p(n) / 5, count["letter"] == 0],
        axis=1,
    )
    return x.astype(np.float64), n, first


def with_neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Own features, those of the lines before and after (zeros at a document's ends), and a constant."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[first] = 0
    after[np.concatenate([first[1:], [len(x)]]) - 1] = 0
    return np.concatenate([x, before, after, np.ones((len(x), 1))], axis=1)


def _grid(first: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Documents by falling number of lines; how many still run at each step."""
    sizes = np.diff(np.concatenate([first, [total]]))
    order = np.argsort(-sizes, kind="stable")
    falling = sizes[order]
    alive = np.searchsorted(-falling, -np.arange(1, int(falling[0]) + 1 if len(falling) else 1), "right")
    return order, falling, alive.tolist()


def forward_backward(unary: np.ndarray, chain: np.ndarray, first: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Each line's probability of being good, expected transitions (2 x 2), and the sum of log Z. ``unary``: score of good against bad.

    ``weight``: of each document, in the transitions and the sum.
    """
    total = len(unary)
    weight = np.ones(len(first)) if weight is None else weight
    order, _, alive = _grid(first, total)
    start = first[order]
    psi = np.stack([np.zeros(total), unary], axis=1)
    top = psi.max(axis=1, keepdims=True)
    e, t = np.exp(psi - top), np.exp(chain)
    alpha, scale = np.zeros((total, 2)), np.zeros(total)
    for step, n in enumerate(alive):
        i = start[:n] + step
        a = e[i] if step == 0 else (alpha[i - 1] @ t) * e[i]
        s = a.sum(axis=1)
        alpha[i], scale[i] = a / s[:, None], s
    beta = np.ones((total, 2))
    expected = np.zeros((2, 2))
    for step in range(len(alive) - 2, -1, -1):
        n = alive[step + 1]
        i = start[:n] + step
        ahead = e[i + 1] * beta[i + 1] / scale[i + 1][:, None]
        beta[i] = ahead @ t.T
        expected += (alpha[i] * weight[order[:n]][:, None]).T @ ahead * t
    good = alpha * beta
    lines = np.repeat(weight, np.diff(np.append(first, total)))
    return good[:, 1] / good.sum(axis=1), expected, float((lines * (np.log(scale) + top[:, 0])).sum())


@dataclass
class LineField:
    """A fitted field: line weights, transition scores, and each feature's spread."""

    weights: np.ndarray
    chain: np.ndarray
    spread: np.ndarray
    prior: float | None = None

    def scores(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        if len(at) < 2:
            return np.zeros(0)
        if self.prior is not None:
            return np.full(len(at) - 1, self.prior)
        x, n, first = line_features(raw, at)
        good, _, _ = forward_backward(with_neighbours(x, first) / self.spread @ self.weights, self.chain, first)
        return np.clip(np.add.reduceat(good * n, first) / np.add.reduceat(n, first), 0, 1)


def fit_field(x: np.ndarray, first: np.ndarray, label: np.ndarray, *, ridge: float = 1e-3, steps: int = 150) -> LineField:
    """Maximises the conditional likelihood of the lines' labels (a document's label on each line) by adaptive gradient steps.

    The one objective is the mean over documents of a document's log-likelihood per line, in lines and transitions
    alike, less ``ridge`` / 2 times the squared weights and 0.15 times the squared transition scores.
    """
    z = with_neighbours(x, first)
    spread = np.maximum(np.sqrt((z**2).mean(axis=0)), 1e-3)
    z = z / spread
    sizes = np.diff(np.concatenate([first, [len(x)]]))
    y = np.repeat(label, sizes).astype(np.float64)
    weight = 1 / sizes / len(sizes)
    share = np.repeat(weight, sizes)
    theta = np.zeros(z.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    seen = np.diag(np.bincount(label.astype(np.int64), weight * (sizes - 1), 2))
    for step in range(1, steps + 1):
        w, chain = theta[:-4], theta[-4:].reshape(2, 2)
        p, expected, _ = forward_backward(z @ w, chain, first, weight)
        grad = np.concatenate([z.T @ ((y - p) * share) - ridge * w, (seen - expected - 0.3 * chain).ravel()])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return LineField(theta[:-4], theta[-4:].reshape(2, 2), spread)


_LINES = "doc long, label int, features array<array<double>>"


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_docs: int = FIT_DOCS) -> LineField:
    """Fits on at most ``fit_docs`` labelled documents of each class that are not held out. Line features are made on the executors."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).filter(F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & ~held_out("_id"))
    known = known.groupBy("_id").agg(F.min("_y").alias("_y"))
    counts = {r[0]: r[1] for r in known.groupBy("_y").count().collect()}
    if len(counts) < 2:
        return LineField(np.zeros(0), np.zeros((2, 2)), np.zeros(0), prior=float(counts.get(1, 0) > 0 or not counts))
    chosen = None
    for y in (0, 1):
        some = known.filter(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(fit_docs)
        chosen = some if chosen is None else chosen.unionByName(some)
    sample = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "_id")
    sample = sample.groupBy("_id", "_y").agg(F.min("text").alias("text")).select("_y", "text")  # one row of a repeated id

    def features(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for i in range(len(batch)):
                raw, at = flat_bytes(batch.column(1).slice(i, 1))
                x, _, _ = line_features(raw, at)
                yield pa.RecordBatch.from_arrays([pa.array([int(batch.column(0)[i].as_py())], pa.int32()), pa.array([x.ravel().tolist()], pa.list_(pa.float64()))], ["y", "x"])

    rows = sample.mapInArrow(features, "y int, x array<double>").collect()
    rows.sort(key=lambda r: (r[0], r[1]))
    xs = [np.array(r[1]).reshape(-1, len(OWN)) for r in rows]
    if len({r[0] for r in rows}) < 2:
        return LineField(np.zeros(0), np.zeros((2, 2)), np.zeros(0), prior=1.0 if any(r[0] for r in rows) or not rows else 0.0)
    first = np.concatenate([[0], np.cumsum([len(x) for x in xs])])[:-1]
    return fit_field(np.concatenate(xs), first, np.array([r[0] for r in rows]))


def _score_batches(sent, column: str):
    def run(batches):
        field = sent.value
        for batch in batches:
            raw, at = flat_bytes(batch.column(batch.schema.get_field_index(column)))
            got = [field.scores(raw[at[a] : at[b]], at[a : b + 1] - at[a]) for a, b in portions(np.diff(at), PORTION)]
            yield batch, np.concatenate(got) if got else np.zeros(0)

    return run


def score(docs: DataFrame, field: LineField, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the score of every document, in one narrow pass."""
    sent = docs.sparkSession.sparkContext.broadcast(field)
    table = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    each = _score_batches(sent, "text")

    def run(batches):
        for batch, s in each(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], ["id", "score"])

    return table.mapInArrow(run, f"id {table.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, field: LineField, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those that score below ``threshold``; all columns as they were."""
    each = _score_batches(docs.sparkSession.sparkContext.broadcast(field), text_col)

    def run(batches):
        for batch, s in each(batches):
            yield batch.filter(pa.array(s >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op2_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    field = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, field).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
