"""Embedding near-dedup by PCA-ordered tiled comparison.

Equal vectors are one class first, with a count. The classes' unit vectors are
rotated onto the principal axes of their second moments (a sum over all of them),
strongest axis first; a rotation keeps every product. Classes that lie close on
the leading axes are packed into blocks of about ``BLOCK`` rows, and every two
blocks make a tile, unless the extents of the two blocks on the leading axes show
that no pair of them can reach the threshold.

A tile accumulates products axis by axis, ``STEP`` axes at a time. What is left of
a product is at most the product of the two suffix norms, so a pair stops as soon
as its cosine cannot reach the threshold any more, and is accepted as soon as it
cannot miss it. Sums are float32 with a safe margin; a pair that ends within the
margin is decided in double precision from the original vectors.

A tile returns no pairs: it returns how many vectors each of its rows is linked
with, and a forest that connects what its links connect. So a group of near copies,
however large, gives rows in proportion to its rows and blocks, not to its pairs. Counts are added
up, forests go to the connected components. Nothing is capped or skipped.

Vectors that are null, empty, all zero or hold null or non-finite components link
with nothing; nor do vectors of different lengths. Repeated rows and equal vectors
link with each other. Rows with one id stay rows of their own; a null id is never
the smallest unless all of its component are null. Components of any finite size:
vectors are scaled before norms are taken. Empty tables give an empty result; other
columns are not read, so names cannot clash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dnsloom.llm.ann import usable
from dnsloom.llm.common import hot_join, scratch, settle, spread
from dnsloom.llm.graph import components

#: Rows of a block, rows of it compared at once, axes added at once, blocks at most (more rows make larger blocks).
BLOCK, STRIP, STEP, MOST_BLOCKS = 4096, 512, 16, 1 << 16
#: Components that are rotated together; longer vectors are rotated by slices.
SLICE = 256
#: Leading axes that place a class, each in one of four ranges.
PLACED = 8
#: Tiles whose list is broadcast, and pairs gathered at once in a tile.
LISTED, GATHERED = 500_000, 1 << 17
TILE = "kind int, u long, v long"


class Rotation:
    """Principal axes of unit vectors of one length, strongest first; ``moments``: a square matrix of second moments for each slice."""

    def __init__(self, moments: list[np.ndarray]):
        values, self.axes = [], []
        for m in moments:
            val, vec = np.linalg.eigh(m)
            values.append(val)
            self.axes.append(vec)
        values = np.concatenate(values)
        self.order = np.argsort(-values, kind="stable")
        self.spread = np.sqrt(np.maximum(values[self.order], 1e-30))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        turned = [x[:, i * SLICE : (i + 1) * SLICE] @ a for i, a in enumerate(self.axes)]
        return np.concatenate(turned, axis=1)[:, self.order]

    def place(self, turned: np.ndarray) -> np.ndarray:
        """A number below 4 ** PLACED: near rows have near numbers (ranges of the leading axes, bits interleaved)."""
        some = turned[:, :PLACED]
        range_ = np.searchsorted([-0.67, 0.0, 0.67], (some / self.spread[: some.shape[1]]).ravel()).reshape(some.shape)
        out = np.zeros(len(some), np.int64)
        for bit in (1, 0):
            for j in range(some.shape[1]):
                out = out * 2 + ((range_[:, j] >> bit) & 1)
        return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _grid(column: pa.Array) -> np.ndarray:
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), int(sizes[0]) if len(sizes) else 0)


def _moments(batches):
    """Sums of products of components within each slice: slice, row, sums."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        if batch.num_rows:
            x = unit(_grid(batch.column("v")))
            for s, at in enumerate(range(0, x.shape[1], SLICE)):
                part = x[:, at : at + SLICE]
                total[s] = total.get(s, 0) + part.T @ part
    for s, m in total.items():
        i, j = np.divmod(np.arange(m.size), m.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, s, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(m.ravel())], ["s", "i", "j", "x"])


def fit(classes: DataFrame, d: int) -> Rotation:
    """The rotation for vectors of ``d`` components; sums run over all rows, and what comes to the driver goes by ``d`` alone."""
    rows = classes.select("v").mapInArrow(_moments, "s int, i int, j int, x double").groupBy("s", "i", "j").agg(F.sum("x").alias("x")).collect()
    moments = [np.zeros((min(SLICE, d - at),) * 2) for at in range(0, d, SLICE)]
    for s, i, j, x in rows:
        moments[s][i, j] = x
    return Rotation(moments)


def _placed(sent):
    def run(batches):
        turn = sent.value
        for batch in batches:
            if batch.num_rows:
                raw = _grid(batch.column("v"))
                yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("n"), pa.array(turn.place(turn(unit(raw)))), pa.array([r.tobytes() for r in raw], pa.binary())], ["node", "n", "place", "raw"])

    return run


class Block:
    """A block's rows ready for tiles."""

    def __init__(self, nodes: bytes, counts: bytes, raw: bytes, kind: str, turn: Rotation):
        self.nodes, self.counts = np.frombuffer(nodes, np.int64), np.frombuffer(counts, np.int64)
        self.unit = unit(np.frombuffer(raw, kind).reshape(len(self.nodes), -1))
        turned = turn(self.unit)
        self.x = turned.astype(np.float32)
        #: Norm of what is left from each multiple of STEP on.
        ends = np.arange(STEP, turned.shape[1] + STEP, STEP)
        square = np.cumsum((turned * turned)[:, ::-1], axis=1)[:, ::-1]
        self.left = np.stack([np.sqrt(np.maximum(square[:, e], 0)) if e < turned.shape[1] else np.zeros(len(turned)) for e in ends], axis=1).astype(np.float32)


def linked(a: Block, b: Block, threshold: float, same: bool):
    """Rows of ``a`` and ``b`` with a cosine of ``threshold`` or more, a strip of ``a`` at a time. ``same``: one block, each pair once."""
    d = a.x.shape[1]
    margin = 1e-6 * (d + 8)
    stages = a.left.shape[1]
    for at in range(0, len(a.x), STRIP):
        ax, al = a.x[at : at + STRIP], a.left[at : at + STRIP]
        total = ax[:, :STEP] @ b.x[:, :STEP].T
        open_ = total >= (threshold - margin) - al[:, :1] * b.left[:, 0][None, :]
        if same:
            open_ &= np.arange(len(b.x))[None, :] > np.arange(at, at + len(ax))[:, None]
        stage = 1
        # While many pairs are open, all products go on; after that, only the open ones.
        while stage < stages and np.count_nonzero(open_) > open_.size // 16:
            total += ax[:, stage * STEP : (stage + 1) * STEP] @ b.x[:, stage * STEP : (stage + 1) * STEP].T
            open_ &= total >= (threshold - margin) - al[:, stage : stage + 1] * b.left[:, stage][None, :]
            stage += 1
        rows_all, cols_all = np.nonzero(open_)
        for g in range(0, len(rows_all), GATHERED):
            rows, cols = rows_all[g : g + GATHERED], cols_all[g : g + GATHERED]
            sums, yes = total[rows, cols], []
            for k in range(stage, stages + 1):
                rest = al[rows, k - 1] * b.left[cols, k - 1]
                sure = sums - rest >= threshold + margin
                yes.append((rows[sure], cols[sure]))
                go = ~sure & (sums + rest >= threshold - margin)
                rows, cols, sums = rows[go], cols[go], sums[go]
                if k < stages and len(rows):
                    sums = sums + np.einsum("ij,ij->i", ax[rows, k * STEP : (k + 1) * STEP], b.x[cols, k * STEP : (k + 1) * STEP])
            exact = np.einsum("ij,ij->i", a.unit[at + rows], b.unit[cols]) >= threshold
            yes.append((rows[exact], cols[exact]))
            yield at + np.concatenate([r for r, _ in yes]), np.concatenate([c for _, c in yes])


def hook(head: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """``head`` (each node's representative) with the nodes ``u`` and ``v`` joined pairwise."""
    while True:
        a, b = head[u], head[v]
        apart = a != b
        if not apart.any():
            return head
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(head, np.maximum(a, b), np.minimum(a, b))
        while True:
            above = head[head]
            if (above == head).all():
                break
            head = above


def tile(a: Block, b: Block, threshold: float, same: bool) -> pd.DataFrame:
    """kind 0: a node and the vectors of this tile it is linked with; kind 1: an edge of a forest of the links."""
    nodes = a.nodes if same else np.concatenate([a.nodes, b.nodes])
    counts = a.counts if same else np.concatenate([a.counts, b.counts])
    shift, n = 0 if same else len(a.nodes), np.zeros(len(nodes), np.int64)
    head = np.arange(len(nodes))
    for rows, cols in linked(a, b, threshold, same):
        cols = cols + shift
        np.add.at(n, rows, counts[cols])
        np.add.at(n, cols, counts[rows])
        head = hook(head, rows, cols)
    some, lower = np.flatnonzero(n), np.flatnonzero(head != np.arange(len(nodes)))
    kind = np.repeat(np.array([0, 1], np.int32), [len(some), len(lower)])
    return pd.DataFrame({"kind": kind, "u": np.concatenate([nodes[some], nodes[lower]]), "v": np.concatenate([n[some], nodes[head[lower]]])})


def _pack(sent):
    """One row for the rows of a block: nodes, counts and vectors as bytes, their extents on the leading axes and their largest rest."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        turn, kind = sent.value
        raw = b"".join(f["raw"])
        turned = turn(unit(np.frombuffer(raw, kind).reshape(len(f), -1)))
        lead, rest = turned[:, :STEP], np.sqrt((turned[:, STEP:] ** 2).sum(axis=1)).max()
        return pd.DataFrame({"block": [f["block"].iloc[0]], "nodes": [f["node"].to_numpy(np.int64).tobytes()], "counts": [f["n"].to_numpy(np.int64).tobytes()], "raw": [raw], "low": [lead.min(axis=0).tolist()], "high": [lead.max(axis=0).tolist()], "rest": [float(rest)]})

    return run


def _tiles(sent, threshold: float):
    """Pairs of blocks that may hold links: a, b with a <= b."""

    def run(frames):
        block, low, high, rest = sent.value
        for f in frames:
            for k in f["id"].tolist():
                ends = [low[k] * low[k:], low[k] * high[k:], high[k] * low[k:], high[k] * high[k:]]
                most = np.maximum.reduce(ends).sum(axis=1) + rest[k] * rest[k:]
                near = k + np.flatnonzero(most >= threshold - 1e-6)
                yield pd.DataFrame({"a": np.full(len(near), block[k]), "b": block[near]})

    return run


def _compare(classes: DataFrame, d: int, kind: str, threshold: float, block: int) -> DataFrame:
    """What the tiles of all classes of ``d`` components found, as ``TILE``; ``kind``: how components are stored."""
    spark, sc = classes.sparkSession, classes.sparkSession.sparkContext
    turn = sc.broadcast(fit(classes, d))
    placed = settle(classes.select("node", "n", "v").mapInArrow(_placed(turn), "node long, n long, place long, raw binary"), "placed")
    # Places are at most 4 ** PLACED; a crowded one is dealt to several blocks, sparse neighbours share one.
    filled = sorted((r[0], r[1]) for r in placed.groupBy("place").count().collect())
    rows = sum(n for _, n in filled)
    # What moves is rows * rows / block: blocks grow with the table while there are tiles enough to share out.
    block = max(min(max(block, rows // 64), 8 * block), rows // MOST_BLOCKS)
    begin, share, now, room = {}, {}, -1, 0
    for place, n in filled:
        if n > room:
            now, room = now + 1, block
        begin[place], share[place] = now, spread(n, block)
        now, room = now + share[place] - 1, room - n if share[place] == 1 else 0
    table = spark.createDataFrame([(p, b, share[p]) for p, b in begin.items()], "place long, first int, parts int")
    dealt = placed.join(F.broadcast(table), "place").withColumn("block", (F.col("first") + F.pmod(F.xxhash64("node"), F.col("parts"))).cast("int"))
    sent = sc.broadcast((turn.value, kind))
    blocks = settle(dealt.select("block", "node", "n", "raw").groupBy("block").applyInPandas(_pack(sent), "block int, nodes binary, counts binary, raw binary, low array<float>, high array<float>, rest float"), "blocks")
    extents = sorted(map(tuple, blocks.select("block", "low", "high", "rest").collect()))  # MOST_BLOCKS rows at most, but for dealt places
    if not extents:
        return spark.createDataFrame([], TILE)
    bounds = tuple(np.array([e[i] for e in extents], t) for i, t in enumerate((np.int32, np.float64, np.float64, np.float64)))
    listed = sc.broadcast(bounds)
    numbers = spark.range(0, len(extents), 1, min(len(extents), 512))
    tiles = settle(numbers.mapInPandas(_tiles(listed, threshold), "a int, b int"), "tiles")
    hint = F.broadcast if tiles.count() <= LISTED else (lambda t: t)
    data = blocks.select("block", "nodes", "counts", "raw")
    left = data.join(hint(tiles), F.col("block") == F.col("a")).drop("block")
    second = tiles.filter("a <> b").select(F.col("a").alias("ra"), F.col("b").alias("rb"))
    right = blocks.select(F.col("block").alias("rb"), *[F.col(c).alias(f"r_{c}") for c in ("nodes", "counts", "raw")]).join(hint(second), "rb")

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        rotation, stored = sent.value
        one = lambda f, p: Block(f[f"{p}nodes"].iloc[0], f[f"{p}counts"].iloc[0], f[f"{p}raw"].iloc[0], stored, rotation)
        a = one(x, "")
        return tile(a, one(y, "r_") if len(y) else a, threshold, not len(y))

    found = settle(left.groupBy("a", "b").cogroup(right.groupBy("ra", "rb")).applyInPandas(run, TILE), "found")
    for b in (turn, sent, listed):
        b.destroy()
    return found


def near_groups(vectors: DataFrame, threshold: float = 0.95, *, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept: per row, how many other rows have a cosine of ``threshold`` or more (above 0), and the smallest id
    reachable by such links. Call it within ``scratch``, or delete its tables yourself."""
    inner = vectors.schema[vector_col].dataType.elementType.simpleString()
    kind = "float32" if inner == "float" else "float64"
    v = F.col(vector_col).cast("array<float>" if kind == "float32" else "array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(usable(v), v).alias("v"))
    sound = rows.filter("v is not null")
    classes = sound.groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    classes = settle(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    found = None
    for (d,) in sorted(map(tuple, classes.select(F.size("v")).distinct().collect())):  # a row per length of vectors
        some = _compare(classes.filter(F.size("v") == d), d, kind, threshold, block)
        found = some if found is None else found.unionByName(some)
    if found is not None:
        links = found.filter("kind = 0").groupBy(F.col("u").alias("node")).agg(F.sum("v").alias("links"))
        reach = components(found.filter("kind = 1").select("u", "v"))
        named = classes.join(links, "node", "left").join(reach, "node", "left").withColumn("root", F.coalesce("root", "node"))
        named = settle(named.select("v", "id", "n", "root", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "named")
        lowest = settle(named.groupBy("root").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("_n")), "lowest")
        of_class = settle(hot_join(named.select("v", "n", "n_links", "root"), lowest, ["root"]).select("v", F.col("n").alias("_n"), "n_links", "component_id"), "of_class")
        answered = hot_join(sound, of_class, ["v"]).select("id", "n_links", "component_id")
    else:
        answered = sound.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    alone = rows.filter("v is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    every = answered.unionByName(alone)
    return every.select(F.col("id").alias("vec_id"), F.col("n_links").cast("long").alias("n_links"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op13_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    with scratch(spark):
        return settle(near_groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")), "near_groups", keep=True)


OP13_SQL = """
WITH RECURSIVE r AS (SELECT row_number() OVER () AS rid, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
v AS (SELECT * FROM r WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT a.rid AS x, b.rid AS y FROM v a JOIN v b ON a.rid <> b.rid AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
w AS (SELECT rid, rid AS at FROM r UNION SELECT w.rid, p.y FROM w JOIN p ON p.x = w.at),
m AS (SELECT w.rid, min(r.vec_id) AS component_id FROM w JOIN r ON r.rid = w.at GROUP BY w.rid),
n AS (SELECT x AS rid, count(*) AS n FROM p GROUP BY x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM r JOIN m USING (rid) LEFT JOIN n USING (rid)
"""
